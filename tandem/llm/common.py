"""What the operators share: written intermediates, text batches, bounded joins."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder, written  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_LIMIT, SPARKS_OWN, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "4m"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of 4 MB where the session has Spark's default: whole texts are long, and both the
    JVM's buffers and the Python workers hold several batches for each running task."""
    if spark.conf.get(BATCH_LIMIT, SPARKS_OWN) == SPARKS_OWN:
        spark.conf.set(BATCH_LIMIT, BATCH_BYTES)


_kept: list = []
_stage: list = [None]


def kept_for_a_stage(function):
    """A cache of what ``function`` makes, in a Python worker, until the worker begins a task of another stage."""
    cached = lru_cache(maxsize=2)(function)
    _kept.append(cached.cache_clear)
    return cached


def _begin_stage() -> None:
    """Drop what earlier stages kept: workers live on, and memory of one stage must not add to that of the next."""
    context = TaskContext.get()
    if context is None or context.stageId() == _stage[0]:
        return
    if _stage[0] is not None:
        for clear in _kept:
            clear()
        gc.collect()
        with suppress(AttributeError, OSError):  # only glibc has it
            ctypes.CDLL(None).malloc_trim(0)
    _stage[0] = context.stageId()


def mapped(frame: DataFrame, function, schema) -> DataFrame:
    """``frame.mapInArrow`` over batches bounded in bytes."""
    bound_batches(frame.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin_stage()
        return function(batches)

    return frame.mapInArrow(run, schema)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that a worker holds few Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def runs(texts: list[str], limit: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``limit`` characters, one text at least."""
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


class Memo:
    """Packed ids of chunks, in two generations of about ``entries`` each: what is asked for again stays."""

    def __init__(self, entries: int):
        self.entries = entries
        self.young: dict = {}
        self.old: dict = {}

    def lacking(self, chunks: set) -> list:
        """The chunks of neither generation; those of the old one become young."""
        out = []
        for c in chunks.difference(self.young):
            if (ids := self.old.get(c)) is None:
                out.append(c)
            else:
                self.young[c] = ids
        return out

    def age(self, drop: list) -> None:
        """Forget ``drop`` and, when the young generation is full, the old one."""
        for c in drop:
            self.young.pop(c, None)
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}

    def joined(self, chunks: list) -> bytes:
        return b"".join(map(self.young.__getitem__, chunks))


#: Bits of a membership bitmap: 2 ** 26 bits are 8 MB, however many ids it holds.
BITMAP_BITS, BUCKET_BITS = 26, 15


def possible_members(rows: DataFrame, column: str, ids: DataFrame, mark: str = "possible") -> DataFrame:
    """``rows`` with a column ``mark``: false only where ``column`` is certainly not among ``ids`` (one column).

    A hashed bitmap of bounded size is broadcast, so wide rows that no id names need not be
    moved by the exact join that follows. Null ids are not members.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    named = ids.select(place(F.col(ids.columns[0])).alias("p"))
    bits = named.groupBy(F.shiftright("p", BUCKET_BITS).alias("__bitmap_bucket")).agg(F.bitmap_construct_agg(F.col("p") % (1 << BUCKET_BITS)).alias("__bitmap_bits"))
    at = place(F.col(column))
    found = rows.withColumn("__bitmap_bucket", F.shiftright(at, BUCKET_BITS)).join(F.broadcast(bits), "__bitmap_bucket", "left")
    low = (at % (1 << BUCKET_BITS)).cast("int")
    byte = F.conv(F.hex(F.col("__bitmap_bits").substr(F.shiftright(low, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, low % 8) == 1
    return found.withColumn(mark, F.coalesce(bit & F.col(column).isNotNull(), F.lit(False))).drop("__bitmap_bucket", "__bitmap_bits")


#: A key is frequent from this part of all rows on, and from so many rows: there are at most FREQUENT such keys.
FREQUENT, FREQUENT_ROWS = 4096, 1024


def by_key(rows: DataFrame, found: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``found``, which has one row for each key and in ``size`` about how many of ``rows`` have it.

    Frequent keys are at most FREQUENT in number, whatever the input, so their side is
    broadcast and their rows stay where they are; all other keys are joined by a shuffle.
    """
    told = found.agg(F.sum(size).alias("all"), F.max(size).alias("most")).first()
    cut = max(FREQUENT_ROWS, (told["all"] or 0) // FREQUENT)
    if (told["most"] or 0) <= cut:
        return rows.join(found.drop(size), keys, how)
    many = F.broadcast(found.where(F.col(size) > cut).drop(size))
    rest = rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(found.where(F.col(size) <= cut).drop(size), keys, how)
    return rows.join(many, keys).unionByName(rest)
