"""Resampling by seeded hashes, so that results depend neither on partitions nor on the engine.

A draw says how often each cluster is taken, the same for every metric. The index of a slot
is a number of 32 bits cut from the MD5 of seed, draw and four slots together. What a metric
needs of a draw are sums over clusters: while the clusters' values fit a bounded array
(``HELD``, checked), every task gets it and makes whole draws, and a row for each draw is all
that is moved; beyond that, a task writes how often its draws take each cluster as half bytes,
compressed, and these meet the values by blocks of ``PLACES`` clusters: what is moved is about
a quarter of a byte for each draw and cluster, and no task has all values. Signs of flips are
the bits of the MD5 of seed, draw and block, one block for every 128 clusters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import numbered_md5, numbered_words
from ..sources.shared import written
from .ranks import ranked

#: Fixed value: the seed of all draws.
SEED = 20260711

#: Clusters whose signs one digest holds; draws whose sums a task holds at once; slots of one digest.
SIGNS, CHUNK, SLOTS = 128, 20_000, 4
#: Values (clusters times columns) that every task may be given: 32 MB; groups that are columns rather than rows.
HELD, WIDE = 1 << 22, 64
#: Clusters of a block of values; draws whose times are packed together; draws that are summed together; digests that are asked for at once.
PLACES, PACKED, TOGETHER, DIGESTS = 1 << 14, 16, 8, 10**6


def numbered(clusters: DataFrame, cluster: str) -> DataFrame:
    """Clusters with place 0, 1, ... in their own order; no task sorts all names."""
    return ranked(written(clusters.select(cluster).distinct(), "names"), [cluster])


def slot_index(seed: Column, draw: Column, slot: Column, n: int) -> Column:
    """The place that a slot of a draw takes, below n."""
    digest = F.md5(F.concat_ws("|", seed, draw, F.floor(slot / SLOTS).cast("long")))
    return F.conv(F.substring(digest, (slot % SLOTS * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("long") % n


@dataclass(frozen=True)
class Draws:
    """Numbered draws, with replacement, of as many clusters as there are."""

    names: DataFrame
    n: int
    cluster: str
    draws: int
    seed: int
    first: int = 0

    def rows(self) -> DataFrame:
        """(draw, cluster, times): how often each cluster is drawn."""
        n = max(1, self.n)
        slots = self.names.sparkSession.range(self.first * n, (self.first + self.draws) * n).select(F.expr(f"id div {n}").alias("draw"), F.expr(f"id % {n}").alias("slot"))
        index = slot_index(F.lit(self.seed), F.col("draw"), F.col("slot"), n)
        return slots.groupBy("draw", index.alias("place")).agg(F.count(F.lit(1)).alias("times")).join(self.names, "place").select("draw", self.cluster, "times")

    def sums(self, frame: DataFrame, columns: list[str]) -> DataFrame:
        """draw and, for each column of ``frame`` (a row for each cluster at most), the sum of its values times how often they are drawn."""
        number = lambda c: F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(0.0)).alias(c)
        values = frame.select(self.cluster, *map(number, columns))
        spark = frame.sparkSession
        schema = T.StructType([T.StructField("draw", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in columns)])
        draws = spark.range(self.first, self.first + (self.draws if self.n else 0), 1, max(1, min(self.draws // PACKED, 4 * spark.sparkContext.defaultParallelism)))
        placed = self.names.join(values, self.cluster).select("place", *(F.col(f"`{c}`") for c in columns))
        if self.n * len(columns) > HELD:
            times = draws.mapInArrow(_packed(self.n, self.seed), "block int, draws array<long>, times binary")
            blocks = placed.withColumn("block", F.expr(f"CAST(place div {PLACES} AS INT)"))
            parts = times.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(_weighed(columns), schema)
            return parts.groupBy("draw").agg(*(F.sum(F.col(f"`{c}`")).alias(c) for c in columns))
        held = np.zeros((max(1, self.n), len(columns)))
        told = placed.toArrow()
        held[told.column(0).to_numpy()] = np.column_stack([told.column(i + 1).to_numpy() for i in range(len(columns))]) if told.num_rows else 0.0
        return draws.mapInArrow(_summed(spark.sparkContext.broadcast(held), self.n, self.seed, ["draw", *columns]), schema)


def _times(n: int, seed: int, draw: int, kind: type = np.uint8) -> np.ndarray:
    """How often a draw takes each of ``n`` places; a byte each, unless one is taken too often for that."""
    times = np.zeros(n, kind)
    one, whole = kind(1), -(-n // SLOTS)
    for made in range(0, whole, DIGESTS):
        for at, words in numbered_words(f"{seed}|{draw}|", range(made, min(made + DIGESTS, whole))):
            for i, word in enumerate(words):
                slots = word[: -(-(n - i) // SLOTS) - at].byteswap()  # the last digest may have fewer
                if n < 1 << 32:  # what % gives, by operations that numpy does on several at once
                    slots -= slots // np.uint32(n) * np.uint32(n)
                np.add.at(times, slots.astype(np.intp), one)
    return times if kind is not np.uint8 or times.sum(dtype=np.int64) == n else _times(n, seed, draw, np.int64)


def _summed(held, n: int, seed: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                draws = batch.column(0).slice(at, TOGETHER).to_pylist()
                times = np.stack([_times(n, seed, draw) for draw in draws])
                out = sum((times[:, p : p + PLACES].astype(np.float64) @ values[p : p + PLACES] for p in range(0, n, PLACES)), np.zeros((len(draws), values.shape[1])))
                yield pa.record_batch([pa.array(draws, pa.int64()), *(pa.array(c) for c in out.T)], names)

    return run


def _layers(times: np.ndarray) -> Iterator[np.ndarray]:
    """Arrays of half bytes that add up to ``times``: one, unless a place is taken more than 15 times."""
    while times.max() > 15:
        least = np.minimum(times, 15)
        yield least.astype(np.uint8)
        times = times - least
    yield times.astype(np.uint8)


def _packed(n: int, seed: int):
    """Of draws, the times of each block of places: two places a byte, compressed."""
    blocks, half = -(-n // PLACES), PLACES // 2

    def rows(draws: list[int], packed: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, blocks, 64):
            own = range(at, min(at + 64, blocks))
            told = [pa.compress(np.ascontiguousarray(packed[:, b]).tobytes(), codec="zstd", asbytes=True) for b in own]
            yield pa.record_batch([pa.array(own, pa.int32()), pa.array([draws] * len(own), pa.list_(pa.int64())), pa.array(told, pa.binary())], ["block", "draws", "times"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, PACKED):
                draws = batch.column(0).slice(at, PACKED).to_pylist()
                packed = np.empty((len(draws), blocks, half), np.uint8)
                for i, draw in enumerate(draws):
                    for k, layer in enumerate(_layers(_times(n, seed, draw))):
                        layer = np.pad(layer, (0, blocks * PLACES - n)).reshape(blocks, 2, half)
                        layer = layer[:, 0] | layer[:, 1] << 4
                        if k:
                            yield from rows([draw], layer[None])
                        else:
                            packed[i] = layer
                yield from rows(draws, packed)

    return run


def _weighed(columns: list[str]):
    """Of a block, the sums of its values times how often each draw takes them."""
    half = PLACES // 2

    def run(times: pa.Table, values: pa.Table) -> pa.Table:
        held = np.zeros((PLACES, len(columns)))
        if values.num_rows:
            held[values.column("place").to_numpy() % PLACES] = np.column_stack([values.column(c).to_numpy() for c in columns])
        names, sums = [], [np.zeros((0, len(columns)))]
        for draws, told in zip(times.column("draws").to_pylist(), times.column("times"), strict=True):
            packed = np.frombuffer(pa.decompress(told.as_buffer(), len(draws) * half, codec="zstd"), np.uint8).reshape(-1, half)
            sums.append((packed & 15).astype(np.float64) @ held[:half] + (packed >> 4).astype(np.float64) @ held[half:])
            names += draws
        return pa.table([pa.array(names, pa.int64()), *(pa.array(c) for c in np.concatenate(sums).T)], ["draw", *columns])

    return run


class Whole:
    """Every cluster once, as draw -1: what was observed."""

    @staticmethod
    def sums(frame: DataFrame, columns: list[str]) -> DataFrame:
        return frame.agg(*(F.sum(F.col(f"`{c}`").cast("double")).alias(c) for c in columns)).select(F.lit(-1).cast("long").alias("draw"), "*")


def multiplicities(clusters: DataFrame, cluster: str, draws: int, seed: int = SEED, first: int = 0, names: DataFrame | None = None) -> Draws:
    """``draws`` draws of the clusters of a table, from number ``first`` on."""
    names = numbered(clusters, cluster) if names is None else names
    return Draws(names, names.count(), cluster, draws, seed, first)


def redrawn(clusters: DataFrame, cluster: str, draws: int, valid: Callable[[Draws], DataFrame], most_rejected: int, seed: int = SEED) -> DataFrame:
    """The first ``draws`` valid draws, in order of their numbers; rejected ones are made up for by further draws.

    ``valid`` takes draws and returns a row for each draw (column ``draw``) that is not
    to be rejected. Draws are numbered on, so the same ones are accepted however many are made
    at a time. More than ``most_rejected`` rejections before the last accepted draw are an error.
    """
    names = numbered(clusters, cluster)
    found: DataFrame | None = None
    made = accepted = 0
    more = draws
    while True:
        part = written(valid(multiplicities(clusters, cluster, more, seed, made, names)), "draws")
        found = part if found is None else found.unionByName(part)
        accepted, made = accepted + part.count(), made + more
        if accepted < draws and made - accepted > most_rejected:
            raise ValueError(f"{made - accepted} of {made} draws were rejected")
        if accepted >= draws:
            break
        # as many as the share accepted so far suggests, and no more than may still be rejected
        more = min(max(1024, (draws - accepted) * made // max(1, accepted)), most_rejected + draws - made + 1)
    kept = found.orderBy("draw").limit(draws)
    last = kept.agg(F.max("draw")).first()[0]
    if last is not None and last + 1 - draws > most_rejected:
        raise ValueError(f"{last + 1 - draws} of {last + 1} draws were rejected")
    return kept


def bootstrap_interval(effects: DataFrame, cluster: str, times: Draws, by: tuple[str, ...] = (), value: str = "effect", low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of the balanced mean; metrics (``by``) share the drawn clusters.

    A metric that lacks some clusters uses those it has; draws without any are left out and
    ``valid_draws`` says how many remain. Up to WIDE metrics are columns of one sum.
    """
    rows = effects.where(F.col(value).isNotNull())
    groups = rows.select(*by).distinct().limit(WIDE + 1).collect() if by else [()]
    if len(groups) > WIDE:
        each = times.rows().join(rows, cluster).groupBy("draw", *by).agg((F.sum(F.col("times") * F.col(value)) / F.sum("times")).alias("mean"))
    else:
        of = lambda g: reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.lit(v)) for c, v in zip(by, g, strict=True)), F.lit(True))
        wide = rows.groupBy(cluster).agg(*(f.alias(n) for i, g in enumerate(groups) for n, f in ((f"v{i}", F.sum(F.when(of(g), F.col(value)))), (f"w{i}", F.count_if(of(g))))))
        drawn = times.sums(wide, [f"{x}{i}" for i in range(len(groups)) for x in "vw"]) if groups else None
        if drawn is None:
            return rows.groupBy(*by).agg(F.first(value).alias("lower"), F.first(value).alias("upper"), F.count(F.lit(1)).alias("valid_draws"))
        kinds = dict(rows.dtypes)
        long = F.explode(F.array(*(F.struct(*(F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(by, g, strict=True)), F.try_divide(F.col(f"v{i}"), F.col(f"w{i}")).alias("mean")) for i, g in enumerate(groups))))
        each = drawn.select("draw", long.alias("x")).select("draw", "x.*").where("mean IS NOT NULL")
    return each.groupBy(*by).agg(F.percentile("mean", F.lit(low)).alias("lower"), F.percentile("mean", F.lit(high)).alias("upper"), F.count(F.lit(1)).alias("valid_draws"))


def class_sums(counts: DataFrame, cluster: str, gold: str, columns: list[str], times: Draws) -> DataFrame:
    """draw, gold and the drawn sums of count columns by class; classes that a draw lacks have no row."""
    classes = [r[0] for r in counts.select(gold).distinct().limit(WIDE + 1).collect()]
    if len(classes) > WIDE:
        raise ValueError(f"more than {WIDE} classes")
    wide = counts.groupBy(cluster).agg(*(F.sum(F.when(F.col(gold).eqNullSafe(F.lit(g)), F.col(c))).alias(f"{c}_{i}") for i, g in enumerate(classes) for c in columns))
    drawn = times.sums(wide, [f"{c}_{i}" for i in range(len(classes)) for c in columns])
    each = F.explode(F.array(*(F.struct(F.lit(g).alias(gold), *(F.col(f"{c}_{i}").alias(c) for c in columns)) for i, g in enumerate(classes))))
    return drawn.select("draw", each.alias("x")).select("draw", "x.*").where(F.col(columns[0]) > 0)


def balanced_accuracy_bootstrap(rows: DataFrame, cluster: str, gold: str, left: str, right: str, times: Draws, labels: int) -> DataFrame:
    """Interval of the difference of balanced accuracies over resampled cluster counts.

    Draws in which a class is missing are rejected.
    """
    counts = rows.groupBy(cluster, gold).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(left) == F.col(gold)).alias("l"), F.count_if(F.col(right) == F.col(gold)).alias("r"))
    drawn = class_sums(written(counts, "counts"), cluster, gold, ["n", "l", "r"], times)
    each = drawn.groupBy("draw").agg(F.avg((F.col("r") - F.col("l")) / F.col("n")).alias("difference"), F.count(F.lit(1)).alias("classes")).where(F.col("classes") == labels)
    return each.agg(F.percentile("difference", F.lit(0.025)).alias("lower"), F.percentile("difference", F.lit(0.975)).alias("upper"), F.count(F.lit(1)).alias("valid_draws"))


#: The bits of every byte, the highest first.
BITS_OF = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)


def _flipped(draws: range, block: int, effects: np.ndarray, seed: int | None) -> np.ndarray:
    """The signed sums (draw, column) of a block's effects (place, column); without a seed the signs are the bits of the draw, so that all flips come."""
    if seed is None:
        bits = (np.arange(draws.start, draws.stop)[:, None] >> np.arange(SIGNS).clip(max=62)[None, :]) & 1
        return (1.0 - 2.0 * bits) @ effects
    digests = numbered_md5(f"{seed}|", draws, f"|{block}")
    # a byte of a digest decides eight signs: their sums for each of its values are made once
    eights = effects.reshape(-1, 8, effects.shape[1])
    sums = eights.sum(axis=1)[:, None] - 2.0 * np.einsum("vi,bic->bvc", BITS_OF, eights)
    out = np.zeros((len(draws), effects.shape[1]))
    for i in range(len(eights)):
        out += sums[i].take(digests[:, i], axis=0)
    return out


def _partial_sums(draws: int, seed: int | None, columns: int):
    """Of all clusters of a task the signed sums of each column, as one array for each CHUNK of draws."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            values = np.column_stack([c.fill_null(0.0).to_numpy(zero_copy_only=False) for c in batch.columns[1:]])
            for place, x in zip(batch.column(0).to_pylist(), values, strict=True):
                blocks.setdefault(place // SIGNS, np.zeros((SIGNS, columns)))[place % SIGNS] = x
        for at in range(0, draws if blocks else 0, CHUNK):
            chunk = range(at, min(at + CHUNK, draws))
            sums = np.zeros((len(chunk), columns))
            for block, effects in blocks.items():
                sums += _flipped(chunk, block, effects, seed)
            yield pa.record_batch([pa.array([at // CHUNK] * columns, pa.int32()), pa.array(range(columns), pa.int32()), pa.array(list(sums.T), pa.list_(pa.float64()))], ["chunk", "of", "sums"])

    return run


def _extreme(observed: list[float]):
    """How many summed draws of a chunk and column are as far from zero as what was observed."""

    def run(chunk: pa.Table) -> pa.Table:
        total = np.zeros(0)
        for part in chunk.column("sums").iterchunks():
            for row in range(len(part)):
                values = part[row].values.to_numpy()
                total = values.copy() if not len(total) else total + values
        of = chunk.column("of")[0].as_py()
        return pa.table([pa.array([of], pa.int32()), pa.array([int((np.abs(total) >= observed[of] - 1e-9).sum())], pa.int64()), pa.array([len(total)], pa.int64())], ["of", "k", "draws"])

    return run


def sign_flips(effects: DataFrame, cluster: str, draws: int, values: list[str], seed: int = SEED, exact_up_to: int = 20) -> DataFrame:
    """(of, p, draws, clusters): two-sided sign-flip tests of the means of several columns, whose number ``of`` is, under the same flips.

    All flips for few clusters, (k + 1) / (draws + 1) otherwise. A task sums its clusters for
    every draw into arrays, which are added up by chunks of draws: what is moved is a number for
    each draw, column and task, never a row for each draw and cluster.
    """
    names = [f"x{i}" for i in range(len(values))]
    each = effects.select(cluster, *(F.col(v).cast("double").alias(x) for v, x in zip(values, names, strict=True)))
    places = written(ranked(written(each, "flipped"), [cluster]).select("place", *names), "effects")
    told = places.agg(F.count(F.lit(1)).alias("n"), *(F.coalesce(F.abs(F.sum(x)), F.lit(0.0)).alias(x) for x in names)).first()
    exact = told.n <= exact_up_to
    made = 2**told.n if exact else draws
    tasks = max(1, min(-(-told.n // SIGNS), 4 * places.sparkSession.sparkContext.defaultParallelism))
    sums = places.repartition(tasks, F.expr(f"place div {SIGNS}")).mapInArrow(_partial_sums(made, None if exact else seed, len(names)), "chunk int, of int, sums array<double>")
    counts = sums.groupBy("chunk", "of").applyInArrow(_extreme([told[x] for x in names]), "of int, k long, draws long").groupBy("of").agg(F.sum("k").alias("k"), F.sum("draws").alias("draws"))
    every = effects.sparkSession.range(len(names)).select(F.col("id").cast("int").alias("of"))  # columns without clusters, too
    counts = every.join(counts, "of", "left").select("of", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("draws", F.lit(0)).alias("draws"))
    p = F.try_divide(F.col("k"), F.col("draws")) if exact else (F.col("k") + 1) / (F.col("draws") + 1)
    return counts.select("of", p.alias("p"), "draws", F.lit(told.n).cast("long").alias("clusters"))


def sign_flip(effects: DataFrame, cluster: str, draws: int, value: str = "effect", seed: int = SEED, exact_up_to: int = 20) -> DataFrame:
    """The sign-flip test of one mean: a row of p, draws and clusters."""
    return sign_flips(effects, cluster, draws, [value], seed, exact_up_to).drop("of")


def condition_swaps(rows: DataFrame, cluster: str, gold: str, pairs: list[tuple[str, str]], draws: int, seed: int = SEED) -> DataFrame:
    """(of, p, draws, clusters, difference): permutation tests of differences of balanced accuracies that swap conditions within clusters.

    A difference is a sum of cluster contributions, so a draw is a signed sum over clusters; the
    pairs of conditions share the draws.
    """
    size = rows.groupBy(gold).agg(F.count(F.lit(1)).alias("n"))
    classes = size.count()
    names = [f"effect_{i}" for i in range(len(pairs))]
    share = lambda left, right: F.sum(((F.col(right) == F.col(gold)).cast("double") - (F.col(left) == F.col(gold)).cast("double")) / F.col("n") / classes)
    each = rows.join(F.broadcast(size), gold).groupBy(cluster).agg(*(share(*p).alias(n) for p, n in zip(pairs, names, strict=True)))
    each = written(each, "swap-effects")
    sums = F.explode(F.array(*(F.struct(F.lit(i).alias("of"), F.col(n).alias("difference")) for i, n in enumerate(names)))).alias("s")
    told = each.agg(*(F.sum(n).alias(n) for n in names)).select(sums).select("s.*")
    return sign_flips(each, cluster, draws, names, seed).join(F.broadcast(told), "of")


def condition_swap(rows: DataFrame, cluster: str, gold: str, left: str, right: str, draws: int, seed: int = SEED) -> DataFrame:
    """The swap test of one pair of conditions: a row of p, draws, clusters and difference."""
    return condition_swaps(rows, cluster, gold, [(left, right)], draws, seed).drop("of")
