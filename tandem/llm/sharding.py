"""Histogram sort into shards of nearly equal bytes (operator 9), DataFrame operations only.

The sort key of a document is (60 bits of its text's MD5, doc_id): copies of a text stand
together and a group of copies that is larger than a shard is still divisible. Splitters
are found by counting: each round sums the exact bytes and rows that lie below candidate
keys, then probes only the intervals that still hold a wanted boundary. Sums are combined
before the shuffle, a round brings at most ``probes`` rows for each boundary to the driver,
and the rounds read a narrow table of keys, never the texts. When each boundary's interval
holds a single key, rows are dealt to ranges and ranked inside them by one exchange.

Law ``bytes``: a document whose key has b bytes of smaller keys before it, of T in all,
goes to shard floor(b * shards / T). So shards differ by less than one document.

Defined results: a null text has no bytes (size 1, CRC of nothing) and a null doc_id sorts
before all others; repeated rows share a key, so they go to one shard, with slots of their
own; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import written

KEY_BITS, COARSE_BITS = 60, 12
LOWEST = -(2**63)

SPLITTERS = T.StructType([T.StructField("k", T.LongType()), T.StructField("d", T.LongType())])


def sort_keys(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (key, tie): one narrow pass over the texts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), 1, KEY_BITS // 4), 16, 10).cast("long").alias("key"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("tie"),
    )


def _coarse(key: Column) -> Column:
    return F.shiftright(key, KEY_BITS - COARSE_BITS)


def _sums() -> list[Column]:
    return [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")]


def splitters(keys: DataFrame, parts: int, probes: int = 256) -> tuple[list[dict], int, int]:
    """The boundaries of ``parts`` ranges of equal bytes, with the rows below each; total bytes and rows.

    Boundary i is the smallest key with at least i / parts of all bytes before it, as
    (k, d): keys from (k, d) upwards lie above it. The driver holds a bounded histogram
    (2 ** 12 coarse counts, then ``probes`` counts for each boundary and round).
    """
    coarse = keys.groupBy(_coarse(F.col("key")).alias("bucket")).agg(*_sums(), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    coarse.sort(key=lambda r: r.bucket)
    total, rows = sum(r["bytes"] for r in coarse), sum(r["rows"] for r in coarse)
    found: list[dict] = []
    open_: list[dict] = []
    before = rows_before = 0
    i = 1
    for r in coarse:
        while i < parts and (before + r["bytes"]) * parts >= i * total:
            open_.append({"i": i, "level": "key", "key": 0, "lo": r.lo, "hi": r.hi, "before": before, "rows_before": rows_before, "bytes": r["bytes"], "rows": r["rows"]})
            i += 1
        before, rows_before = before + r["bytes"], rows_before + r["rows"]
    while open_:
        # an interval of one key is either indivisible or goes on among the tied documents
        go: list[dict] = []
        for x in open_:
            if x["lo"] < x["hi"]:
                go.append(x)
            elif x["level"] == "key" and x["rows"] > 1:
                go.append(x | {"level": "tie", "key": x["lo"], "lo": None, "hi": None})
            elif x["level"] == "key":
                found.append({"i": x["i"], "k": x["lo"] + 1, "d": LOWEST, "rows_before": x["rows_before"] + x["rows"]})
            else:
                found.append({"i": x["i"], "k": x["key"], "d": x["lo"] + 1, "rows_before": x["rows_before"] + x["rows"]})
        open_ = _narrower(keys, go, parts, total, probes) if go else []
    return sorted(found, key=lambda x: x["i"]), total, rows


def _narrower(keys: DataFrame, intervals: list[dict], parts: int, total: int, probes: int) -> list[dict]:
    """The intervals after one more round of counting; each is cut into ``probes`` at most."""
    spark = keys.sparkSession
    slots: dict[tuple, int] = {}
    for x in intervals:
        slots.setdefault((x["level"], x["key"], x["lo"], x["hi"]), len(slots))
    counts = []
    cut = [(s, lo >> (KEY_BITS - COARSE_BITS), lo, hi, max(1, ceil((hi - lo + 1) / probes))) for (level, _, lo, hi), s in slots.items() if level == "key"]
    if cut:
        probe = spark.createDataFrame(cut, "slot int, bucket long, p_lo long, p_hi long, step long")
        inside = keys.withColumn("bucket", _coarse(F.col("key"))).join(F.broadcast(probe), "bucket").where(F.col("key").between(F.col("p_lo"), F.col("p_hi")))
        counts += inside.groupBy("slot", F.expr("(key - p_lo) div step").alias("cell")).agg(*_sums(), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    ties = [(slot, key, lo, hi) for (level, key, lo, hi), slot in slots.items() if level == "tie"]
    if ties:
        counts += _tie_counts(keys, ties, probes)
    cells: dict[int, list] = {}
    for r in counts:
        cells.setdefault(r["slot"], []).append(r)
    out = []
    for x in intervals:
        before, rows_before = x["before"], x["rows_before"]
        for r in sorted(cells[slots[(x["level"], x["key"], x["lo"], x["hi"])]], key=lambda r: r["cell"]):
            if (before + r["bytes"]) * parts >= x["i"] * total:
                out.append(x | {"lo": r["lo"], "hi": r["hi"], "before": before, "rows_before": rows_before, "bytes": r["bytes"], "rows": r["rows"]})
                break
            before, rows_before = before + r["bytes"], rows_before + r["rows"]
    return out


def _tie_counts(keys: DataFrame, ties: list[tuple], probes: int) -> list:
    """Counts among documents of one key by their ids; an interval without ends takes those of its ids."""
    spark = keys.sparkSession
    wanted = spark.createDataFrame([(s, k, lo, hi) for s, k, lo, hi in ties], "slot int, key long, t_lo long, t_hi long")
    tied = keys.join(F.broadcast(wanted), "key").where(F.col("t_lo").isNull() | F.col("tie").between(F.col("t_lo"), F.col("t_hi")))
    ends = {r["slot"]: (r["a"], r["z"]) for r in tied.groupBy("slot").agg(F.min("tie").alias("a"), F.max("tie").alias("z")).collect()}
    steps = spark.createDataFrame([(s, a, max(1, ceil((z - a + 1) / probes))) for s, (a, z) in ends.items()], "slot int, a long, step long")
    wide = T.DecimalType(38, 0)
    cell = F.floor((F.col("tie").cast(wide) - F.col("a").cast(wide)) / F.col("step")).cast("long")
    return tied.join(F.broadcast(steps), "slot").groupBy("slot", cell.alias("cell")).agg(*_sums(), F.min("tie").alias("lo"), F.max("tie").alias("hi")).collect()


def histogram_sort(keys: DataFrame, shards: int = 8, rows_per_range: int = 4096, max_ranges: int = 1024) -> DataFrame:
    """``keys`` (from sort_keys) with shard and slot: rows in key order, slots gapless in each shard.

    A shard is dealt as several ranges, so that no task ranks a whole shard; rows_per_range
    sets their number up to ``max_ranges``. The splitter table is of at most that many rows.
    """
    spark = keys.sparkSession
    rows = keys.count()
    if not rows:
        return keys.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    each = min(max(1, max_ranges // shards), max(1, ceil(rows / shards / rows_per_range)))
    parts = shards * each
    cuts, _, _ = splitters(keys, parts)
    starts = [0] + [c["rows_before"] for c in cuts]
    # of each coarse bucket: the splitters below it, and those inside it
    inside: dict[int, list[tuple]] = {}
    for c in cuts:
        inside.setdefault(min(c["k"] >> (KEY_BITS - COARSE_BITS), 2**COARSE_BITS), []).append((c["k"], c["d"]))
    below, table = 0, []
    for bucket in range(2**COARSE_BITS):
        table.append((bucket, below, inside.get(bucket, [])))
        below += len(inside.get(bucket, ()))
    deal = spark.createDataFrame(table, T.StructType([T.StructField("bucket", T.LongType()), T.StructField("below", T.IntegerType()), T.StructField("cuts", T.ArrayType(SPLITTERS))]))
    ranges = spark.createDataFrame([(p, p // each, starts[p] - starts[p // each * each]) for p in range(parts)], "part int, shard int, first long")
    passed = F.size(F.filter("cuts", lambda c: (c["k"] < F.col("key")) | ((c["k"] == F.col("key")) & (c["d"] <= F.col("tie")))))
    dealt = (
        keys.withColumn("bucket", _coarse(F.col("key")))
        .join(F.broadcast(deal), "bucket")
        .withColumn("part", F.when(F.size("cuts") == 0, F.col("below")).otherwise(F.col("below") + passed))
        .drop("bucket", "below", "cuts")
        .join(F.broadcast(ranges), "part")
    )
    place = F.row_number().over(Window.partitionBy("part").orderBy("key", "tie", "size"))
    return dealt.withColumn("slot", F.col("first") + place - 1).drop("first", "part")


def op9_histogram_sort(spark, sf_dir: str) -> DataFrame:
    keys = written(sort_keys(spark.read.parquet(f"{sf_dir}/documents.parquet")), "sort-keys")
    return histogram_sort(keys).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
