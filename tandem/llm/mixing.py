"""Mixing sources to target weights by hash thresholds (operator 12), DataFrame operations only.

Every source has a weight and gets its share of all words; a target stops at ``MOST`` times
its source's words, and what is left over is shared again by weight until none is above. A
target of t words takes each of the source's S words t div S times, and once more those of
the documents whose hash lies below a threshold. So the takes of rising budgets are nested,
and the same documents are taken in every run.

A threshold is found by counting: words by source and leading bits of the hash, the bucket in
which the budget ends, then only that bucket's documents by their next bits, until it holds
one hash. Nothing is sorted but the counts of a source (2 ** BITS at most); the filter is a
comparison. Of the documents with the threshold's very hash (one, as a rule) each gives the
same part, so a source misses its target by less than a word for each of them.

The rounds read a narrow table (source, words, hash), never texts. Only sums over all sources
reach the driver. A source of a third of all rows is summed before the shuffle.

Defined results: a null text has no words; a null source is a source of its own, the last;
equal rows have one hash and give equal parts; sources without words have target 0; with no
rows nothing comes out; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import ranked
from .common import table, written

WEIGHTS, MOST = (1, 2, 3), 3
HASH_BITS, BITS = 60, 12
BLANK = r" \t\n\x0B\f\r"


def word_count(text):
    """Runs of other characters than space and the five controls from tab to carriage return."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{BLANK}]+", "")
    return F.length(F.regexp_replace(trimmed, f"[^{BLANK}]+[{BLANK}]*", "x")).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words, and 60 bits of a hash of id and text."""
    said = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(":"), F.coalesce("text", F.lit("")))
    hashed = F.conv(F.substring(F.md5(said.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count(F.col("text")).alias("size"), hashed.alias("hash"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, weight and target; weights are dealt in turn to the sources in code-point order."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("unnamed", F.col("source").isNull())
    placed = ranked(sizes, ["unnamed", "source"])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights)).cast("int") + 1)
    named = written(placed.select("source", "source_size", weight.cast("long").alias("weight")), "sources")
    first = named.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights")).first()
    rest, open_ = first.words or 0, first.weights or 1
    limit = F.lit(most) * F.col("source_size")
    while True:
        share = F.lit(rest) * F.col("weight") / F.lit(open_)
        above = share > limit
        told = named.agg(F.coalesce(F.sum(F.when(above, limit)), F.lit(0)).alias("fixed"), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)).alias("open")).first()
        now = ((first.words or 0) - told.fixed, told.open or 1)
        if now == (rest, open_):
            return named.withColumn("target", F.when(above, limit.cast("double")).otherwise(share))
        rest, open_ = now


def _here(rows: DataFrame, found: DataFrame, *more: str) -> DataFrame:
    """``rows`` joined with a table of sources; a null source meets itself."""
    told = found.withColumnRenamed("source", "__source")
    same = F.col("source").eqNullSafe(F.col("__source"))
    for c in more:
        told = told.withColumnRenamed(c, f"__{c}")
        same &= F.col(c) == F.col(f"__{c}")
    return rows.join(told, same).drop("__source", *(f"__{c}" for c in more))


def thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, threshold, part and of: hashes below the threshold are in; of those that equal it ``part`` of ``of`` words.

    ``budgets`` (source, need): 0 < need <= the source's words.
    """
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = _here(rows.select("source", "size", "hash"), budgets)
    for shift in range(HASH_BITS - BITS, -1, -BITS):
        counted = inside.withColumn("bucket", F.shiftright("hash", shift)).groupBy("source", "bucket")
        counted = counted.agg(F.sum("size").alias("words"), F.min("hash").alias("lo"), F.max("hash").alias("hi"), F.min("need").alias("need"))
        ends = counted.withColumn("before", before).where("before < need AND before + words >= need")
        ends = written(ends.select("source", "bucket", "lo", "hi", "words", (F.col("need") - F.col("before")).alias("need")), "budget-ends")
        if not shift or ends.where("lo < hi").limit(1).count() == 0:
            break
        here = inside.drop("need").withColumn("bucket", F.shiftright("hash", shift))
        inside = written(_here(here, ends.select("source", "bucket", "need"), "bucket").select("source", "size", "hash", "need"), "boundary")
    return ends.select("source", F.col("lo").alias("threshold"), F.col("need").alias("part"), F.col("words").alias("of"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Every document with its words, its source's words and target, and the words that the mix takes of it."""
    rows = written(measured(docs), "measured")
    whole = F.floor("target").cast("long")
    times = F.when(F.col("source_size") > 0, F.expr("cast(floor(target) as bigint) div source_size")).otherwise(0)
    wanted = written(targets(rows, weights, most).withColumn("times", times).withColumn("need", whole - F.col("times") * F.col("source_size")), "targets")
    ends = thresholds(rows, wanted.where("need > 0").select("source", "need"))
    told = wanted.select("source", "source_size", "target", "times").join(ends.withColumnRenamed("source", "of_source"), F.col("source").eqNullSafe(F.col("of_source")), "left")
    once = F.when(F.col("hash") < F.col("threshold"), F.col("size")).when(F.col("hash") == F.col("threshold"), F.expr("size * part div of")).otherwise(0)
    taken = F.col("size") * F.col("times") + once
    return _here(rows, told.drop("of_source")).select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"), "source")


def op12_hash_thresholds(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same mix by sorting: sources by the ratio at which they stop, documents by their hash.
ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '-') || ':' || coalesce(text, '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS w FROM d GROUP BY source),
o AS (
  SELECT *, ((SELECT sum(n) FROM s) - coalesce(sum(3 * n) OVER prev, 0))::BIGINT AS rest, ((SELECT sum(w) FROM s) - coalesce(sum(w) OVER prev, 0))::BIGINT AS open
  FROM s WINDOW prev AS (ORDER BY 3 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT rest, open FROM o WHERE rest * w / open <= 3 * n ORDER BY 3 * n / w, source NULLS LAST LIMIT 1),
t AS (SELECT source, n, CASE WHEN rest * w / open > 3 * n THEN (3 * n)::DOUBLE ELSE rest * w / open END AS target FROM s, level),
b AS (SELECT *, CASE WHEN n > 0 THEN floor(target)::BIGINT // n ELSE 0 END AS times, CASE WHEN n > 0 THEN floor(target)::BIGINT % n ELSE 0 END AS need FROM t),
e AS (
  SELECT d.*, b.n, b.target, b.times, b.need, sum(size) OVER (PARTITION BY d.source, h) AS tied,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, n AS source_size, target, source,
       (size * times + CASE WHEN upto <= need THEN size WHEN upto - tied >= need THEN 0 ELSE size * (need - (upto - tied)) // tied END)::BIGINT AS taken
FROM e
"""
