"""Operator 12 against its SQL twin and against plain Python."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tandem.llm import mixing

from .helpers import awkward, documents, words


def twin(docs):
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "source", "text").toArrow())
    return sorted(con.execute(f"SELECT doc_id, size, source_size, target, taken, source FROM ({mixing.ORACLE})").fetchall(), key=str)


def mixed(docs):
    return sorted((tuple(r) for r in mixing.mix(docs).collect()), key=str)


def filled(sizes):
    """Targets by resharing, from (source, words)."""
    weights = {s: k % 3 + 1 for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    total, fixed = sum(sizes.values()), {}
    while True:
        rest, open_ = total - sum(fixed.values()), sum(w for s, w in weights.items() if s not in fixed)
        more = {s: 3 * n for s, n in sizes.items() if s not in fixed and open_ and rest * weights[s] / open_ > 3 * n}
        if not more:
            return {s: float(fixed[s]) if s in fixed else rest * weights[s] / open_ for s in sizes}
        fixed |= more


def test_words_are_runs_between_ascii_blanks(spark):
    texts = ["", " \t\n", "a", " a\x0bb\x0c\rc ", "x\x85y z", "\x1fa b", None, "😀 é\n\n日本", "end  "]
    got = [r.n for r in spark.createDataFrame([(t,) for t in texts], "text string").select(mixing.word_count(F.col("text")).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]


def test_hot_sources_stopped_targets_and_odd_rows(spark):
    rows = awkward()
    docs = documents(spark, rows).withColumn("source", F.when(F.col("doc_id").isNull(), None).when(F.col("doc_id") < 5, "tiny").when(F.col("doc_id") == 12, "").otherwise("hot"))
    got = mixed(docs)
    assert got == twin(docs) and len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    for _, size, of_source, t, take, source in got:
        sizes[source] = sizes.get(source, 0) + size
        taken[source] = taken.get(source, 0) + take
        target[source] = t
        assert 0 <= take <= 3 * size
    assert target == filled(sizes)
    assert any(t == 3 * sizes[s] for s, t in target.items())
    assert all(abs(taken[s] - target[s]) <= 3 for s in sizes)


def test_repeated_rows_share_the_threshold(spark):
    docs = documents(spark, [(7, "one two three", "en")] * 40 + [(i, "a b", "en") for i in range(100, 103)]).withColumn("source", F.when(F.col("doc_id") == 7, "copies").otherwise("rest"))
    got = mixed(docs)
    assert got == twin(docs)
    assert len({r[4] for r in got if r[0] == 7}) == 1


@pytest.mark.parametrize("source", [None, "only"])
def test_one_source_is_taken_whole(spark, source):
    docs = documents(spark, [(i, "w " * (i % 7), "en") for i in range(50)]).withColumn("source", F.lit(source).cast("string"))
    assert all(r[4] == r[1] for r in mixed(docs))


def test_no_rows_no_words_and_clashing_names(spark):
    assert mixing.mix(documents(spark, [])).count() == 0
    docs = documents(spark, [(1, None, "en"), (2, " ", "en")], ["size", "hash", "target", "bucket", "need"])
    assert [(r[1], r[3], r[4]) for r in mixed(docs)] == [(0, 0.0, 0)] * 2


def test_reruns_and_partitions_agree(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert mixed(docs) == mixed(docs.repartition(13)) == twin(docs)


def test_takes_are_nested(spark):
    import random

    rng = random.Random(1)
    docs = documents(spark, [(i, words(rng, rng.randint(1, 30)), "en") for i in range(300)])
    rows = mixing.measured(docs)
    whole = rows.agg(F.sum("size")).first()[0]
    before = -1
    for need in (1, whole // 3, whole // 2, whole):
        cut = mixing.thresholds(rows, spark.createDataFrame([("s", need)], "source string, need long")).first()
        below = rows.where(F.col("hash") < cut.threshold).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        assert below + cut.part == need and 0 < cut.part <= cut.of and cut.threshold >= before
        before = cut.threshold
