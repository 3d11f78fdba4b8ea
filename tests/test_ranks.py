"""Ranks over ranges, and tables in the shared folder."""

import random

from tandem.operators.ranks import ranges, ranked
from tandem.sources.shared import forget_written, written


def test_ranks_are_gapless_in_every_group(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "b", "b", ""]), rng.randrange(400), i) for i in range(2000)]
    table = spark.createDataFrame(rows, "g string, v int, i int").repartition(7)
    groups = {}
    for g, v, i in rows:
        groups.setdefault(g, []).append((v, i))
    expected = {(g, i): k for g, members in groups.items() for k, (_, i) in enumerate(sorted(members))}
    assert {(r.g, r.i): r.place for r in ranked(table, ["v", "i"], ("g",)).collect()} == expected
    whole = sorted(range(2000), key=lambda k: (rows[k][1], rows[k][2]))
    assert [r.i for r in ranked(table, ["v", "i"]).orderBy("place").collect()] == whole


def test_no_task_ranks_a_whole_group(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    one = ranges(spark.range(20_000).selectExpr("'hot' AS g", "id"), ["id"], ("g",))
    parts = one.runs.orderBy("part").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(parts) == 4 and sum(r["count"] for r in parts) == 20_000 and all(r.total == 20_000 for r in parts)
    assert max(r["count"] for r in parts) < 10_000
    assert [r.start for r in parts] == [sum(x["count"] for x in parts[:k]) for k in range(4)]


def test_empty_tables_and_repeated_rows(spark):
    assert ranked(spark.createDataFrame([], "g string, v int"), ["v"], ("g",)).count() == 0
    same = spark.createDataFrame([("a", 1)] * 5 + [(None, None)] * 3, "g string, v int")
    assert sorted(r.place for r in ranked(same, ["v"], ("g",)).collect()) == [0, 0, 1, 1, 2, 2, 3, 4]


def test_written_tables_can_be_forgotten(spark):
    forget_written(spark)
    kept = written(spark.range(10), "some")
    assert kept.count() == 10 and forget_written(spark) == 1
    assert forget_written(spark) == 0
