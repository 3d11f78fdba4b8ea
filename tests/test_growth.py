"""Steps whose work once grew faster than their input: what is dealt, by which keys, and how large a file may be."""

import random
import re
import time
from collections import Counter

from pyspark.sql import functions as F

from tandem.operators import audit, cases, cubes, gates, reports, units
from tandem.plans import exports, gating, nested, procedures
from tandem.sources import fixtures, shared, sinks


def planned(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_published_files_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 10)
    told = sinks.publish(spark.range(95).coalesce(1), str(tmp_path / "p"), ["id"]).collect()
    rows = [len(p.read_text().splitlines()) for p in (tmp_path / "p").glob("part-*")]
    assert sum(rows) == 95 and max(rows) <= 10 and len(told) == len(rows) >= 10


def test_cells_of_a_gate_are_dealt_by_owner(spark):
    owned = spark.createDataFrame([(v, f"o{i}", "p") for v in "xy" for i in range(3)], "variant string, owner_key string, prompt string")
    rows = owned.select(F.lit("c").alias("condition"), "variant", "owner_key", F.lit("ok").alias("hard_status"), F.lit("ok").alias("probability_status"), F.col("prompt").alias("hard_prompt"), F.col("prompt").alias("probability_prompt"))
    gate = gates.cell_gate(rows, owned, spark.createDataFrame([("c", "x"), ("c", "y"), ("d", "x")], "condition string, variant string"))
    assert {(r.condition, r.variant): (r.owners, r.missing, r.passes) for r in gate.collect()} == {("c", "x"): (3, 0, True), ("c", "y"): (3, 0, True), ("d", "x"): (0, 3, False)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = planned(gates.cell_gate(rows, owned, rows.select("condition", "variant")))
        mapped = planned(cubes.rescored(spark.createDataFrame([("original", {"A": 1.0}, "REFUTES")], "variant string, scores map<string,double>, negative_label string"), spark.createDataFrame(nested.MAPPINGS, "variant string, choice string, label string"), nested.LABELS))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert not re.search(r"SortMergeJoin \[variant#\d+\], ", plan) and "BroadcastHashJoin [variant" in plan
    assert "SortMergeJoin" not in mapped


def test_cases_of_several_keys_make_a_cube_without_another_shuffle(spark):
    rows = spark.range(40).select((F.col("id") % 10).alias("k"), F.lit("p").alias("page"), F.element_at(F.array(*map(F.lit, "ab")), (F.col("id") % 20 / 10 + 1).cast("int")).alias("c"), F.element_at(F.array(*map(F.lit, "xy")), (F.col("id") / 20 + 1).cast("int")).alias("v"), F.col("id").cast("double").alias("n"))
    found = cubes.complete_cube(cubes.cube(rows.repartition("k"), ("v", "k"), "page", "c", ["a", "b"], "n"), ("v", "k"))
    assert planned(found).count("Exchange hashpartitioning") == 1  # the repartition by k
    assert {(r.v, r.k): r["values"] for r in found.collect()} == {(v, k): [20.0 * i + k, 20.0 * i + 10 + k] for i, v in enumerate("xy") for k in range(10)}


def test_conditions_of_an_owner_are_counted_in_one_shuffle(spark):
    rows = spark.createDataFrame([("o", c, "full", "g") for c in "ab"], "owner_key string, condition string, control string, gold string")
    for frame in (cases.aligned(rows, "owner_key", "condition", 2), units.alignment_gate(rows, 2, ["control", "gold"])):
        assert planned(frame).count("Exchange hashpartitioning(owner_key") == 1


def test_exports_read_their_cells_once(spark, sf_dir):
    assert exports.exports(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("l_linenumber") and planned(exports.exports(spark, sf_dir)).count("FileScan") == 2  # lineitem and orders


def test_values_of_an_overlap_are_made_once_for_each_row(spark, sf_dir):
    assert procedures.text_overlap(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 2  # documents and benchmark
    left = spark.createDataFrame([("a", None), ("a", None), ("", None), (None, ""), ("b", None)], "x string, y string")
    found = audit.overlap(left, left.where("x = 'b' OR x IS NULL"), {n: (F.col(n), F.col(n)) for n in "xy"})
    assert [tuple(r) for r in found.collect()] == [("x", 2, 1, 1)]  # neither null nor empty values count, and a level without others has no row


def test_cells_of_a_release_are_sent_once(spark):
    rows = spark.createDataFrame([], nested.RELEASED)
    plan = planned(reports.released_numbers(rows, ("base", "treat"), ["A", "N", "R"]))
    assert plan.count("Exchange hashpartitioning(case_id") == 1  # two with a distinct count


def test_recomputed_keeps_its_cells_and_a_release_in_columns(spark, sf_dir, tmp_path, monkeypatch):
    for module in (nested, shared):
        monkeypatch.setattr(module, "shared_folder", lambda spark: str(tmp_path))
    found = nested.recomputed(spark, sf_dir).collect()
    assert len(found) == 6 and all(r.agrees for r in found)
    kept = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert kept == {"cells", "release", "report-level"}  # no second copy of both conditions
    parts = [p for p in tmp_path.glob("release-*/records/part-*")]
    assert parts and all(p.name.endswith(".parquet") for p in parts)


def test_shuffles_of_a_written_step_are_dropped(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {n for n in re.findall(r"shuffle_\d+_\d+_\d+\.data", disk.getAllFiles().mkString(" "))}
    before = files()
    shared.written(spark.range(1000).repartition(3, "id"), "left")
    assert files() - before
    before = files()
    with shared.shuffles_dropped(spark):
        df = shared.written(spark.range(1000).repartition(3, "id"), "dropped")
    until = time.time() + 20
    while (left := files() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left and df.count() == 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"


def test_owners_of_a_gate_stay_with_their_case(spark, sf_dir):
    plan = planned(gating.cell_gate(spark, sf_dir))
    assert "owner_key" not in " ".join(re.findall(r"Exchange hashpartitioning\([^)]*\)", plan)) and "row_number" not in plan and not re.search(r"SortMergeJoin \[[^]]*owner_key", plan)
    assert plan.count("REPARTITION_BY_NUM") == 2  # the same one for units and rows


def test_cases_are_those_of_the_cells(spark, sf_dir, tmp_path):
    found = lambda sf: (sorted(r[0] for r in fixtures.case_ids(spark, sf).collect() for _ in range(4)), sorted(r[0] for r in fixtures.cells(spark, sf).select("case_id").collect()))
    assert len(set(map(tuple, found(sf_dir)))) == 1
    lines = fixtures.table(spark, sf_dir, "lineitem").limit(1).drop("l_orderkey")
    spark.createDataFrame([(k,) for k, n in ((1, 3), (2, 4), (3, 9), (4, 5), (None, 6)) for _ in range(n)], "l_orderkey long").crossJoin(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1,), (2,), (3,), (3,), (5,), (None,)], "o_orderkey long").selectExpr("o_orderkey", "1L AS o_custkey", "'' AS o_orderpriority", "'' AS o_orderstatus").write.parquet(f"{tmp_path}/orders.parquet")
    ours, theirs = found(str(tmp_path))
    assert ours == theirs == [2] * 4 + [3] * 8  # four equal lines, an order that stands twice; neither too few lines nor an absent order


def test_a_gate_counts_the_same_with_and_without_cases(spark):
    rng = random.Random(5)
    owners = [(i, f"o{i}") for i in range(60)]
    told = [(k, o, v, None if rng.random() < 0.1 else f"{v}{o}") for k, o in owners for v in "ab" if rng.random() < 0.9]
    told += told[:3]
    prompts = {(o, v): p for _, o, v, p in told}
    odd = lambda good, bad: bad if rng.random() < 0.1 else good
    rows = [(c, v, k, o, odd("ok", "failed"), odd("ok", "failed"), odd(prompts.get((o, v)), None), odd(prompts.get((o, v)), "x")) for c in "xyz" for v in "ab" for k, o in owners for _ in range(rng.choice([0, 1, 1, 1, 2]))]
    design = [(c, v) for c in "xyw" for v in "ab" if (c, v) != ("y", "b")]
    stands, of = Counter((o, v) for _, o, v, _ in told), {}
    for c, v, _, o, hs, ps, hp, pp in rows:
        of.setdefault((c, v), {}).setdefault(o, []).append(("failed" in (hs, ps), hp == pp == prompts.get((o, v))))
    expected = {}
    for c, v in {*of, *design}:
        here, asked = of.get((c, v), {}), {o: n for (o, w), n in stands.items() if w == v and (c, v) in design}
        times = {o: max(asked.get(o, 0), 1) for o in here}
        expected[c, v] = (len(here), len(asked.keys() - here.keys()), len(here.keys() - asked.keys()), sum(len(x) * times[o] > 1 for o, x in here.items()), sum(f * times[o] for o, x in here.items() for f, _ in x), sum((not ok) * asked[o] for o, x in here.items() if o in asked for _, ok in x))
    units = spark.createDataFrame(told, "case_id int, owner_key string, variant string, prompt string")
    exported = spark.createDataFrame(rows, "condition string, variant string, case_id int, owner_key string, hard_status string, probability_status string, hard_prompt string, probability_prompt string")
    cells = spark.createDataFrame(design, "condition string, variant string")
    for gate in (gates.cell_gate(exported, units, cells), gates.cell_gate(exported.repartition(3, "case_id"), units.repartition(3, "case_id"), cells, by=("case_id",)), gates.cell_gate(exported, units.repartition(3, "case_id"), cells, by=("case_id",))):
        assert {(r.condition, r.variant): (r.owners, r.missing, r.extra, r.repeated, r.failed, r.other_prompts) for r in gate.collect()} == expected
