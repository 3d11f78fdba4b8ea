"""Nested reports, expectations, cubes, mappings and inventories: every failure, and numbers by hand."""

import hashlib
import json
import math
import os
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandem.operators import cubes, reports
from tandem.plans import nested
from tandem.sources import expectations, readers, releases


def leaves_of(value, path=""):
    if isinstance(value, dict) and value:
        return [x for k, v in value.items() for x in leaves_of(v, path + "/" + k.replace("~", "~0").replace("/", "~1"))]
    if isinstance(value, list) and value:
        return [x for i, v in enumerate(value) for x in leaves_of(v, f"{path}/{i}")]
    return [(path, value)]


def test_leaves_of_any_json(spark):
    docs = {"a": {"x/y": 1.5, "~": [1, {"q": None}], "e": {}, "f": [], "n": [None, None], "s": "hi", "t": True, "tiny": 1.417e-288, "big": 123456789012345}, "b": [[["deep"]], {"é": {"": -2}}], "c": 3, "d": None, "e": {"m": [{"k": [{"z": 0.1}]}]}}
    frame = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "source string, j string")
    found = {(r.source, r.path): r for r in reports.flattened(frame, "j").collect()}
    expected = {(k, p): v for k, d in docs.items() for p, v in leaves_of(d)}
    assert found.keys() == expected.keys()
    for key, value in expected.items():
        row = found[key]
        if isinstance(value, bool):
            assert (row.kind, row.text) == ("boolean", str(value).lower())
        elif isinstance(value, (int, float)):
            assert row.kind == "number" and row.number == value
        elif isinstance(value, str):
            assert (row.kind, row.text) == ("string", value)
        else:
            assert row.kind == ("null" if value is None else "empty")
    with pytest.raises(Exception, match="MALFORMED_RECORD"):
        reports.flattened(spark.createDataFrame([("a", "{")], "source string, j string"), "j").collect()
    assert reports.flattened(frame.where("source = 'z'"), "j").count() == 0


def test_adapters_and_addresses(spark):
    report = {"models": {"m/1": {"gptq": {"estimate": 0.25, "note": "x"}}, "m2": {"awq": {"estimate": -1}}}, "rows": [{"row_id": "0a", "v": {"n": [1, 2.5]}}, {"row_id": "0b", "v": {"n": []}}, {"row_id": "0b", "v": 1}]}
    leaves = reports.flattened(spark.createDataFrame([("r", json.dumps(report))], "source string, j string"), "j")
    told = reports.adapted(leaves, {"effect": "/models/{model}/{route}/{metric}", "third": "/rows/*/v/n/1"}).collect()
    assert {(r.role, r.model, r.route, r.metric, r.value) for r in told} == {("effect", "m/1", "gptq", "estimate", 0.25), ("effect", "m2", "awq", "estimate", -1.0), ("third", None, None, None, 2.5)}
    asked = [("/models/m~11/gptq/estimate", 0.25 + 1e-13, None, "ok"), ("/models/m2/awq/estimate", -1.1, None, "differs"), ("/models/m~11/gptq/note", None, "x", "ok"), ("/models/m~11/gptq/note", None, "y", "differs"), ("/nothing", 1.0, None, "missing"),
             ("rows[row_id=0a].v.n[1]", 2.5, None, "ok"), ("rows[row_id=0b].v", 1.0, None, "row_not_unique"), ("rows[row_id=0c].v", 1.0, None, "missing")]
    frame = spark.createDataFrame([("r", *a) for a in asked], "source string, address string, number double, text string, expected string")
    got = {(r.address, r.number, r.text): r.status for r in reports.resolved(frame, leaves).collect()}
    assert got == {a[:3]: a[3] for a in asked}


def test_a_changed_row_breaks_a_release(spark, sf_dir, tmp_path):
    folder = f"{tmp_path}/release"
    rows = nested.released_cells(spark, sf_dir, folder)
    published = reports.flattened(nested.published_report(spark, sf_dir), "json").where("kind = 'number'")
    check = lambda r: {x.path for x in reports.recomputed(published, reports.released_numbers(r, ("base", "treat"), ["A", "N", "R"])).where("NOT agrees").collect()}
    assert check(rows) == set()
    one = rows.where("condition = 'treat'").orderBy("case_id").first()
    here = (F.col("condition") == "treat") & (F.col("case_id") == one.case_id)
    assert check(rows.withColumn("score", F.when(here & (F.col("cell_index") == 0), F.col("score") + 1e-6).otherwise(F.col("score")))) == {"/primary/estimate", "/primary/case_weighted"}
    assert check(rows.withColumn("prediction", F.when(here & (F.col("prediction") == F.col("gold")), "?").otherwise(F.col("prediction")))) <= {"/balanced_accuracy/treat"}
    for broken in (rows.where(~(here & (F.col("cell_index") == 3))), rows.withColumn("cluster_id", F.when(here, -1).otherwise(F.col("cluster_id"))), rows.withColumn("gold", F.when(here, "A").otherwise("R")), rows.unionByName(rows.where(here).limit(1))):
        with pytest.raises(Exception, match="aren't paired"):
            check(broken)
    part = next(p for p in sorted((tmp_path / "release" / "records").glob("part-*")) if p.stat().st_size)
    os.chmod(part, 0o644)
    part.write_bytes(part.read_bytes().replace(b'"cell_index":1', b'"cell_index":2', 1))
    crc = part.parent / f".{part.name}.crc"
    crc.unlink(missing_ok=True)
    with pytest.raises(ValueError, match="isn't what the manifest says"):
        releases.read_release(spark, folder, nested.RELEASED)


# expectations


def test_expectations_are_measured_while_writing(spark):
    frame = spark.createDataFrame([(1, "a", 0.5), (2, "b", 0.7), (3, "a", 1.0)], "k int, label string, p double")
    good = expectations.Expectations().rows(3).labels("label", {"a": 2, "b": 1}).finite("p").within("p", 0, 1).expect("largest", F.max("k"), lambda m: m >= 3)
    assert expectations.checked(frame, good, "some").count() == 3
    bad = frame.unionByName(spark.createDataFrame([(4, "c", math.nan), (5, None, math.inf)], frame.schema))
    with pytest.raises(ValueError) as told:
        expectations.checked(bad, good, "some")
    assert all(x in str(told.value) for x in ("some: rows is 5, not 3", "other label is 2, not 0", "p not finite is 2, not 0", "p outside 0 to 1 is 2"))


def test_lines_are_scanned_once(spark, tmp_path):
    def written_lines(*lines):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    good = readers.scan_lines(spark, written_lines('{"a": 1}', ' {"a": null, "b": "x"}'), "a int, b string")
    assert sorted(map(tuple, good.collect()), key=str) == [(1, None), (None, "x")]
    assert good._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    for lines, why in (((' ', '{"a": 1}'), "blank line"), (('[1]',), "no object"), (('{"a": "x"}',), "MALFORMED|malformed"), (('{"a": 1',), "MALFORMED|malformed")):
        with pytest.raises(Exception, match=why):
            readers.scan_lines(spark, written_lines(*lines), "a int, b string").collect()


def stage_row(i, gold="Entailed", **changes):
    canon = lambda x: hashlib.sha256(json.dumps(x, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    parts = {
        "metadata": {"sample_id": f"s{i}é", "table_id": f"t{i // 2}", "gold_label": gold, "control": "full", "table_truncated": False, "score": 1.417e-288, "more": [1, {"b": 2, "a": None}]},
        "hard_payload": {"scored_label": gold, "hard_label_method": "argmax", "x": 0.1}, "probability_payload": {"scored_label": gold, "direct_logit_method": "direct", "p": 1e-05},
    }
    for key, value in changes.items():
        part, _, field = key.partition("__")
        if field and part in parts:
            parts[part][field] = value
    row = {"owner_key": f"s{i}é|full", **parts, **{f"{k}_sha256": canon(v) for k, v in parts.items()}, "hard_status": "ok", "hard_error_code": None, "probability_status": "ok", "probability_error_code": None}
    return row | {k: v for k, v in changes.items() if "__" not in k}


def test_gated_condition_scan(spark, tmp_path):
    def scan(rows):
        path = tmp_path / f"{len(list(tmp_path.iterdir()))}.jsonl"
        path.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in rows))
        return expectations.scan_condition(spark, str(path), {"Entailed": 3, "Refuted": 2}, 3, 2, ("argmax", "direct"), "q4")

    golds = ["Entailed", "Refuted", "Entailed", "Refuted", "Entailed"]
    rows = [stage_row(i, g) for i, g in enumerate(golds)]
    found = scan(rows)
    assert {(r.sample_id, r.table_id, r.gold_label, r.hard_label) for r in found.collect()} == {(f"s{i}é", f"t{i // 2}", g, g) for i, g in enumerate(golds)}
    failures = {
        "metadata as hashed": {"metadata_sha256": "0"}, "hard_payload as hashed": {"hard_payload_sha256": "0"}, "not probability_payload as hashed": {"probability_payload_sha256": None},
        "not complete": {"hard_status": "failed"}, "complete is 1": {"probability_error_code": "x"}, "not whole": {"metadata__control": "none"}, "whole is 1": {"metadata__table_truncated": True},
        "not owned": {"owner_key": "other|full"}, "not agreeing": {"hard_payload__scored_label": "Refuted"}, "not by_method": {"hard_payload__hard_label_method": "other"}, "other gold_label is 1": {"metadata__gold_label": "?"}, "of 2 rows at most, not 3": {"metadata__table_id": "t9"},
    }
    for why, change in failures.items():
        with pytest.raises(ValueError, match=f"q4: .*{why}"):
            scan([stage_row(0, **change), *rows[1:]])
    with pytest.raises(ValueError, match="rows is 4, not 5"):
        scan(rows[:4])
    with pytest.raises(ValueError, match="an owner comes twice"):
        scan([*rows[:4], stage_row(2)])


# cubes and mappings


def test_cube_says_which_cases_are_whole(spark):
    rows = [(k, "p", c, float(i + 10 * k), "x") for k in range(6) for i, c in enumerate("abc")]
    rows = [r for r in rows if (r[0], r[2]) != (1, "b")] + [(2, "p", "a", 5.0, "x")]  # one lacks, one twice
    rows = [("q" if r[0] == 3 and r[2] == "c" else r[1]) and (r[0], "q" if r[0] == 3 and r[2] == "c" else r[1], *r[2:4], "y" if r[0] == 4 and r[2] == "a" else r[4]) for r in rows]
    rows += [(5, "p", "d", 1.0, "x"), (6, "p", "a", 1.0, "x"), (6, "p", "b", math.nan, "x"), (6, "p", "c", 1.0, "x")]
    frame = spark.createDataFrame(rows, "k int, page string, c string, v double, label string")
    found = {r.k: r for r in cubes.cube(frame, "k", "page", "c", ["a", "b", "c"], "v", ("label",)).collect()}
    assert [k for k in sorted(found) if found[k].complete] == [0]
    assert found[0]["values"] == [0.0, 1.0, 2.0]
    with pytest.raises(Exception, match="of case . don't match"):
        cubes.complete_cube(cubes.cube(frame, "k", "page", "c", ["a", "b", "c"], "v"), "k").collect()


LABELS = nested.LABELS


def test_mappings_must_be_bijections(spark):
    right = spark.createDataFrame(nested.MAPPINGS, "variant string, choice string, label string")
    assert {r.variant: r.choice_of for r in cubes.bijections(right, LABELS).collect()}["cycle_1"] == {"REFUTES": "A", "NOT ENOUGH INFO": "B", "SUPPORTS": "C"}
    for change in (("x", "A", "SUPPORTS"), ("original", "D", "SUPPORTS"), ("original", "A", "SUPPORTS"), ("original", "A", "OTHER")):
        with pytest.raises(Exception, match="no bijection"):
            cubes.bijections(right.unionByName(spark.createDataFrame([change], right.schema)), LABELS).collect()
    cell = lambda variant, scores, negative: spark.createDataFrame([(variant, scores, negative)], "variant string, scores map<string,double>, negative_label string")
    scores = {"A": 1.0, "B": 5.0, "C": 2.5}
    assert cubes.rescored(cell("original", scores, "REFUTES"), right, LABELS).first().margin == -4.0
    assert cubes.rescored(cell("cycle_1", scores, "REFUTES"), right, LABELS).first().margin == 1.5
    for wrong in (("none", scores, "REFUTES"), ("original", {"A": 1.0, "B": 2.0}, "REFUTES"), ("original", scores | {"D": 1.0}, "REFUTES"), ("original", scores, "SUPPORTS"), ("original", scores | {"B": math.inf}, "REFUTES"), ("original", scores, None)):
        with pytest.raises(Exception, match="can't be scored"):
            cubes.rescored(cell(*wrong), right, LABELS).collect()


def test_mapping_report_wants_equal_cases(spark):
    rows = [(v, c, c % 4, [float(c), float(c) + (1 if v == "a" else -1) + c % 3]) for v in "ab" for c in range(20)]
    frame = spark.createDataFrame(rows, "variant string, case_id int, page int, values array<double>")
    found = cubes.mapping_report(frame, ["h", "q"], {"r": ("h", "q")}, ("a", "b"), 200).first()
    assert found.difference == -2.0 and found.se == 0.0 and found.p == 0.0 and found.lower == found.upper == -2.0
    pages = [statistics.fmean(r[3][1] - r[3][0] for r in rows if r[0] == "a" and r[2] == p) for p in range(4)]
    assert abs(found.first - statistics.fmean(pages)) < 1e-12 and found.direction_stable == (found.first * found.second > 0)
    for broken in (frame.where("NOT (variant = 'b' AND case_id = 3)"), frame.withColumn("page", F.when(F.col("variant") == "b", 0).otherwise(F.col("page")))):
        with pytest.raises(ValueError, match="other cases or pages"):
            cubes.mapping_report(broken, ["h", "q"], {"r": ("h", "q")}, ("a", "b"), 50)


def test_scale_report_by_hand(spark):
    rng = np.random.default_rng(2)
    conditions = [f"{m}_{r}" for m in "xy" for r in ("f", "q")]
    values = rng.normal(size=(40, 4)) + [0, 0.4, 0, -0.2]
    rows = [(i, i % 8, values[i].tolist()) for i in range(40)]
    frame = spark.createDataFrame(rows, "case_id int, page int, values array<double>")
    report = lambda seed: cubes.scale_report(frame, conditions, ["x", "y"], {"q": ("q", "f")}, [("x", "y")], 400, seed)
    found = {(r.weighting, r.endpoint): r for r in report(1).collect()}
    page = np.arange(40) % 8
    delta = [values[:, 1] - values[:, 0], values[:, 3] - values[:, 2]]
    balanced = lambda d: np.mean([d[page == p].mean() for p in range(8)])
    sd = [values[:, k].std(ddof=1) for k in (0, 2)]
    expected = {("page_balanced", "standardised"): balanced(delta[0]) / sd[0] - balanced(delta[1]) / sd[1], ("case_weighted", "standardised"): delta[0].mean() / sd[0] - delta[1].mean() / sd[1], ("page_balanced", "directional"): balanced(np.sign(delta[0]) / 2) - balanced(np.sign(delta[1]) / 2)}
    for key, value in expected.items():
        assert abs(found[key].estimate - value) < 1e-9
    for r in found.values():
        assert r.draws == 400 and r.lower < r.estimate < r.upper and abs(r.p - math.erfc(abs(r.estimate / r.se) / math.sqrt(2))) < 1e-9 and r.p <= r.adjusted <= 1
    family = cubes.joint_family({"one": report(1), "two": report(2)}).collect()
    assert len(family) == 8
    for weighting in ("page_balanced", "case_weighted"):
        tests = sorted((r.p, r.name, r.adjusted) for r in family if r.weighting == weighting)
        raised = np.maximum.accumulate([(4 - i) * p for i, (p, _, _) in enumerate(tests)])
        assert np.allclose([t[2] for t in tests], np.minimum(1, raised))


# inventories


def test_large_files_are_streamed_and_links_refused(spark, tmp_path):
    root = tmp_path / "tree"
    (root / "a b").mkdir(parents=True)
    for i, n in enumerate((0, 1, 4095, 4096, 100_000)):
        (root / ("a b" if i % 2 else "") / f"f{i}.bin").write_bytes(os.urandom(n))
    expected = {str(p.relative_to(root)): (p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in root.rglob("*.bin")}
    for whole, chunk in ((1 << 30, 1), (4096, 1000), (0, 4096), (0, 7777)):
        got = {r.path: (r.bytes, r.sha256) for r in readers.inventory(spark, str(root), whole=whole, chunk=chunk).collect()}
        assert got == expected
    with (root / "hole.bin").open("wb") as f:
        f.truncate(3 << 30)
    huge = {r.path: r for r in readers.inventory(spark, str(root)).where("path = 'hole.bin'").collect()}["hole.bin"]
    state = hashlib.sha256()
    for _ in range(3 << 6):
        state.update(bytes(1 << 24))
    assert (huge.bytes, huge.sha256) == (3 << 30, state.hexdigest())
    (root / "hole.bin").unlink()
    (root / "link.bin").symlink_to(root / "f0.bin")
    with pytest.raises(Exception, match="symbolic link"):
        readers.inventory(spark, str(root)).collect()
