"""Gates, bundles, sets and file scans: every failure by a change of one row."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.operators import audit, gates, selection
from tandem.sources import bundles, readers

PAYLOAD = "struct<prompt:string,tokens:string,scores:double>"
EXPORT = f"owner_key string, control string, page int, hard_status string, hard_payload {PAYLOAD}, probability_status string, probability_payload {PAYLOAD}"
CONTROLS = {"full": 3, "no_evidence": 1}


def export_rows():
    return [(f"o{i}", "full" if i < 3 else "no_evidence", i % 2, "ok", (f"p{i}", f"t{i}", float(i)), "ok", (f"p{i}", f"t{i}", float(i))) for i in range(4)]


def broken_checks(spark, left, right):
    gate = gates.full_pair_gate(*(spark.createDataFrame(x, EXPORT) for x in (left, right)), ["page"], ["prompt", "tokens"], CONTROLS)
    return {r["check"]: r.broken for r in gate.collect() if r.broken}


def test_each_check_of_a_pair(spark):
    rows = export_rows()
    assert broken_checks(spark, rows, rows) == {}
    change = lambda i, at, value: [(*r[:at], value, *r[at + 1 :]) if k == i else r for k, r in enumerate(rows)]
    p = rows[0][4]
    cases = [
        (rows[1:], {"owner_set": 1, "rows_of_full": 1}), (rows + rows[:1], {"owner_once": 1}), (change(0, 1, "no_evidence"), {"same_control": 1}), (change(0, 2, None), {"same_page": 1}),
        (change(0, 3, "failed"), {"hard_complete": 1}), (change(0, 5, None), {"probability_complete": 1}), (change(0, 4, ("x", *p[1:])), {"hard_prompt": 1}), (change(0, 6, (p[0], "x", p[2])), {"probability_tokens": 1}),
        (change(0, 4, (*p[:2], 9.0)), {"one_pass": 1}), (change(0, 4, None), {"hard_complete": 1, "hard_prompt": 1, "hard_tokens": 1, "one_pass": 1}),
    ]
    for right, expected in cases:
        assert broken_checks(spark, rows, right) == expected
    other = [(*r[:1], "other", *r[2:]) if k == 3 else r for k, r in enumerate(rows)]
    assert broken_checks(spark, other, other) == {"known_control": 1, "rows_of_no_evidence": 1}
    with pytest.raises(ValueError, match="owner_set 1, rows_of_full 1"):
        gates.require(gates.full_pair_gate(spark.createDataFrame(rows, EXPORT), spark.createDataFrame(rows[1:], EXPORT), ["page"], ["prompt"], CONTROLS))
    gates.require(gates.full_pair_gate(spark.createDataFrame(rows, EXPORT), spark.createDataFrame(rows, EXPORT), ["page"], ["prompt"], CONTROLS))


def test_each_check_of_a_cell(spark):
    units = spark.createDataFrame([(f"o{i}", v, f"{v}{i}") for i in range(3) for v in "ab"], "owner_key string, variant string, prompt string")
    design = spark.createDataFrame([(c, v) for c in "xy" for v in "ab"], "condition string, variant string")
    rows = [(c, v, f"o{i}", "ok", "ok", f"{v}{i}", f"{v}{i}") for c in "xy" for v in "ab" for i in range(3)]
    names = "condition string, variant string, owner_key string, hard_status string, probability_status string, hard_prompt string, probability_prompt string"
    gate = lambda r: {(x.condition, x.variant): x for x in gates.cell_gate(spark.createDataFrame(r, names), units, design).collect()}
    assert all(x.passes and x.owners == 3 for x in gate(rows).values()) and len(gate(rows)) == 4
    first = rows[0]
    for change, field in ((rows[1:], "missing"), (rows + [(*first[:2], "o9", *first[3:])], "extra"), (rows + rows[:1], "repeated"), ([(*first[:4], "failed", *first[5:]), *rows[1:]], "failed"), ([(*first[:5], "b0", *first[6:]), *rows[1:]], "other_prompts"), ([(*first[:6], None), *rows[1:]], "other_prompts")):
        found = gate(change)
        assert found["x", "a"][field] == 1 and not found["x", "a"].passes and all(x.passes for k, x in found.items() if k != ("x", "a"))
    absent = gate([r for r in rows if r[:2] != ("y", "b")])["y", "b"]
    assert (absent.owners, absent.missing, absent.passes) == (0, 3, False)
    strange = gate([*rows, ("z", "a", "o0", "ok", "ok", "a0", "a0")])["z", "a"]
    assert (strange.in_design, strange.extra, strange.passes) == (False, 1, False)


def test_bundles_bind_results_and_sources(spark, tmp_path):
    results = spark.createDataFrame([("b", 2.5), ("a", None)], "name string, value double")
    source = lambda digest: spark.createDataFrame([("gate", "gate.json", digest)], "role string, path string, sha256 string")
    good = hashlib.sha256(b"x").hexdigest()
    for bad in (source("abc"), source(good).where("false"), source(good).withColumn("role", F.lit(""))):
        with pytest.raises(ValueError, match="needs sources"):
            bundles.write_bundle(results, f"{tmp_path}/no", ["name"], bad, {})
    assert not (tmp_path / "no").exists()
    folder = f"{tmp_path}/report"
    told = bundles.write_bundle(results, folder, ["name"], source(good), {"draws": "10"})
    assert len(told["files"]) == 3 and all(len(d) == 64 for d in [*told["files"].values(), told["manifest_sha256"]])
    read = lambda **more: sorted(map(tuple, bundles.read_bundle(spark, folder, "name string, value double", **more).collect()))
    assert read() == read(sources=source(good)) == [("a", None), ("b", 2.5)]
    assert "| b | 2.5 |" in next((tmp_path / "report/analysis").glob("part-*")).read_text()
    with pytest.raises(ValueError, match="source gate has changed"):
        read(sources=source(hashlib.sha256(b"y").hexdigest()))
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        bundles.write_bundle(results, folder, ["name"], source(good), {})
    part = next((tmp_path / "report/results").glob("part-*.json"))
    kept = part.read_text()

    def changed(file, text):
        file.write_text(text)
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)

    changed(part, kept.replace("2.5", "2.6"))
    with pytest.raises(ValueError, match=r"results/part-.*isn't what"):
        read()
    changed(part, kept)
    assert len(read()) == 2
    sealed = next((tmp_path / "report/manifest").glob("part-*"))
    changed(sealed, json.dumps(told | {"manifest_sha256": good}))
    with pytest.raises(ValueError, match="manifest isn't what"):
        read()
    changed(sealed, json.dumps(told))
    (tmp_path / "report/results/added.json").write_text("{}")
    with pytest.raises(ValueError, match="results/added.json isn't what"):
        read()


def test_second_set_avoids_clusters_of_the_first(spark):
    rows = spark.createDataFrame([(i, i // 3, "ab"[i % 2]) for i in range(300)], "k int, page int, s string")
    found = selection.two_sets(rows, "k", "page", "s", ({"a": 10, "b": 4}, {"a": 30, "b": 20}), 5).collect()
    sizes = {}
    for r in found:
        sizes[r.part, r.s] = sizes.get((r.part, r.s), 0) + 1
    assert sizes == {("pilot", "a"): 10, ("pilot", "b"): 4, ("discovery", "a"): 30, ("discovery", "b"): 20}
    pages = {p: {r.page for r in found if r.part == p} for p in ("pilot", "discovery")}
    assert not pages["pilot"] & pages["discovery"]
    for quotas, why in ((({"a": 200}, {"a": 1}), "pilot: stratum a has 150"), (({"a": 100}, {"a": 100}), "discovery: stratum a"), (({"c": 1}, {"a": 1}), "pilot: stratum c has 0")):
        with pytest.raises(ValueError, match=why):
            selection.two_sets(rows, "k", "page", "s", quotas, 5)


def test_roles_are_sorted_by_three_keys(spark):
    rows = [("r1", "m2", "a", None), ("r2", "m1", "b", "x"), ("r1", None, "z", "y"), ("r3", "m1", "a", "x"), ("r1", "m2", "a", "b")]
    frame = spark.createDataFrame(rows, "source_role string, model_key string, route string, scope string")
    assert [tuple(r) for r in selection.of_roles(frame, ["r1", "r2"]).collect()] == [rows[2], rows[1], rows[0], rows[4]]


def test_layers_overlap_but_labels_do_not(spark):
    frame = spark.createDataFrame([(i,) for i in range(12)], "k int")
    found = audit.layered(frame, {"parity": F.col("k") % 2, "large": F.when(F.col("k") > 8, "yes").otherwise("no")})
    assert {(r.dimension, r.label): r["count"] for r in found.groupBy("dimension", "label").count().collect()} == {("parity", "0"): 6, ("parity", "1"): 6, ("large", "yes"): 3, ("large", "no"): 9}
    assert isinstance(found.schema["label"].dataType, T.StringType)


def test_files_must_hold_the_same_rows(spark, tmp_path):
    def folder(*files):
        path = tmp_path / str(len(list(tmp_path.iterdir())))
        path.mkdir()
        for i, rows in enumerate(files):
            (path / f"v{i}_test.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
        (path / "other.jsonl").write_text("not read")
        return f"{path}/*_test.jsonl"

    rows = [{"id": f"s{i}", "claim": f"c{i}", "model": "left out"} for i in range(3)]
    other = [r | {"model": "another"} for r in rows[::-1]]
    scan = lambda glob, **more: readers.scan_files(spark, glob, "id string, claim string", "id", 2, **more)
    found = scan(folder(rows, other), rows_each=3)
    assert sorted(map(tuple, found.collect())) == [("s0", "c0"), ("s1", "c1"), ("s2", "c2")] and found.columns == ["id", "claim"]
    for glob, more, why in ((folder(rows), {}, "1 files"), (folder(rows, other[1:]), {"rows_each": 3}, "2 files of 2 to 3 rows"), (folder(rows, other, other), {}, "3 files")):
        with pytest.raises(ValueError, match=why):
            scan(glob, **more)
    for second in (other[1:], other[:2] + [rows[0] | {"claim": "changed"}], other + other[:1], other[:2] + [{"claim": "c0"}]):
        with pytest.raises(Exception, match="the files differ at"):
            scan(folder(rows, second)).collect()
