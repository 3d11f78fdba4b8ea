"""Readers, sinks, releases, schema checks and the store, on files that the tests write."""

import csv
import hashlib
import io
import json
import sqlite3
import tarfile

import pytest
from pyspark.sql import functions as F

from tandem.functions import schema, scalars
from tandem.operators import audit, cases, units
from tandem.plans import studies
from tandem.sources import readers, releases, sinks
from tandem.streaming import store


def lines(path, rows):
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return str(path)


def test_line_files(spark, tmp_path):
    good = lines(tmp_path / "a.jsonl", [{"k": 1, "t": "ü"}, {"k": 2, "t": None}])
    assert sorted(tuple(r) for r in readers.read_jsonl(spark, good, "k int, t string").collect()) == [(1, "ü"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"k": 1}\n\n{"k": 2}\n')
    with pytest.raises(ValueError, match="blank"):
        readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "k int")
    assert readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "k int", blank_lines=True).count() == 2
    (tmp_path / "c.jsonl").write_text('{"k": 1}\n{"k": \n')
    with pytest.raises(Exception):
        readers.read_jsonl(spark, str(tmp_path / "c.jsonl"), "k int").collect()
    (tmp_path / "d.json").write_text('{\n "k": 5\n}')
    assert readers.read_object(spark, str(tmp_path / "d.json"), "k int").first().k == 5


def test_claims_tables_and_manifests(spark, tmp_path):
    (tmp_path / "claims.json").write_text(json.dumps({"t1.csv": [["a", "b"], [1, 0], "cap"], "t2.csv": [["c"], [1], ""]}))
    found = sorted(tuple(r) for r in readers.read_claims(spark, str(tmp_path / "claims.json")).collect())
    assert found == [("t1.csv", 0, "a", 1, "cap"), ("t1.csv", 1, "b", 0, "cap"), ("t2.csv", 0, "c", 1, "")]
    (tmp_path / "bad.json").write_text(json.dumps({"t": [["a", "b"], [1], ""]}))
    with pytest.raises(Exception, match="differ in number"):
        readers.read_claims(spark, str(tmp_path / "bad.json")).collect()
    raw = 'name# points \n"a#b"#2\n"two\nlines"#""\n'
    folder = tmp_path / "tables"
    folder.mkdir()
    (folder / "t1.csv").write_text(raw)
    rows = list(csv.reader(io.StringIO(raw, newline=""), delimiter="#"))
    assert tuple(readers.read_serialised_tables(spark, str(folder)).first()) == ("t1.csv", "\n".join(f"Row {i}: " + " | ".join(r) for i, r in enumerate(rows)), 3)
    (folder / "t2.csv").write_text("a#b\n\nc#d\n")
    with pytest.raises(Exception, match="empty row"):
        readers.read_serialised_tables(spark, str(folder)).collect()
    row = {"sample_id": "t1:0", "table_id": "t1", "claim_index": 0, "label": 1, "path": "tables/t1.csv"}
    assert readers.read_manifest(spark, lines(tmp_path / "m.jsonl", [row])).count() == 1
    for change in ({"sample_id": "t1:1"}, {"path": "../x"}, {"path": "/x"}, {"path": "a/../../x"}, {"path": None}):
        with pytest.raises(Exception, match="key that its row|path that leaves"):
            readers.read_manifest(spark, lines(tmp_path / "n.jsonl", [row | change])).collect()


def test_ids_and_splits(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("a\nb\nc\n")
    ids = readers.read_ids(spark, str(tmp_path / "ids.txt"))
    assert sorted(r.id for r in ids.collect()) == ["a", "b", "c"]
    quartets = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", 4)], "case_id string, v int")
    assert readers.read_split(ids, quartets, 3).count() == 3
    for n, some in ((4, quartets), (3, quartets.where("v > 1"))):
        with pytest.raises(ValueError, match="differ in number"):
            readers.read_split(ids, some, n)
    for text in ("a\na\n", "a\n \n"):
        (tmp_path / "bad.txt").write_text(text)
        with pytest.raises(ValueError, match="empty or repeated"):
            readers.read_ids(spark, str(tmp_path / "bad.txt"))


def test_agreement_of_files_and_fields(spark):
    rows = [("x", "1", "f"), ("x", "1", "g"), ("y", "1", "f"), ("z", "1", "f"), ("z", "2", "g")]
    found = readers.agreeing(spark.createDataFrame(rows, "k string, c string, f string"), "k", F.col("c"), F.col("f"), 2)
    assert sorted(tuple(r) for r in found.collect()) == [("x", True, True), ("y", False, True), ("z", True, False)]
    frame = spark.createDataFrame([(1, None), (None, 2), (3, 3), (None, None)], "a int, b int")
    assert [r[0] for r in frame.select(readers.first_of("a", "b")).collect()] == [1, 2, 3, None]
    with pytest.raises(Exception, match="differ"):
        spark.createDataFrame([(1, 2)], "a int, b int").select(readers.first_of("a", "b")).collect()


def test_inventories(spark, tmp_path):
    root = tmp_path / "root"
    (root / "sub").mkdir(parents=True)
    (root / "a.txt").write_bytes(b"one")
    (root / "sub" / "b.txt").write_bytes(b"two")
    (root / "__pycache__").mkdir()
    (root / "__pycache__" / "c").write_bytes(b"x")
    first = {r.path: (r.bytes, r.sha256) for r in readers.inventory(spark, str(root)).collect()}
    assert first == {"a.txt": (3, hashlib.sha256(b"one").hexdigest()), "sub/b.txt": (3, hashlib.sha256(b"two").hexdigest())}
    recorded = spark.createDataFrame([(k, v[1]) for k, v in first.items()] + [("gone", "x")], "path string, sha256 string")
    (root / "a.txt").write_bytes(b"ONE")
    (root / "new").write_bytes(b"n")
    now = spark.read.format("binaryFile")  # a fresh listing
    assert now is not None
    found = {tuple(r) for r in readers.inventory_differences(readers.inventory(spark, str(root)), recorded).collect()}
    assert found == {("a.txt", "changed"), ("gone", "removed"), ("new", "added")}


def test_frozen_trees_configs_and_context_versions(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    (root / "a.txt").write_bytes(b"one")
    recorded = spark.createDataFrame([("a.txt", hashlib.sha256(b"one").hexdigest())], "path string, sha256 string")
    assert readers.frozen(spark, str(root), recorded, r"\.key$").count() == 1
    (root / "b.key").write_bytes(b"k")
    with pytest.raises(ValueError, match="may not be here"):
        readers.frozen(spark, str(root), recorded, r"\.key$")
    with pytest.raises(ValueError, match="is added"):
        readers.frozen(spark, str(root), recorded, r"\.pem$")
    (tmp_path / "c.json").write_text('{"seed": 7, "name": "x"}')
    assert tuple(readers.read_config(spark, str(tmp_path / "c.json"), "seed int, name string").first()) == (7, "x")
    for text in ('{"seed": 7}', '{"seed": 7, "name": "x", "more": 1}', '{"seed": 7, "name": null}'):
        (tmp_path / "d.json").write_text(text)
        with pytest.raises(ValueError, match="other fields"):
            readers.read_config(spark, str(tmp_path / "d.json"), "seed int, name string")
    new = {"sample_id": "1", "query_identity_sha256": "q", "hard_status": "ok", "probability_status": "error", "hard_payload": {"analysis_context_type": "gold", "bcu": True, "context_identity_sha256": "c", "target_new": "True"}}
    old = {"sample_id": "2", "query_identity_sha256": "q", "hard_status": "ok", "probability_status": "ok", "analysis_context_type": "irrelevant", "context_identity_sha256": "d", "probability_payload": {"ccu": 0.5, "ccu_target_label": "False"}}
    found = {r.sample_id: r for r in readers.read_contexts(spark, lines(tmp_path / "x.jsonl", [new, old])).collect()}
    assert (found["1"].analysis_context_type, found["1"].bcu, found["1"].probability_ok) == ("gold", True, False)
    assert (found["2"].analysis_context_type, found["2"].ccu, found["2"].target_new, found["2"].hard_ok) == ("irrelevant", 0.5, None, True)
    with pytest.raises(Exception, match="differ"):
        readers.read_contexts(spark, lines(tmp_path / "y.jsonl", [new | {"target_new": "False"}])).collect()


def archive(path, members):
    with tarfile.open(path, "w:gz") as tar:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return str(path)


def test_archives_and_databases(spark, tmp_path):
    path = archive(tmp_path / "a.tar.gz", {"x/r.jsonl": b"one\ntwo\n", "x/note.md": b"no"})
    assert sorted(tuple(r) for r in readers.read_archive(spark, path).collect()) == [("a.tar.gz", "x/r.jsonl", 0, "one"), ("a.tar.gz", "x/r.jsonl", 1, "two")]
    for name, data, word in (("../r.jsonl", b"a\n", "unsafe"), ("r.jsonl", b"a SECRET\n", "forbidden")):
        bad = archive(tmp_path / f"{word}.tar.gz", {name: data})
        with pytest.raises(Exception, match=word):
            readers.read_archive(spark, bad, forbidden=(b"SECRET",)).collect()
    with sqlite3.connect(tmp_path / "s.db") as db:
        db.execute("CREATE TABLE u (control TEXT, n INTEGER, x REAL)")
        db.executemany("INSERT INTO u VALUES (?, ?, ?)", [("full", 1, 0.5), ("full", None, 1.5), ("none", 3, None)])
    db.close()
    found = readers.read_sqlite(spark, str(tmp_path / "s.db"), "SELECT control, count(*), sum(x) FROM u GROUP BY control", "control string, n long, x double")
    assert sorted(tuple(r) for r in found.collect()) == [("full", 2, 2.0), ("none", 1, None)]


def test_canonical_json(spark):
    frame = spark.createDataFrame([("é", 1, None)], "b string, a int, c string").select(F.struct("b", "a", "c").alias("s"))
    assert frame.select(readers.canonical_json(F.col("s"))).first()[0] == '{"a":1,"b":"é","c":null}'


def test_schema_checks(spark):
    frame = spark.createDataFrame([(1, ("t", 2), [("p",)])], "k int, s struct<Text:string,n:int>, a array<struct<prompt:string>>")
    assert set(schema.forbidden_fields(frame, {"text", "prompt"})) == {"s.Text", "a.prompt"}
    with pytest.raises(ValueError, match="may not leave"):
        schema.reject_fields(frame, {"text"})
    assert schema.only_fields(frame, ["k"]).columns == ["k"]
    with pytest.raises(ValueError, match="lack"):
        schema.only_fields(frame, ["k", "zz"])
    renamed = schema.rename_fields(frame, {"Text": "t", "prompt": "q", "k": "key"})
    assert renamed.first().asDict(True) == {"key": 1, "s": {"t": "t", "n": 2}, "a": [{"q": "p"}]}


def test_publishing(spark, tmp_path):
    frame = spark.createDataFrame([(2, "b", "x"), (1, "a", "x")], "k int, v string, text string")
    with pytest.raises(ValueError, match="may not leave"):
        sinks.publish(frame, str(tmp_path / "p"), ["k"])
    told = sinks.publish(frame, str(tmp_path / "p"), ["k"], ["k", "v"]).collect()
    assert told and all(len(r.sha256) == 64 for r in told) and (tmp_path / "p" / "_SUCCESS").exists()
    with pytest.raises(Exception, match="exist"):
        sinks.publish(frame, str(tmp_path / "p"), ["k"], ["k", "v"])
    plain = frame.drop("text")
    assert sinks.publish_idempotently(plain, str(tmp_path / "i"), ["k"]) == "written"
    assert sinks.publish_idempotently(plain.orderBy("k"), str(tmp_path / "i"), ["k"]) == "unchanged"
    for other in (plain.where("k = 1"), plain.union(plain.where("k = 1")), plain.withColumn("v", F.lit("z"))):
        with pytest.raises(ValueError, match="other rows"):
            sinks.publish_idempotently(other, str(tmp_path / "i"), ["k"])
    assert tuple(sinks.content_digest(plain).first()) == tuple(sinks.content_digest(plain.orderBy("k")).first())


def test_exports_and_reports(spark, tmp_path):
    stored = spark.createDataFrame([("a", "hard", "ok"), ("a", "probability", "ok"), ("b", "hard", "ok")], "owner_key string, stage string, status string")
    registered = spark.createDataFrame([("a",), ("b",)], "owner_key string")
    with pytest.raises(ValueError, match="not complete"):
        sinks.export_complete(stored, registered, str(tmp_path / "e"), "owner_key", ["hard", "probability"])
    assert sinks.export_complete(stored, registered, str(tmp_path / "e"), "owner_key", ["hard"]).count()
    frame = spark.createDataFrame([("m", 0.5, None), ("n", None, "x")], "name string, a double, b string")
    sinks.metrics_csv(frame, str(tmp_path / "c"), ["name", "a", "b"])
    assert "".join(p.read_text() for p in (tmp_path / "c").glob("part-*")) == "name,a,b\nm,0.5,\nn,,x\n"
    assert sinks.markdown(frame, ["name"]).first()[0] == "| name | a | b |\n|---|---|---|\n| m | 0.5 |  |\n| n |  | x |"


def condition(spark, name, scores, gold="Y"):
    return spark.createDataFrame([(name, f"full:{i}", "full", i // 4, "p", i % 4, gold, "N", s, "secret text") for i, s in enumerate(scores)], "condition string, owner_key string, control string, case_id int, cluster_id string, cell_index int, gold string, prediction string, score double, claim string")


def test_paired_release(spark, tmp_path):
    a, b = condition(spark, "f", [0.1, 0.2, 0.3, 0.4, 0.5]), condition(spark, "q", [0.2, 0.2, 0.1, 0.9, 0.7])
    (tmp_path / "source.json").write_text("{}")
    sources = releases.source_digests(spark, [str(tmp_path / "source.json")])
    records = releases.aligned_records(a.unionByName(b), 2, releases.CELL_FIELDS)
    folder = str(tmp_path / "r")
    told = releases.release(records, folder, ["condition", "owner_key"], sources)
    assert {r.kind for r in told.collect()} == {"record", "source"}
    rows = [json.loads(line) for p in (tmp_path / "r" / "records").glob("part-*") for line in p.read_text().splitlines()]
    assert len(rows) == 10 and set(rows[0]) <= set(releases.CELL_FIELDS) and "secret" not in json.dumps(rows)
    releases.verify_release(spark, folder, sources)
    read = releases.read_release(spark, folder, "condition string, owner_key string, case_id int, cell_index int, score double", ["f", "q"])
    assert sorted((r.condition, r.owner_key, r.score) for r in read.collect())[0] == ("f", "full:0", 0.1) and read.count() == 10
    with pytest.raises(ValueError, match="the release holds"):
        releases.read_release(spark, folder, "condition string", ["f"])
    with pytest.raises(ValueError, match="may not leave"):
        releases.aligned_records(a.unionByName(b), 2, [*releases.CELL_FIELDS, "claim"])
    with pytest.raises(ValueError, match="owner_set"):
        releases.aligned_records(a.unionByName(b.where("owner_key <> 'full:2'")), 2, releases.CELL_FIELDS)
    with pytest.raises(ValueError, match="same_gold"):
        releases.aligned_records(a.unionByName(condition(spark, "q", [0.1] * 5, "N")), 2, releases.CELL_FIELDS)
    (tmp_path / "source.json").write_text("{1}")
    with pytest.raises(ValueError, match="source source.json"):
        releases.verify_release(spark, folder, releases.source_digests(spark, [str(tmp_path / "source.json")]))
    part = next((tmp_path / "r" / "records").glob("part-*"))
    for crc in (tmp_path / "r" / "records").glob(".*.crc"):
        crc.unlink()
    part.write_text(part.read_text().replace("0.9", "0.8"))
    with pytest.raises(ValueError, match="record part-"):
        releases.verify_release(spark, folder)


def test_subset_release_and_contexts(spark):
    both = condition(spark, "f", [0.1] * 8).unionByName(condition(spark, "q", [0.2] * 8))
    ids = spark.createDataFrame([(1,)], "case_id int")
    assert releases.aligned_records(both, 2, releases.CELL_FIELDS, ids).count() == 8
    with pytest.raises(ValueError, match="ids without rows"):
        releases.aligned_records(both, 2, releases.CELL_FIELDS, spark.createDataFrame([(1,), (9,)], "case_id int"))
    left = spark.createDataFrame([(1, "q", "gold", "t", 0.5), (2, "q", "irrelevant", "t", 0.1)], "sample_id int, query string, kind string, target string, use double")
    right = left.withColumn("target", F.when(F.col("sample_id") == 2, "other").otherwise(F.col("target")))
    found = releases.context_records({"c": (left, right)}, ["query", "kind"], "target", "kind", ["use"])
    assert sorted(r.sample_id for r in found.collect()) == [1, 2]
    for bad in (right.withColumn("target", F.lit("other")), right.withColumn("query", F.lit("z")), right.where("sample_id = 1")):
        with pytest.raises(Exception, match="target_differs|identity_differs|sample_missing"):
            releases.context_records({"c": (left, bad)}, ["query", "kind"], "target", "kind", ["use"]).collect()


def test_sealed_results(spark, tmp_path):
    frame = spark.createDataFrame([("b", 2.0), ("a", 1.0)], "k string, v double")
    assert len(releases.seal(frame, str(tmp_path / "s"), ["k"])) == 64
    assert [tuple(r) for r in releases.unsealed(spark, str(tmp_path / "s"), "k string, v double").collect()] == [("a", 1.0), ("b", 2.0)]
    for p in [*(tmp_path / "s" / "result").glob("part-*"), *(tmp_path / "s" / "result").glob(".*.crc")]:
        p.write_text(p.read_text().replace("1.0", "1.5")) if p.name.startswith("part-") else p.unlink()
    with pytest.raises(ValueError, match="digest"):
        releases.unsealed(spark, str(tmp_path / "s"), "k string, v double")


def test_store_identity_stream_and_resumption(spark, tmp_path):
    path = str(tmp_path / "id")
    assert [store.bind_identity(spark, path, {"model": "m", "split": "s"}) for _ in range(2)] == ["bound", "known"]
    with pytest.raises(ValueError, match="another run"):
        store.bind_identity(spark, path, {"model": "n", "split": "s"})
    schema_ = "owner_key string, stage string, status string, payload_sha256 string"
    inbox = tmp_path / "in"
    for n, rows in enumerate(([("a", "hard", "ok", "1"), ("b", "hard", "ok", "1")], [("a", "hard", "ok", "1"), ("b", "hard", "ok", "2"), ("c", "hard", "ok", "3")])):
        spark.createDataFrame(rows, schema_).coalesce(1).write.mode("append").parquet(str(inbox))
        store.stream_into(spark.readStream.schema(schema_).parquet(str(inbox)), str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    assert sorted(tuple(r)[:1] for r in spark.read.parquet(str(tmp_path / "store")).collect()) == [("a",), ("b",), ("c",)]
    assert [r.owner_key for r in spark.read.parquet(str(tmp_path / "store-conflicts")).collect()] == ["b"]


def test_small_operators(spark):
    frame = spark.createDataFrame([(1, 5.0), (1, 7.0), (2, 1.0)], "g int, v double")
    assert sorted(tuple(r) for r in cases.rank_within(frame, ["g"], [F.desc("v")]).collect()) == [(1, 5.0, 2), (1, 7.0, 1), (2, 1.0, 1)]
    shown, source = (spark.createDataFrame(rows, "k string, v double") for rows in ([("a", 1.0), ("b", 2.0), ("c", 3.0)], [("a", 1.0 + 1e-13), ("b", 2.1)]))
    assert {r.k: r.agrees for r in audit.within_tolerance(shown, source, ["k"], "v").collect()} == {"a": True, "b": False, "c": False}
    assert spark.range(1).select(scalars.choice_grammar(["A", "B"])).first()[0] == 'root ::= "A" | "B"'
    assert units.unique_row(frame, F.col("g") == 2).first().v == 1.0
    for condition_ in (F.col("g") == 1, F.col("g") == 3):
        with pytest.raises(ValueError, match="row"):
            units.unique_row(frame, condition_)
    with pytest.raises(Exception, match="unsupported negative label"):
        frame.select(units.label_stratum(F.lit("X"))).collect()
    assert spark.range(1).select(scalars.escaped(F.lit(r"a_b\{~^$#")), scalars.signed(F.lit(-0.0456), 2), scalars.signed(F.lit(3.0), 1)).first()[:] == (r"a\_b\textbackslash{}\{\textasciitilde{}\textasciicircum{}\$\#", "-0.05", "+3.0")


def test_more_draws_than_the_queries(spark, sf_dir):
    for found in (studies.scale_bootstrap(spark, sf_dir, 1000).collect(), studies.joint_bootstrap(spark, sf_dir, 1000).collect()):
        assert all(r.valid_draws == 1000 for r in found)
