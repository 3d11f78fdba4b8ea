"""Operator 13 against a plain tree and its SQL twin."""

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tandem.llm import manifest

from .helpers import awkward, documents, words


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = (row.doc_id, row.source, row.lang, row.n_chars, text)
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(leaves):
    rows = [leaves]
    while len(rows[-1]) > 1:
        rows.append([h(*rows[-1][i : i + 3]) for i in range(0, len(rows[-1]), 3)])
    return rows


def way(rows, i):
    for row in rows[:-1]:
        g = i - i % 3
        yield row[g:i], row[i + 1 : g + 3]
        i //= 3


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    keys = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    sources = {s: sorted(by[s], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf_of(r, r.text))) for s in keys}
    trees = {s: tree([leaf_of(r, r.text) for r in sources[s]]) for s in keys}
    top = tree([trees[s][-1][0] for s in keys])
    out = []
    for k, s in enumerate(keys):
        for i, r in enumerate(sources[s]):
            path = [*way(trees[s], i), *way(top, k)]
            changed = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 2 == 0
            fold = leaf_of(r, r.text.replace("\n", "") if changed else r.text)
            for left, right in path:
                fold = h(*left, fold, *right)
            out.append((r.doc_id, trees[s][0][i], trees[s][-1][0], top[-1][0], h(*(x for pair in path for side in pair for x in side)), fold, fold == top[-1][0]))
    return sorted(out, key=str)


def proved(docs):
    return sorted((tuple(r) for r in manifest.proofs(docs).collect()), key=str)


def twin(docs):
    con = duckdb.connect()
    con.register("documents", docs.select(*manifest.FIELDS).toArrow())
    return sorted(con.execute(manifest.ORACLE).fetchall(), key=str)


@pytest.mark.parametrize("start", range(7))
@pytest.mark.parametrize("count", [1, 2, 3, 4, 5, 9, 10, 26, 27, 28, 80])
def test_a_mountain_range_holds_whole_nodes_only(start, count):
    leaves = [h(str(i)) for i in range(start, start + count)]
    done, peaks = manifest.mountain(start, leaves)
    rows = tree([h(str(i)) for i in range(243)])
    assert all(rows[level][i] == digest for level, i, digest in [*done, *peaks])
    spans = sorted((i * 3**level, (i + 1) * 3**level) for level, i, _ in peaks)
    assert spans[0][0] == start and spans[-1][1] == start + count and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    whole = {(level, i) for level in range(5) for i in range(243) if start <= i * 3**level and (i + 1) * 3**level <= start + count}
    assert {x[:2] for x in done} == {x for x in whole if x[0]}


def test_odd_rows_and_sizes_around_powers(spark):
    rng = random.Random(1)
    rows = []
    for k, n in enumerate([1, 2, 3, 4, 9, 10, 27, 28, 82]):
        rows += [(None if i == 5 else 1000 * k + i, None if i == 3 else words(rng, 4) + "\n" * (i % 3) + "é", "en", k) for i in range(n)]
    docs = documents(spark, [r[:3] for r in rows] + awkward()).withColumn("source", F.when(F.col("doc_id").isNull(), None).otherwise((F.col("doc_id") / 1000).cast("int").cast("string")))
    expected = brute(docs.collect())
    assert proved(docs) == expected == twin(docs)
    assert proved(docs.repartition(9).withColumns({"key": F.lit(1), "part": F.lit(2), "digest": F.lit("x")})) == expected


def test_repeated_rows_and_hot_source(spark):
    docs = documents(spark, [(4, "same\ntext", "en")] * 500 + [(i, f"t\n{i}", "en") for i in range(700)])
    got = proved(docs)
    assert got == brute(docs.collect()) and len({r[4] for r in got if r[0] == 4}) > 1


def test_small_tables(spark):
    assert proved(documents(spark, [])) == []
    one = documents(spark, [(1, "a\nb", "en")])
    assert proved(one) == brute(one.collect()) and proved(one)[0][1] == proved(one)[0][3]


def test_query_over_the_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = sorted((tuple(r) for r in manifest.op13_peak_manifest(spark, sf_dir).collect()), key=str)
    assert got == brute(docs.collect()) == twin(docs)
    assert 0 < sum(r[-1] for r in got) < len(got)


def test_node_records_are_the_whole_tree(spark):
    docs = documents(spark, [(i, f"text {i}", "en") for i in range(200)])
    below, _ = manifest.manifest(docs)
    rows = tree([leaf_of(r, r.text) for r in docs.orderBy("doc_id").collect()])
    found = {(r.level, r.idx): r.digest for r in below.nodes.collect()}
    assert {k: v for k, v in found.items() if k[0]} == {(level, i): d for level, row in enumerate(rows) if level for i, d in enumerate(row)}
    assert below.nodes.where("level > 0").count() == sum(map(len, rows[1:]))
