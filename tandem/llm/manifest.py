"""A Merkle manifest of a dataset: a tree for each source and one over the sources (operator 13).

Leaves are hashed where their rows are read, then stand in sorted ranges that know the index
of their first leaf in its source. Each run of a source in a range is a mountain range: a
stack of peaks, where the last of ``FANOUT`` siblings carries them into their parent, as in
counting to that base. Completed nodes are records of the manifest. What a run can't complete
(siblings on the other side of its ends, and the short run at a source's end) stays a peak;
peaks of all runs are merged by Spark, ``STEP`` levels a round, in groups of the leaves below
one node, so that no task sees more than FANOUT ** STEP of them. Short runs are hashed as they
are, without padding. The subroots are the leaves of one more such tree.

For proofs each run is given the few siblings that lie outside it, and the path above its
subroot; it builds its own levels once more and folds each leaf up to the root.

Defined results: null fields are ``-``; a null source is a source of its own, the first; null
doc_ids come first in their source and are never tampered with; rows that tie in doc_id go by
their leaf, and equal rows are equal leaves side by side, each with a place of its own; an
empty table has no rows and no root; further columns are no part of a leaf.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import Ranges, ranges
from .common import table, written

FANOUT, STEP = 3, 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

NODES = "key string, level int, idx long, digest string, peak boolean, total long"
OUTSIDE = "key string, part long, level int, idx long"
PATHS = "key string, digest string, root string, lefts array<string>, rights array<string>"
PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- one run ---------------------------------------------------------------------------


def mountain(start: int, leaves: list[str]) -> tuple[list[tuple], list[tuple]]:
    """Completed nodes and remaining peaks, as (level, index, digest), of consecutive leaves from index ``start``."""
    peaks: list[tuple] = []
    done: list[tuple] = []
    for index, h in enumerate(leaves, start):
        node = (0, index, h)
        while True:
            peaks.append(node)
            level, i, _ = node
            if i % FANOUT != FANOUT - 1 or len(peaks) < FANOUT or peaks[-FANOUT][:2] != (level, i - FANOUT + 1):
                break  # siblings are still to come, or lie before the run
            node = (level + 1, i // FANOUT, digest(*(p[2] for p in peaks[-FANOUT:])))
            del peaks[-FANOUT:]
            done.append(node)
    return done, peaks


def width(total: int, level: int) -> int:
    """Nodes of a level of a tree of ``total`` leaves."""
    return -(-total // FANOUT**level)


def height(total: int) -> int:
    level = 0
    while width(total, level) > 1:
        level += 1
    return level


def outside(start: int, end: int, total: int) -> Iterator[tuple[int, int]]:
    """(level, index) of the siblings that leaves start..end-1 need on their ways up and that aren't above them."""
    for level in range(height(total)):
        a, z = start // FANOUT**level, (end - 1) // FANOUT**level
        last = min(z - z % FANOUT + FANOUT, width(total, level))
        yield from ((level, i) for i in range(a - a % FANOUT, a))
        yield from ((level, i) for i in range(z + 1, last))


def levels(start: int, leaves: list[str], total: int, given: dict[tuple[int, int], str]) -> list[tuple[int, list[str]]]:
    """Of each level below the top: the first index and the digests of the groups that the leaves' ways pass."""
    out, at, own = [], start, leaves
    for level in range(height(total)):
        first, z = at - at % FANOUT, at + len(own) - 1
        last = min(z - z % FANOUT + FANOUT, width(total, level))
        row = [given[level, i] for i in range(first, at)] + own + [given[level, i] for i in range(z + 1, last)]
        out.append((first, row))
        at, own = first // FANOUT, [digest(*row[i : i + FANOUT]) for i in range(0, len(row), FANOUT)]
    return out


def siblings(rows: list[tuple[int, list[str]]], index: int) -> Iterator[tuple[str, str]]:
    """The digests left and right of a leaf's way up, level by level."""
    for first, row in rows:
        at = index - first
        group = at - at % FANOUT
        yield "".join(row[group:at]), "".join(row[at + 1 : group + FANOUT])
        index //= FANOUT


# --- all runs --------------------------------------------------------------------------


def _leaves_of(run: pa.Table) -> tuple[int, list[str], pa.Table]:
    run = run.sort_by("place")
    return run["place"][0].as_py(), run["digest"].to_pylist(), run


def _of_run(run: pa.Table) -> pa.Table:
    start, leaves, run = _leaves_of(run)
    done, peaks = mountain(start, leaves)
    tops = {x[:2] for x in peaks}
    nodes = [(*x, False) for x in done if x[:2] not in tops] + [(*x, True) for x in peaks]
    n = len(nodes)
    level, index, hashed, peak = zip(*nodes, strict=True)
    return pa.table([pa.array([run["key"][0].as_py()] * n, pa.string()), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(hashed, pa.string()), pa.array(peak), pa.array([run["total"][0].as_py()] * n, pa.int64())], ["key", "level", "idx", "digest", "peak", "total"])


def _merging(low: int):
    """Merge the nodes below one node of level low + STEP: its descendants from level ``low`` up that no run completed."""

    def merge(group: pa.Table) -> pa.Table:
        key, total = group["key"][0].as_py(), group["total"][0].as_py()
        have: dict[int, dict[int, str]] = {}
        for level, index, h in zip(*(group[c].to_pylist() for c in ("level", "idx", "digest")), strict=True):
            have.setdefault(level, {})[index] = h
        made = []
        for level in range(low, min(low + STEP, height(total))):
            row, most = have.get(level, {}), width(total, level)
            for up in sorted({i // FANOUT for i in row}):
                children = range(up * FANOUT, min((up + 1) * FANOUT, most))
                h = digest(*(row[i] for i in children))
                have.setdefault(level + 1, {})[up] = h
                made.append((level + 1, up, h))
        level, index, hashed = zip(*made, strict=True) if made else ((), (), ())
        n = len(made)
        return pa.table([pa.array([key] * n, pa.string()), pa.array(level, pa.int32()), pa.array(index, pa.int64()), pa.array(hashed, pa.string()), pa.array([False] * n, pa.bool_()), pa.array([total] * n, pa.int64())], ["key", "level", "idx", "digest", "peak", "total"])

    return merge


def nodes(placed: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The node records of all trees (key, level, idx, digest, peak, total), and those that several runs may ask for.

    ``placed``: leaves (key, part, place, digest, total). ``most``: leaves of the largest tree.
    A record is a ``peak`` where its run had no whole parent for it; leaves are records only then.
    """
    own = written(placed.groupBy("part", "key").applyInArrow(_of_run, NODES), "node-records")
    edges = pending = own.where("peak")
    for low in range(0, height(most), STEP):
        reach = F.pow(F.lit(FANOUT), F.lit(low + STEP) - F.col("level")).cast("long")
        now = pending.where(F.col("level") < low + STEP).withColumn("reach", reach).withColumn("above", F.expr("idx div reach"))
        merged = written(now.groupBy("key", "above").applyInArrow(_merging(low), NODES), "merged-nodes")
        pending = pending.where(F.col("level") >= low + STEP).unionByName(merged.where(F.col("level") == low + STEP))
        edges = edges.unionByName(merged)
    return own.where("NOT peak").unionByName(edges), edges


def _tops() -> Column:
    """Whether a node is its tree's root: the lowest level with one node."""
    alone = F.col("total") <= F.pow(F.lit(FANOUT), "level")
    return alone & ((F.col("level") == 0) | (F.col("total") > F.pow(F.lit(FANOUT), F.col("level") - 1)))


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, part, start, count, total in zip(*(batch.column(c).to_pylist() for c in ("key", "part", "start", "count", "total")), strict=True):
            asked = list(outside(start, start + count, total))
            yield pa.record_batch([pa.array([key] * len(asked), pa.string()), pa.array([part] * len(asked), pa.int64()), pa.array([x[0] for x in asked], pa.int32()), pa.array([x[1] for x in asked], pa.int64())], ["key", "part", "level", "idx"])


def _given(dealt: Ranges, edges: DataFrame) -> DataFrame:
    """Of each run the digests of the siblings outside it."""
    asked = dealt.runs.select("key", "part", "start", "count", "total").mapInArrow(_wanted, OUTSIDE)
    return asked.join(edges.select("key", "level", "idx", "digest"), ["key", "level", "idx"]).select("key", "part", "level", "idx", "digest")


def _dict(given: pa.Table) -> dict[tuple[int, int], str]:
    return {(level, i): h for level, i, h in zip(*(given[c].to_pylist() for c in ("level", "idx", "digest")), strict=True) if level is not None}


def _paths_of(run: pa.Table, given: pa.Table) -> pa.Table:
    start, leaves, run = _leaves_of(run)
    total = run["total"][0].as_py()
    rows = levels(start, leaves, total, _dict(given))
    ways = [list(siblings(rows, start + i)) for i in range(len(leaves))]
    top = rows[-1][1] if rows else leaves
    root = digest(*top) if rows else leaves[0]
    return pa.table([run["own"].combine_chunks(), run["digest"].combine_chunks(), pa.array([root] * len(leaves)), pa.array([[x[0] for x in w] for w in ways], pa.list_(pa.string())), pa.array([[x[1] for x in w] for w in ways], pa.list_(pa.string()))], ["key", "digest", "root", "lefts", "rights"])


def _proofs_of(run: pa.Table, given: pa.Table) -> pa.Table:
    start, leaves, run = _leaves_of(run)
    total = run["total"][0].as_py()
    path = next(r for r in given.to_pylist() if r["root"] is not None)
    upper = list(zip(path["lefts"], path["rights"], strict=True))
    subroot, root = path["digest"], path["root"]
    rows = levels(start, leaves, total, _dict(given.filter(pc.is_null(given["root"]))))
    proof, folded = [], []
    for i, (leaf, changed) in enumerate(zip(leaves, run["tampered"].to_pylist(), strict=True)):
        way = [*siblings(rows, start + i), *upper]
        proof.append(digest(*(s for pair in way for s in pair)))
        h = changed or leaf
        for left, right in way:
            h = digest(left, h, right)
        folded.append(h)
    n = len(leaves)
    same = pa.array([h == root for h in folded])
    return pa.table([run["doc_id"].combine_chunks(), run["digest"].combine_chunks(), pa.array([subroot] * n), pa.array([root] * n), pa.array(proof), pa.array(folded), same], ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


# --- the dataset -----------------------------------------------------------------------


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(text: Column) -> Column:
    return F.sha2(F.concat(*(_field(text if c == "text" else F.col(c)) for c in FIELDS)), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, key (the source; null sorts first), leaf digest, and that of the tampered row where it differs."""
    told = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("key"),
        _leaf(F.col("text")).alias("digest"),
        F.when(told, _leaf(F.replace("text", F.lit("\n"), F.lit("")))).alias("tampered"),
    )


class Trees:
    """The trees of ``rows`` (key, digest), one for each key, its leaves in the order of ``by``.

    ``dealt``: the leaves in ranges; ``placed``: with part, place and total; ``nodes``: the
    node records; ``edges``: those of them that a proof may need from outside its run.
    """

    def __init__(self, rows: DataFrame, by: list[str]):
        self.dealt = ranges(rows, by, ("key",))
        self.placed = self.dealt.placed("place", "total")
        self.nodes, self.edges = nodes(self.placed, self.dealt.runs.agg(F.max("total")).first()[0] or 0)

    def given(self) -> DataFrame:
        return _given(self.dealt, self.edges)

    def subroots(self) -> DataFrame:
        return self.nodes.where(_tops()).select("key", "digest")


def manifest(docs: DataFrame) -> tuple[Trees, Trees]:
    """The trees of the sources, and the tree over their subroots (its leaves' ``own``: the source's key)."""
    own = written(leaves(docs), "leaves").withColumn("tie", F.monotonically_increasing_id())
    below = Trees(own, ["doc_id", "digest", "tie"])
    subroots = written(below.subroots().select(F.col("key").alias("own"), F.lit("").alias("key"), "digest"), "subroots")
    return below, Trees(subroots, ["own"])


def proofs(docs: DataFrame) -> DataFrame:
    """Every leaf with its subroot, the root, the digest of its proof, and what its row (tampered, where it is) folds to."""
    below, above = manifest(docs)
    paths = written(above.placed.groupBy("part", "key").cogroup(above.given().groupBy("part", "key")).applyInArrow(_paths_of, PATHS), "paths")
    none = {c: F.lit(None).cast(kind) for c, kind in (("root", "string"), ("lefts", "array<string>"), ("rights", "array<string>"))}
    ways = below.dealt.runs.select("key", "part").join(paths, "key").withColumns({"level": F.lit(None).cast("int"), "idx": F.lit(None).cast("long")})
    given = below.given().withColumns(none).unionByName(ways)
    return below.placed.groupBy("part", "key").cogroup(given.groupBy("part", "key")).applyInArrow(_proofs_of, PROOFS)


def op13_peak_manifest(spark, sf_dir: str) -> DataFrame:
    return proofs(table(spark, sf_dir, "documents"))


def _twin(levels_below: int = 24, levels_above: int = 8) -> str:
    """DuckDB SQL that builds level after level by grouping, up to 3 ** levels leaves in a source and sources."""
    crc = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda r, i: xor(r >> 1, 3988292384 * (r & 1)))), 4294967295)"
    field = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"
    parts = [
        f"d AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND text LIKE '%' || chr(10) || '%' AND {crc} % 2 = 0 THEN {leaf("replace(text, chr(10), '')")} END AS tampered FROM documents)",
        "w0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, '' AS proof, coalesce(tampered, leaf) AS fold FROM d)",
        "n0 AS (SELECT source, i, leaf AS h, count(*) OVER (PARTITION BY source) AS width FROM w0)",
    ]
    climb = "SELECT {w}.* EXCLUDE (i, proof, fold), i // 3 AS i, CASE WHEN g IS NULL THEN proof ELSE proof || array_to_string(hs[:i % 3] || hs[i % 3 + 2:], '') END AS proof, CASE WHEN g IS NULL THEN fold ELSE sha256(array_to_string(hs[:i % 3] || [fold] || hs[i % 3 + 2:], '')) END AS fold FROM {w} LEFT JOIN {c} ON {same} AND {c}.g = {w}.i // 3"

    def tree(n: str, c: str, w: str, levels: int, key: str) -> None:
        for k in range(levels):
            by = f"{key}, " if key else ""
            parts.append(f"{c}{k} AS (SELECT {by}i // 3 AS g, list(h ORDER BY i) AS hs, max(width) AS width FROM {n}{k} WHERE width > 1 GROUP BY ALL)")
            parts.append(f"{n}{k + 1} AS (SELECT {by}g AS i, sha256(array_to_string(hs, '')) AS h, (width + 2) // 3 AS width FROM {c}{k} UNION ALL SELECT {by}i, h, width FROM {n}{k} WHERE width = 1)")
            same = f"{w}{k}.{key} IS NOT DISTINCT FROM {c}{k}.{key}" if key else "true"
            parts.append(f"{w}{k + 1} AS ({climb.format(w=f'{w}{k}', c=f'{c}{k}', same=same)})")

    tree("n", "c", "w", levels_below, "source")
    parts.append(f"m0 AS (SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, source, h, count(*) OVER () AS width FROM n{levels_below})")
    parts.append(f"v0 AS (SELECT w.* EXCLUDE (i), m0.i, m0.h AS subroot FROM w{levels_below} w JOIN m0 ON w.source IS NOT DISTINCT FROM m0.source)")
    tree("m", "e", "v", levels_above, "")
    end = f"SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = h AS verified FROM v{levels_above} CROSS JOIN (SELECT h FROM m{levels_above})"
    return "WITH " + ",\n".join(f"{p.replace(' AS (', ' AS MATERIALIZED (', 1)}" for p in parts) + "\n" + end


ORACLE = _twin()
