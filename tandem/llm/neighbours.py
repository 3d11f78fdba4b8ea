"""Nearest neighbours by inner product with multi-index hashing (operator 10).

1. Equal vectors form a class, and only classes go on. A bounded sample (``SAMPLE`` classes)
   fits rotations whose signs are the bits of a code: principal axes, then iterative
   quantisation in blocks of ``WIDTH`` directions. Vectors get one more component first, so
   that the largest inner product becomes the nearest direction whatever the norms are.
2. A code is split into ``parts`` substrings of 16 bits, each with an index of its own: a
   table of (substring number and leading bits of its value, class, code), a row for each
   substring. A query goes to the cells whose leading bits lie within ``reach`` of its own.
   That join on cells is the only place where rows and queries meet. In a cell rows stand
   sorted by value, and a query reads the buckets of the values within ``reach`` bits.
   By the pigeonhole principle this retrieves every code within the Hamming radius
   parts * (reach + 1) - 1, and codes beyond it that come near in some substring.
3. What was retrieved is kept if the whole code lies within ``radius``; each pair comes out
   of its first substring alone. Kept pairs are joined with both vectors and ranked by the
   exact inner product.

``reach``, ``parts`` and ``radius`` are fitted to the data: ``TRUTH`` queries are compared
with all rows once, and the cheapest setting that retrieves ``WANTED`` of their true
neighbours is taken. If none does, or a query keeps fewer than k candidates, rows and
queries meet in blocks instead, each giving back its best k: the exact way for the rest.
Cells with very many rows or queries are dealt as blocks of both.

Vectors of any length take part: codes see the components up to the most frequent length,
scores all of them, missing components counting as zero.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
take no part; rows with a null vec_id take no part; repeated rows count once; rows that
share a vec_id but not the vector are candidates (and queries) of their own; equal scores
go to the smaller vec_id; fewer than k candidates give all of them; further columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import mapped, written

#: Rows that fit the rotations; queries whose true neighbours set reach, parts and radius; their wanted share.
SAMPLE, TRUTH, WANTED, KEPT = 8192, 64, 0.97, 0.94
#: Bits of a substring; directions of a rotation; substrings and bits of difference at most.
BITS, WIDTH, MOST, FAR = 16, 64, 48, 5
#: Rows (or queries) of one cell that a task compares at once; those of a block of the exact way.
CELL, BLOCK = 1 << 16, 4096

RESULT = "query_id long, rank int, vec_id long, score double"
PAIRS = "q long, c long"


@dataclass
class Coder:
    """Mean, rotations and largest norm make codes; reach, parts and radius say what is retrieved."""

    mean: np.ndarray
    rotation: np.ndarray
    norm: float
    reach: int = FAR
    parts: int = MOST
    radius: int = MOST * BITS
    recall: float = 0.0

    def _codes(self, lifted: np.ndarray) -> np.ndarray:
        bits = np.packbits((lifted - self.mean) @ self.rotation[:, : self.parts * BITS] > 0, axis=1)
        return np.ascontiguousarray(bits).view(np.uint16)

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Codes of vectors: an array (rows, parts) of substrings."""
        x = x / self.norm
        return self._codes(np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x**2).sum(axis=1)))]))

    def queries(self, q: np.ndarray) -> np.ndarray:
        q = q / np.maximum(np.sqrt((q**2).sum(axis=1, keepdims=True)), 1e-300)
        return self._codes(np.column_stack([q, np.zeros(len(q))]))


def rotations(x: np.ndarray, norm: float, rounds: int = 8, seed: int = 3) -> Coder:
    """A coder of MOST * BITS bits from a sample of vectors; ``norm``: the largest of the whole table."""
    rng = np.random.default_rng(seed)
    y = x / norm
    lifted = np.column_stack([y, np.sqrt(np.maximum(0, 1 - (y**2).sum(axis=1)))])
    mean = lifted.mean(axis=0)
    _, axes = np.linalg.eigh((lifted - mean).T @ (lifted - mean))
    width = min(WIDTH, max(1, axes.shape[1] - 1))
    blocks = []
    for _ in range(-(-MOST * BITS // width)):
        # the directions of largest variance, or as many mixtures of all if there are more
        some = axes[:, ::-1] if axes.shape[1] <= WIDTH + 1 else axes @ np.linalg.qr(rng.normal(size=(axes.shape[1], width)))[0]
        some = some[:, :width]
        flat = (lifted[rng.permutation(len(lifted))[:2048]] - mean) @ some
        turn, _ = np.linalg.qr(rng.normal(size=(width, width)))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.sign(flat @ turn).T @ flat)
            turn = (u @ w).T
        blocks.append(some @ turn)
    return Coder(mean, np.concatenate(blocks, axis=1)[:, : MOST * BITS], norm)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of each substring."""
    return np.bitwise_count(a ^ b)


def calibrated(coder: Coder, queries: np.ndarray, near: np.ndarray, n: int, asked: int) -> bool:
    """Set reach, parts and radius from pairs of queries and true neighbours; False where no setting finds WANTED.

    The cost of a setting: bytes of the index rows, probes, and rows that random codes would retrieve.
    """
    far = distances(coder.queries(queries), coder.rows(near))
    best = None
    for reach in range(FAR + 1):
        share = np.logical_or.accumulate(far <= reach, axis=1).mean(axis=0)
        enough = np.flatnonzero(share >= WANTED)
        if len(enough):
            parts = int(enough[0]) + 1
            probes = sum(comb(BITS, i) for i in range(reach + 1))
            cost = parts * (n * (16 + 2 * parts) * 2e-8 + asked * probes * (1e-8 + 1e-6 * n / 2**BITS))
            if best is None or cost < best[0]:
                best = cost, reach, parts
    if best is None:
        return False
    _, coder.reach, coder.parts = best
    kept = far[:, : coder.parts]
    hit = (kept <= coder.reach).any(axis=1)
    whole = kept.sum(axis=1, dtype=np.int64)
    coder.radius = max(coder.parts * (coder.reach + 1) - 1, int(np.quantile(whole[hit], KEPT, method="higher")))
    coder.recall = float((hit & (whole <= coder.radius)).mean())
    return True


def masks(bits: int, reach: int) -> np.ndarray:
    """All patterns of at most ``reach`` set bits."""
    return np.array([sum(1 << i for i in some) for k in range(min(reach, bits) + 1) for some in combinations(range(bits), k)], dtype=np.int64)


def probed(coder: Coder, part: int, prefix: int, lead: int, rows: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (places in queries, places in rows) of one cell: rows in a probed bucket, by runs of queries.

    The cell holds the rows whose substring ``part`` begins with the ``lead`` bits of ``prefix``.
    """
    low = BITS - lead
    values = rows[:, part].astype(np.int64) & ((1 << low) - 1)
    order = np.argsort(values, kind="stable")
    starts = np.searchsorted(values[order], np.arange((1 << low) + 1))
    asked = queries[:, part].astype(np.int64)
    away = np.bitwise_count((asked >> low) ^ prefix)
    for gap in np.unique(away).tolist():
        if gap > coder.reach:
            continue
        some, probes = np.flatnonzero(away == gap), masks(low, coder.reach - gap)
        step = max(1, (1 << 20) // len(probes))
        for at in range(0, len(some), step):
            run = some[at : at + step]
            wanted = (asked[run] & ((1 << low) - 1))[:, None] ^ probes[None, :]
            first, size = starts[wanted].ravel(), (starts[wanted + 1] - starts[wanted]).ravel()
            full = np.flatnonzero(size)
            first, size, who = first[full], size[full], np.repeat(run, len(probes))[full]
            # as many pairs at a time as memory allows
            ends = np.cumsum(size)
            cuts = np.searchsorted(ends, np.arange(1 << 21, int(ends[-1]) if len(ends) else 0, 1 << 21)) + 1
            for a, z in zip([0, *cuts.tolist()], [*cuts.tolist(), len(size)]):
                n = size[a:z]
                if len(n):
                    steps = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    yield np.repeat(who[a:z], n), order[np.repeat(first[a:z], n) + steps]


def kept(coder: Coder, part: int, rows: np.ndarray, queries: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which retrieved pairs lie within the radius and were not retrieved by an earlier substring."""
    far = distances(queries[i], rows[j])
    return (far.sum(axis=1, dtype=np.int64) <= coder.radius) & (far[:, :part] > coder.reach).all(axis=1)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The first ``dim`` components of each vector, zeros where there are fewer."""
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if (sizes == dim).all():
        return flat.reshape(len(sizes), dim)
    out = np.zeros((len(sizes), dim))
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[place < dim], place[place < dim]] = flat[place < dim]
    return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding of the rows that take part, repeated rows once."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)).distinct()


def classes(rows: DataFrame, label: str) -> DataFrame:
    """Equal vectors as one row: a number of its own, the smallest vec_id, how many, the vector."""
    found = rows.groupBy("embedding").agg(F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    return written(found.select(F.monotonically_increasing_id().alias("number"), "first", "copies", "embedding"), label)


def some_of(frame: DataFrame, n: int, wanted: int) -> DataFrame:
    """The ``wanted`` of the n classes with the smallest hashes, in their order: the same however the rows are dealt."""
    bits = 1 << 30
    rate = min(1.0, 1.1 * wanted / max(n, 1))
    hashed = frame.withColumn("hash", F.pmod(F.xxhash64("first", "embedding"), F.lit(bits)))
    return hashed.where(F.col("hash") < int(rate * bits)).orderBy("hash", "first", "embedding").limit(wanted).drop("hash")


def top(score: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, equal ones by name."""
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        some = np.arange(len(score))
    return some[np.lexsort((names[some], -score[some]))[:k]]


def true_neighbours(index: DataFrame, queries: np.ndarray, dim: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a few queries: pairs of a query and one of its k nearest other vectors, as two matrices."""
    told = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = told.value
        best = [(np.empty(0), np.empty(0, np.int64), np.empty(0, np.int64)) for _ in asked]
        for batch in batches:
            x = matrix(batch.column(2), dim)
            numbers, names = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            score = asked @ x.T
            for i, vector in enumerate(asked):
                other = np.flatnonzero(~(x == vector).all(axis=1))
                joined = [np.concatenate([old, new[other]]) for old, new in zip(best[i], (score[i], names, numbers), strict=True)]
                lead = top(joined[0], joined[1], k)
                best[i] = tuple(c[lead] for c in joined)
        for i, (score, _, numbers) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), i, np.int32)), pa.array(numbers), pa.array(score)], names=["q", "number", "score"])

    found = mapped(index.select("number", "first", "embedding"), run, "q int, number long, score double").join(index.select("number", "first", "embedding"), "number")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "first")
    rows = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("q", "place", "embedding").orderBy("q", "place").collect()  # TRUTH * k rows at most
    near = matrix(pa.array([r["embedding"] for r in rows], pa.list_(pa.float64())), dim)
    return queries[[r["q"] for r in rows]], near


def _coded(coder, dim: int, lead: int, asking: bool):
    """Index rows (or the cells that a query visits): cell, number and the whole code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = coder.value
        near = masks(lead, model.reach) if asking else np.zeros(1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                x = matrix(some.column(1), dim)
                codes = model.queries(x) if asking else model.rows(x)
                n, parts = codes.shape
                prefix = codes.astype(np.int64) >> (BITS - lead)
                cells = ((np.arange(parts) << lead) | prefix)[:, :, None] ^ near
                numbers = np.repeat(some.column(0).to_numpy(), parts * len(near))
                raw = np.repeat(codes, parts * len(near), axis=0)
                binary = pa.Array.from_buffers(pa.binary(2 * parts), len(raw), [None, pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(cells.ravel().astype(np.int32)), pa.array(numbers), binary], names=["cell", "number", "code"])

    return run


def _dealt(rows: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides with (cell, i, j): cells of very many rows or queries in blocks of both."""
    large = lambda frame, name: frame.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * CELL).select("cell", F.ceil(F.col("n") / CELL).cast("int").alias(name))
    blocks = large(rows, "r").join(large(asked, "a"), "cell", "full").select("cell", F.coalesce("r", F.lit(1)).alias("r"), F.coalesce("a", F.lit(1)).alias("a"))
    blocks = written(blocks, "large-cells")

    def side(frame: DataFrame, own: str, other: str, mine: str, theirs: str) -> DataFrame:
        out = frame.join(blocks, "cell", "left")
        block = F.coalesce(F.pmod(F.xxhash64("number"), F.col(own)).cast("int"), F.lit(0))
        everywhere = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(other) - 1, F.lit(0))))
        return out.withColumn(mine, block).withColumn(theirs, everywhere).select("cell", "i", "j", "number", "code")

    return side(rows, "r", "a", "i", "j"), side(asked, "a", "r", "j", "i")


def retrieved(index: DataFrame, asked: DataFrame, coder, dim: int, n: int) -> DataFrame:
    """Pairs (q, c) of a query class and an index class that probing retrieves within the radius."""
    lead = max(0, min(BITS - 4, int(np.ceil(np.log2(max(n, 1) / CELL)))))
    schema = "cell int, number long, code binary"
    rows = mapped(index.select("number", "embedding"), _coded(coder, dim, lead, False), schema)
    queries = mapped(asked.select("number", "embedding"), _coded(coder, dim, lead, True), schema)
    rows, queries = _dealt(rows, queries)

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        model, out = coder.value, []
        if left.num_rows and right.num_rows:
            name = left.column("cell")[0].as_py()
            part, prefix = name >> lead, name & ((1 << lead) - 1)
            codes, wanted = (np.frombuffer(b"".join(side.column("code").to_pylist()), np.uint16).reshape(-1, model.parts) for side in (left, right))
            for i, j in probed(model, part, prefix, lead, codes, wanted):
                near = kept(model, part, codes, wanted, i, j)
                out.append((i[near], j[near]))
        i, j = (np.concatenate([x[side] for x in out] or [np.empty(0, np.int64)]) for side in (0, 1))
        q, c = right.column("number").to_numpy(), left.column("number").to_numpy()
        return pa.table({"q": pa.array(q[i], pa.int64()), "c": pa.array(c[j], pa.int64())})

    return rows.groupBy("cell", "i", "j").cogroup(queries.groupBy("cell", "i", "j")).applyInArrow(cell, PAIRS)


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products whose terms are added one after the other, as ``product`` does."""
    out = np.zeros(len(x))
    for d in range(x.shape[1]):
        out += x[:, d] * y[d]
    return out


def compared(index: DataFrame, asked: DataFrame, n: int, m: int, k: int) -> DataFrame:
    """Pairs (q, c) of each query and its best k + 1 classes of every block of rows, no more: the exact way."""
    rows, queries = max(1, -(-n // BLOCK)), max(1, -(-m // BLOCK))

    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        out: tuple[list, list] = ([], [])
        if left.num_rows and right.num_rows:
            sides = [t.column("embedding").combine_chunks() for t in (left, right)]
            dim = max(int(np.max(s.value_lengths().to_numpy(zero_copy_only=False))) for s in sides)
            x, asking = (matrix(s, dim) for s in sides)
            c, q = (t.column("number").to_numpy() for t in (left, right))
            names = left.column("first").to_numpy()
            for at in range(0, len(q), 256):
                score = asking[at : at + 256] @ x.T
                least = np.partition(score, max(0, score.shape[1] - k - 1), axis=1)[:, max(0, score.shape[1] - k - 1)]
                close = score >= (least - 1e-9 * np.maximum(1, np.abs(least)))[:, None]
                for i in range(len(score)):
                    some = np.flatnonzero(close[i])
                    if len(some) > k + 1:  # ties: the exact score decides, then the smaller id
                        some = some[top(in_order(x[some], asking[at + i]), names[some], k + 1)]
                    out[0].append(np.full(len(some), q[at + i]))
                    out[1].append(c[some])
        return pa.table({name: pa.array(np.concatenate(x or [np.empty(0, np.int64)]), pa.int64()) for name, x in zip(("q", "c"), out)})

    block = lambda of: F.pmod(F.xxhash64("number"), F.lit(of)).cast("int")
    spread = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    left = index.select("number", "first", "embedding").withColumn("i", block(rows)).withColumn("j", spread(queries))
    right = asked.select("number", "embedding").withColumn("j", block(queries)).withColumn("i", spread(rows))
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(cell, PAIRS)


def product(a: Column, b: Column) -> Column:
    """Inner product in double precision, components in order; missing ones count as zero."""
    terms = F.zip_with(a, b, lambda x, y: F.coalesce(x.cast("double") * y.cast("double"), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def ranked(pairs: DataFrame, index: DataFrame, asked: DataFrame, rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k nearest vectors of every query from pairs of classes."""
    best = lambda frame, tie: frame.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), tie))).where(F.col("place") <= k + 1)
    right = index.select(F.col("number").alias("c"), "first", "copies", F.col("embedding").alias("x"))
    left = asked.select(F.col("number").alias("q"), F.col("embedding").alias("y"))
    scored = pairs.join(right, "c").join(left, "q").select("q", "first", "c", "copies", product(F.col("x"), F.col("y")).alias("score"))
    scored = best(scored, "first").drop("place")
    # members of classes of several: the k + 1 smallest ids stand for all
    several = index.where("copies > 1").select(F.col("number").alias("c"), "embedding")
    members = rows.join(several, "embedding").select("c", "vec_id")
    members = members.withColumn("nth", F.row_number().over(Window.partitionBy("c").orderBy("vec_id"))).where(F.col("nth") <= k + 1).drop("nth")
    each = scored.join(members, "c", "left").select("q", F.coalesce("vec_id", "first").alias("vec_id"), "score")
    lists = best(each, "vec_id").groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("best"))  # k + 1 at most
    # queries of one vector share a list; many of them are dealt over several tasks
    salts = lambda n: F.ceil(n / CELL).cast("int")
    shared = lists.join(asked.select(F.col("number").alias("q"), "copies"), "q").withColumn("salt", F.explode(F.sequence(F.lit(0), salts(F.col("copies")) - 1))).drop("copies")
    who = queries.join(asked.select(F.col("number").alias("q"), "copies", "embedding"), "embedding").select("q", F.col("vec_id").alias("query_id"), F.pmod(F.xxhash64("vec_id"), salts(F.col("copies"))).cast("int").alias("salt"))
    own = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    found = who.join(shared, ["q", "salt"]).select("query_id", F.posexplode(own).alias("rank", "b"))
    return found.select("query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", "b.score")


def fitted(index: DataFrame, asked: DataFrame, n: int, m: int, dim: int, k: int, sample: int = SAMPLE) -> Coder | None:
    """A coder of the whole table, or None where no setting reaches WANTED."""
    norm = index.agg(F.max(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))).first()[0] ** 0.5
    pull = lambda frame, of, wanted: matrix(pa.array([r["embedding"] for r in some_of(frame, of, wanted).select("embedding").collect()], pa.list_(pa.float64())), dim)
    x, queries = pull(index, n, sample), pull(asked, m, TRUTH)
    if not len(x) or not len(queries):
        return None
    coder = rotations(x, norm)
    pairs = true_neighbours(index, queries, dim, k)
    return coder if len(pairs[0]) and calibrated(coder, *pairs, n, m) else None


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k nearest vectors."""
    spark = vectors.sparkSession
    rows, who = usable(vectors), usable(queries)
    index, asked = classes(rows, "vector-classes"), classes(who, "query-classes")
    sizes = index.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("rows")).orderBy(F.desc("n"), "dim")
    m = asked.count()
    dims = sizes.agg(F.sum("n").alias("n"), F.sum("rows").alias("rows"), F.max(F.struct("n", -F.col("dim"))).alias("most")).first()
    if not m or not dims["n"]:
        return spark.createDataFrame([], RESULT)
    n, dim = dims["n"], -dims["most"][1]
    coder = fitted(index, asked, n, m, dim, k, sample)
    if coder is None:
        pairs = compared(index, asked, n, m, k)
    else:
        pairs = written(retrieved(index, asked, spark.sparkContext.broadcast(coder), dim, n), "neighbour-pairs")
        copies = index.where("copies > 1").select(F.col("number").alias("c"), "copies")
        have = pairs.join(copies, "c", "left").groupBy("q").agg(F.sum(F.coalesce("copies", F.lit(1))).alias("have"))
        enough = have.where(F.col("have") >= min(k + 1, dims["rows"])).select(F.col("q").alias("number"))
        short = written(asked.join(enough, "number", "left_anti"), "short-queries")
        few = short.count()
        if few:
            rest = compared(index, short, n, few, k)
            pairs = pairs.join(short.select(F.col("number").alias("q")), "q", "left_anti").unionByName(rest)
    return ranked(pairs, index, asked, rows, who, k)


def op10_multi_index_hashing(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0))
