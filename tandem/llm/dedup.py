"""Near-duplicate documents by SetSketch registers (operator 3).

1. A map over documents makes each one's set of hashed five-word shingles, a digest of the
   set and M SetSketch registers: with h_i(d) exponentially distributed, register i is the
   truncated exponent floor(1 - log_b min_d h_i(d)). Registers of a union are the maxima of
   registers, and equal registers are the more likely the more similar two sets are.
2. Documents with equal sets form a class; only one member of a class goes on.
3. BAND registers together are a bucket key. Inside a bucket the joint maximum-likelihood
   estimate of the Jaccard similarity (from the numbers of greater, smaller and equal
   registers and the set sizes) leaves out clearly different sets; a bucket gives back a
   spanning forest of what is left, never all pairs.
4. Connected components of those forests are the families of candidates. Each family is
   checked on the full sets, again giving back a spanning forest.
5. Connected components of the confirmed links are the result.

Large buckets and families are dealt in blocks, bounded in rows and in shingles, with some
leaders in every block (see ``spanning``); only members that stay apart from most of their
family after that are compared with all blocks, so texts of a large group of near copies
are moved about once.

The least similarity is a parameter in hundredths: ``LEAST`` is the contract of operator 3,
``STAGE_LEAST`` the rule of near-duplicate stages. Two sets of equal size miss every band
with a chance of 2e-7 at 0.85 and of 2.5e-5 at 0.80, and an estimate lies ``MARGIN`` below
the truth with a chance of about 3e-6 and 3e-5 (one and nine of 300,000 simulated pairs).

Defined results: a null text, or one without words, has no shingles, links with nothing and
is kept; fewer than five words are one shingle; a null doc_id is kept, has a null
component_id and links with nothing; rows that share a doc_id are one document in the
graph, whose links are those of all its texts; very long texts are hashed in blocks of
words, whole; repeated rows give repeated results; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_key, mapped, possible_members, written
from .components import connected

WORDS, LEAST, STAGE_LEAST = 5, 85, 80  # shingle length; similarities in hundredths
M, BAND, BASE, RATE, TOP = 128, 5, 1.1, 20.0, 255
BANDS = M // BAND
MARGIN = 0.15
#: Documents of a bucket or family that one task compares at once.
BUCKET_BLOCK, FAMILY_BLOCK, LEADERS = 2048, 256, 16
#: Shingles of a block's rows together, about; rows of cells that a task has, about.
BLOCK_SHINGLES, TASK_ROWS = 1 << 19, 8192
WORD_BLOCK = 1 << 16

SKETCH = "doc_id long, text_hash long, n_shingles long, d1 long, d2 long, registers binary"
CELLS = ("i", "j", "rep", "asks", "part", "n", "registers")


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray, int, int]:
    rng = np.random.default_rng(20_240_501)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    base = 0x9E3779B97F4A7C15 | 1
    return draw(256), draw(M), draw(M) | np.uint64(1), base, pow(base, -1, 2**64)


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse, modulo 2 ** 64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _, _, _, base, inverse = _constants()
        _powers[:] = []
        for x in (base, inverse):
            table = np.full(size, np.uint64(x))
            table[0] = 1
            _powers.append(np.multiply.accumulate(table))
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles; long texts go in blocks of words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    table = _constants()[0]
    parts = []
    for at in range(0, max(1, len(words) - WORDS + 1), WORD_BLOCK):
        raw = np.frombuffer(b" ".join(words[at : at + WORD_BLOCK + WORDS - 1]) + b" ", dtype=np.uint8)
        power, inverse = _power_tables(len(raw))
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(table[raw] * power[: len(raw)], out=sums[1:])
        ends = np.flatnonzero(raw == 32)
        starts = np.concatenate([np.zeros(1, ends.dtype), ends[:-1] + 1])
        n = min(WORDS, len(ends))
        a, z = starts[: len(ends) - n + 1], ends[n - 1 :]
        parts.append(_mix((sums[z] - sums[a]) * inverse[a]))
    return np.unique(np.concatenate(parts))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """M registers of each of the (non-empty) sets."""
    _, offsets, factors, _, _ = _constants()
    out = np.empty((len(sets), M), np.uint8)
    done = 0
    while done < len(sets):
        last, size = done, 0
        while last < len(sets) and (last == done or size + len(sets[last]) <= 1 << 16):
            size += len(sets[last])
            last += 1
        group = sets[done:last]
        flat = np.concatenate(group)
        starts = np.cumsum([0] + [len(s) for s in group[:-1]])
        least = np.empty((len(group), M), np.uint64)
        room = np.empty_like(flat)
        for i in range(M):
            np.bitwise_xor(flat, offsets[i], out=room)
            np.multiply(room, factors[i], out=room)
            least[:, i] = np.minimum.reduceat(room, starts)
        x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
        with np.errstate(divide="ignore"):
            out[done:last] = np.clip(np.floor(1 - np.log(np.maximum(x, 1e-300)) / np.log(BASE)), 0, TOP)
        done = last
    return out


GRID = np.linspace(0.0, 1.0, 81)


def estimate(greater: np.ndarray, smaller: np.ndarray, sizes: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Joint maximum-likelihood Jaccard similarities from register comparisons and set sizes."""
    total = (sizes + others).astype(np.float64)
    u, v = (sizes / total)[:, None], (others / total)[:, None]
    most = np.minimum(u / v, v / u)
    j = np.minimum(GRID[None, :], most)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    tiny = 1e-12
    like = greater[:, None] * np.log(up + tiny) + smaller[:, None] * np.log(down + tiny) + (M - greater - smaller)[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(j)), like.argmax(axis=1)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            some = batch.slice(at, 512)
            sets = [shingles(t) for t in some.column(2).to_pylist()]
            full = [s for s in sets if len(s)]
            raw = registers(full).tobytes() if full else b""
            rows = iter([raw[i : i + M] for i in range(0, len(raw), M)])
            digests = [np.frombuffer(hashlib.md5(s.tobytes()).digest(), "<i8") for s in sets]
            yield pa.RecordBatch.from_arrays(
                [some.column(0), some.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([int(d[0]) for d in digests], pa.int64()), pa.array([int(d[1]) for d in digests], pa.int64()), pa.array([next(rows) if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "text_hash", "n_shingles", "d1", "d2", "registers"],
            )


def sketches(docs: DataFrame) -> DataFrame:
    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text"), _sketches, SKETCH)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = _constants()[2][:BAND]
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        regs = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, M)[:, : BANDS * BAND].reshape(n, BANDS, BAND)
        keys = _mix((regs.astype(np.uint64) * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*(pa.array(np.repeat(batch.column(i).to_numpy(), BANDS)) for i in range(2)), pa.array(keys.ravel())], names=["c", "rep", "band"])


def _linked(regs: np.ndarray, sizes: np.ndarray, asks: np.ndarray, labels: np.ndarray, least: int, confirm=None) -> list[tuple[int, int]]:
    """Places of linked rows, a spanning forest; ``labels`` name what is connected, before and after.

    A row is compared only with rows that nothing connects it with so far: in a group of near
    copies the first row connects nearly all. Estimates decide; ``confirm``, if given, after them.
    """
    found = []
    margin = least / 100 - MARGIN
    left = right = np.arange(len(labels))
    if asks.any():
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    for k, i in enumerate(left.tolist()):
        rest = right if asks.any() else right[k + 1 :]
        rest = rest[labels[rest] != labels[i]]
        # sets of too different sizes can't be similar
        rest = rest[100 * np.minimum(sizes[i], sizes[rest]) >= least * np.maximum(sizes[i], sizes[rest])]
        if not len(rest):
            continue
        rest = rest[(regs[rest] == regs[i]).sum(axis=1) >= M * (margin - 0.05)]
        if not len(rest):
            continue
        greater, smaller = (regs[rest] < regs[i]).sum(axis=1), (regs[rest] > regs[i]).sum(axis=1)
        e = estimate(greater, smaller, np.full(len(rest), sizes[i]), sizes[rest])
        order = np.argsort(-e, kind="stable")
        for j in rest[order[e[order] >= margin]].tolist():
            if labels[i] != labels[j] and (confirm is None or confirm(i, j)):
                labels[labels == labels[j]] = labels[i]
                found.append((i, j))
    return found


def _cells(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows of one cell after another; the first ``keys`` columns name the cell and rows are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for x in names:
            change[1:] |= x[1:] != x[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, z in zip(edges, edges[1:]):
            name = tuple(x[a] for x in names)
            if held and name != last:
                yield held
                held = []
            held.append(batch.slice(a, z - a))
            last = name
    if held:
        yield held


def _column(cell: list[pa.RecordBatch], i: int) -> list:
    return [x for b in cell for x in b.column(i).to_pylist()]


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=["a", "b"])


def _forests(batches: Iterator[pa.RecordBatch], least: int = LEAST, exact: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows of CELLS (and text), sorted by cell -> edges among similar rows, a spanning forest of each cell.

    Rows with ``asks`` are compared with all others; where no row asks, all are compared.
    Rows of one ``part`` are known to be connected. ``exact``: links are confirmed on the full
    sets; without it, estimates decide.
    """
    pairs: list[tuple[int, int]] = []
    for cell in _cells(batches, 3):
        reps = _column(cell, 3)
        if len(reps) < 2:
            continue
        asks, parts, sizes = (np.array(_column(cell, i)) for i in (4, 5, 6))
        regs = np.frombuffer(b"".join(_column(cell, 7)), np.uint8).reshape(len(reps), M)
        texts = [t for part in cell for t in part.column(8)] if exact else []
        sets: dict[int, np.ndarray] = {}

        def confirm(x: int, y: int) -> bool:
            for i in (x, y):
                if i not in sets:
                    sets[i] = shingles(texts[i].as_py())
            both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
            return 100 * both >= least * (len(sets[x]) + len(sets[y]) - both)

        found = _linked(regs, sizes, asks, parts, least, confirm if exact else None)
        # each linked row to the smallest document of its tree: stars need fewer rounds to connect than chains
        ends = sorted({i for pair in found for i in pair}, key=reps.__getitem__)
        first: dict[int, int] = {}
        pairs += [(reps[i], to) for i in ends if (to := first.setdefault(int(parts[i]), reps[i])) != reps[i]]
        if len(pairs) > 10_000:
            yield _edges(pairs)
            pairs = []
    yield _edges(pairs)


def spanning(rows: DataFrame, group: str, attached, forests, block: int, label: str) -> DataFrame:
    """Edges (a, b) that connect what ``forests`` links among rows (group, c, rep, n) of one group.

    A group of more than ``block`` rows, or of very many shingles, is dealt in blocks, and
    LEADERS of its rows join every block: in a group of near copies they connect all blocks,
    each text is moved about once. Rows that are not connected with most of their group after
    that are then compared with every block. ``attached`` adds registers (and texts) to cells.
    """
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("shingles")).where("of > 1")
    blocks = F.greatest(F.ceil(F.col("of") / block), F.least("of", F.ceil(F.col("shingles") / BLOCK_SHINGLES))).cast("int")
    sizes = written(sizes.select(group, "of", blocks.alias("blocks")), f"{label}-sizes")
    placed = by_key(rows, sizes, [group], "of").withColumn("i", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
    placed = written(placed.select(group, "i", "c", "rep", "blocks"), f"{label}-rows")
    total = placed.count()
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_ROWS))

    def edges(cells: DataFrame) -> DataFrame:
        cells = attached(cells).repartition(tasks, group, "i", "j").sortWithinPartitions(group, "i", "j")
        return mapped(cells, forests, "a long, b long")

    alone = placed.select(group, "i", F.lit(0).alias("j"), "c", "rep", F.lit(False).alias("asks"), F.col("c").alias("part"))
    large = placed.where("blocks > 1")
    if not large.limit(1).count():
        return edges(alone)
    order = Window.partitionBy(group).orderBy(F.xxhash64("c", F.lit(1)), "c")
    leaders = large.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= LEADERS)
    guests = leaders.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("at <> i")
    guests = guests.select(group, F.col("at").alias("i"), F.lit(0).alias("j"), "c", "rep", F.lit(False).alias("asks"), F.col("c").alias("part"))
    found = written(edges(alone.unionByName(guests)), f"{label}-edges")
    links = connected(found).select(F.col("node").alias("rep"), "component")
    large = large.join(links, "rep", "left").select(group, "i", "c", "rep", "blocks", F.coalesce("component", "rep").alias("part"))
    large = written(large, f"{label}-large")
    most = large.groupBy(group, "part").agg(F.count(F.lit(1)).alias("n")).groupBy(group).agg(F.max(F.struct("n", "part")).alias("most"), F.sum("n").alias("of"))
    told = written(most.select(group, F.col("most.part").alias("main"), (F.col("of") - F.col("most.n")).alias("left"), "of").where("left > 0"), f"{label}-left")
    if not told.limit(1).count():
        return found
    rest = by_key(large, told.withColumn("turns", F.ceil(F.col("left") / block).cast("int")), [group], "of")
    spread = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    here = rest.withColumn("j", spread(F.col("turns"))).select(group, "i", "j", "c", "rep", F.lit(False).alias("asks"), "part")
    asking = rest.where("part <> main").withColumn("j", F.pmod(F.xxhash64("c"), F.col("turns")).cast("int")).withColumn("i", spread(F.col("blocks")))
    return found.unionByName(edges(here.unionByName(asking.select(group, "i", "j", "c", "rep", F.lit(True).alias("asks"), "part"))))


def similar_classes(docs: DataFrame, told: DataFrame, least: int = LEAST) -> DataFrame:
    """Edges (a, b) between documents of classes of equal sets that are similar."""
    kept = told.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = F.min(F.struct("doc_id", "text_hash", "n_shingles", "registers")).alias("r")
    classes = kept.groupBy("d1", "d2").agg(first).select(F.monotonically_increasing_id().alias("c"), F.col("r.doc_id").alias("rep"), "r.text_hash", F.col("r.n_shingles").alias("n"), "r.registers")
    classes = written(classes, "classes")
    bands = mapped(classes.select("c", "rep", "registers"), _bands, "c long, rep long, band long")
    sketch = classes.select("c", "n", "registers")
    with_registers = lambda cells: cells.join(sketch, "c").select("band", *CELLS)
    likely = spanning(bands.withColumn("n", F.lit(0)), "band", with_registers, partial(_forests, least=least), BUCKET_BLOCK, "buckets")
    family = connected(likely)
    family = written(family.select(F.col("component").alias("family"), F.col("node").alias("rep")).union(family.select("component", "component").distinct()), "families")
    members = written(family.join(classes.select("c", "rep", "text_hash", "n"), "rep").select("family", "c", "rep", "text_hash", "n"), "members")
    # of the texts, read again, only those that may be members' are moved
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text").where("text IS NOT NULL")
    texts = possible_members(texts, "rep", members.select("rep")).where("possible").withColumn("text_hash", F.xxhash64("text")).drop("possible")
    texts = written(texts.dropDuplicates(["rep", "text_hash"]).join(members.select("c", "rep", "text_hash"), ["rep", "text_hash"]).select("c", "text"), "member-texts")
    with_texts = lambda cells: cells.join(sketch, "c").join(texts, "c").select("family", *CELLS, "text")
    return spanning(members.select("family", "c", "rep", "n"), "family", with_texts, partial(_forests, least=least, exact=True), FAMILY_BLOCK, "families")


def shared_ids(told: DataFrame) -> DataFrame:
    """Edges (a, b) between the classes that rows of one doc_id with different texts belong to."""
    kept = told.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "d1", "d2")
    ends = kept.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("z"), F.count(F.lit(1)).alias("n"))
    several = written(ends.where("a <> z").select("doc_id", "n"), "shared-ids")
    if not several.limit(1).count():
        return told.sparkSession.createDataFrame([], "a long, b long")
    reps = kept.groupBy("d1", "d2").agg(F.min("doc_id").alias("b"), F.count(F.lit(1)).alias("n"))
    return by_key(by_key(kept, several, ["doc_id"], "n").distinct(), reps, ["d1", "d2"], "n").select(F.col("doc_id").alias("a"), "b")


def near_duplicates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document; ``least``: similarity in hundredths."""
    told = written(sketches(docs), "sketches")
    links = connected(similar_classes(docs, told, least).unionByName(shared_ids(told)))
    classes = told.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    moved = classes.join(links, classes["rep"] == links["node"], "left").withColumn("component_id", F.coalesce("component", "rep"))
    moved = written(moved.where("size > 1 OR component IS NOT NULL").select("d1", "d2", "size", "component_id"), "class-components")
    found = by_key(told.select("doc_id", "n_shingles", "d1", "d2"), moved, ["d1", "d2"], "size", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return found.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_one_of_each(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` without the documents that another one of their component stands for."""
    dropped = written(near_duplicates(docs, least).where("NOT kept").select(F.col("doc_id").alias("__dropped_id")).distinct(), "dropped")
    mark = "__possible"
    told = possible_members(docs, "doc_id", dropped, mark)
    sure = told.where(~F.col(mark)).drop(mark)  # not moved
    rest = told.where(F.col(mark)).drop(mark)
    return sure.unionByName(rest.join(dropped, rest["doc_id"] == dropped["__dropped_id"], "left_anti"))


def op3_setsketch_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
