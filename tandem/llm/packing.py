"""Packing documents into fixed sequences by cutting-stock column generation (operator 1).

1. A map over documents makes token ids and cuts each document into pieces: whole
   sequences while it is longer, then the rest. The table of pieces (no ids) is written.
2. Piece lengths, rounded up to ``GRAIN`` tokens, give a histogram of at most
   capacity / GRAIN classes: all that the driver needs, whatever the number of documents.
3. The driver solves the linear program over patterns (which classes share a sequence) by
   column generation: a knapsack dynamic program prices new patterns at the current duals.
   Solutions are rounded down, then up while a whole pattern still fits the demand; what
   remains (at most a few sequences for each class) is packed first-fit by class.
4. Pieces are ranked within their class over counted ranges (a class with a third of all
   pieces is as many ranges as it fills) and rank ranges are mapped to pattern slots.

Defined results: a null text counts as the empty text, which is one piece holding the end
id alone; a null doc_id packs like any other; repeated rows are packed once for each row;
very long texts are many pieces; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.ranks import ranges
from .bpe import IDS, PairRanks, byte_characters, tokenizer_json, vocabulary_path
from .common import Memo, kept_for_a_stage, mapped, runs, written

CAPACITY, GRAIN = 4096, 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

#: Fixed value: the pre-tokenization pattern of the word vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Chunks of printable ASCII and Latin-1 letters are normal forms whose lower case is one character each.
PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]*")
#: Of lower-cased bytes the pattern above is this, if all are printable ASCII.
ASCII, ASCII_WORDS = re.compile(rb"[!-~]*"), re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
MEMO_ENTRIES, MEMO_BYTES = 250_000, 48


class WordIds:
    """Ids of whole texts as the tokenizers library gives them, by a bounded memo of white-space chunks.

    ASCII white space separates words in every step of the vocabulary's normalizer, so its
    chunks are encoded on their own; plain ones by the shared rank arrays, others by the
    library itself.
    """

    def __init__(self, name: str, entries: int = MEMO_ENTRIES):
        from tokenizers import Tokenizer

        spec = tokenizer_json(name)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        chars = byte_characters()
        self.library = Tokenizer.from_file(vocabulary_path(name))
        self.library.no_truncation()
        self.library.no_padding()
        self.ranks = PairRanks([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        self.first = np.array([vocab[c] for c in chars], dtype=np.int32)
        self.last = np.array([vocab[c + suffix] for c in chars], dtype=np.int32)
        self.marks = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.mark = os_prefix(self.marks)
        self.words = regex.compile(WORDS)
        self.memo = Memo(entries)
        self.long: list[bytes] = []

    def chunks(self, text: str) -> list[bytes]:
        raw = text.encode()
        if self.mark and self.mark in raw:  # a special token may stand in the text
            return raw.split()
        return raw.lower().split()

    def learn(self, chunks: set[bytes]) -> None:
        new = self.memo.lacking(chunks)
        memo = self.memo.young
        self.long += [c for c in new if len(c) > MEMO_BYTES]
        plain = [c for c in new if c.isalpha()]  # ASCII letters: one word
        memo.update(zip(plain, self.ranks.merge([c.lower() for c in plain], self.first, self.last)))
        cut: list[tuple[bytes, list[bytes]]] = []
        words: dict[bytes, bytes | None] = {}
        other = []
        for c in new:
            if c.isalpha():
                continue
            if c.isascii() and ASCII.fullmatch(c) and not (self.mark in c if self.mark else any(m in c for m in self.marks)):
                cut.append((c, parts := ASCII_WORDS.findall(c.lower())))
                for p in parts:
                    words[p] = memo.get(p)
                continue
            text = c.decode()
            if not PLAIN.fullmatch(text) or (self.mark in c if self.mark else any(m in c for m in self.marks)):
                other.append((c, text))
                continue
            text = text.lower()
            parts = [text.encode()] if text.isalpha() else [p.encode() for p in self.words.findall(text)]
            cut.append((c, parts))
            for p in parts:
                words[p] = memo.get(p)
        lack = [w for w, ids in words.items() if ids is None]
        words.update(zip(lack, self.ranks.merge(lack, self.first, self.last)))
        for c, parts in cut:
            memo[c] = words[parts[0]] if len(parts) == 1 else b"".join([words[p] for p in parts])
        for (c, _), e in zip(other, self.library.encode_batch([t for _, t in other], add_special_tokens=False)):
            memo[c] = np.array(e.ids, dtype=IDS).tobytes()

    def forget(self) -> None:
        self.memo.age(self.long)
        self.long.clear()

    def packed_ids(self, chunks: list[bytes]) -> bytes:
        return self.memo.joined(chunks)

    def encode(self, text: str) -> list[int]:
        chunks = self.chunks(text)
        self.learn(set(chunks))
        return np.frombuffer(self.packed_ids(chunks), dtype=IDS).tolist()


def os_prefix(marks: list[bytes]) -> bytes:
    """The longest common beginning of the special tokens."""
    import os

    return os.path.commonprefix(marks) if marks else b""


@kept_for_a_stage
def word_ids(name: str, entries: int = MEMO_ENTRIES) -> WordIds:
    return WordIds(name, entries)


def _pieces(vocabulary: str, end_id: int, capacity: int, entries: int = MEMO_ENTRIES):
    end = np.array([end_id], dtype=IDS).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(vocabulary, entries)
        gc.disable()  # very many lists of bytes and no cycles: it would only walk them
        try:
            for batch in batches:
                ids = batch.column(0).to_pylist()
                texts = [t or "" for t in batch.column(1).to_pylist()]
                rows = []
                for a, z in runs(texts):
                    cut = [coder.chunks(t) for t in texts[a:z]]
                    coder.learn(set().union(*cut))
                    for doc_id, chunks in zip(ids[a:z], cut):
                        raw = coder.packed_ids(chunks) + end
                        n = len(raw) // 4
                        for start in range(0, n, capacity):
                            part = raw[4 * start : 4 * (start + capacity)]
                            rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n))
                    coder.forget()
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        finally:
            gc.enable()

    return run


def knapsack(prices: np.ndarray, capacity: int) -> np.ndarray:
    """Copies of each class (sizes 1, 2, ...) in the most valuable pattern of at most ``capacity`` units."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for room in range(1, capacity + 1):
        top = min(room, len(prices))
        values = prices[:top] + best[room - 1 :: -1][:top]
        i = int(values.argmax())
        if values[i] > best[room - 1] + 1e-12:
            best[room], took[room] = values[i], i + 1
        else:
            best[room] = best[room - 1]
    copies, room = np.zeros(len(prices), dtype=np.int64), capacity
    while room > 0:
        if took[room]:
            copies[took[room] - 1] += 1
            room -= int(took[room])
        else:
            room -= 1
    return copies


def column_generation(demand: np.ndarray, capacity: int, rounds: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and their fractional numbers for demand[c] pieces of c + 1 units.

    Revised simplex: the basis starts with one pattern for each class; a pattern enters
    while the knapsack prices it above 1. ``rounds`` bounds the work; the solution covers
    the demand after every round.
    """
    kinds = np.flatnonzero(demand)
    need = demand[kinds].astype(float)
    m = len(kinds)
    patterns = np.zeros((m, m))
    np.fill_diagonal(patterns, capacity // (kinds + 1))
    inverse = np.diag(1.0 / np.diag(patterns))
    amount = inverse @ need
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        prices = np.zeros(capacity)
        prices[kinds] = np.maximum(duals, 0)
        column = knapsack(prices, capacity)[kinds].astype(float)
        if column @ duals <= 1 + 1e-9:
            break
        change = inverse @ column
        able = change > 1e-11
        ratio = np.where(able, amount / np.where(able, change, 1), np.inf)
        out = int(ratio.argmin())
        step = ratio[out]
        amount = amount - step * change
        amount[out] = step
        row = inverse[out] / change[out]
        inverse = inverse - np.outer(change, row)
        inverse[out] = row
        patterns[out] = column
    full = np.zeros((m, len(demand)), dtype=np.int64)
    full[:, kinds] = patterns.round().astype(np.int64)
    return full, np.maximum(amount, 0)


def rounded(demand: np.ndarray, patterns: np.ndarray, amount: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """(copies of each class, times) that use every piece exactly once."""
    left, plan = demand.astype(np.int64).copy(), []

    def use(copies: np.ndarray, times: int) -> None:
        some = copies > 0
        times = min(times, int((left[some] // copies[some]).min()))
        if times > 0:
            left[some] -= copies[some] * times
            plan.append((copies, times))

    for p in np.argsort(-amount, kind="stable"):
        if patterns[p].any():
            use(patterns[p], int(amount[p] + 1e-9))
    for p in np.argsort(np.floor(amount) - amount, kind="stable"):
        if patterns[p].any():
            use(patterns[p], 1)
    while left.any():  # the largest class that fits, again and again
        copies, room = np.zeros_like(left), capacity
        for c in np.flatnonzero(left)[::-1]:
            take = min(int(left[c]), room // (c + 1))
            copies[c], room = take, room - take * (c + 1)
        use(copies, int(left.max()))
    return plan


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``pieces`` (at most ``capacity`` long) with sequence_id and offset."""
    spark = pieces.sparkSession
    units = -(-capacity // grain)
    dealt = ranges(pieces.withColumn("kind", F.ceil(F.col("length") / grain).cast("int")), ["doc_id", "start", "ids_crc32", "doc_tokens"], ("kind",))
    demand = np.zeros(units, dtype=np.int64)
    for r in dealt.runs.groupBy("kind").agg(F.max("total").alias("total")).collect():  # units rows at most
        demand[r.kind - 1] = r.total
    slots, sequence = [], 0
    used = np.zeros(units, dtype=np.int64)
    for copies, times in rounded(demand, *column_generation(demand, units), units) if demand.any() else []:
        slot = 0
        for c in np.flatnonzero(copies)[::-1]:
            a = int(copies[c])
            slots.append((int(c) + 1, int(used[c]), int(used[c]) + a * times, a, sequence, slot))
            used[c] += a * times
            slot += a
        sequence += times
    # rank ranges of each class: a row for each class of each pattern, independent of the number of documents
    patterns = spark.createDataFrame(slots, "kind int, low long, high long, copies int, base long, slot int")
    inside = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = dealt.placed("rank").join(F.broadcast(patterns.withColumnRenamed("kind", "of")), (F.col("kind") == F.col("of")) & inside)
    placed = placed.withColumn("sequence_id", F.expr("base + (rank - low) div copies")).withColumn("slot", F.col("slot") + F.expr("(rank - low) % copies"))
    ahead = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).select(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 2, capacity: int = CAPACITY, grain: int = GRAIN, entries: int = MEMO_ENTRIES) -> DataFrame:
    """All documents in sequences of ``capacity`` tokens: a row for each piece. ``entries``: size of a worker's memo, memory against time."""
    pieces = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _pieces(vocabulary, end_id, capacity, entries), PIECES)
    return pack(written(pieces, "pieces"), capacity, grain)


def op1_column_generation(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
