"""Language identification by averaged hashed subword embeddings (operator 6).

A text is the mean of the embeddings of its letter n-grams (1 to 3, words bounded), hashed
into ``BUCKETS`` rows; a linear softmax over that mean names the language. Both are trained
by stochastic gradient descent in numpy on a bounded sample of labelled documents
(``sample_rows``, spread over the languages; only their hashed counts reach the driver).
At most ``LANGUAGES`` values of lang, the most frequent, are learned. Every fifth row of each
language isn't trained on: these rows set the softmax temperature, so that scores are
calibrated, and the score below which a prediction is rejected. Prediction is a map
over whole texts with the product of the two matrices, buckets x languages, broadcast.

Defined results: a null text, or one without a letter, is ``und`` with score 0 and is
rejected; when nothing can be learned every document is; a null doc_id is not held out and
is never learned from; documents without lang are predicted but not learned from; repeated
rows give repeated results; very long texts are read whole, in blocks that overlap by the
two letters that an n-gram may reach back; further columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mapped, small

BUCKET_BITS, DIM, BLOCK = 14, 16, 1 << 20
BUCKETS = 1 << BUCKET_BITS
#: At most this many labelled rows are fitted (expected number; the languages share it evenly, each has one at least).
SAMPLE_ROWS = 2400
#: A sample holds OVERDRAWN times its rows at most.
OVERDRAWN = 2
#: The part of right predictions that rejection may cost on the calibration rows.
REJECT = 0.001

SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def _grams(codes: np.ndarray) -> list[np.ndarray]:
    """Hashes of the 1-, 2- and 3-grams of letters (0: no letter), each by the place where it ends."""
    one = codes * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (codes[1:] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = ((two[:-1] ^ codes[2:]) * np.uint32(0x27D4EB2F)) ^ np.uint32(0x165667B1)
    return [one[codes != 0], two, (three * np.uint32(0x9E3779B1))[codes[1:-1] != 0]]


def subwords(text: str) -> np.ndarray:
    """Bucket of every letter n-gram of the text; runs of other characters count as one."""
    out = [np.empty(0, np.uint32)]
    before = np.zeros(1, np.uint32)  # the last two letters of the block before
    for at in range(0, len(text), BLOCK):
        codes = np.frombuffer(text[at : at + BLOCK].lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        codes = np.where(_letters()[codes], codes, np.uint32(0))
        last = at + BLOCK >= len(text)
        full = np.concatenate([before, codes, np.zeros(int(last), np.uint32)])
        full = full[np.concatenate([[True], (full[1:] != 0) | (full[:-1] != 0)])]
        one, two, three = _grams(full)
        # n-grams within the letters carried over were counted with their block
        carried = len(before)
        out += [one[int((before != 0).sum()) :], two[max(0, carried - 1) :], three]
        before = full[-2:]
    return np.concatenate(out) >> np.uint32(32 - BUCKET_BITS)


@dataclass
class Model:
    """languages, summed weights (buckets x languages), bias, temperature, least score."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0

    def logits(self, buckets: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        if counts is None:
            counts = np.bincount(buckets, minlength=BUCKETS)
            buckets = np.flatnonzero(counts)
            counts = counts[buckets]
        return counts @ self.weights[buckets] / counts.sum() + self.bias

    def scores(self, logits: np.ndarray) -> np.ndarray:
        z = (logits - logits.max(axis=-1, keepdims=True)) / self.temperature
        e = np.exp(z)
        return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 6, rate: float = 2.0, seed: int = 7) -> Model | None:
    """A model from (language, buckets, counts); every fifth row calibrates."""
    rows = [r for r in rows if len(r[1])]
    if not rows:
        return None
    languages = sorted({r[0] for r in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    # the first row of a language trains, every fifth after it calibrates
    nth: dict[str, int] = {}
    place = [nth.update({r[0]: nth.get(r[0], -1) + 1}) or nth[r[0]] for r in rows]
    fit = [r for n, r in zip(place, rows) if n % 5 != 4]
    rng = np.random.default_rng(seed)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    shares = [(number[g], b, (c / c.sum()).astype(np.float32)) for g, b, c in fit]
    # rare languages weigh as much as frequent ones
    seen = np.bincount([g for g, _, _ in shares], minlength=len(languages))
    weight = len(shares) / (len(languages) * np.maximum(seen, 1))
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(shares)):
            gold, b, share = shares[i]
            hidden = share @ embed[b]
            z = hidden @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[gold] -= 1
            p *= np.float32(weight[gold] * step)
            back = out @ p
            out -= np.outer(hidden, p)
            bias -= 0.05 * p
            # shares are small numbers spread over many rows: the step of a row is raised by their norm
            embed[b] -= np.outer(share / max(1e-6, float(share @ share)) * 0.05, back)
    model = Model(languages, (embed @ out).astype(np.float64), bias.astype(np.float64))
    held = [r for n, r in zip(place, rows) if n % 5 == 4] or rows
    gold = np.array([number[r[0]] for r in held])
    logits = np.array([model.logits(b, c) for _, b, c in held])
    loss = []
    grid = np.geomspace(0.05, 20, 49)
    for t in grid:
        model.temperature = t
        loss.append(-np.log(np.maximum(model.scores(logits)[np.arange(len(held)), gold], 1e-12)).mean())
    model.temperature = float(grid[int(np.argmin(loss))])
    p = model.scores(logits)
    right = p.max(axis=1)[p.argmax(axis=1) == gold]
    model.least = min(0.5, float(np.quantile(right, REJECT))) if len(right) else 0.0
    return model


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches):
        rows = []
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            found, n = np.unique(subwords(text), return_counts=True)
            rows.append((lang, found.astype("<u2").tobytes(), n.astype("<u4").tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.binary(), pa.binary()))], names=["lang", "buckets", "counts"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """A model learned from text and lang of documents that are not held out."""
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # the classes of the model
    if not sizes:
        return None
    quota = max(1, sample_rows // len(sizes))
    spark = docs.sparkSession
    rates = spark.createDataFrame([(g, min(1.0, quota / n)) for g, n in sizes.items()], "lang string, rate double")
    drawn = known.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1_000_003)) < F.col("rate") * 1_000_003)
    drawn = drawn.where(F.col("text").isNotNull()).limit(OVERDRAWN * max(sample_rows, len(sizes)))  # rows of one doc_id are drawn together
    rows = mapped(drawn.select("lang", "text"), _counts, "lang string, buckets binary, counts binary").collect()
    rows = sorted((r["lang"], bytes(r["buckets"]), bytes(r["counts"])) for r in rows)  # the order of training doesn't depend on partitions
    return train([(g, np.frombuffer(b, "<u2"), np.frombuffer(c, "<u4")) for g, b, c in rows])


def judge(model: Model | None, text: str | None) -> tuple[str, float, bool]:
    """Language, calibrated score, and whether the prediction is rejected."""
    buckets = subwords(text) if text and model is not None else ()
    if not len(buckets):
        return "und", 0.0, True
    p = model.scores(model.logits(buckets))
    best = int(p.argmax())
    return model.languages[best], float(p[best]), bool(p[best] < model.least)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document."""
    told = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = [judge(told.value, text) for text in batch.column(2).to_pylist()]
            columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text"), run, SCHEMA)


def identify(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    return predict(docs, fit(docs, sample_rows))


def keep_identified(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` without the documents that language identification rejects; all columns stay as they are."""
    bound_batches(docs.sparkSession)
    told = docs.sparkSession.sparkContext.broadcast(fit(docs, sample_rows))

    @F.arrow_udf("boolean")
    def identified(texts: pa.Array) -> pa.Array:
        return pa.array([not judge(told.value, t.as_py())[2] for t in texts], pa.bool_())

    return docs.where(identified("text"))  # only texts go to Python, only booleans come back


def op6_subword_language(spark, sf_dir: str) -> DataFrame:
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
