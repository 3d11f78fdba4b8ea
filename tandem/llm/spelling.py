"""Spelling variants: words one letter apart, grouped under their most frequent forms (operator 11).

Counting: one pass over the texts sums a worker's words before they are shuffled.

Near words: of two words that are one error apart, either the first half of the shorter one
stands unchanged at the other's beginning, or its second half stands unchanged at the other's
end. So words are dealt to groups by either half. A task takes groups up to ``BLOCK`` letters,
builds the minimal acyclic automaton of their words, forward for first halves and of reversed
words for second ones, walks each word's half exactly and completes it with one error; the
numbers that perfect hashing gives to the words found lead to their counts. A pair that agrees
on both halves is given by the forward automaton alone, so nothing need be deduplicated later.

A group of more than ``GROUP`` words (a prefix that a third of all words may share) is dealt
anew: what lies between the known beginning and end is halved again, and so on until groups
are small or the error's place is known, where a group is bounded by the alphabet. What lies
between is halved likewise while it has more than ``LONG`` letters. A pair belongs to the one
group that is named by the length of its common beginning; no pair is lost or found twice.

Roots: pointers to forms are doubled by joins. A form has at least twice its word's count, so
few rounds are needed and no cycle can arise.

Defined results: null and empty texts have no words; a null doc_id counts as an empty one;
repeated rows count each; among forms of equal count the smallest in code-point order is
taken; words of any length are whole; an empty table gives no words; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automata import Automaton
from .common import mapped, small, table, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
SLIP, LETTERS, OCCURRENCES, RATIO = 97, 5, 3, 2
LOWER = {c: c + 32 for c in range(65, 91)}

#: Characters of a text taken at once; distinct words that a worker holds; letters of one automaton.
PIECE, HELD, BLOCK = 1 << 20, 1 << 18, 100_000
GROUP, LONG = 8192, 64
PRIVATE = 0xF0000

COUNTS = "word string, n long"
NEAR = "word string, n_near long, form_n long, form string"


# --- words -----------------------------------------------------------------------------


def runs_of(text: str) -> Counter:
    """Maximal runs of letters, A-Z lower-cased, with their counts; long texts are cut between runs."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text) and (more := RUN.match(text, end)):
            end = more.end()
        found.update(RUN.findall(text, at, end))
        at = end
    out: Counter = Counter()
    for run, n in found.items():
        out[run if run.islower() else run.translate(LOWER)] += n
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in small(batches):
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            mark = f"{'' if doc is None else doc}:".encode()
            for run, n in runs_of(text or "").items():
                h = crc32(run.encode(), crc32(mark))
                if h % SLIP == 0:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                if len(run) >= LETTERS:
                    held[run] += n
            if len(held) > HELD:
                yield _rows(held)
                held.clear()
    yield _rows(held)


def _rows(held: Counter) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held.keys()), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])


def word_counts(docs: DataFrame, occurrences: int = OCCURRENCES) -> DataFrame:
    """word and n of the words with enough letters and occurrences, slips of the pen included."""
    counted = mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), _counted, COUNTS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


# --- near words ------------------------------------------------------------------------


def halved(rows: DataFrame) -> DataFrame:
    """Each row in two groups: what lies between its known ends (``head`` and ``tail`` letters) is halved.

    ``forward``: the beginning is longer now. Else the end is, and only pairs whose common
    beginning is shorter than ``below`` letters count, since longer ones are found forward.
    """
    between = F.col("size") - F.col("head") - F.col("tail")
    half = F.floor(between / 2).cast("int")
    ways = F.array(
        F.struct(F.lit(True).alias("forward"), (F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("below").alias("below")),
        F.struct(F.lit(False).alias("forward"), F.col("head").alias("head"), (F.col("tail") + between - half).alias("tail"), F.least("below", F.col("head") + half).alias("below")),
    )
    dealt = rows.select("word", "n", "size", "asks", "deep", F.explode(ways).alias("way")).select("word", "n", "size", "asks", "deep", "way.*")
    ends = F.substring("word", F.lit(1), F.col("head")), F.substring("word", F.char_length("word") - F.col("tail") + 1, F.col("tail"))
    return dealt.withColumn("group", F.xxhash64("size", "forward", "head", *ends))


def _between() -> F.Column:
    return F.col("size") - F.col("head") - F.col("tail")


def grouped(words: DataFrame) -> DataFrame:
    """The words in all their groups: as askers for their own length, and as answers for that and one letter less."""
    length = F.char_length("word")
    sizes = F.explode(F.array(length, length - 1)).alias("size")
    start = words.select("word", "n", sizes).select("word", "n", "size", (F.col("size") == length).alias("asks"), F.lit(False).alias("deep"), F.lit(0).alias("head"), F.lit(0).alias("tail"), F.col("size").alias("below"))
    rows = halved(start)
    done: list[DataFrame] = []
    longest = words.agg(F.max(length)).first()[0] or 0
    while longest > 2 * LONG:
        done.append(rows.where(_between() <= LONG))
        rows = halved(rows.where(_between() > LONG).withColumn("deep", F.lit(True)))
        longest = -(-longest // 2)
    for part in done:
        rows = rows.unionByName(part)
    out = None
    while True:
        rows = written(rows, "halves")
        many = written(rows.where(_between() > 1).groupBy("group").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > GROUP).select("group"), "large-groups")
        if many.limit(1).count() == 0:
            return rows if out is None else out.unionByName(rows)
        rest = rows.join(many, "group", "left_anti").select(*rows.columns)
        out = rest if out is None else out.unionByName(rest)
        rows = halved(rows.join(many, "group", "left_semi").withColumn("deep", F.lit(True)))


def _block(rows: list[tuple], forward: bool) -> dict[str, list]:
    """word -> [near words, largest count, that word] of the askers among ``rows`` of whole groups and of the words they find.

    ``rows``: (group, word, n, asks, deep, head, tail, below). Automata hold whole words, reversed
    unless ``forward``; of deep groups one sign for the known ends, and what lies between.
    """
    places: dict[tuple, str] = {}
    texts: dict[str, tuple] = {}
    asked = []
    for group, word, n, asks, deep, head, tail, below in rows:
        middle = word[head : len(word) - tail]
        if deep:
            known = places.setdefault((word[:head], word[len(word) - tail :], group), chr(PRIVATE + len(places)))
        else:
            known = word[:head] if forward else word[len(word) - tail :][::-1]
        rest = middle if forward else middle[::-1]
        texts[known + rest] = (word, n)
        if asks:
            asked.append((known, rest, middle, head, below, word, n))
    names = sorted(texts)
    found = [texts[t] for t in names]
    automaton = Automaton(names)
    out: dict[str, list] = {}

    def told(word: str, n: int, near: str) -> None:
        best = out.setdefault(word, [0, 0, ""])
        best[0] += 1
        if n > best[1] or n == best[1] and near < best[2]:
            best[1:] = n, near

    for known, rest, middle, head, below, word, n in asked:
        for number in automaton.with_one_error(known, rest):
            near, m = found[number]
            if not forward and below - head <= len(middle) and near[head : below] == middle[: below - head]:
                continue  # the beginnings agree: found forward
            told(word, m, near)
            if len(near) > len(word):
                told(near, n, word)
    return out


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["forward", "group", "word", "n", "asks", "deep", "head", "tail", "below"]
    held: list[tuple] = []
    letters = 0
    way = last = None
    for batch in small(batches, 8192):
        for forward, *row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if held and (forward != way or (letters > BLOCK and row[0] != last)):
                yield _found(_block(held, way))
                held, letters = [], 0
            way, last = forward, row[0]
            held.append(tuple(row))
            letters += min(len(row[1]), 2 * LONG)
    if held:
        yield _found(_block(held, way))


def _found(out: dict[str, list]) -> pa.RecordBatch:
    best = list(out.values())
    return pa.record_batch([pa.array(list(out.keys()), pa.string()), pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.int64()), pa.array([b[2] for b in best], pa.string())], ["word", "n_near", "form_n", "form"])


def near_words(words: DataFrame) -> DataFrame:
    """Of each word with a near one: n_near, and the near word of the largest count (form, form_n)."""
    dealt = grouped(words).repartition("group").sortWithinPartitions("forward", "group", "word")
    found = mapped(dealt.select("forward", "group", "word", "n", "asks", "deep", "head", "tail", "below"), _searched, NEAR)
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.less")).alias("form_n"), "best.form")


# --- groups ----------------------------------------------------------------------------


def roots(links: DataFrame) -> DataFrame:
    """word and root, the last of the forms from word (word, form) on; words without a form aren't listed."""
    now = written(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = now.join(far, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        moved = written(moved, "roots")
        now = moved.drop("moved")
        if moved.where("moved").limit(1).count() == 0:
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n of (word, n): forms are near words at least ``ratio`` times as frequent."""
    words = written(words, "words")
    near = words.join(near_words(words), "word", "left")
    ok = F.col("form_n") >= ratio * F.col("n")
    told = written(near.select("word", F.when(ok, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(ok, F.col("form_n")).alias("form_n")), "variants")
    out = told.join(roots(told.where("form IS NOT NULL")), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_halves_automata(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents")))
