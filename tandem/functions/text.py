"""Tokens, signatures and edit features of texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What counts as a token, a number, a date, a contracted negation; the words that negate.
TOKEN = r"(?U)\w+|[^\w\s]"
NUMBER = r"(?U)(?<!\w)[+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?%?(?!\w)"
MONTH = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|jun(?:e)?|jul(?:y)?|aug(?:ust)?|sep(?:tember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
DATE = rf"(?iU)(?<!\w)(?:\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|\d{{1,2}}[-/.]\d{{1,2}}[-/.]\d{{2,4}}|(?:{MONTH})\s+\d{{1,2}}(?:st|nd|rd|th)?,?\s+\d{{4}})(?!\w)"
CONTRACTION = r"(?iU)\b\w+n['’]t\b"
NEGATIONS = ["no", "not", "never", "neither", "nor", "none", "nobody", "nothing", "nowhere", "without", "否", "不", "没", "没有", "并非", "从未"]


def folded(text: Column) -> Column:
    """Case folded, not only lowered: ß is ss, ſ is s, a final sigma is a sigma; a dotless i stays one."""
    # what stands between lower and upper also keeps the optimizer from taking one for both
    mark, dotless = F.lit("\uf8fe"), F.lit("ı")
    upper = F.upper(F.replace(F.lower(text), dotless, mark))
    return F.replace(F.lower(F.replace(upper, mark, dotless)), F.lit("ς"), F.lit("σ"))


def tokens(text: Column) -> Column:
    """Words and single punctuation marks, case folded."""
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), folded)


def signature(text: Column, pattern: str) -> Column:
    """The sorted, case-folded matches of a pattern: equal signatures are equal multisets."""
    return F.array_sort(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), folded))


def negations(text: Column) -> Column:
    """The sorted negating words and contractions (don't) of a text."""
    words = F.filter(tokens(text), lambda w: w.isin(NEGATIONS))
    return F.array_sort(F.concat(words, signature(text, CONTRACTION)))


def edit_features(claims: tuple[Column, Column], evidences: tuple[Column, Column], words: tuple[tuple[Column, Column], tuple[Column, Column]] | None = None) -> dict[str, Column]:
    """All edit features of two claims and two evidences: distances, token counts, and what changed.

    ``words``: their tokens, if they are columns already; ``with_edit_features`` makes them once.
    """
    out: dict[str, Column] = {}
    for i, (name, (a, b)) in enumerate((("claim", claims), ("evidence", evidences))):
        x, y = words[i] if words else (tokens(a), tokens(b))
        distance = token_distance(x, y).cast("long")
        out |= {f"{name}_distance": distance, f"{name}_distance_normalised": normalised_distance(distance, x, y), f"{name}_left_tokens": F.size(x), f"{name}_right_tokens": F.size(y)}
        out |= {f"{name}_numeric_change": signature(a, NUMBER) != signature(b, NUMBER), f"{name}_date_change": signature(a, DATE) != signature(b, DATE), f"{name}_negation_change": negations(a) != negations(b)}
    return out


def with_edit_features(frame: DataFrame, claims: tuple[str, str], evidences: tuple[str, str]) -> DataFrame:
    """``frame`` with all edit features; the tokens of its four texts are made in one step and used in the next."""
    texts = [*claims, *evidences]
    split = frame.withColumns({f"__words_{i}": tokens(F.col(t)) for i, t in enumerate(texts)})
    w = [F.col(f"__words_{i}") for i in range(4)]
    pair = lambda names: tuple(F.col(n) for n in names)
    return split.withColumns(edit_features(pair(claims), pair(evidences), ((w[0], w[1]), (w[2], w[3])))).drop(*(f"__words_{i}" for i in range(4)))


def token_distance(left: Column, right: Column) -> Column:
    """Exact edit distance of two token arrays of any length; null where either is null."""
    return _distances(left, right)


def edit_distance(left: list, right: list) -> int:
    """Exact edit distance of two sequences of hashable items."""
    codes: dict = {}
    return coded_distance(*(np.array([codes.setdefault(w, len(codes)) for w in words], np.int64) for words in (left, right)))


def coded_distance(a: np.ndarray, b: np.ndarray) -> int:
    """Edit distance of two arrays of codes: what lies between their common ends, column by column in bits.

    A column of differences of the distance table (Myers, 1999; Hyyrö, 2003) is two whole
    numbers of as many bits as the longer side has items, so a step costs a few long additions.
    """
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[:n] != b[:n])
    at = int(differs[0]) if len(differs) else n
    a, b = a[at:], b[at:]
    n = min(len(a), len(b))
    differs = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    end = int(differs[0]) if len(differs) else n
    a, b = a[: len(a) - end], b[: len(b) - end]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    at_code: dict[int, int] = {}
    order = np.argsort(a, kind="stable")
    for code, places in zip(*_runs(a, order), strict=True):
        bits = np.zeros(len(a) + 7, np.uint8)
        bits[places] = 1
        at_code[code] = int.from_bytes(np.packbits(bits[: len(a) // 8 * 8 + 8], bitorder="little").tobytes(), "little")
    full = (1 << len(a)) - 1
    top = 1 << (len(a) - 1)
    more, less, score = full, 0, len(a)
    for code in b.tolist():
        same = at_code.get(code, 0)
        vertical = same | less
        level = (((same & more) + more) ^ more) | same
        up = less | (full & ~(level | more))
        down = more & level
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up = (up << 1 | 1) & full
        down = down << 1 & full
        more = down | (full & ~(vertical | up))
        less = up & vertical
    return score


def _runs(a: np.ndarray, order: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct codes and the places of each."""
    cuts = np.flatnonzero(np.diff(a[order])) + 1
    return a[order[np.concatenate([[0], cuts])]].tolist(), np.split(order, cuts)


@F.arrow_udf(T.IntegerType())
def _distances(left: pa.Array, right: pa.Array) -> pa.Array:
    codes = pa.concat_arrays([left.flatten(), right.flatten()]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    sides = []
    at = 0
    for side in (left, right):
        lengths = side.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = at + np.cumsum(lengths)
        sides.append((ends - lengths, ends))
        at += int(lengths.sum())
    known = pc.and_(left.is_valid(), right.is_valid()).to_pylist()
    (la, lz), (ra, rz) = sides
    return pa.array([coded_distance(codes[la[i] : lz[i]], codes[ra[i] : rz[i]]) if ok else None for i, ok in enumerate(known)], pa.int32())


def normalised_distance(distance: Column, left: Column, right: Column) -> Column:
    return distance / F.greatest(F.size(left), F.size(right), F.lit(1))
