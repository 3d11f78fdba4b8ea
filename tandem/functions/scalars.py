"""Scalar functions of the data model as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded

#: What counts as white space in texts, as the inside of a character class.
WHITE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """The text without white space of any kind at either end."""
    return F.regexp_replace(text, rf"\A[{WHITE}]+|[{WHITE}]+\z", "")


def margin(scores: dict[str, Column], positive: str, negative: Column) -> Column:
    """Score of the positive label minus that of the row's negative label; null for an unknown label."""
    other = None
    for label, score in scores.items():
        if label != positive:
            other = (F.when(negative == label, score) if other is None else other.when(negative == label, score))
    return scores[positive] - other


def mapped_margin(scores: dict[str, Column], mapping: Column, positive: Column, negative: Column) -> Column:
    """The margin when a map column says which label each choice stands for; null unless the map is a bijection."""
    back = F.map_from_arrays(F.map_values(mapping), F.map_keys(mapping))
    by_choice = F.create_map(*(x for c, s in scores.items() for x in (F.lit(c), s)))
    whole = F.size(F.array_distinct(F.map_values(mapping))) == len(scores)
    return F.when(whole, F.try_element_at(by_choice, F.try_element_at(back, positive)) - F.try_element_at(by_choice, F.try_element_at(back, negative)))


def first_argmax(scores: list[tuple[str, Column]]) -> Column:
    """The choice of the largest score; ties go to the choice declared first."""
    top = F.greatest(*(s for _, s in scores))
    out = None
    for name, score in scores:
        out = F.when(score == top, name) if out is None else out.when(score == top, name)
    return out


def log_softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    total = top + F.ln(sum((F.exp(s - top) for s in scores[1:]), F.exp(scores[0] - top)))
    return [s - total for s in scores]


def binary_use(kind: Column, without: Column, with_: Column, target: Column) -> Column:
    """Whether a context was used: for irrelevant contexts an unchanged answer, else the target, case aside.

    White space around answers is no part of them; a target stands as it is.
    """
    plain = lambda c: folded(stripped(c))
    return F.when(kind == "irrelevant", plain(without) == plain(with_)).otherwise(plain(with_) == folded(target))


def continuous_use(before: Column, after: Column) -> Column:
    """Change of a probability as a share of the room that it had; null unless both lie inside (0, 1)."""
    inside = (before > 0) & (before < 1) & (after > 0) & (after < 1)
    return F.when(inside, F.when(after >= before, (after - before) / (1 - before)).otherwise((after - before) / before))


def direction(value: Column) -> Column:
    """1, 0.5 or 0 for positive, zero and negative."""
    return (F.signum(value) + 1) / 2


def without_bias(probability: Column, bias: Column) -> Column:
    """The probability before ``bias`` was added to its log-odds."""
    return 1 / (1 + F.exp(-(F.ln(probability) - F.log1p(-probability) - bias)))


def stable_probe(values: Column, tolerance: float) -> Column:
    """The first of the first two usable probes of an array, if their logarithms agree; else null."""
    usable = F.slice(F.filter(values, lambda v: (v > 0) & (v < 1)), 1, 2)
    agree = F.abs(F.ln(usable[0]) - F.ln(usable[1])) <= tolerance
    return F.when((F.size(usable) == 2), F.when(agree, usable[0]))


def parse_choice(raw: Column, letters: list[str]) -> tuple[Column, Column]:
    """(letter, reason of failure): the text, stripped of white space and upper-cased, must be one of the letters."""
    text = F.upper(stripped(raw))
    # fixed values: the reasons
    reason = F.when(raw.isNull(), "invalid_response_type").when(text == "", "empty_response").when(F.char_length(text) != 1, "not_single_choice").when(~text.isin(letters), "disallowed_choice")
    return F.when(reason.isNull(), text), reason


def choice_grammar(letters: list[str]) -> Column:
    return F.concat(F.lit("root ::= "), F.concat_ws(" | ", *(F.lit(f'"{x}"') for x in letters)))


def frozen_bin(value: Column, cuts: list[Column]) -> Column:
    """1 + the number of cut points below the value: ties go to the lower bin."""
    return sum(((value > c).cast("int") for c in cuts[1:]), (value > cuts[0]).cast("int")) + 1


def stable_rank(seed: int, namespace: str, value: Column) -> Column:
    """A total order that depends on nothing but seed, namespace and value."""
    return F.sha2(F.concat_ws("|", F.lit(seed), F.lit(namespace), value.cast("string")), 256)


def normal_text(text: Column) -> Column:
    """Case folded, stripped, every run of white space one space; a null text is an empty one."""
    # the wide class first: a letter is told by two comparisons
    return folded(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[\x00-\x20\x80-\uffff&&[{WHITE}]]+", " ")))


def text_digest(text: Column) -> Column:
    return F.sha2(normal_text(text), 256)


def target_label(kind: Column, query_label: Column, new_target: Column) -> Column:
    """The label that counts as used: the query's own for irrelevant contexts, else the context's target."""
    return F.when(kind == "irrelevant", query_label).otherwise(new_target)


def identity(*columns: str) -> Column:
    """The digest of the canonical JSON of text columns: keys in order, no spaces."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def signed(value: Column, digits: int) -> Column:
    """A number with its sign and a fixed number of decimals."""
    rounded = F.abs(F.round(value, digits)).cast(f"decimal(38,{digits})")
    return F.concat(F.when(value < 0, "-").otherwise("+"), rounded.cast("string"))


#: Characters that TeX reads as commands, and how they are written.
TEX = (("\\", r"\textbackslash{}"), ("&", r"\&"), ("%", r"\%"), ("$", r"\$"), ("#", r"\#"), ("_", r"\_"), ("{", r"\{"), ("}", r"\}"), ("~", r"\textasciitilde{}"), ("^", r"\textasciicircum{}"))


def escaped(text: Column) -> Column:
    """Every character that TeX would read as a command, written out; one pass over the characters."""
    table = F.create_map(*(F.lit(x) for pair in TEX for x in pair))
    return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
