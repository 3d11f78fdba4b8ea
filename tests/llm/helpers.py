"""Small tables for the operators' edge cases."""

import random

from pyspark.sql import types as T

SYLLABLES = "the and ing ion ent er is of to le ou re an qui été über der schön casa niño".split()


def words(rng, n):
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 3))) for _ in range(n))


def documents(spark, rows, more=()):
    """(doc_id, text, lang) rows as a documents table; ``more``: names of extra string columns."""
    fields = [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    fields += [T.StructField(c, T.StringType()) for c in more]
    full = [(i, t, g, "s", None if t is None else len(t), *("x",) * len(more)) for i, t, g in rows]
    return spark.createDataFrame(full, T.StructType(fields))


def awkward():
    """Nulls, empty and blank texts, a long text, ties, repeated rows, special tokens, unusual characters."""
    rng = random.Random(4)
    long = words(rng, 9000)
    return [
        (0, None, None), (1, "", "en"), (2, " \n\t ", "en"), (3, "one two", "en"), (4, "Don't STOP, l'été   à 12:30! <|endoftext|> done", "fr"),
        (5, long, "en"), (6, long, "en"), (7, long + " tail", None), (8, "日本語 テキスト 😀́ ﬁ İ \x1c \x85 x", "en"), (9, "same text here for all", "en"), (9, "same text here for all", "en"),
        (10, "same text here for all", "de"), (None, "no id at all", "en"), (None, None, None), (11, "x" * 5000, "en"), (12, "1" * 5000, None), (13, words(rng, 300), "en"),
    ]
