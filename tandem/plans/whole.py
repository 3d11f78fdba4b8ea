"""Queries over whole texts that SQL can't express; tests compare them with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ranks import ranked
from ..sources.fixtures import table
from . import effects, procedures

QUERIES: dict = {}

def query(f):
    QUERIES[f.__name__] = f
    return f


# texts


def edit_features_of(texts: DataFrame, group: str, order: str) -> DataFrame:
    """Token edit distances, over whole texts, of each text to the next one of its group.

    Places in a group are counted over ranges, and each neighbourhood is a key of its own, so
    a group of any size is dealt over all tasks.
    """
    placed = ranked(texts.select(group, order, "text"), [order, "text"], (group,))
    left, right = (placed.select(group, (F.col("place") - i).alias("at"), F.lit(i).alias("side"), order, "text") for i in (0, 1))
    side = lambda i, c: F.max(F.when(F.col("side") == i, F.col(c)))
    pairs = left.unionByName(right).groupBy(group, "at").agg(side(0, order).alias("left_id"), side(1, order).alias("right_id"), side(0, "text").alias("a"), side(1, "text").alias("b"))
    pairs = pairs.where("a IS NOT NULL AND b IS NOT NULL")
    words = pairs.select(group, "left_id", "right_id", X.tokens(F.col("a")).alias("x"), X.tokens(F.col("b")).alias("y"))
    told = words.withColumn("distance", X.token_distance(F.col("x"), F.col("y")).cast("long"))
    return told.select(group, "left_id", "right_id", "distance", F.round(X.normalised_distance(F.col("distance"), F.col("x"), F.col("y")), 9).alias("normalised"))


@query
def edit_features_whole(spark, sf):
    """Whole texts of consecutive turns of a conversation."""
    return edit_features_of(table(spark, sf, "conversations"), "conv_id", "turn")


@query
def edit_signatures_whole(spark, sf):
    """Numbers, dates and negations of every document, as sorted lists joined by spaces."""
    text, joined = F.col("text"), lambda c: F.array_join(c, " ")
    return table(spark, sf, "documents").select("doc_id", joined(X.signature(text, X.NUMBER)).alias("numbers"), joined(X.signature(text, X.DATE)).alias("dates"), joined(X.negations(text)).alias("negations"))


@query
def quartet_edit_features_whole(spark, sf):
    """The whole feature row of two claims and two evidences: four consecutive turns of a conversation."""
    turns = table(spark, sf, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "role", "text")
    placed = ranked(turns, ["turn", "role", "text"], ("conv_id",), "n")
    four = placed.groupBy("conv_id", F.expr("n div 4").alias("quartet")).agg(*(F.max(F.when(F.col("n") % 4 == i, F.col("text"))).alias(f"t{i}") for i in range(4))).where("t3 IS NOT NULL")
    return X.with_edit_features(four, ("t0", "t1"), ("t2", "t3")).drop("t0", "t1", "t2", "t3")


# The plain names of these took fewer rows or draws once; now either name takes all.

ORACLE: dict[str, str] = {}
for _plans, _names in ((procedures, ("bootstrap_interval", "stratified_bootstrap", "balanced_accuracy_bootstrap", "sign_flip", "condition_swap", "parse_choice")), (effects, ("mcnemar", "paired_cases"))):
    for _name in _names:
        QUERIES[f"{_name}_whole"], ORACLE[f"{_name}_whole"] = _plans.QUERIES[_name], _plans.ORACLE[_name]
QUERIES["edit_features"] = edit_features_whole
