"""Cells to cases, cases to clusters: the two-level aggregation of paired effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Signs of the four cells of a case in its interaction.
SIGNS = (1, -1, -1, 1)


def interaction(value: Column, index: Column, complete: Column | None = None) -> Column:
    """(v0 - v1 - v2 + v3) / 2 as one aggregate; null unless all four cells are complete."""
    at = lambda i: F.max(F.when(index == i, value))  # noqa: E731  a cell index occurs once in a case
    whole = (at(0) - at(1) - at(2) + at(3)) / 2
    if complete is None:
        return whole
    return F.when(F.count_if(complete) == 4, whole)


def summarise_cases(cells: DataFrame, score: str, prediction: str, gold: str = "gold", ok: str | None = None) -> DataFrame:
    """interaction, accuracy, four-bit pattern of right cells, and coverage of each case. A cell without result counts as wrong."""
    usable = F.col(ok) if ok else F.lit(True)
    right = F.coalesce(usable & (F.col(prediction) == F.col(gold)), F.lit(False))
    bit = lambda i: F.max(F.when(F.col("cell_index") == i, F.when(right, "1").otherwise("0")))
    return cells.groupBy("case_id").agg(
        F.min("cluster_id").alias("cluster_id"),
        interaction(F.col(score), F.col("cell_index"), usable).alias("interaction"),
        F.avg(right.cast("double")).alias("accuracy"),
        F.concat(*(bit(i) for i in range(4))).alias("pattern"),
        F.avg(usable.cast("double")).alias("coverage"),
    )


def pair(left: DataFrame, right: DataFrame, key: str, values: list[str], equal: tuple[str, ...] = ()) -> DataFrame:
    """Two conditions side by side on equal keys: <value>_left, <value>_right and <value>_effect (right - left).

    ``status`` says what is wrong with a key: only_left, only_right, or differs (metadata in
    ``equal``); ok otherwise. Nothing is dropped: callers assert on status.
    """
    a = left.select(key, *(F.col(c).alias(f"{c}_left") for c in (*values, *equal)))
    b = right.select(key, *(F.col(c).alias(f"{c}_right") for c in (*values, *equal)), F.lit(True).alias("has_right"))
    both = a.withColumn("has_left", F.lit(True)).join(b, key, "full_outer")
    status = F.when(F.col("has_right").isNull(), "only_left").when(F.col("has_left").isNull(), "only_right")
    for c in equal:
        status = status.when(~F.col(f"{c}_left").eqNullSafe(F.col(f"{c}_right")), "differs")
    both = both.withColumn("status", status.otherwise("ok")).drop("has_left", "has_right")
    for c in values:
        both = both.withColumn(f"{c}_effect", F.col(f"{c}_right") - F.col(f"{c}_left"))
    return both


def cluster_means(cases: DataFrame, cluster: str, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    return cases.groupBy(*by, cluster).agg(F.avg(value).alias("effect"), F.count(value).alias("cases"))


def balanced_mean(clusters: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean of cluster means, the case-weighted mean, and their sizes."""
    return clusters.groupBy(*by).agg(
        F.avg("effect").alias("balanced"),
        (F.sum(F.col("effect") * F.col("cases")) / F.sum("cases")).alias("weighted"),
        F.count(F.lit(1)).alias("clusters"),
        F.sum("cases").alias("cases"),
    )


def capped_mean(clusters: DataFrame, cap: int) -> DataFrame:
    """Cluster means weighted by their number of cases, up to ``cap``."""
    weight = F.least("cases", F.lit(cap))
    return clusters.agg((F.sum(F.col("effect") * weight) / F.sum(weight)).alias("capped"))


def jackknife(clusters: DataFrame, cluster: str) -> DataFrame:
    """Range of the leave-one-cluster-out means, whether the sign turns, and the most influential cluster.

    A closed form over two sums; ties go to the larger cluster name.
    """
    totals = clusters.agg(F.sum("effect").alias("s"), F.count(F.lit(1)).alias("n"))
    left_out = clusters.crossJoin(F.broadcast(totals)).withColumn("without", (F.col("s") - F.col("effect")) / (F.col("n") - 1))
    shift = F.abs(F.col("without") - F.col("s") / F.col("n"))
    return left_out.agg(
        F.min("without").alias("lowest"),
        F.max("without").alias("highest"),
        ((F.min("without") < 0) & (F.max("without") > 0)).alias("sign_turns"),
        F.max_by(cluster, F.struct(F.round(shift, 12), F.col(cluster))).alias("most_influential"),
    )


def complete_mean(frame: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The mean, null where any value is missing, with the number missing."""
    return frame.groupBy(*by).agg(
        F.when(F.count(value) == F.count(F.lit(1)), F.avg(value)).alias("mean"),
        (F.count(F.lit(1)) - F.count(value)).alias("missing"),
    )


def missing_bounds(frame: DataFrame, cluster: str, left: str, right: str, low: float = -1.0, high: float = 1.0) -> DataFrame:
    """Worst-case bounds of the balanced effect when missing values may be anything between low and high."""
    put = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    each = frame.groupBy(cluster).agg(F.avg(put(right, low) - put(left, high)).alias("lower"), F.avg(put(right, high) - put(left, low)).alias("upper"))
    return each.agg(F.avg("lower").alias("lower"), F.avg("upper").alias("upper"), F.count(F.lit(1)).alias("clusters"))


def aligned(frame: DataFrame, key: str, condition: str, conditions: int, same: tuple[str, ...] = ()) -> DataFrame:
    """Keys that stand once in each of N conditions with the same metadata: a common support, in one shuffle."""
    checks = [F.count(F.lit(1)).alias("rows"), F.size(F.collect_set(condition)).alias("of")]  # a few conditions; a distinct count would shuffle twice
    checks += [F.min(F.col(c)).alias(f"lo_{i}") for i, c in enumerate(same)] + [F.max(F.col(c)).alias(f"hi_{i}") for i, c in enumerate(same)]
    found = frame.groupBy(key).agg(*checks).where((F.col("rows") == conditions) & (F.col("of") == conditions))
    for i in range(len(same)):
        found = found.where(F.col(f"lo_{i}") == F.col(f"hi_{i}"))
    return found.select(key)


def contrasts(frame: DataFrame, key: str, condition: str, value: str, pairs: list[tuple[str, str]], keep: tuple[str, ...] = ()) -> DataFrame:
    """Differences (first - second) for each key and pair of conditions; a key lacking either side drops out.

    One pass: each row contributes with its sign to the contrasts that it is part of.
    """
    signed = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("contrast"), F.when(F.col(condition) == a, 1).when(F.col(condition) == b, -1).alias("sign")) for a, b in pairs))
    each = frame.withColumn("c", F.explode(F.filter(signed, lambda c: c["sign"].isNotNull())))
    total = each.groupBy(F.col("c.contrast").alias("contrast"), key).agg(F.sum(F.col("c.sign") * F.col(value)).alias("effect"), F.count(F.lit(1)).alias("sides"), *(F.min(k).alias(k) for k in keep))
    return total.where("sides = 2").drop("sides")


def unpivot(frame: DataFrame, keys: list[str], values: list[str], names: str = "model", value: str = "value") -> DataFrame:
    return frame.unpivot(keys, values, names, value)


def rank_within(frame: DataFrame, by: list[str], order: list) -> DataFrame:
    return frame.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long"))
