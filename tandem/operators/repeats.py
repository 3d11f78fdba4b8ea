"""Repeated runs of the same conditions: spans, flips, stable directions, and route effects run by run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Below which a baseline has no ratio, and the largest span that passes.
NEAR_ZERO, LARGEST_SPAN = 1e-12, 1e-6


def series(values: Column, center: float = 0.0) -> Column:
    """span, ratio (span over the first value's size) and direction_stable of an array of a value for each repeat.

    All are null where a value is; the ratio also where the first value is next to zero. A
    direction is stable if all values lie on the same side of the center, or all on it.
    """
    whole = F.size(values) > 0
    whole &= F.forall(values, lambda v: v.isNotNull())
    span = F.array_max(values) - F.array_min(values)
    sides = F.size(F.array_distinct(F.transform(values, lambda v: F.signum(v - center))))
    first = F.abs(F.try_element_at(values, F.lit(1)))
    return F.struct(F.when(whole, span).alias("span"), F.when(whole & (first > NEAR_ZERO), span / first).alias("ratio"), F.when(whole, sides == 1).alias("direction_stable"))


def by_repeat(rows: DataFrame, keys: list[str], repeat: str, repeats: int, value: str) -> DataFrame:
    """keys and ``values``, an array in the order of repeats; a key that lacks a repeat or has one twice is an error."""
    each = rows.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(repeat, value))), lambda x: x[value]).alias("values"), F.count(F.lit(1)).alias("n"), F.countDistinct(repeat).alias("of"))  # ``repeats`` entries
    guard = F.when((F.col("n") == repeats) & (F.col("of") == repeats), True).otherwise(F.raise_error(F.lit("a unit lacks a repeat or has one twice")).cast("boolean"))
    return each.where(guard).drop("n", "of")


def span_report(rows: DataFrame, condition: list[str], unit: str, repeat: str, repeats: int, score: str, label: str, threshold: float = LARGEST_SPAN) -> DataFrame:
    """Of each condition: largest, 99th percentile and median span of its units' scores, flipped labels and their rate, whether all is identical or passes."""
    scores = by_repeat(rows, [*condition, unit], repeat, repeats, score)
    flips = rows.groupBy(*condition, unit).agg((F.countDistinct(label) > 1).alias("flips"))
    each = scores.withColumn("s", series(F.col("values"))).join(flips, [*condition, unit])
    told = each.groupBy(*condition).agg(
        F.count(F.lit(1)).alias("units"), F.max("s.span").alias("largest"), F.percentile("s.span", F.lit(0.99)).alias("p99"), F.median("s.span").alias("median"), F.max("s.ratio").alias("largest_ratio"),
        F.count_if("flips").alias("flips"), F.count_if(F.col("s.direction_stable")).alias("stable"),
    )
    outcome = F.when((F.col("largest") == 0) & (F.col("flips") == 0), "identical_outputs").when((F.col("largest") <= threshold) & (F.col("flips") == 0), "within_engineering_threshold").otherwise("requires_investigation")
    return told.withColumn("flip_rate", F.col("flips") / F.col("units")).withColumn("outcome", outcome)


def route_effects(rows: DataFrame, model: str, route: str, repeat: str, repeats: int, case: str, page: str, value: str, contrasts: dict[str, tuple[str, str]]) -> DataFrame:
    """(model, contrast, weighting, endpoint): the effect run by run, with its series.

    Endpoints: the mean difference of a route and its reference, that over the reference's
    deviation of the run (none if it is next to zero), and the share of positive differences
    (ties half), whose center is 0.5. Weightings: pages alike, or cases alike. Cases must stand in
    all routes of a run.
    """
    names = sorted({r for pair in contrasts.values() for r in pair})
    at = lambda name: F.max(F.when(F.col(route) == name, F.col(value)))
    wide = rows.where(F.col(route).isin(names)).groupBy(F.col(model).alias("model"), F.col(repeat).alias("repeat"), F.col(case).alias("case")).agg(F.min(page).alias("page"), *(at(n).alias(f"r_{n}") for n in names))
    lacks = F.lit(False)
    for n in names:
        lacks |= F.col(f"r_{n}").isNull()
    wide = wide.where(F.when(lacks, F.raise_error(F.lit("a case lacks a route")).cast("boolean")).otherwise(True))
    pairs = F.array(*(F.struct(F.lit(c).alias("contrast"), (F.col(f"r_{a}") - F.col(f"r_{b}")).alias("delta"), F.col(f"r_{b}").alias("reference")) for c, (a, b) in contrasts.items()))
    long = wide.select("model", "repeat", "page", F.explode(pairs).alias("p")).select("model", "repeat", "page", "p.*")
    up = (F.signum("delta") + 1) / 2
    pages = long.groupBy("model", "contrast", "repeat", "page").agg(F.count(F.lit(1)).alias("n"), F.avg("delta").alias("dm"), F.sum("delta").alias("ds"), F.avg(up).alias("um"), F.sum(up).alias("us"))
    scale = long.groupBy("model", "contrast", "repeat").agg(F.coalesce(F.stddev_samp("reference"), F.lit(0.0)).alias("sd"))
    each = pages.groupBy("model", "contrast", "repeat").agg(F.avg("dm").alias("page_balanced"), (F.sum("ds") / F.sum("n")).alias("case_weighted"), F.avg("um").alias("page_up"), (F.sum("us") / F.sum("n")).alias("case_up")).join(scale, ["model", "contrast", "repeat"])
    over = lambda c: F.when(F.col("sd") > NEAR_ZERO, F.col(c) / F.col("sd"))
    rows_ = F.array(*(F.struct(F.lit(w).alias("weighting"), F.lit(e).alias("endpoint"), v.alias("value")) for w, mean, share in (("page_balanced", "page_balanced", "page_up"), ("case_weighted", "case_weighted", "case_up")) for e, v in (("difference", F.col(mean)), ("standardised", over(mean)), ("directional", F.col(share)))))
    told = each.select("model", "contrast", "repeat", F.explode(rows_).alias("x")).select("model", "contrast", "repeat", "x.*")
    found = by_repeat(told, ["model", "contrast", "weighting", "endpoint"], "repeat", repeats, "value")
    told = F.when(F.col("endpoint") == "directional", series(F.col("values"), 0.5)).otherwise(series(F.col("values")))
    return found.withColumn("s", told).select(*found.columns, "s.span", "s.ratio", "s.direction_stable")


def cross_effects(effects: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Differences of two models' standardised and directional effects run by run, with their series around zero."""
    keys = ["contrast", "weighting", "endpoint"]
    some = effects.where("endpoint IN ('standardised', 'directional')").select("model", *keys, "values")
    sides = F.array(*(F.struct(F.lit(f"{a}-{b}").alias("pair"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs))
    each = some.withColumn("pair", F.explode(F.filter(sides, lambda s: (s["a"] == F.col("model")) | (s["b"] == F.col("model")))))
    side = lambda which: F.max(F.when(F.col("model") == F.col(f"pair.{which}"), F.col("values")))
    both = each.groupBy(F.col("pair.pair").alias("pair"), *keys).agg(side("a").alias("x"), side("b").alias("y"))
    return both.withColumn("values", F.zip_with("x", "y", lambda a, b: a - b)).withColumn("s", series(F.col("values"))).select("pair", *keys, "values", "s.span", "s.ratio", "s.direction_stable")
