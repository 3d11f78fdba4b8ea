"""Whole reports of a study as single plans: contrasts with families, resampled scales, joint metrics, repeat runs, gates, ledgers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written
from . import inference as I
from . import resampling as R


def linear_contrasts(frame: DataFrame, key: str, cluster: str, contrasts: dict[str, dict[str, float]]) -> DataFrame:
    """Named weighted sums of columns for each key, as long rows (contrast, cluster, value); a key that lacks a column drops out of it."""
    total = lambda weights: reduce(lambda a, b: a + b, (F.col(c) * w for c, w in weights.items()))
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("contrast"), total(w).alias("value")) for n, w in contrasts.items())))
    return frame.select(key, cluster, each.alias("x")).select(key, cluster, "x.*").where("value IS NOT NULL")


def contrast_report(values: DataFrame, cluster: str, primary: list[str]) -> DataFrame:
    """Cluster-balanced estimate, error and p of every contrast; Holm over the primary ones and over the others apart."""
    pages = values.groupBy("contrast", cluster).agg(F.avg("value").alias("effect"))
    told = I.wald(pages, by=("contrast",)).withColumn("family", F.when(F.col("contrast").isin(primary), "primary").otherwise("secondary"))
    signs = I.direction_summary(pages, by=("contrast",)).select("contrast", F.col("median"), F.col("p").alias("sign_p"))
    return I.holm(told, "contrast", "p", ("family",)).join(signs, "contrast")


def page_sums(values: DataFrame, cluster: str, effect: str, reference: str) -> DataFrame:
    """Sufficient statistics of each cluster: count, sums and means of the effect and its direction, sum and squares of the reference."""
    up = (F.signum(F.col(effect)) + 1) / 2 - 0.5
    return values.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("n"), F.sum(effect).alias("delta_sum"), F.avg(effect).alias("delta_mean"), F.sum(up).alias("up_sum"), F.avg(up).alias("up_mean"),
        F.sum(reference).alias("reference_sum"), F.sum(F.col(reference) * F.col(reference)).alias("reference_squares"),
    )


def scale_bootstrap(sums: DataFrame, cluster: str, draws: int, seed: int = R.SEED) -> DataFrame:
    """Standardised and directional effects whose reference deviation is estimated anew in each draw; cluster- and case-weighted.

    Draws without a deviation are rejected and drawn again, up to ten times ``draws`` (1000 at
    least); more are an error. Intervals rest on ``draws`` valid ones.
    """
    variance = (F.col("reference_squares") - F.col("reference_sum") * F.col("reference_sum") / F.col("n")) / (F.col("n") - 1)

    columns = ["n", "delta_sum", "delta_mean", "up_sum", "up_mean", "reference_sum", "reference_squares"]

    def valid(times: R.Draws) -> DataFrame:
        each = times.sums(sums.withColumn("k", F.lit(1)), ["k", *columns])
        return each.where("n > 1").withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), F.round(variance, 12)))).where("sd > 0")

    kept = R.redrawn(sums, cluster, draws, valid, max(1000, 10 * draws), seed)
    long = F.explode(F.array(
        F.struct(F.lit("balanced").alias("weighting"), (F.col("delta_mean") / F.col("k") / F.col("sd")).alias("standardised"), (F.col("up_mean") / F.col("k")).alias("directional")),
        F.struct(F.lit("cases").alias("weighting"), (F.col("delta_sum") / F.col("n") / F.col("sd")).alias("standardised"), (F.col("up_sum") / F.col("n")).alias("directional")),
    ))
    ends = lambda c: (F.percentile(c, F.lit(0.025)).alias(f"{c}_lower"), F.percentile(c, F.lit(0.975)).alias(f"{c}_upper"), F.stddev_samp(c).alias(f"{c}_error"))
    return kept.select(long.alias("x")).select("x.*").groupBy("weighting").agg(*ends("standardised"), *ends("directional"), F.count(F.lit(1)).alias("valid_draws"))


def joint_bootstrap(rows: DataFrame, cluster: str, gold: str, predictions: dict[str, str], labels: int, draws: int, effects: dict[str, dict[str, int]] | None = None, seed: int = R.SEED) -> DataFrame:
    """Intervals of the accuracy and balanced accuracy of several conditions, and of their differences, over the same drawn clusters.

    ``effects``: weights of conditions by name ({"effect": {"b": 1, "a": -1}}), so a difference
    of differences is the heterogeneity of two effects. A draw that lacks a class is rejected for
    all conditions and drawn again; with a hundred times ``draws`` attempts it is an error.
    """
    counts = written(rows.groupBy(cluster, gold).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(F.col(p) == F.col(gold)).alias(f"r_{c}") for c, p in predictions.items())), "counts")
    metrics = [m for c in predictions for m in ((F.sum(f"r_{c}") / F.sum("n")).alias(f"{c}|accuracy"), F.avg(F.col(f"r_{c}") / F.col("n")).alias(f"{c}|balanced"))]

    def valid(times: R.Draws) -> DataFrame:
        drawn = R.class_sums(counts, cluster, gold, ["n", *(f"r_{c}" for c in predictions)], times)
        return drawn.groupBy("draw").agg(F.count(F.lit(1)).alias("classes"), *metrics).where(F.col("classes") == labels)

    kept = R.redrawn(counts, cluster, draws, valid, 99 * draws, seed)
    for name, weights in (effects or {}).items():
        for m in ("accuracy", "balanced"):
            kept = kept.withColumn(f"{name}|{m}", reduce(lambda a, b: a + b, (F.col(f"{c}|{m}") * w for c, w in weights.items())))
    names = [f"{c}|{m}" for c in (*predictions, *(effects or {})) for m in ("accuracy", "balanced")]
    long = kept.unpivot(["draw"], names, "metric", "value")
    told = long.groupBy(F.substring_index("metric", "|", 1).alias("condition"), F.substring_index("metric", "|", -1).alias("metric"))
    return told.agg(F.percentile("value", F.lit(0.025)).alias("lower"), F.percentile("value", F.lit(0.975)).alias("upper"), F.count(F.lit(1)).alias("valid_draws"))


def threshold_gate(intervals: DataFrame, lower: str, threshold: float) -> DataFrame:
    return intervals.withColumn("passes", F.col(lower) > threshold)


def run_summary(runs: DataFrame, condition: list[str], unit: str, repeat: str, score: str, label: str) -> DataFrame:
    """Repeated runs by condition: units, span of the score over repeats (largest and mean), units whose label flips."""
    each = runs.groupBy(*condition, unit).agg((F.max(score) - F.min(score)).alias("span"), (F.min(label) != F.max(label)).alias("flips"), F.countDistinct(repeat).alias("repeats"))
    return each.groupBy(*condition).agg(F.count(F.lit(1)).alias("units"), F.max("span").alias("largest_span"), F.avg("span").alias("mean_span"), F.count_if("flips").alias("flips"), F.min("repeats").alias("repeats"))


def both_signs(frame: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Whether a dimension has effects of either sign (and whatever zeros)."""
    return frame.groupBy(*by).agg((F.bool_or(F.col(value) > 0) & F.bool_or(F.col(value) < 0) & ~F.bool_or(F.col(value) == 0)).alias("both_signs"))


# gates and ledgers


def identity_gate(conditions: DataFrame, same: list[str], expected: DataFrame, key: str = "condition") -> DataFrame:
    """Fields that must have one value over all conditions, and conditions that are expected but absent, or present but not expected."""
    one = conditions.agg(*((F.countDistinct(c) == 1).alias(f"one_{c}") for c in same)).unpivot([], [f"one_{c}" for c in same], "check", "holds")
    a, b = conditions.select(key).distinct().withColumn("is", F.lit(True)), expected.select(key).distinct().withColumn("should", F.lit(True))
    met = a.join(b, key, "full_outer").select(F.concat(F.lit("expected_"), F.col(key).cast("string")).alias("check"), (F.col("is").isNotNull() & F.col("should").isNotNull()).alias("holds"))
    return one.unionByName(met)


def claim_guard(ledger: DataFrame, claims: DataFrame, keys: list[str], level: float = 0.05) -> DataFrame:
    """Claims (sign, significant) against the ledger's estimate and adjusted p; a claim without a row does not hold."""
    met = claims.join(ledger, keys, "left")
    sign = F.signum("estimate") == F.col("sign")
    return met.select(*keys, F.coalesce(sign & ((F.col("adjusted") < level) == F.col("significant")), F.lit(False)).alias("holds"))


def union_checked(frames: list[DataFrame], key: str) -> DataFrame:
    """The union of row sources of one schema; a repeated key is an error of its row, not of the plan."""
    rows = reduce(lambda a, b: a.unionByName(b), frames)
    twice = F.count(F.lit(1)).over(Window.partitionBy(key)) > 1
    return rows.withColumn("repeated", twice)


def flow(populations: dict[str, DataFrame], key: str) -> DataFrame:
    """Consecutive populations: size, how many of its predecessor are gone, and whether it is a subset of it."""
    marked = reduce(lambda a, b: a.unionByName(b), (p.select(key).distinct().withColumn("at", F.lit(i)) for i, p in enumerate(populations.values())))
    each = marked.groupBy(key).agg(F.collect_set("at").alias("at"))  # as many entries as populations at most
    out = None
    for i, name in enumerate(populations):
        here, before = F.array_contains("at", i), F.array_contains("at", i - 1) if i else F.lit(False)
        row = each.agg(F.count_if(here).alias("size"), F.count_if(before & ~here).alias("gone"), (F.count_if(here & ~before) == 0).alias("subset") if i else F.lit(True).alias("subset")).select(F.lit(name).alias("population"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def equivalent(actual: DataFrame, expected: DataFrame, path: str = "path", tolerance: float = 5e-15) -> DataFrame:
    """Two results as (path, value) rows: paths that are missing on a side or differ by more than a relative tolerance."""
    both = actual.select(path, F.col("value").alias("actual")).join(expected.select(path, F.col("value").alias("expected")), path, "full_outer")
    near = F.abs(F.col("actual") - F.col("expected")) <= tolerance * F.greatest(F.abs("actual"), F.abs("expected"))
    return both.where(~F.coalesce(near, F.lit(False)))


def finite(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The report as it is; a value that is null or not finite is an error."""
    bad = reduce(lambda a, b: a | b, (F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf")) for c in columns))
    guard = F.when(bad, F.raise_error(F.lit("a report holds a value that is not finite")).cast("boolean")).otherwise(True)
    return frame.where(guard)


def adapted(report: DataFrame, source: str, metrics: list[str], keys: list[str]) -> DataFrame:
    """A wide report as ledger rows (source, keys, metric, value), a row for each metric that is present."""
    wide = report.select(F.lit(source).alias("source"), *(F.col(k).cast("string").alias(k) for k in keys), *(F.col(m).cast("double").alias(m) for m in metrics))
    return wide.unpivot(["source", *keys], metrics, "metric", "value").where("value IS NOT NULL")


def evidence_groups(ledger: DataFrame, groups: dict[str, Column], least: int = 1) -> DataFrame:
    """Named groups of ledger rows: how many rows, from how many sources, and whether there are enough."""
    each = ledger.withColumn("groups", F.array_compact(F.array(*(F.when(c, n) for n, c in groups.items())))).select("*", F.explode("groups").alias("group"))
    return each.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("source").alias("sources"), (F.count(F.lit(1)) >= least).alias("enough"))


def table_cells(ledger: DataFrame, row: str, column: str, value: str, digits: int) -> DataFrame:
    """Cells of a shown table with their lineage: row, column, the rendered text, the ledger row it came from."""
    text = F.format_number(F.col(value), digits)
    return ledger.select(F.col(row).alias("table_row"), F.col(column).alias("table_column"), text.alias("rendered"), F.sha2(F.concat_ws("|", "source", row, column), 256).alias("row_id"))
