"""Classification metrics and transitions between two sets of predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(rows: DataFrame, gold: str, prediction: str, labels: list[str]) -> DataFrame:
    """A row for each gold label and a count for each predicted one; labels outside the list are an error."""
    known = F.assert_true(F.col(gold).isin(labels) & F.col(prediction).isin(labels), F.lit("label outside the declared classes"))
    checked = rows.withColumn("ok", F.coalesce(known.cast("boolean"), F.lit(True)))
    return checked.where("ok").groupBy(F.col(gold).alias("gold")).agg(*(F.count_if(F.col(prediction) == p).alias(f"pred_{p}") for p in labels))


def balanced_accuracy(rows: DataFrame, gold: str, prediction: str, labels: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """The mean recall of the declared classes; a group that lacks one of them is an error."""
    recall = rows.groupBy(*by, gold).agg(F.avg((F.col(gold) == F.col(prediction)).cast("double")).alias("recall"))
    mean = F.when(F.count_if(F.col(gold).isin(labels)) == len(labels), F.avg("recall")).otherwise(F.raise_error(F.lit("a declared class has no rows")).cast("double"))
    return recall.groupBy(*by).agg(mean.alias("balanced_accuracy"))


def matthews(rows: DataFrame, gold: str, prediction: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The multiclass correlation coefficient from label counts; 0 where it is undefined."""
    cells = rows.groupBy(*by, F.col(gold).alias("g"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(*by, F.explode(F.array(F.struct(F.col("g").alias("label"), F.col("n").alias("t"), F.lit(0).cast("long").alias("q"), F.when(F.col("g") == F.col("p"), F.col("n")).otherwise(0).alias("c")), F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("t"), F.col("n").alias("q"), F.lit(0).cast("long").alias("c")))).alias("s")).select(*by, "s.*")
    label = sides.groupBy(*by, "label").agg(*(F.sum(x).cast("double").alias(x) for x in ("t", "q", "c")))
    sums = label.groupBy(*by).agg(F.sum("t").alias("s"), F.sum("c").alias("c"), F.sum(F.col("t") * F.col("q")).alias("tq"), F.sum(F.col("t") * F.col("t")).alias("tt"), F.sum(F.col("q") * F.col("q")).alias("qq"))
    s2 = F.col("s") * F.col("s")
    below = F.sqrt((s2 - F.col("qq")) * (s2 - F.col("tt")))
    return sums.select(*by, F.when(below > 0, (F.col("c") * F.col("s") - F.col("tq")) / below).otherwise(0.0).alias("mcc"))


def binary_metrics(rows: DataFrame, gold: Column, prediction: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts, accuracy, recalls, balanced accuracy, correlation and positive rate of boolean labels."""
    n = lambda g, p: F.count_if((gold if g else ~gold) & (prediction if p else ~prediction))
    counts = rows.groupBy(*by).agg(n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
    d = {c: F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn")}
    total = d["tp"] + d["tn"] + d["fp"] + d["fn"]
    rp, rn = F.try_divide(d["tp"], d["tp"] + d["fn"]), F.try_divide(d["tn"], d["tn"] + d["fp"])
    below = F.sqrt((d["tp"] + d["fp"]) * (d["tp"] + d["fn"]) * (d["tn"] + d["fp"]) * (d["tn"] + d["fn"]))
    return counts.select(
        "*",
        F.try_divide(d["tp"] + d["tn"], total).alias("accuracy"),
        rp.alias("recall_positive"),
        rn.alias("recall_negative"),
        ((rp + rn) / 2).alias("balanced_accuracy"),
        F.when(below > 0, (d["tp"] * d["tn"] - d["fp"] * d["fn"]) / below).otherwise(0.0).alias("mcc"),
        F.try_divide(d["tp"] + d["fp"], total).alias("positive_rate"),
    )


def transitions(rows: DataFrame, gold: str, left: str, right: str, by: tuple[str, ...] = ()) -> DataFrame:
    """How predictions move between two conditions: flips, degraded, improved, right in both, wrong in both, agreement."""
    a, b = F.col(left) == F.col(gold), F.col(right) == F.col(gold)
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(left) != F.col(right)).alias("flips"),
        F.count_if(a & ~b).alias("degraded"),
        F.count_if(~a & b).alias("improved"),
        F.count_if(a & b).alias("both_right"),
        F.count_if(~a & ~b).alias("both_wrong"),
        F.avg((F.col(left) == F.col(right)).cast("double")).alias("agreement"),
    )


def transition_histogram(rows: DataFrame, left: str, right: str) -> DataFrame:
    return rows.groupBy(F.concat_ws("->", left, right).alias("transition")).agg(F.count(F.lit(1)).alias("rows"))


def label_rates(rows: DataFrame, control: str, label: str) -> DataFrame:
    """Count and share of each label within each control: one shuffle, the share from a window over few rows."""
    from pyspark.sql.window import Window

    counts = rows.groupBy(control, label).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(control)))


def pearson(rows: DataFrame, left: str, right: str) -> DataFrame:
    """Correlation (null for fewer than two rows or a constant side) and the difference's distribution."""
    d = F.col(right) - F.col(left)
    sure = (F.count(d) > 1) & (F.stddev_samp(left) > 0) & (F.stddev_samp(right) > 0)
    return rows.agg(
        F.when(sure, F.corr(left, right)).alias("pearson"),
        F.avg(d).alias("mean"),
        F.median(d).alias("median"),
        F.stddev_samp(d).alias("sd"),
        F.min(d).alias("least"),
        F.max(d).alias("most"),
    )
