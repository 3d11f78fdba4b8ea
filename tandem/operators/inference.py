"""Closed-form tests over cluster effects, as aggregates and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Below NEAR, erf by its series of SERIES terms; above, erfc by a continued fraction of FRACTION levels.
NEAR, SERIES, FRACTION = 2.0, 60, 120


def _erfc(x: Column) -> Column:
    """erfc of x >= 0 to some 13 digits, however small it is; both sums go from their last term to their first."""
    square = x * x
    down = lambda n: F.sequence(F.lit(n), F.lit(1), F.lit(-1))
    series = F.aggregate(down(SERIES), F.lit(1.0), lambda s, n: 1 + s * 2 * square / (2 * n + 1))
    fraction = F.aggregate(down(FRACTION), x, lambda f, n: x + n / 2 / f)
    head = F.exp(-square) / F.sqrt(F.pi())
    return F.when(x < NEAR, 1 - 2 * head * x * series).otherwise(head / fraction)


def normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) for a standard normal Z; null for a null z."""
    return _erfc(F.abs(z.cast("double")) / F.sqrt(F.lit(2.0)))


def chi_square_tail(x: Column, df: int) -> Column:
    """P(X > x) for a chi-square X of a small whole number of degrees of freedom.

    Upward recurrence from df 1 (normal tail) or df 2 (exponential).
    """
    x = x.cast("double")
    tail, k = (normal_tail(F.sqrt(x)), 1) if df % 2 else (F.exp(-x / 2), 2)
    term = F.sqrt(2 * x / F.pi()) * F.exp(-x / 2) if df % 2 else x / 2 * F.exp(-x / 2)
    while k < df:
        tail, k = tail + term, k + 2
        term = term * x / k
    return tail


def sign_test(fewer: Column, total: Column) -> Column:
    """min(1, 2 P(Binomial(total, 1/2) <= fewer)), exact, summed in logarithms."""
    n = total.cast("int")
    steps = F.sequence(F.lit(0), fewer.cast("int"))
    # C(n, i) by its ratio to C(n, i - 1): (sum, log of the term)
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0.0).alias("log"))
    walk = F.aggregate(
        steps,
        start,
        lambda s, i: F.struct(
            (s["sum"] + F.exp(F.when(i == 0, F.lit(0.0)).otherwise(s["log"] + F.ln((n - i + 1).cast("double")) - F.ln(F.greatest(i, F.lit(1)).cast("double"))) - n * F.ln(F.lit(2.0)))).alias("sum"),
            F.when(i == 0, F.lit(0.0)).otherwise(s["log"] + F.ln((n - i + 1).cast("double")) - F.ln(F.greatest(i, F.lit(1)).cast("double"))).alias("log"),
        ),
    )["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * walk))


def wald(clusters: DataFrame, value: str = "effect", by: tuple[str, ...] = ()) -> DataFrame:
    """Estimate, standard error, (estimate / se) squared and its p-value; p is 1 or 0 where the error is zero."""
    se = F.stddev_samp(value) / F.sqrt(F.count(value).cast("double"))
    base = clusters.groupBy(*by).agg(F.avg(value).alias("estimate"), se.alias("se"), F.count(value).alias("clusters"))
    z = F.when(F.col("se") > 0, F.col("estimate") / F.col("se"))
    p = F.when(F.col("se") > 0, normal_tail(z)).when(F.col("estimate") == 0, 1.0).otherwise(0.0)
    return base.withColumn("statistic", z * z).withColumn("p", p)


def direction_summary(clusters: DataFrame, value: str = "effect", by: tuple[str, ...] = ()) -> DataFrame:
    """Median, signs, and the exact sign test that leaves zeros out."""
    counts = clusters.groupBy(*by).agg(F.median(value).alias("median"), F.count_if(F.col(value) < 0).alias("negative"), F.count_if(F.col(value) > 0).alias("positive"), F.count_if(F.col(value) == 0).alias("zero"))
    return counts.withColumn("p", sign_test(F.least("negative", "positive"), F.col("negative") + F.col("positive")))


def mcnemar(rows: DataFrame, left: Column, right: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Discordant counts of two booleans, the continuity-corrected statistic and the exact p.

    The correction also holds where both counts are equal: (0 - 1) squared over their sum.
    """
    counts = rows.groupBy(*by).agg(F.count_if(left & ~right).alias("only_left"), F.count_if(~left & right).alias("only_right"))
    n = (F.col("only_left") + F.col("only_right")).cast("double")
    d = (F.abs(F.col("only_left") - F.col("only_right")) - 1).cast("double")
    return counts.withColumn("statistic", F.coalesce(F.try_divide(d * d, n), F.lit(0.0))).withColumn("p", sign_test(F.least("only_left", "only_right"), F.col("only_left") + F.col("only_right")))


def cochran_q(rows: DataFrame, key: str, condition: str, indicator: Column, conditions: int) -> DataFrame:
    """Cochran's Q over matched indicators of N conditions: column totals and squared row totals."""
    x = rows.withColumn("x", indicator.cast("long"))
    row = x.groupBy(key).agg(F.sum("x").alias("r"), F.count(F.lit(1)).alias("of")).where(F.col("of") == conditions)
    column = x.join(row.select(key), key, "left_semi").groupBy(condition).agg(F.sum("x").alias("c"))
    by_row = row.agg(F.sum("r").alias("total"), F.sum(F.col("r") * F.col("r")).alias("squares"), F.count(F.lit(1)).alias("keys"))
    both = by_row.crossJoin(F.broadcast(column.agg(F.sum(F.col("c") * F.col("c")).alias("columns"))))  # one row each
    k = float(conditions)
    q = F.try_divide((k - 1) * (k * F.col("columns") - F.col("total") * F.col("total")), k * F.col("total") - F.col("squares"))
    return both.select(F.coalesce(q, F.lit(0.0)).alias("q"), "keys").withColumn("p", chi_square_tail(F.col("q"), conditions - 1))


def covariance(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The sample covariance matrix in long form, in one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = frame.agg(*(F.covar_samp(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "covariance").select(F.substring_index("pair", "|", 1).alias("a"), F.substring_index("pair", "|", -1).alias("b"), "covariance")


def omnibus_wald(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Equality of k matched means: contrasts to the first, their covariance, chi-square with k - 1 df.

    One aggregation gives means and covariances; the quadratic form with the inverse comes
    from eliminating the (k - 1) x (k - 1) system column by column, as expressions.
    A singular covariance gives a null statistic.
    """
    first, *others = columns
    d = frame.select(*((F.col(c) - F.col(first)).alias(f"d{i}") for i, c in enumerate(others)))
    k = len(others)
    m = d.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"d{i}").alias(f"b{i}") for i in range(k)), *(F.covar_samp(f"d{i}", f"d{j}").alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)))
    m = m.select("*", *(F.col(f"a{j}_{i}").alias(f"a{i}_{j}") for i in range(k) for j in range(i)), F.lit(0.0).alias("form"))
    for p in range(k):
        # form grows by b_p squared over the pivot; the rest of the system loses row p
        scale = lambda i, p=p: F.try_divide(F.col(f"a{i}_{p}"), F.col(f"a{p}_{p}"))
        rest = range(p + 1, k)
        form = F.col("form") + F.try_divide(F.col(f"b{p}") * F.col(f"b{p}"), F.col(f"a{p}_{p}"))
        m = m.select("n", form.alias("form"), *((F.col(f"b{i}") - scale(i) * F.col(f"b{p}")).alias(f"b{i}") for i in rest), *((F.col(f"a{i}_{j}") - scale(i) * F.col(f"a{p}_{j}")).alias(f"a{i}_{j}") for i in rest for j in rest))
    return m.select(F.col("n").alias("clusters"), (F.col("n") * F.col("form")).alias("statistic")).withColumn("p", chi_square_tail(F.col("statistic"), k))


def holm(tests: DataFrame, name: str, p: str, family: tuple[str, ...] = ()) -> DataFrame:
    """Holm's step-down adjustment within families: the running maximum of (m - i) p in order of (p, name), at most 1."""
    each = Window.partitionBy(*family)
    order = each.orderBy(p, name)
    raised = (F.count(F.lit(1)).over(each) - F.row_number().over(order) + 1) * F.col(p)
    return tests.withColumn("raised", raised).withColumn("adjusted", F.least(F.lit(1.0), F.max("raised").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("raised")


def standardised(clusters: DataFrame, value: str = "effect", by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over sample standard deviation; the deviation from mergeable sums, never below 0."""
    sums = clusters.groupBy(*by).agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.count(value).alias("n"))
    sd = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("q") - F.col("s") * F.col("s") / F.col("n"), F.col("n") - 1)))
    return sums.select(*by, (F.col("s") / F.col("n")).alias("mean"), sd.alias("sd"), F.try_divide(F.col("s") / F.col("n"), sd).alias("standardised"))


def mad_scale(frame: DataFrame, value: str) -> DataFrame:
    """1.4826 times the median absolute deviation from the median."""
    middle = frame.agg(F.median(value).alias("m"))
    return frame.crossJoin(F.broadcast(middle)).agg((F.median(F.abs(F.col(value) - F.col("m"))) * 1.4826).alias("mad_scale"))


def gate(standardised_estimate: Column, standardised_p: Column, directional_estimate: Column, directional_p: Column, level: float = 0.05) -> Column:
    """The claim that two endpoints allow: they must point the same way, and both or one stay below the level."""
    below = (standardised_p < level).cast("int") + (directional_p < level).cast("int")
    agree = standardised_estimate * directional_estimate > 0
    # fixed values: the names of the three claims
    return F.when(agree & (below == 2), "bounded_scale_robust").when(agree & (below == 1), "qualitative_scale_robust").otherwise("fixed_protocol_descriptive")
