"""Structural checks: groups classified by their first failing reason, gates, ledgers, overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_reason(checks: list[tuple[str, Column]]) -> Column:
    """The name of the first check that fails (is not true), in the order given; null if all hold."""
    out = F.when(~F.coalesce(checks[0][1], F.lit(False)), checks[0][0])
    for name, ok in checks[1:]:
        out = out.when(~F.coalesce(ok, F.lit(False)), name)
    return out


def _grids(rows: DataFrame, case: str, kind: str, claim: str, evidence: str, page: str, unit: str, label: str) -> DataFrame:
    """Of every case of four rows its rows as an array, in order of claim and evidence; of others their number.

    Only cases of four rows are gathered, so no array grows with the input.
    """
    has = F.coalesce(F.col(case).cast("string").rlike(r"(?U)\S"), F.lit(False))
    each = rows.withColumn("case_", F.when(has, F.col(case)))
    sizes = each.groupBy(F.col("case_").alias(case)).agg(F.count(F.lit(1)).alias("rows"))
    four = sizes.where(F.col(case).isNotNull() & (F.col("rows") == 4)).select(F.col(case).alias("case_"))
    line = F.struct(F.col(claim).alias("claim"), F.col(evidence).alias("evidence"), F.col(label).alias("label"), F.col(page).alias("page"), F.col(unit).cast("string").alias("unit"), F.col(kind).alias("kind"))
    grids = each.join(four, "case_").groupBy(F.col("case_").alias(case)).agg(F.array_sort(F.collect_list(line)).alias("grid"))
    return sizes.join(grids, case, "left")


def _judged(rows: DataFrame, columns: tuple[str, ...], real: str, positive: str, negatives: list[str]) -> DataFrame:
    g = F.col("grid")
    text = lambda field: F.forall(g, lambda x: F.coalesce(x[field].cast("string").rlike(r"(?U)\S"), F.lit(False)))
    distinct = lambda f: F.size(F.array_distinct(F.transform(g, f)))
    l = [F.try_element_at(g, F.lit(i + 1))["label"] for i in range(4)]
    other = F.when(l[0] == positive, l[1]).otherwise(l[0])
    # fixed values: the reasons, in the order in which they are tried
    reason = first_reason([
        ("missing_case_id", F.col(columns[0]).isNotNull()),
        ("row_count", F.col("rows") == 4),
        ("non_real", F.forall(g, lambda x: x["kind"].eqNullSafe(F.lit(real)))),
        ("invalid_claim", text("claim")),
        ("invalid_evidence", text("evidence")),
        ("invalid_page", text("page")),
        ("invalid_unique_id", text("unit")),
        ("invalid_label", text("label")),
        ("duplicate_unique_id", distinct(lambda x: x["unit"]) == 4),
        ("dimensions", (distinct(lambda x: x["claim"]) == 2) & (distinct(lambda x: x["evidence"]) == 2) & (distinct(lambda x: x["page"]) == 1)),
        ("duplicate_cartesian_cell", distinct(lambda x: F.struct(x["claim"], x["evidence"])) == 4),
        ("label_pattern", (l[0] == l[3]) & (l[1] == l[2]) & (l[0] != l[1]) & ((l[0] == positive) | (l[1] == positive))),
        ("unsupported_label", other.isin(negatives)),
    ])
    return _grids(rows, *columns).withColumn("reason", reason).withColumn("negative_label", F.when(F.col("reason").isNull(), other))


def audit_quartets(rows: DataFrame, case: str, kind: str, claim: str, evidence: str, page: str, unit: str, label: str, real: str, positive: str, negatives: list[str]) -> DataFrame:
    """Each case with its first failing reason, or null and its negative label.

    A valid case has four real rows: two claims by two evidences on one page, each cell
    once, the positive label on one diagonal and a single negative label off it. Rows
    without a case are counted together.
    """
    return _judged(rows, (case, kind, claim, evidence, page, unit, label), real, positive, negatives).select(case, "rows", "reason", "negative_label")


def oriented_quartets(rows: DataFrame, case: str, kind: str, claim: str, evidence: str, page: str, unit: str, label: str, real: str, positive: str, negatives: list[str]) -> DataFrame:
    """The accepted cases, evidences turned so that the positive label stands on the main diagonal."""
    g = F.col("grid")
    turned = F.when(g[0]["label"] == positive, g).otherwise(F.array(g[1], g[0], g[3], g[2]))
    good = _judged(rows, (case, kind, claim, evidence, page, unit, label), real, positive, negatives).where("reason IS NULL").withColumn("grid", turned)
    return good.select(case, g[0]["page"].alias("page"), "negative_label", F.array(g[0]["claim"], g[2]["claim"]).alias("claims"), F.array(g[0]["evidence"], g[1]["evidence"]).alias("evidences"), F.transform(g, lambda x: x["unit"]).alias("units"), F.transform(g, lambda x: x["label"]).alias("labels"))


def overlap(left: DataFrame, right: DataFrame, levels: dict[str, tuple[Column, Column]]) -> DataFrame:
    """For each level: distinct values on either side and how many they share, in one union and two aggregations."""
    sides = None
    for level, (a, b) in levels.items():
        for frame, value, side in ((left, a, 1), (right, b, 2)):
            part = frame.select(F.lit(level).alias("level"), value.cast("string").alias("value"), F.lit(side).alias("side"))
            sides = part if sides is None else sides.unionByName(part)
    each = sides.groupBy("level", "value").agg(F.bit_or("side").alias("seen"))
    # not a filter of the rows: that would be pushed to the tables, and a costly value made again for each of its conditions
    told = F.col("value") != ""
    counts = each.groupBy("level").agg(F.count_if(told & (F.col("seen") != 2)).alias("left_values"), F.count_if(told & (F.col("seen") != 1)).alias("right_values"), F.count_if(told & (F.col("seen") == 3)).alias("shared"))
    return counts.where("left_values + right_values > 0")


def layered(frame: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Every row once in each dimension, with that dimension's label; dimensions overlap, labels of one don't."""
    each = F.array(*(F.struct(F.lit(n).alias("dimension"), label.cast("string").alias("label")) for n, label in dimensions.items()))
    return frame.withColumn("__layer", F.explode(each)).select("*", "__layer.*").drop("__layer")


def violations(frame: DataFrame, checks: dict[str, Column], by: tuple[str, ...] = ()) -> DataFrame:
    """How many rows break each named check (a check that is null is broken)."""
    counts = frame.groupBy(*by).agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in checks.items()))
    return counts.unpivot([*by], [*checks], "check", "broken")


def functional(frame: DataFrame, key: str, value: str) -> DataFrame:
    """Keys that have more than one value."""
    return frame.groupBy(key).agg(F.countDistinct(value).alias("values")).where(F.col("values") > 1)


def ledger(rows: DataFrame, identity: list[str]) -> DataFrame:
    """Rows with a content address: the digest of their identity columns."""
    return rows.withColumn("row_id", F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in identity)), 256))


def within_tolerance(shown: DataFrame, source: DataFrame, keys: list[str], value: str, tolerance: float = 1e-12) -> DataFrame:
    """Displayed values joined to their source, with whether they agree; a missing side does not."""
    s = source.select(*keys, F.col(value).alias("source_value"))
    both = shown.join(s, keys, "full_outer")
    return both.withColumn("agrees", F.coalesce(F.abs(F.col(value) - F.col("source_value")) <= tolerance, F.lit(False)))
