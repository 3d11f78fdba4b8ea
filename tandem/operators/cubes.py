"""Conditions as positions of one row a case, label mappings as a dimension, and the studies over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import inference as I
from . import resampling as R


def cube(rows: DataFrame, key: str | tuple[str, ...], page: str, condition: str, conditions: list[str], value: str, same: tuple[str, ...] = ()) -> DataFrame:
    """key (one column or several), page, ``values`` in the order of ``conditions``, and ``complete``: in one shuffle at most.

    A case is complete if it stands once in each of the conditions and in no other, with one
    page, one value in each of ``same``, and finite numbers. Nothing is dropped: callers assert
    on ``complete`` (``complete_cube``).
    """
    of = F.col(condition)
    one = lambda c: F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True))
    keys = (key,) if isinstance(key, str) else key
    each = rows.groupBy(*keys).agg(
        F.min(page).alias("page"),
        F.array(*(F.max(F.when(of == c, F.col(value).cast("double"))) for c in conditions)).alias("values"),
        (F.count(F.lit(1)) == len(conditions)).alias("as_many"),
        reduce(lambda a, b: a & b, (F.count_if(of == c) == 1 for c in conditions)).alias("each"),
        reduce(lambda a, b: a & b, (one(c) for c in (page, *same))).alias("alike"),
    )
    finite = F.forall("values", lambda v: F.coalesce(F.abs(v) < float("inf"), F.lit(False)))
    return each.select(*keys, "page", "values", (F.col("as_many") & F.col("each") & F.col("alike") & finite).alias("complete"))


def complete_cube(found: DataFrame, key: str | tuple[str, ...]) -> DataFrame:
    """The cube without its mark; a case that isn't complete is an error."""
    guard = F.when(F.col("complete"), True).otherwise(F.raise_error(F.concat(F.lit("conditions of case "), F.concat_ws(":", *((key,) if isinstance(key, str) else key)), F.lit(" don't match"))).cast("boolean"))
    return found.where(guard).drop("complete")


# label mappings


def bijections(mappings: DataFrame, labels: list[str]) -> DataFrame:
    """variant and ``choice_of``, the choice of each label, of (variant, choice, label); a mapping that is no bijection is an error."""
    pairs = F.sort_array(F.collect_list(F.struct("label", "choice")))  # as many as there are labels in a right mapping
    each = mappings.groupBy("variant").agg(pairs.alias("pairs"), F.countDistinct("choice").alias("choices"), F.count(F.lit(1)).alias("rows"))
    right = (F.col("rows") == len(labels)) & (F.col("choices") == len(labels)) & (F.col("pairs.label") == F.lit(sorted(labels)))
    guard = F.when(right, True).otherwise(F.raise_error(F.concat(F.lit("mapping "), "variant", F.lit(" is no bijection"))).cast("boolean"))
    return each.where(guard).select("variant", F.map_from_entries("pairs").alias("choice_of"))


def rescored(cells: DataFrame, mappings: DataFrame, labels: list[str], scores: str = "scores", positive: str = "SUPPORTS", negative: str = "negative_label") -> DataFrame:
    """``cells`` (variant, ``scores`` by choice, a negative label) with ``margin`` under their own variant's mapping.

    A variant without a mapping, a negative label that isn't one, or scores of other choices
    than the mapping's are errors.
    """
    told = cells.join(F.broadcast(bijections(mappings, labels)), "variant", "left")  # a row for each mapping
    at = lambda label: F.try_element_at(scores, F.try_element_at("choice_of", label))
    margin = at(F.lit(positive)) - at(F.col(negative))
    whole = F.array_sort(F.map_keys(scores)) == F.array_sort(F.map_values("choice_of"))
    ok = whole & F.col(negative).isin([x for x in labels if x != positive]) & (F.abs(margin) < float("inf"))
    wrong = F.raise_error(F.concat(F.lit("a cell of variant "), F.coalesce("variant", F.lit("null")), F.lit(" can't be scored"))).cast("double")
    return told.withColumn("margin", F.when(F.coalesce(ok, F.lit(False)), margin).otherwise(wrong)).drop("choice_of")


def mapped_interactions(cells: DataFrame, keys: list[str], page: str) -> DataFrame:
    """keys, page and ``interaction`` of each case's four margins; a case without its four cells once is an error."""
    at = lambda i: F.max(F.when(F.col("cell_index") == i, F.col("margin")))
    each = cells.groupBy(*keys).agg(F.min(page).alias("page"), ((at(0) - at(1) - at(2) + at(3)) / 2).alias("interaction"), F.count(F.lit(1)).alias("n"), *(F.count_if(F.col("cell_index") == i).alias(f"of_{i}") for i in range(4)))
    ok = (F.col("n") == 4) & reduce(lambda a, b: a & b, (F.col(f"of_{i}") == 1 for i in range(4))) & F.col("interaction").isNotNull()
    guard = F.when(ok, True).otherwise(F.raise_error(F.lit("a case lacks one of its four cells")).cast("boolean"))
    return each.where(guard).select(*keys, "page", "interaction")


def mapping_report(cubes: DataFrame, conditions: list[str], routes: dict[str, tuple[str, str]], variants: tuple[str, str], draws: int, seed: int = R.SEED) -> DataFrame:
    """One row a route: the page-balanced effect (second condition less first) under two mappings and their difference.

    ``cubes``: (variant, case_id, page, values). Cases and pages must be the same under both
    mappings, else it is an error. The difference of pages has a Wald test, Holm over the
    routes, and a bootstrap interval over draws that all routes share.
    """
    at = {c: i for i, c in enumerate(conditions)}
    pairs = F.array(*(F.struct(F.lit(r).alias("route"), (F.col("values")[at[b]] - F.col("values")[at[a]]).alias("effect")) for r, (a, b) in routes.items()))
    both = cubes.where(F.col("variant").isin(*variants))
    met = both.groupBy("case_id").agg((F.bool_or(F.col("variant") == variants[0]) & F.bool_or(F.col("variant") == variants[1])).alias("both"), (F.min("page") == F.max("page")).alias("page")).where("NOT both OR NOT page").limit(1)
    if met.count():
        raise ValueError("the mappings have other cases or pages")
    pages = both.select("variant", "page", F.explode(pairs).alias("p")).groupBy("p.route", "page").agg(*(F.avg(F.when(F.col("variant") == v, F.col("p.effect"))).alias(n) for n, v in zip(("first", "second"), variants, strict=True)))
    pages = written(pages.withColumn("effect", F.col("second") - F.col("first")), "mapping-pages")
    tests = I.holm(I.wald(pages, by=("route",)), "route", "p")
    ends = R.bootstrap_interval(pages.select("route", "page", "effect"), "page", R.multiplicities(pages, "page", draws, seed), ("route",))
    sides = pages.groupBy("route").agg(F.avg("first").alias("first"), F.avg("second").alias("second"))
    told = tests.join(sides, "route").join(ends, "route")
    return told.select("route", "first", "second", F.col("estimate").alias("difference"), "se", "p", "adjusted", "lower", "upper", (F.signum("first") == F.signum("second")).alias("direction_stable"))


# scales of several models


def _stats(cube_: DataFrame, conditions: list[str], models: list[str], contrasts: dict[str, tuple[str, str]]) -> DataFrame:
    """Of each page its number of cases, and for each model and contrast the sums that a draw needs."""
    at = {c: i for i, c in enumerate(conditions)}
    sums = [F.count(F.lit(1)).alias("n")]
    for m in models:
        for name, (a, b) in contrasts.items():
            delta, reference = F.col("values")[at[f"{m}_{a}"]] - F.col("values")[at[f"{m}_{b}"]], F.col("values")[at[f"{m}_{b}"]]
            up = (F.signum(delta) + 1) / 2 - 0.5
            each = {"rs": F.sum(reference), "rq": F.sum(reference * reference), "ds": F.sum(delta), "dm": F.avg(delta), "us": F.sum(up), "um": F.avg(up)}
            sums += [v.alias(f"{k}|{m}|{name}") for k, v in each.items()]
    return cube_.groupBy("page").agg(*sums)


def _estimates(stats: DataFrame, times, models: list[str], contrasts: dict[str, tuple[str, str]], pairs: list[tuple[str, str]]) -> DataFrame:
    """draw and ``found``: (weighting, pair, contrast, standardised, directional) of every draw whose reference scales are all above 0."""
    each = times.sums(stats.withColumn("k", F.lit(1)), ["k", *(c for c in stats.columns if c != "page")])
    of = lambda k, m, c: F.col(f"`{k}|{m}|{c}`")
    each = each.where("n > 1")
    for m in models:
        for c in contrasts:
            variance = (of("rq", m, c) - of("rs", m, c) * of("rs", m, c) / F.col("n")) / (F.col("n") - 1)
            each = each.withColumn(f"sd|{m}|{c}", F.sqrt(F.greatest(F.lit(0.0), F.round(variance, 12)))).where(f"`sd|{m}|{c}` > 0")

    def differences(weighting: str, delta: str, up: str, over: str) -> list[Column]:
        s = lambda m, c: of(delta, m, c) / F.col(over) / of("sd", m, c)
        d = lambda m, c: of(up, m, c) / F.col(over)
        return [F.struct(F.lit(weighting).alias("weighting"), F.lit(f"{a}-{b}").alias("pair"), F.lit(c).alias("contrast"), (s(a, c) - s(b, c)).alias("standardised"), (d(a, c) - d(b, c)).alias("directional")) for a, b in pairs for c in contrasts]

    found = F.array(*differences("page_balanced", "dm", "um", "k"), *differences("case_weighted", "ds", "us", "n"))
    return each.select("draw", found.alias("found"))


def scale_report(cube_: DataFrame, conditions: list[str], models: list[str], contrasts: dict[str, tuple[str, str]], pairs: list[tuple[str, str]], draws: int, seed: int = R.SEED) -> DataFrame:
    """Differences of models in their route effects, on two endpoints and under two weightings, each with interval, error, p and claim.

    Conditions are named model_route. The reference scale of every model and contrast is
    estimated anew in each draw of pages, which all of them share; a draw in which one has no
    scale is rejected and drawn again. p comes from the bootstrap's error; Holm runs over all
    endpoints of a weighting, and both endpoints of a pair and contrast decide its claim.
    """
    stats = written(_stats(cube_, conditions, models, contrasts), "page-stats")
    estimates = lambda times: _estimates(stats, times, models, contrasts, pairs)
    long = lambda frame: frame.select("draw", F.explode("found").alias("f")).select("draw", "f.*").unpivot(["draw", "weighting", "pair", "contrast"], ["standardised", "directional"], "endpoint", "value")
    keys = ["weighting", "pair", "contrast", "endpoint"]
    seen = long(estimates(R.Whole)).select(*keys, F.col("value").alias("estimate"))
    drawn = long(R.redrawn(stats, "page", draws, estimates, max(1000, 10 * draws), seed)).groupBy(*keys)
    ends = drawn.agg(F.percentile("value", F.lit(0.025)).alias("lower"), F.percentile("value", F.lit(0.975)).alias("upper"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("se"), F.count(F.lit(1)).alias("draws"))
    p = F.when(F.col("se") > 0, I.normal_tail(F.col("estimate") / F.col("se"))).when(F.col("estimate") == 0, 1.0).otherwise(0.0)
    tests = seen.join(ends, keys).withColumn("p", p).withColumn("name", F.concat_ws(".", "pair", "contrast", "endpoint"))
    return claimed(I.holm(tests, "name", "p", ("weighting",)))


def claimed(tests: DataFrame, by: tuple[str, ...] = ("weighting", "pair", "contrast")) -> DataFrame:
    """``tests`` (endpoint, estimate, adjusted) with the claim that the two endpoints of each group of ``by`` allow."""
    side = lambda endpoint, c: F.max(F.when(F.col("endpoint") == endpoint, F.col(c)))
    s, d = ((side(e, "estimate"), side(e, "adjusted")) for e in ("standardised", "directional"))
    return tests.join(tests.groupBy(*by).agg(I.gate(s[0], s[1], d[0], d[1]).alias("claim")), list(by))


def joint_family(reports: dict[str, DataFrame]) -> DataFrame:
    """Reports of several mappings as one family of tests for each weighting: Holm over all of them, claims anew."""
    every = reduce(lambda a, b: a.unionByName(b), (r.drop("adjusted", "claim").withColumn("variant", F.lit(v)).withColumn("name", F.concat_ws(".", F.lit(v), "pair", "contrast", "endpoint")) for v, r in reports.items()))
    return claimed(I.holm(every, "name", "p", ("weighting",)), ("weighting", "variant", "pair", "contrast"))
