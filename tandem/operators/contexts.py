"""The report of paired context use: effects over queries, with intervals, flips, bounds of what is missing, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import resampling as R

STAGES = ("hard", "probability")


def _measured(effects: DataFrame, query: str, draws: int, flips: int, seed: int) -> DataFrame:
    """One row: the mean over queries, its bootstrap interval and its sign-flip p, of (query, effect)."""
    effects = written(effects, "query-effects")
    mean = effects.agg(F.avg("effect").alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    ends = R.bootstrap_interval(effects, query, R.multiplicities(effects, query, draws, seed)).select("lower", "upper")
    p = R.sign_flip(effects, query, flips, seed=seed).select("p")
    return mean.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(p))  # one row each


def context_effects(rows: DataFrame, query: str, kind: str, kinds: list[str], hits: tuple[str, str], uses: tuple[str, str], draws: int, flips: int, seed: int = R.SEED) -> DataFrame:
    """(kind, metric): estimate, interval, p, clusters, pairs and total pairs; of continuous use also bounds for missing values.

    Binary use (``hits``) must be there in every row. Continuous use (``uses``, from -1 to 1) is
    averaged over pairs that have both sides; the bounds let a missing side be anything. A kind
    without rows is an error, one without complete pairs has no estimate.
    """
    out: DataFrame | None = None
    for name in kinds:
        own = rows.where(F.col(kind) == name)
        told = own.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(hits[0]).isNull() | F.col(hits[1]).isNull()).alias("open"), F.count_if(F.col(uses[0]).isNotNull() & F.col(uses[1]).isNotNull()).alias("pairs")).first()
        if not told.total or told.open:
            raise ValueError(f"context kind {name}: {told.open} of {told.total} rows lack a binary result")
        hit = own.groupBy(query).agg(F.avg(F.col(hits[1]).cast("double") - F.col(hits[0]).cast("double")).alias("effect"))
        use = own.where(F.col(uses[0]).isNotNull() & F.col(uses[1]).isNotNull()).groupBy(query).agg(F.avg(F.col(uses[1]) - F.col(uses[0])).alias("effect"))
        put = lambda c, v: F.coalesce(F.col(c), F.lit(v))
        each = own.groupBy(query).agg(F.avg(put(uses[1], -1.0) - put(uses[0], 1.0)).alias("low"), F.avg(put(uses[1], 1.0) - put(uses[0], -1.0)).alias("high"))
        bounds = each.agg(F.avg("low").alias("least"), F.avg("high").alias("most"))
        none = F.lit(None).cast("double")
        first = _measured(hit, query, draws, flips, seed).withColumns({"metric": F.lit("binary"), "pairs": F.lit(told.total).cast("long"), "least": none, "most": none})
        second = _measured(use, query, draws, flips, seed).crossJoin(F.broadcast(bounds)).withColumns({"metric": F.lit("continuous"), "pairs": F.lit(told.pairs).cast("long")})
        both = first.unionByName(second).withColumns({"kind": F.lit(name), "total": F.lit(told.total).cast("long")})
        out = both if out is None else out.unionByName(both)
    return out


def coverage(rows: DataFrame, kind: str, ok: dict[str, tuple[str, str]]) -> DataFrame:
    """Of each kind and stage: pairs whose left, right, and both sides are complete, and all pairs."""
    sides = F.array(*(F.struct(F.lit(s).alias("stage"), F.coalesce(F.col(a), F.lit(False)).alias("a"), F.coalesce(F.col(b), F.lit(False)).alias("b")) for s, (a, b) in ok.items()))
    each = rows.select(F.col(kind).alias("kind"), F.explode(sides).alias("s"))
    return each.groupBy("kind", "s.stage").agg(F.count_if("s.a").alias("left_ok"), F.count_if("s.b").alias("right_ok"), F.count_if(F.col("s.a") & F.col("s.b")).alias("paired_ok"), F.count(F.lit(1)).alias("total"))
