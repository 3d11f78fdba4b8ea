"""Whole study programmes over the bound test tables: contexts, families, repeated runs; with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import contexts as U
from ..operators import inference as I
from ..operators import repeats as K
from ..operators import resampling as R
from ..sources.fixtures import CELLS, CONTEXT, cells, context, table
from ..sources.shared import written
from .effects import r
from .procedures import DRAWS, FLIPPED, FLIPS, SEED, TIMES
from .studies import FOURTH, SIGN_P, THIRD

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


# contexts


def _own_times(names: str) -> str:
    """CTEs named_k, slots and times over the distinct ``k`` of a relation."""
    return f"""named_k AS (SELECT k, row_number() OVER (ORDER BY k) - 1 AS place, count(*) OVER () AS n FROM {names}), slots AS (SELECT d AS draw, s AS slot FROM range({DRAWS}) t(d), range((SELECT count(*) FROM {names})) u(s)),
times AS (SELECT draw, k, count(*) AS times FROM (SELECT draw, ('0x' || substr(md5('{SEED}|' || draw || '|' || (slot // 4)), 1 + 8 * (slot % 4)::INT, 8))::BIGINT % (SELECT count(*) FROM {names}) AS place FROM slots) JOIN named_k USING (place) GROUP BY ALL)"""


def _measured_sql(kind: str, metric: str) -> str:
    value, complete = ("hit_treat::INT - hit_base::INT", "TRUE") if metric == "binary" else ("use_treat - use_base", "use_treat IS NOT NULL AND use_base IS NOT NULL")
    bounds = "NULL::DOUBLE AS least, NULL::DOUBLE AS most" if metric == "binary" else "(SELECT round(avg(l), 9) FROM b) AS least, (SELECT round(avg(h), 9) FROM b) AS most"
    return f"""SELECT * FROM (WITH own AS (SELECT * FROM context WHERE kind = '{kind}'), effects AS (SELECT query_id AS k, avg({value}) AS x FROM own WHERE {complete} GROUP BY query_id), b AS (SELECT avg(coalesce(use_treat, -1.0) - coalesce(use_base, 1.0)) AS l, avg(coalesce(use_treat, 1.0) - coalesce(use_base, -1.0)) AS h FROM own GROUP BY query_id),
{_own_times("effects")}, means AS (SELECT draw, sum(times * x) / sum(times) AS mean FROM times JOIN effects USING (k) GROUP BY draw), flipped AS (WITH {FLIPPED} FROM f_counts, f_size)
SELECT '{kind}' AS kind, '{metric}' AS metric, (SELECT round(avg(x), 9) FROM effects) AS estimate, (SELECT round(quantile_cont(mean, 0.025), 9) FROM means) AS lower, (SELECT round(quantile_cont(mean, 0.975), 9) FROM means) AS upper, (SELECT p FROM flipped) AS p,
  (SELECT count(*) FROM effects) AS clusters, (SELECT count(*) FROM own WHERE {complete}) AS pairs, (SELECT count(*) FROM own) AS total, {bounds})"""


@query("context_effects", f"WITH {CONTEXT} " + " UNION ALL ".join(_measured_sql(k, m) for k in ("gold", "conflicting") for m in ("binary", "continuous")))
def context_effects(spark, sf, draws=DRAWS, flips=FLIPS):
    found = U.context_effects(context(spark, sf), "query_id", "kind", ["gold", "conflicting"], ("hit_base", "hit_treat"), ("use_base", "use_treat"), draws, flips)
    return r(found, 9, "estimate", "lower", "upper", "p", "least", "most")


@query("context_coverage", f"""WITH {CONTEXT}, s AS (SELECT kind, 'hard' AS stage, hit_base IS NOT NULL AS a, hit_treat IS NOT NULL AS b FROM context UNION ALL SELECT kind, 'probability', use_base IS NOT NULL, use_treat IS NOT NULL FROM context)
SELECT kind, stage, count(*) FILTER (WHERE a) AS left_ok, count(*) FILTER (WHERE b) AS right_ok, count(*) FILTER (WHERE a AND b) AS paired_ok, count(*) AS total FROM s GROUP BY ALL""")
def context_coverage(spark, sf):
    c = context(spark, sf).withColumns({f"{n}_ok": F.col(n).isNotNull() for n in ("hit_base", "hit_treat", "use_base", "use_treat")})
    return U.coverage(c, "kind", {"hard": ("hit_base_ok", "hit_treat_ok"), "probability": ("use_base_ok", "use_treat_ok")})


# families

FAMILIES = {"first": ("base_score", "treat_score", "base_pred", "treat_pred"), "second": ("third_score", "fourth_score", "third_pred", "fourth_pred"), "third": ("base_score", "fourth_score", "base_pred", "fourth_pred")}
PREDICTED = f"predicted AS (SELECT *, {THIRD} AS third_pred, {FOURTH} AS fourth_pred FROM cells)"


def _corners(a: str, b: str) -> str:
    at = lambda s: " ".join(f"{sign} max(CASE WHEN cell_index = {i} THEN {s} END)" for i, sign in enumerate(("", "-", "-", "+")))
    return f"(({at(b)}) - ({at(a)})) / 2"


def _family_sql(name: str) -> str:
    a, b, p, q = FAMILIES[name]
    return f"""SELECT * FROM (WITH e AS (SELECT case_id, min(cluster_id) AS cluster_id, {_corners(a, b)} AS d FROM predicted GROUP BY case_id), pages AS (SELECT cluster_id, avg(d) AS e FROM e GROUP BY cluster_id),
means AS (SELECT draw, sum(times * e) / sum(times) AS mean FROM times JOIN pages USING (cluster_id) GROUP BY draw), g AS (SELECT median(e) AS med, count(*) FILTER (WHERE e < 0) AS neg, count(*) FILTER (WHERE e > 0) AS pos FROM pages),
sizes AS (SELECT gold, count(*) AS m FROM predicted GROUP BY gold), kinds AS (SELECT count(*) AS classes FROM sizes), effects AS (SELECT cluster_id AS k, sum((({q} = gold)::INT - ({p} = gold)::INT)::DOUBLE / m / classes) AS x FROM predicted JOIN sizes USING (gold), kinds GROUP BY cluster_id), flipped AS (WITH {FLIPPED} FROM f_counts, f_size)
SELECT '{name}' AS family, (SELECT avg(e) FROM pages) AS estimate, (SELECT quantile_cont(mean, 0.025) FROM means) AS lower, (SELECT quantile_cont(mean, 0.975) FROM means) AS upper, (SELECT count(*) FROM pages) AS clusters, (SELECT sum(x) FROM effects) AS accuracy_difference, (SELECT p FROM flipped) AS p,
  (SELECT med FROM g) AS median, (SELECT {SIGN_P} FROM g) AS sign_p, (SELECT count(*) FROM predicted WHERE {p} <> {q}) AS changed, (SELECT count(*) FROM predicted WHERE {p} = gold AND {q} <> gold) AS degraded, (SELECT count(*) FROM predicted WHERE {p} <> gold AND {q} = gold) AS improved)"""


@query("family_study", f"""WITH {TIMES}, {PREDICTED}, f AS ({" UNION ALL ".join(_family_sql(n) for n in FAMILIES)}), h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, family) + 1) * p AS raised FROM f)
SELECT family, {", ".join(f"round({c}, 9) AS {c}" for c in ("estimate", "lower", "upper", "accuracy_difference", "p", "median", "sign_p"))}, round(least(1.0, max(raised) OVER (ORDER BY p, family ROWS UNBOUNDED PRECEDING)), 9) AS adjusted, clusters, changed, degraded, improved FROM h""")
def family_study(spark, sf, draws=DRAWS, flips=FLIPS):
    """Of each family its effect with interval and signs, the swap test of its accuracies with Holm, and its transitions."""
    c = written(cells(spark, sf).withColumns({"third_pred": F.expr(THIRD), "fourth_pred": F.expr(FOURTH)}), "family-cells")
    at = F.col("cell_index")
    each = c.groupBy("case_id").agg(F.min("cluster_id").alias("cluster_id"), *((C.interaction(F.col(b), at) - C.interaction(F.col(a), at)).alias(n) for n, (a, b, _, _) in FAMILIES.items()))
    pages = written(C.cluster_means(each.unpivot(["case_id", "cluster_id"], [*FAMILIES], "family", "d"), "cluster_id", "d", ("family",)), "family-pages")
    told = pages.groupBy("family").agg(F.avg("effect").alias("estimate"), F.count(F.lit(1)).alias("clusters"))
    # the families share the drawn clusters and the flips
    ends = R.bootstrap_interval(pages, "cluster_id", R.multiplicities(pages, "cluster_id", draws), ("family",)).select("family", "lower", "upper")
    signs = I.direction_summary(pages, by=("family",)).select("family", "median", F.col("p").alias("sign_p"))
    names = F.array(*map(F.lit, FAMILIES))
    swap = R.condition_swaps(c, "cluster_id", "gold", [(p, q) for _, _, p, q in FAMILIES.values()], flips).select(names[F.col("of")].alias("family"), "p", F.col("difference").alias("accuracy_difference"))
    right = lambda x: F.col(x) == F.col("gold")
    moved = [F.struct(F.lit(n).alias("family"), F.count_if(F.col(p) != F.col(q)).alias("changed"), F.count_if(right(p) & ~right(q)).alias("degraded"), F.count_if(~right(p) & right(q)).alias("improved")) for n, (_, _, p, q) in FAMILIES.items()]
    moved = c.agg(F.array(*moved).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    out = told
    for part in (ends, signs, swap, moved):
        out = out.join(F.broadcast(part), "family")  # a row for each family
    return r(I.holm(out, "family", "p"), 9, "estimate", "lower", "upper", "accuracy_difference", "p", "median", "sign_p", "adjusted")


# repeated runs

RUNS = """runs AS (SELECT label AS model, vec_id, i AS repeat, ['fp16', 'gptq', 'awq'][1 + (j - 1) % 3] AS route, vec_id || ':' || j AS unit, vec_id * 100 + (j - 1) // 3 AS case_id, vec_id % 7 AS page, CAST(embedding[j] AS DOUBLE) + (i - 1) * 1e-4 * CAST(embedding[1 + j % 64] AS DOUBLE) AS score FROM embeddings, range(1, 61) u(j), range(1, 4) t(i))"""
CONTRASTS = {"awq-fp16": ("awq", "fp16"), "awq-gptq": ("awq", "gptq")}


def runs(spark, sf: str):
    """Three repeats of 60 scored units of every vector, in three routes; scores drift a little from repeat to repeat."""
    e = table(spark, sf, "embeddings").select(F.col("label").alias("model"), "vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("j"))
    e = e.select("*", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("repeat"))
    at = lambda i: F.element_at("embedding", i).cast("double")
    score = at(F.col("j")) + (F.col("repeat") - 1) * 1e-4 * at(F.col("j") % 64 + 1)
    route = F.element_at(F.array(*map(F.lit, ("fp16", "gptq", "awq"))), (F.col("j") - 1) % 3 + 1)
    return e.select("model", "vec_id", "repeat", route.alias("route"), F.concat_ws(":", "vec_id", "j").alias("unit"), (F.col("vec_id") * 100 + F.expr("(j - 1) div 3")).alias("case_id"), (F.col("vec_id") % 7).alias("page"), score.alias("score"))


@query("repeat_report", f"""WITH {RUNS}, u AS (SELECT model, route, unit, max(score) - min(score) AS span, arg_min(score, repeat) AS first, count(DISTINCT sign(score)) AS sides FROM runs GROUP BY ALL)
SELECT model, route, count(*) AS units, round(max(span), 12) AS largest, round(quantile_cont(span, 0.99), 12) AS p99, round(median(span), 12) AS median, round(max(span / abs(first)) FILTER (WHERE abs(first) > 1e-12), 9) AS largest_ratio, count(*) FILTER (WHERE sides > 1) AS flips, count(*) FILTER (WHERE sides = 1) AS stable, round(count(*) FILTER (WHERE sides > 1) / count(*), 12) AS flip_rate,
  CASE WHEN max(span) = 0 AND max(sides) = 1 THEN 'identical_outputs' WHEN max(span) <= 1e-6 AND max(sides) = 1 THEN 'within_engineering_threshold' ELSE 'requires_investigation' END AS outcome FROM u GROUP BY model, route""")
def repeat_report(spark, sf):
    labelled = runs(spark, sf).withColumn("choice", F.signum("score"))
    found = K.span_report(labelled, ["model", "route"], "unit", "repeat", 3, "score", "choice")
    return r(r(found, 12, "largest", "p99", "median", "flip_rate"), 9, "largest_ratio")


ROUTE_SQL = f"""{RUNS}, w AS (SELECT model, repeat, case_id, min(page) AS page, {", ".join(f"max(score) FILTER (WHERE route = '{x}') AS {x}" for x in ("fp16", "gptq", "awq"))} FROM runs GROUP BY ALL),
l AS (SELECT model, repeat, page, 'awq-fp16' AS contrast, awq - fp16 AS delta, fp16 AS ref FROM w UNION ALL SELECT model, repeat, page, 'awq-gptq', awq - gptq, gptq FROM w),
g AS (SELECT model, contrast, repeat, page, count(*) AS n, avg(delta) AS dm, sum(delta) AS ds, avg((sign(delta) + 1) / 2) AS um, sum((sign(delta) + 1) / 2) AS us FROM l GROUP BY ALL), sd AS (SELECT model, contrast, repeat, coalesce(stddev_samp(ref), 0) AS sd FROM l GROUP BY ALL),
e AS (SELECT g.model, g.contrast, g.repeat, avg(dm) AS dm, sum(ds) / sum(n) AS ds, avg(um) AS um, sum(us) / sum(n) AS us, min(sd) AS sd FROM g JOIN sd ON g.model = sd.model AND g.contrast = sd.contrast AND g.repeat = sd.repeat GROUP BY ALL),
x AS ({" UNION ALL ".join(f"SELECT model, contrast, repeat, '{w}' AS weighting, '{n}' AS endpoint, {v} AS v FROM e" for w, m, u in (("page_balanced", "dm", "um"), ("case_weighted", "ds", "us")) for n, v in (("difference", m), ("standardised", f"CASE WHEN sd > 1e-12 THEN {m} / sd END"), ("directional", u)))})"""


@query("route_repeats", f"""WITH {ROUTE_SQL} SELECT model, contrast, weighting, endpoint, round(arg_min(v, repeat), 9) AS first, round(max(v) - min(v), 9) AS span, CASE WHEN abs(arg_min(v, repeat)) > 1e-12 THEN round((max(v) - min(v)) / abs(arg_min(v, repeat)), 6) END AS ratio,
  count(DISTINCT sign(v - CASE WHEN endpoint = 'directional' THEN 0.5 ELSE 0 END)) = 1 AS direction_stable FROM x GROUP BY ALL""")
def route_repeats(spark, sf):
    found = K.route_effects(runs(spark, sf), "model", "route", "repeat", 3, "case_id", "page", "score", CONTRASTS)
    return r(r(found.select("model", "contrast", "weighting", "endpoint", F.col("values")[0].alias("first"), "span", "ratio", "direction_stable"), 9, "first", "span"), 6, "ratio")


@query("cross_repeats", f"""WITH {ROUTE_SQL}, m AS (SELECT min(model) AS a, max(model) AS b FROM x), d AS (SELECT p.contrast, p.weighting, p.endpoint, p.repeat, p.v - q.v AS v FROM x p JOIN x q ON p.contrast = q.contrast AND p.weighting = q.weighting AND p.endpoint = q.endpoint AND p.repeat = q.repeat, m WHERE p.model = m.a AND q.model = m.b AND p.endpoint <> 'difference')
SELECT contrast, weighting, endpoint, round(arg_min(v, repeat), 9) AS first, round(max(v) - min(v), 9) AS span, count(DISTINCT sign(v)) = 1 AS direction_stable FROM d GROUP BY ALL""")
def cross_repeats(spark, sf):
    ends = table(spark, sf, "embeddings").agg(F.min("label").alias("a"), F.max("label").alias("b")).first()
    effects = K.route_effects(runs(spark, sf), "model", "route", "repeat", 3, "case_id", "page", "score", CONTRASTS)
    found = K.cross_effects(effects, [(ends.a, ends.b)])
    return r(found.select("contrast", "weighting", "endpoint", F.col("values")[0].alias("first"), "span", "direction_stable"), 9, "first", "span")
