"""Paired effects, metrics and closed-form tests over the bound test tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import inference as I
from ..operators import metrics as M
from ..sources.fixtures import CELLS, CONTEXT, cells, context, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


def r(frame: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Rounded, so that the order of sums does not show."""
    return frame.withColumns({c: F.round(c, digits) for c in columns})


CASES = CELLS + """, summary AS (
  SELECT case_id, min(cluster_id) AS cluster_id, min(stratum) AS stratum,
    (max(CASE WHEN cell_index = 0 THEN base_score END) - max(CASE WHEN cell_index = 1 THEN base_score END)
      - max(CASE WHEN cell_index = 2 THEN base_score END) + max(CASE WHEN cell_index = 3 THEN base_score END)) / 2 AS base,
    CASE WHEN count(*) FILTER (WHERE treat_ok) = 4 THEN (max(CASE WHEN cell_index = 0 THEN treat_score END) - max(CASE WHEN cell_index = 1 THEN treat_score END)
      - max(CASE WHEN cell_index = 2 THEN treat_score END) + max(CASE WHEN cell_index = 3 THEN treat_score END)) / 2 END AS treat,
    (max(CASE WHEN cell_index = 0 THEN treat_score END) - max(CASE WHEN cell_index = 1 THEN treat_score END)
      - max(CASE WHEN cell_index = 2 THEN treat_score END) + max(CASE WHEN cell_index = 3 THEN treat_score END)) / 2 AS treat_all,
    (max(CASE WHEN cell_index = 0 THEN third_score END) - max(CASE WHEN cell_index = 1 THEN third_score END)
      - max(CASE WHEN cell_index = 2 THEN third_score END) + max(CASE WHEN cell_index = 3 THEN third_score END)) / 2 AS third,
    (max(CASE WHEN cell_index = 0 THEN fourth_score END) - max(CASE WHEN cell_index = 1 THEN fourth_score END)
      - max(CASE WHEN cell_index = 2 THEN fourth_score END) + max(CASE WHEN cell_index = 3 THEN fourth_score END)) / 2 AS fourth
  FROM cells GROUP BY case_id)"""

CLUSTERS = CASES + """, clusters AS (
  SELECT cluster_id, avg(treat_all - base) AS effect, count(*) AS cases FROM summary GROUP BY cluster_id)"""


def case_values(spark, sf: str) -> DataFrame:
    """case_id, cluster_id, stratum and the interaction of each score."""
    at = F.col("cell_index")
    return cells(spark, sf).groupBy("case_id").agg(
        F.min("cluster_id").alias("cluster_id"),
        F.min("stratum").alias("stratum"),
        C.interaction(F.col("base_score"), at).alias("base"),
        C.interaction(F.col("treat_score"), at, F.col("treat_ok")).alias("treat"),
        C.interaction(F.col("treat_score"), at).alias("treat_all"),
        C.interaction(F.col("third_score"), at).alias("third"),
        C.interaction(F.col("fourth_score"), at).alias("fourth"),
    )


def clusters(spark, sf: str) -> DataFrame:
    return C.cluster_means(case_values(spark, sf).withColumn("d", F.col("treat_all") - F.col("base")), "cluster_id", "d")


@query("balanced_effect", f"""WITH {CLUSTERS} SELECT round(avg(effect), 6) AS balanced, round(sum(effect * cases) / sum(cases), 6) AS weighted,
  count(*) AS clusters, CAST(sum(cases) AS BIGINT) AS cases FROM clusters""")
def balanced_effect(spark, sf):
    return r(C.balanced_mean(clusters(spark, sf)), 6, "balanced", "weighted")


@query("case_summary", f"""WITH {CELLS} SELECT case_id, min(cluster_id) AS cluster_id,
  round(CASE WHEN count(*) FILTER (WHERE treat_ok) = 4 THEN (max(CASE WHEN cell_index = 0 THEN treat_score END) - max(CASE WHEN cell_index = 1 THEN treat_score END)
    - max(CASE WHEN cell_index = 2 THEN treat_score END) + max(CASE WHEN cell_index = 3 THEN treat_score END)) / 2 END, 10) AS interaction,
  avg(CASE WHEN treat_ok AND treat_pred = gold THEN 1.0 ELSE 0.0 END) AS accuracy,
  string_agg(CASE WHEN treat_ok AND treat_pred = gold THEN '1' ELSE '0' END, '' ORDER BY cell_index) AS pattern,
  avg(CASE WHEN treat_ok THEN 1.0 ELSE 0.0 END) AS coverage FROM cells GROUP BY case_id""")
def case_summary(spark, sf):
    return r(C.summarise_cases(cells(spark, sf), "treat_score", "treat_pred", ok="treat_ok"), 10, "interaction")


@query("paired_cases", f"""WITH {CASES}, l AS (SELECT case_id, stratum, base AS x FROM summary WHERE base IS NOT NULL), q AS (SELECT case_id, stratum, treat AS x FROM summary WHERE treat IS NOT NULL)
SELECT coalesce(l.case_id, q.case_id) AS case_id, round(l.x, 10) AS x_left, round(q.x, 10) AS x_right, round(q.x - l.x, 10) AS x_effect,
  CASE WHEN q.case_id IS NULL THEN 'only_left' WHEN l.case_id IS NULL THEN 'only_right' WHEN l.stratum IS DISTINCT FROM q.stratum THEN 'differs' ELSE 'ok' END AS status
FROM l FULL JOIN q ON l.case_id = q.case_id""")
def paired_cases(spark, sf):
    """A side is missing where its condition has no complete case."""
    v = case_values(spark, sf)
    left, right = (v.where(F.col(c).isNotNull()).select("case_id", "stratum", F.col(c).alias("x")) for c in ("base", "treat"))
    return r(C.pair(left, right, "case_id", ["x"], ("stratum",)), 10, "x_left", "x_right", "x_effect").select("case_id", "x_left", "x_right", "x_effect", "status")


@query("cluster_means", f"WITH {CLUSTERS} SELECT cluster_id, round(effect, 6) AS effect, cases FROM clusters")
def cluster_means(spark, sf):
    return r(clusters(spark, sf), 6, "effect")


@query("capped_mean", f"WITH {CLUSTERS} SELECT round(sum(effect * least(cases, 3)) / sum(least(cases, 3)), 6) AS capped FROM clusters")
def capped_mean(spark, sf):
    return r(C.capped_mean(clusters(spark, sf), 3), 6, "capped")


@query("jackknife", f"""WITH {CLUSTERS}, t AS (SELECT sum(effect) AS s, count(*) AS n FROM clusters), w AS (SELECT cluster_id, (s - effect) / (n - 1) AS without, s / n AS mean FROM clusters, t)
SELECT round(min(without), 6) AS lowest, round(max(without), 6) AS highest, min(without) < 0 AND max(without) > 0 AS sign_turns,
  (SELECT cluster_id FROM w ORDER BY round(abs(without - mean), 12) DESC, cluster_id DESC LIMIT 1) AS most_influential FROM w""")
def jackknife(spark, sf):
    return r(C.jackknife(clusters(spark, sf), "cluster_id"), 6, "lowest", "highest")


@query("complete_mean", f"WITH {CASES} SELECT stratum, round(CASE WHEN count(treat) = count(*) THEN avg(treat) END, 6) AS mean, count(*) - count(treat) AS missing FROM summary GROUP BY stratum")
def complete_mean(spark, sf):
    return r(C.complete_mean(case_values(spark, sf), "treat", ("stratum",)), 6, "mean")


@query("confusion", f"""WITH {CELLS} SELECT gold, count(*) FILTER (WHERE treat_pred = 'A') AS "pred_A", count(*) FILTER (WHERE treat_pred = 'N') AS "pred_N", count(*) FILTER (WHERE treat_pred = 'R') AS "pred_R" FROM cells GROUP BY gold""")
def confusion(spark, sf):
    return M.confusion(cells(spark, sf), "gold", "treat_pred", ["A", "N", "R"])


@query("balanced_accuracy", f"""WITH {CELLS}, recalls AS (SELECT stratum, gold, avg(CASE WHEN gold = treat_pred THEN 1.0 ELSE 0.0 END) AS recall FROM cells GROUP BY ALL)
SELECT stratum, round(avg(recall), 9) AS balanced_accuracy FROM recalls GROUP BY stratum""")
def balanced_accuracy(spark, sf):
    return r(M.balanced_accuracy(cells(spark, sf), "gold", "treat_pred", ["A", "N", "R"], ("stratum",)), 9, "balanced_accuracy")


@query("matthews", f"""WITH {CELLS}, n AS (SELECT gold AS g, treat_pred AS p, count(*)::DOUBLE AS n FROM cells GROUP BY ALL),
t AS (SELECT g AS label, sum(n) AS t FROM n GROUP BY g), q AS (SELECT p AS label, sum(n) AS q FROM n GROUP BY p),
s AS (SELECT (SELECT sum(n) FROM n) AS s, (SELECT sum(n) FROM n WHERE g = p) AS c, (SELECT sum(t * q) FROM t JOIN q USING (label)) AS tq, (SELECT sum(t * t) FROM t) AS tt, (SELECT sum(q * q) FROM q) AS qq)
SELECT round((c * s - tq) / sqrt((s * s - qq) * (s * s - tt)), 9) AS mcc FROM s""")
def matthews(spark, sf):
    return r(M.matthews(cells(spark, sf), "gold", "treat_pred"), 9, "mcc")


@query("binary_metrics", """WITH x AS (SELECT d.lang, l.quality = 1 AS g, d.n_chars > 800 AS p FROM labels l JOIN documents d USING (doc_id)),
n AS (SELECT lang, count(*) FILTER (WHERE g AND p) AS tp, count(*) FILTER (WHERE NOT g AND NOT p) AS tn, count(*) FILTER (WHERE NOT g AND p) AS fp, count(*) FILTER (WHERE g AND NOT p) AS fn FROM x GROUP BY lang)
SELECT lang, tp, tn, fp, fn, round((tp + tn)::DOUBLE / (tp + tn + fp + fn), 9) AS accuracy,
  round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall_positive, round(tn::DOUBLE / nullif(tn + fp, 0), 9) AS recall_negative,
  round((tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2, 9) AS balanced_accuracy,
  round(CASE WHEN (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) > 0 THEN (tp * tn - fp * fn)::DOUBLE / sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END, 9) AS mcc,
  round((tp + fp)::DOUBLE / (tp + tn + fp + fn), 9) AS positive_rate FROM n""")
def binary_metrics(spark, sf):
    x = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    found = M.binary_metrics(x, F.col("quality") == 1, F.col("n_chars") > 800, ("lang",))
    return r(found, 9, "accuracy", "recall_positive", "recall_negative", "balanced_accuracy", "mcc", "positive_rate")


@query("transitions", f"""WITH {CELLS} SELECT stratum, count(*) AS rows, count(*) FILTER (WHERE base_pred <> treat_pred) AS flips,
  count(*) FILTER (WHERE base_pred = gold AND treat_pred <> gold) AS degraded, count(*) FILTER (WHERE base_pred <> gold AND treat_pred = gold) AS improved,
  count(*) FILTER (WHERE base_pred = gold AND treat_pred = gold) AS both_right, count(*) FILTER (WHERE base_pred <> gold AND treat_pred <> gold) AS both_wrong,
  round(avg(CASE WHEN base_pred = treat_pred THEN 1.0 ELSE 0.0 END), 9) AS agreement FROM cells GROUP BY stratum""")
def transitions(spark, sf):
    return r(M.transitions(cells(spark, sf), "gold", "base_pred", "treat_pred", ("stratum",)), 9, "agreement")


@query("label_transitions", f"WITH {CELLS} SELECT base_pred || '->' || treat_pred AS transition, count(*) AS rows FROM cells GROUP BY ALL")
def label_transitions(spark, sf):
    return M.transition_histogram(cells(spark, sf), "base_pred", "treat_pred")


@query("pattern_transitions", f"""WITH {CELLS}, p AS (SELECT case_id, string_agg(CASE WHEN base_pred = gold THEN '1' ELSE '0' END, '' ORDER BY cell_index) AS a,
  string_agg(CASE WHEN treat_pred = gold THEN '1' ELSE '0' END, '' ORDER BY cell_index) AS b FROM cells GROUP BY case_id) SELECT a || '->' || b AS transition, count(*) AS rows FROM p GROUP BY ALL""")
def pattern_transitions(spark, sf):
    c = cells(spark, sf)
    bit = lambda p, i: F.max(F.when(F.col("cell_index") == i, F.when(F.col(p) == F.col("gold"), "1").otherwise("0")))
    both = c.groupBy("case_id").agg(*(F.concat(*(bit(p, i) for i in range(4))).alias(p) for p in ("base_pred", "treat_pred")))
    return M.transition_histogram(both, "base_pred", "treat_pred")


@query("label_rates", f"""WITH {CELLS}, n AS (SELECT control, treat_pred, count(*) AS rows FROM cells GROUP BY ALL) SELECT control, treat_pred, rows, round(rows / sum(rows) OVER (PARTITION BY control), 9) AS share FROM n""")
def label_rates(spark, sf):
    return r(M.label_rates(cells(spark, sf), "control", "treat_pred"), 9, "share")


@query("backend_agreement", f"""WITH {CASES} SELECT round(corr(base, treat_all), 6) AS pearson, round(avg(treat_all - base), 6) AS mean, round(median(treat_all - base), 6) AS median,
  round(stddev_samp(treat_all - base), 6) AS sd, round(min(treat_all - base), 6) AS least, round(max(treat_all - base), 6) AS most FROM summary""")
def backend_agreement(spark, sf):
    return r(M.pearson(case_values(spark, sf), "base", "treat_all"), 6, "pearson", "mean", "median", "sd", "least", "most")


@query("context_bounds", f"""WITH {CONTEXT}, c AS (SELECT query_id, avg(coalesce(use_treat, -1.0) - coalesce(use_base, 1.0)) AS lower, avg(coalesce(use_treat, 1.0) - coalesce(use_base, -1.0)) AS upper FROM context WHERE kind = 'gold' GROUP BY query_id)
SELECT round(avg(lower), 6) AS lower, round(avg(upper), 6) AS upper, count(*) AS clusters FROM c""")
def context_bounds(spark, sf):
    return r(C.missing_bounds(context(spark, sf).where("kind = 'gold'"), "query_id", "use_base", "use_treat"), 6, "lower", "upper")


@query("context_report", f"""WITH {CONTEXT}, c AS (SELECT kind, query_id, avg(hit_treat::INT - hit_base::INT) AS hit, avg(use_treat - use_base) AS used, count(*) AS rows, count(use_treat - use_base) AS complete FROM context GROUP BY ALL)
SELECT kind, CAST(sum(rows) AS BIGINT) AS rows, CAST(sum(complete) AS BIGINT) AS complete, round(avg(hit), 6) AS hit_effect, round(avg(used), 6) AS use_effect, count(*) AS clusters FROM c GROUP BY kind""")
def context_report(spark, sf):
    each = context(spark, sf).groupBy("kind", "query_id").agg(
        F.avg(F.col("hit_treat").cast("int") - F.col("hit_base").cast("int")).alias("hit"),
        F.avg(F.col("use_treat") - F.col("use_base")).alias("used"),
        F.count(F.lit(1)).alias("rows"),
        F.count(F.col("use_treat") - F.col("use_base")).alias("complete"),
    )
    found = each.groupBy("kind").agg(F.sum("rows").alias("rows"), F.sum("complete").alias("complete"), F.avg("hit").alias("hit_effect"), F.avg("used").alias("use_effect"), F.count(F.lit(1)).alias("clusters"))
    return r(found, 6, "hit_effect", "use_effect")


LONG = CASES + """, long AS (
  SELECT case_id, cluster_id, 'base' AS model, base AS value FROM summary UNION ALL SELECT case_id, cluster_id, 'treat', treat FROM summary WHERE treat IS NOT NULL
  UNION ALL SELECT case_id, cluster_id, 'third', third FROM summary UNION ALL SELECT case_id, cluster_id, 'fourth', fourth FROM summary WHERE case_id % 9 <> 0)"""


def long_values(spark, sf) -> DataFrame:
    v = case_values(spark, sf).withColumn("fourth", F.when(F.col("case_id") % 9 != 0, F.col("fourth")))
    return C.unpivot(v, ["case_id", "cluster_id"], ["base", "treat", "third", "fourth"]).where("value IS NOT NULL")


@query("common_support", f"WITH {LONG} SELECT case_id FROM long GROUP BY case_id HAVING count(*) = 4 AND count(DISTINCT model) = 4 AND min(cluster_id) = max(cluster_id)")
def common_support(spark, sf):
    return C.aligned(long_values(spark, sf), "case_id", "model", 4, ("cluster_id",))


PAIRS = [("treat", "base"), ("third", "base"), ("fourth", "base"), ("third", "treat"), ("fourth", "treat"), ("fourth", "third")]


@query("pairwise_contrasts", f"""WITH {LONG}, d AS (SELECT a.model || '-' || b.model AS contrast, a.cluster_id, a.value - b.value AS effect
  FROM long a JOIN long b ON a.case_id = b.case_id AND a.model || '-' || b.model IN ('treat-base', 'third-base', 'fourth-base', 'third-treat', 'fourth-treat', 'fourth-third')),
c AS (SELECT contrast, cluster_id, avg(effect) AS effect, count(*) AS cases FROM d GROUP BY ALL)
SELECT contrast, round(avg(effect), 6) AS balanced, round(sum(effect * cases) / sum(cases), 6) AS weighted, count(*) AS clusters, CAST(sum(cases) AS BIGINT) AS cases FROM c GROUP BY contrast""")
def pairwise_contrasts(spark, sf):
    each = C.contrasts(long_values(spark, sf), "case_id", "model", "value", PAIRS, ("cluster_id",))
    return r(C.balanced_mean(C.cluster_means(each, "cluster_id", "effect", ("contrast",)), ("contrast",)), 6, "balanced", "weighted")


@query("interaction_contrast", f"WITH {CASES} SELECT round(avg((treat_all - base) - (fourth - third)), 6) AS effect, count(*) AS cases FROM summary")
def interaction_contrast(spark, sf):
    d = (F.col("treat_all") - F.col("base")) - (F.col("fourth") - F.col("third"))
    return r(case_values(spark, sf).agg(F.avg(d).alias("effect"), F.count(F.lit(1)).alias("cases")), 6, "effect")


def _normal_sql(z: str) -> str:
    """Two-sided normal tail: the series of erf below 2, a continued fraction of erfc above."""
    x = f"(abs({z}) / sqrt(2))"
    series = f"list_reduce(list_prepend(1.0::DOUBLE, range(60, 0, -1)::DOUBLE[]), lambda s, n: 1 + s * 2 * {x} * {x} / (2 * n + 1))"
    fraction = f"list_reduce(list_prepend({x}::DOUBLE, range(120, 0, -1)::DOUBLE[]), lambda f, n: {x} + n / 2 / f)"
    return f"(CASE WHEN {x} < 2 THEN 1 - 2 * exp(-{x} * {x}) / sqrt(pi()) * {x} * {series} ELSE exp(-{x} * {x}) / sqrt(pi()) / {fraction} END)"


@query("wald", f"""WITH {CLUSTERS}, w AS (SELECT avg(effect) AS estimate, stddev_samp(effect) / sqrt(count(*)) AS se, count(*) AS clusters FROM clusters)
SELECT round(estimate, 6) AS estimate, round(se, 6) AS se, clusters, round(pow(estimate / se, 2), 5) AS statistic, round({_normal_sql('estimate / se')}, 6) AS p FROM w""")
def wald(spark, sf):
    return r(r(I.wald(clusters(spark, sf)), 6, "estimate", "se", "p"), 5, "statistic")


@query("direction_summary", f"""WITH {CLUSTERS}, n AS (SELECT median(effect) AS median, count(*) FILTER (WHERE effect < 0) AS negative, count(*) FILTER (WHERE effect > 0) AS positive, count(*) FILTER (WHERE effect = 0) AS zero FROM clusters)
SELECT round(median, 6) AS median, negative, positive, zero,
  round(least(1.0, 2 * list_sum(list_transform(range(0, least(negative, positive) + 1), lambda i: exp(lgamma(negative + positive + 1) - lgamma(i + 1) - lgamma(negative + positive - i + 1) - (negative + positive) * ln(2))))), 6) AS p FROM n""")
def direction_summary(spark, sf):
    return r(I.direction_summary(clusters(spark, sf)), 6, "median", "p")


@query("mcnemar", f"""WITH {CELLS}, n AS (SELECT count(*) FILTER (WHERE base_pred = gold AND treat_pred <> gold) AS a, count(*) FILTER (WHERE base_pred <> gold AND treat_pred = gold) AS b FROM cells)
SELECT a AS only_left, b AS only_right, round(pow(abs(a - b) - 1, 2) / (a + b), 6) AS statistic,
  round(least(1.0, 2 * list_sum(list_transform(range(0, least(a, b) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) - (a + b) * ln(2))))), 6) AS p FROM n""")
def mcnemar(spark, sf):
    return r(I.mcnemar(cells(spark, sf), F.col("base_pred") == F.col("gold"), F.col("treat_pred") == F.col("gold")), 6, "statistic", "p")


@query("cochran_q", f"""WITH {LONG}, x AS (SELECT case_id, model, (value < 0)::INT AS x FROM long), rr AS (SELECT case_id, sum(x) AS r FROM x GROUP BY case_id HAVING count(*) = 4),
c AS (SELECT model, sum(x) AS c FROM x WHERE case_id IN (SELECT case_id FROM rr) GROUP BY model),
s AS (SELECT (SELECT sum(r) FROM rr)::DOUBLE AS t, (SELECT sum(r * r) FROM rr)::DOUBLE AS rs, (SELECT sum(c * c) FROM c)::DOUBLE AS cs, (SELECT count(*) FROM rr) AS keys),
q AS (SELECT 3 * (4 * cs - t * t) / (4 * t - rs) AS q, keys FROM s)
SELECT round(q, 6) AS q, keys, round({_normal_sql('sqrt(q)')} + sqrt(2 * q / pi()) * exp(-q / 2), 6) AS p FROM q""")
def cochran_q(spark, sf):
    return r(I.cochran_q(long_values(spark, sf), "case_id", "model", F.col("value") < 0, 4), 6, "q", "p")


@query("covariance", f"""WITH {CASES} SELECT 'base' AS a, 'base' AS b, round(covar_samp(base, base), 6) AS covariance FROM summary UNION ALL SELECT 'base', 'treat_all', round(covar_samp(base, treat_all), 6) FROM summary
UNION ALL SELECT 'base', 'third', round(covar_samp(base, third), 6) FROM summary UNION ALL SELECT 'treat_all', 'treat_all', round(covar_samp(treat_all, treat_all), 6) FROM summary
UNION ALL SELECT 'treat_all', 'third', round(covar_samp(treat_all, third), 6) FROM summary UNION ALL SELECT 'third', 'third', round(covar_samp(third, third), 6) FROM summary""")
def covariance(spark, sf):
    return r(I.covariance(case_values(spark, sf), ["base", "treat_all", "third"]), 6, "covariance")


@query("omnibus_wald", f"""WITH {CASES}, k AS (SELECT cluster_id, avg(base) AS a, avg(treat_all) AS b, avg(third) AS c FROM summary GROUP BY cluster_id), d AS (SELECT b - a AS u, c - a AS v FROM k),
m AS (SELECT avg(u) AS u, avg(v) AS v, var_samp(u) AS uu, var_samp(v) AS vv, covar_samp(u, v) AS uv, count(*) AS n FROM d), s AS (SELECT n, n * (vv * u * u - 2 * uv * u * v + uu * v * v) / (uu * vv - uv * uv) AS q FROM m)
SELECT n AS clusters, round(q, 5) AS statistic, round(exp(-q / 2), 6) AS p FROM s""")
def omnibus_wald(spark, sf):
    k = case_values(spark, sf).groupBy("cluster_id").agg(*(F.avg(c).alias(c) for c in ("base", "treat_all", "third")))
    return r(r(I.omnibus_wald(k, ["base", "treat_all", "third"]), 5, "statistic"), 6, "p")


@query("standardised", f"""WITH {CLUSTERS} SELECT round(avg(effect), 6) AS mean, round(stddev_samp(effect), 6) AS sd, round(avg(effect) / stddev_samp(effect), 6) AS standardised FROM clusters""")
def standardised(spark, sf):
    return r(I.standardised(clusters(spark, sf)), 6, "mean", "sd", "standardised")


@query("mad_scale", f"WITH {CASES} SELECT round(1.4826 * mad(treat_all), 6) AS mad_scale FROM summary")
def mad_scale(spark, sf):
    return r(I.mad_scale(case_values(spark, sf), "treat_all"), 6, "mad_scale")


HOLM_SQL = """, f AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, name) + 1) * p AS raised FROM t)
SELECT family, name, p, round(least(1.0, max(raised) OVER (PARTITION BY family ORDER BY p, name ROWS UNBOUNDED PRECEDING)), 6) AS adjusted FROM f"""


@query("holm", f"""WITH {LONG}, c AS (SELECT model, cluster_id % 3 AS family, cluster_id, avg(value) AS effect FROM long GROUP BY ALL),
w AS (SELECT model AS name, family, avg(effect) / (stddev_samp(effect) / sqrt(count(*))) AS z FROM c GROUP BY ALL), t AS (SELECT family, name, round({_normal_sql('z')}, 6) AS p FROM w){HOLM_SQL}""")
def holm(spark, sf):
    v = long_values(spark, sf).withColumn("family", F.col("cluster_id") % 3)
    each = C.cluster_means(v, "cluster_id", "value", ("model", "family"))
    tests = I.wald(each, by=("model", "family")).select("family", F.col("model").alias("name"), F.round("p", 6).alias("p"))
    return r(I.holm(tests, "name", "p", ("family",)), 6, "adjusted")


@query("scale_robust_gate", f"""WITH {LONG}, sd AS (SELECT model, stddev_samp(value) AS sd FROM long GROUP BY model), c AS (SELECT l.model, l.cluster_id, avg(value / sd) AS s, avg((sign(value) + 1) / 2 - 0.5) AS d FROM long l JOIN sd ON l.model = sd.model GROUP BY ALL),
w AS (SELECT model, avg(s) AS s, avg(s) / (stddev_samp(s) / sqrt(count(*))) AS zs, avg(d) AS d, avg(d) / (stddev_samp(d) / sqrt(count(*))) AS zd FROM c GROUP BY model),
p AS (SELECT model, round(s, 6) AS s, round(d, 6) AS d, round({_normal_sql('zs')}, 6) AS ps, round({_normal_sql('zd')}, 6) AS pd FROM w)
SELECT model, s AS standardised, d AS directional, CASE WHEN s * d > 0 AND ps < 0.05 AND pd < 0.05 THEN 'bounded_scale_robust' WHEN s * d > 0 AND (ps < 0.05 OR pd < 0.05) THEN 'qualitative_scale_robust' ELSE 'fixed_protocol_descriptive' END AS claim FROM p""")
def scale_robust_gate(spark, sf):
    v = long_values(spark, sf)
    scale = v.groupBy("model").agg(F.stddev_samp("value").alias("sd"))
    each = v.join(F.broadcast(scale), "model").groupBy("model", "cluster_id").agg(F.avg(F.col("value") / F.col("sd")).alias("s"), F.avg((F.signum("value") + 1) / 2 - 0.5).alias("d"))
    s = I.wald(each, "s", ("model",)).select("model", F.round("estimate", 6).alias("standardised"), F.round("p", 6).alias("ps"))
    d = I.wald(each, "d", ("model",)).select("model", F.round("estimate", 6).alias("directional"), F.round("p", 6).alias("pd"))
    return s.join(d, "model").select("model", "standardised", "directional", I.gate(F.col("standardised"), F.col("ps"), F.col("directional"), F.col("pd")).alias("claim"))


@query("repeat_spans", """WITH x AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT label, list_max(v) - list_min(v) AS span, len(list_distinct(list_transform(v, lambda a: sign(a)))) = 1 AS steady FROM x)
SELECT label, round(max(span), 6) AS most, round(quantile_cont(span, 0.99), 6) AS p99, round(median(span), 6) AS median, count(*) FILTER (WHERE steady) AS steady, count(*) AS rows FROM s GROUP BY label""")
def repeat_spans(spark, sf):
    e = table(spark, sf, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    s = e.select("label", (F.array_max("v") - F.array_min("v")).alias("span"), (F.size(F.array_distinct(F.transform("v", F.signum))) == 1).alias("steady"))
    found = s.groupBy("label").agg(F.max("span").alias("most"), F.percentile("span", F.lit(0.99)).alias("p99"), F.median("span").alias("median"), F.count_if("steady").alias("steady"), F.count(F.lit(1)).alias("rows"))
    return r(found, 6, "most", "p99", "median")
