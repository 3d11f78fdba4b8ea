"""Reports, gates and ledgers of a study over the bound test tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cases as C
from ..operators import inference as I
from ..operators import resampling as R
from ..operators import studies as D
from ..sources.fixtures import CONTEXT, cells, context, table
from .effects import CASES, LONG, _normal_sql, case_values, clusters, long_values, r
from ..sources.shared import written
from .procedures import DRAWS, MORE_TIMES, TIMES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


SIGN_P = "least(1.0, 2 * list_sum(list_transform(range(0, least(neg, pos) + 1), lambda i: exp(lgamma(neg + pos + 1) - lgamma(i + 1) - lgamma(neg + pos - i + 1) - (neg + pos) * ln(2)))))"


def _report_sql(values: str, primary: list[str]) -> str:
    """values: a SELECT of (contrast, cluster_id, value)."""
    names = ", ".join(f"'{p}'" for p in primary)
    return f"""WITH {CASES}, v AS ({values}), p AS (SELECT contrast, cluster_id, avg(value) AS e FROM v WHERE value IS NOT NULL GROUP BY ALL),
w AS (SELECT contrast, avg(e) AS estimate, stddev_samp(e) / sqrt(count(*)) AS se, count(*) AS clusters, median(e) AS med, count(*) FILTER (WHERE e < 0) AS neg, count(*) FILTER (WHERE e > 0) AS pos, CASE WHEN contrast IN ({names}) THEN 'primary' ELSE 'secondary' END AS family FROM p GROUP BY contrast),
t AS (SELECT *, {_normal_sql('estimate / se')} AS pv FROM w), h AS (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY pv, contrast) + 1) * pv AS raised FROM t)
SELECT contrast, family, round(estimate, 6) AS estimate, round(se, 6) AS se, clusters, round(pv, 6) AS p, round(least(1.0, max(raised) OVER (PARTITION BY family ORDER BY pv, contrast ROWS UNBOUNDED PRECEDING)), 6) AS adjusted, round(med, 6) AS median, round({SIGN_P}, 6) AS sign_p FROM h"""


def _report(spark, sf, contrasts, primary):
    values = D.linear_contrasts(case_values(spark, sf), "case_id", "cluster_id", contrasts)
    return r(D.contrast_report(values, "cluster_id", primary), 6, "estimate", "se", "p", "adjusted", "median", "sign_p").select("contrast", "family", "estimate", "se", "clusters", "p", "adjusted", "median", "sign_p")


def _values_sql(contrasts: dict[str, dict[str, float]]) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS contrast, cluster_id, {' + '.join(f'({w}) * {c}' for c, w in x.items())} AS value FROM summary" for n, x in contrasts.items())


TRIPLET = {"second-first": {"treat_all": 1, "base": -1}, "third-second": {"third": 1, "treat_all": -1}, "third-first": {"third": 1, "base": -1}}
INTERACTION = {"difference-in-difference": {"fourth": 1, "third": -1, "treat_all": -1, "base": 1}, "left": {"treat_all": 1, "base": -1}, "right": {"fourth": 1, "third": -1}, "routes-old": {"third": 1, "base": -1}, "routes-new": {"fourth": 1, "treat_all": -1}}
FAMILY = {f"{a}-{b}": {a: 1, b: -1} for i, a in enumerate(("base", "treat_all", "third", "fourth")) for b in ("base", "treat_all", "third", "fourth")[i + 1 :]}


@query("triplet_report", _report_sql(_values_sql(TRIPLET), ["second-first", "third-second"]))
def triplet_report(spark, sf):
    return _report(spark, sf, TRIPLET, ["second-first", "third-second"])


@query("interaction_report", _report_sql(_values_sql(INTERACTION), ["difference-in-difference"]))
def interaction_report(spark, sf):
    return _report(spark, sf, INTERACTION, ["difference-in-difference"])


@query("family_report", _report_sql(_values_sql(FAMILY), []))
def family_report(spark, sf):
    return _report(spark, sf, FAMILY, [])


STUDY = {"effect": {"treat_all": 1, "base": -1}, "level": {"base": 1}}


@query("pair_report", _report_sql(_values_sql(STUDY), ["effect"]))
def pair_report(spark, sf):
    return _report(spark, sf, STUDY, ["effect"])


def _first(rows: str) -> str:
    """The first DRAWS valid draws of a SELECT that may have more."""
    return f"SELECT * FROM ({rows}) ORDER BY draw LIMIT {DRAWS}"


@query("scale_bootstrap", f"""WITH {MORE_TIMES}, s AS (SELECT cluster_id, count(*) AS n, sum(treat_all - base) AS ds, avg(treat_all - base) AS dm, sum((sign(treat_all - base) + 1) / 2 - 0.5) AS us, avg((sign(treat_all - base) + 1) / 2 - 0.5) AS um, sum(base) AS rs, sum(base * base) AS rq FROM summary GROUP BY cluster_id),
e AS (SELECT draw, sum(times) AS k, sum(times * n) AS n, sum(times * ds) AS ds, sum(times * dm) AS dm, sum(times * us) AS us, sum(times * um) AS um, sum(times * rs) AS rs, sum(times * rq) AS rq FROM times JOIN s USING (cluster_id) GROUP BY draw),
v AS ({_first("SELECT *, sqrt(greatest(0, round((rq - rs * rs / n) / (n - 1), 12))) AS sd FROM e WHERE n > 1 AND round((rq - rs * rs / n) / (n - 1), 12) > 0")}), x AS (SELECT 'balanced' AS weighting, dm / k / sd AS s, um / k AS d FROM v UNION ALL SELECT 'cases', ds / n / sd, us / n FROM v)
SELECT weighting, round(quantile_cont(s, 0.025), 6) AS standardised_lower, round(quantile_cont(s, 0.975), 6) AS standardised_upper, round(stddev_samp(s), 6) AS standardised_error, round(quantile_cont(d, 0.025), 6) AS directional_lower, round(quantile_cont(d, 0.975), 6) AS directional_upper, round(stddev_samp(d), 6) AS directional_error, count(*) AS valid_draws FROM x GROUP BY weighting""")
def scale_bootstrap(spark, sf, draws=DRAWS):
    v = case_values(spark, sf).withColumn("effect", F.col("treat_all") - F.col("base"))
    found = D.scale_bootstrap(written(D.page_sums(v, "cluster_id", "effect", "base"), "page-sums"), "cluster_id", draws)
    return r(found, 6, *(c for c in found.columns if c.startswith(("standardised", "directional"))))


JOINT_EFFECTS = {"effect": {"treat": 1, "base": -1}, "other": {"fourth": 1, "third": -1}, "heterogeneity": {"treat": 1, "base": -1, "fourth": -1, "third": 1}}
#: Two further predictions of a cell, by thresholds on its other scores.
THIRD, FOURTH = "CASE WHEN third_score < 0.4 THEN gold WHEN third_score < 0.7 THEN 'R' ELSE 'A' END", "CASE WHEN fourth_score < 4 THEN gold ELSE 'N' END"


@query("joint_bootstrap", f"""WITH {MORE_TIMES}, four AS (SELECT cluster_id, gold, base_pred AS base, treat_pred AS treat, {THIRD} AS third, {FOURTH} AS fourth FROM cells),
n AS (SELECT cluster_id, gold, count(*) AS n, {", ".join(f"count(*) FILTER (WHERE {c} = gold) AS {c}" for c in ("base", "treat", "third", "fourth"))} FROM four GROUP BY ALL),
d AS (SELECT draw, gold, sum(times * n)::DOUBLE AS n, {", ".join(f"sum(times * {c})::DOUBLE AS {c}" for c in ("base", "treat", "third", "fourth"))} FROM times JOIN n USING (cluster_id) GROUP BY ALL),
e AS ({_first("SELECT draw, " + ", ".join(f"sum({c}) / sum(n) AS {c}_a, avg({c} / n) AS {c}_b" for c in ("base", "treat", "third", "fourth")) + " FROM d GROUP BY draw HAVING count(*) = 3")}),
x AS ({" UNION ALL ".join(f"SELECT '{c}' AS condition, '{m}' AS metric, {' + '.join(f'{k}_{m[0]} * {w}' for k, w in weights.items())} AS v FROM e" for c, weights in ({k: {k: 1} for k in ("base", "treat", "third", "fourth")} | JOINT_EFFECTS).items() for m in ("accuracy", "balanced"))})
SELECT condition, metric, round(quantile_cont(v, 0.025), 6) AS lower, round(quantile_cont(v, 0.975), 6) AS upper, count(*) AS valid_draws FROM x GROUP BY ALL""")
def joint_bootstrap(spark, sf, draws=DRAWS):
    c = cells(spark, sf).withColumns({"third_pred": F.expr(THIRD), "fourth_pred": F.expr(FOURTH)})
    return r(D.joint_bootstrap(c, "cluster_id", "gold", {"base": "base_pred", "treat": "treat_pred", "third": "third_pred", "fourth": "fourth_pred"}, 3, draws, JOINT_EFFECTS), 6, "lower", "upper")


@query("accuracy_interval", f"""WITH {TIMES}, a AS (SELECT cluster_id, avg(acc) AS e FROM (SELECT case_id, min(cluster_id) AS cluster_id, avg((treat_pred = gold)::INT) AS acc FROM cells GROUP BY case_id) GROUP BY cluster_id),
m AS (SELECT draw, sum(times * e) / sum(times) AS mean FROM times JOIN a USING (cluster_id) GROUP BY draw)
SELECT round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper, count(*) AS valid_draws, round(quantile_cont(mean, 0.025), 6) > 0.5 AS passes FROM m""")
def accuracy_interval(spark, sf):
    each = cells(spark, sf).groupBy("case_id").agg(F.min("cluster_id").alias("cluster_id"), F.avg((F.col("treat_pred") == F.col("gold")).cast("int")).alias("a"))
    pages = written(C.cluster_means(each, "cluster_id", "a"), "pages")  # a row for each cluster there is: the names come from it, too
    times = R.multiplicities(pages, "cluster_id", DRAWS)
    return D.threshold_gate(r(R.bootstrap_interval(pages, "cluster_id", times), 6, "lower", "upper"), "lower", 0.5)


@query("run_summary", """WITH runs AS (SELECT label, vec_id, i AS repeat, CAST(embedding[i] AS DOUBLE) AS score, CASE WHEN embedding[i] > 0 THEN 'A' ELSE 'B' END AS choice FROM embeddings, range(1, 65) t(i)),
e AS (SELECT label, vec_id, max(score) - min(score) AS span, min(choice) <> max(choice) AS flips, count(DISTINCT repeat) AS repeats FROM runs GROUP BY ALL)
SELECT label, count(*) AS units, round(max(span), 6) AS largest_span, round(avg(span), 6) AS mean_span, count(*) FILTER (WHERE flips) AS flips, min(repeats) AS repeats FROM e GROUP BY label""")
def run_summary(spark, sf):
    runs = table(spark, sf, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("repeat", "x")).select("label", "vec_id", "repeat", F.col("x").cast("double").alias("score"), F.when(F.col("x") > 0, "A").otherwise("B").alias("choice"))
    return r(D.run_summary(runs, ["label"], "vec_id", "repeat", "score", "choice"), 6, "largest_span", "mean_span")


@query("both_signs", f"""WITH {CASES} SELECT stratum, bool_or(treat_all - base > 0) AND bool_or(treat_all - base < 0) AND NOT bool_or(treat_all = base) AS both_signs FROM summary GROUP BY stratum""")
def both_signs(spark, sf):
    return D.both_signs(case_values(spark, sf).withColumn("d", F.col("treat_all") - F.col("base")), "d", ("stratum",))


@query("table_counts", """WITH t AS (SELECT source, count(*) AS n, count(DISTINCT lang) AS labels FROM documents GROUP BY source) SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) AS tables, max(n) AS largest, max(labels) AS labels FROM t""")
def table_counts(spark, sf):
    t = table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang").alias("labels"))
    return t.agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("tables"), F.max("n").alias("largest"), F.max("labels").alias("labels"))


@query("context_hits", f"""WITH {CONTEXT}, q AS (SELECT kind, query_id, avg(hit_treat::INT - hit_base::INT) AS e, count(*) AS n FROM context GROUP BY ALL)
SELECT kind, round(avg(e), 9) AS effect, count(*) AS queries, CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (WHERE e > 0) AS up, count(*) FILTER (WHERE e < 0) AS down FROM q WHERE kind <> 'irrelevant' GROUP BY kind
UNION ALL SELECT kind, round(avg(hit_treat::INT - hit_base::INT), 9), NULL, count(*), NULL, NULL FROM context WHERE kind = 'irrelevant' GROUP BY kind""")
def context_hits(spark, sf):
    c = context(spark, sf).withColumn("d", F.col("hit_treat").cast("int") - F.col("hit_base").cast("int"))
    each = c.where("kind <> 'irrelevant'").groupBy("kind", "query_id").agg(F.avg("d").alias("e"), F.count(F.lit(1)).alias("n"))
    told = each.groupBy("kind").agg(F.avg("e").alias("effect"), F.count(F.lit(1)).alias("queries"), F.sum("n").alias("rows"), F.count_if(F.col("e") > 0).alias("up"), F.count_if(F.col("e") < 0).alias("down"))
    none = lambda n: F.lit(None).cast("long").alias(n)
    plain = c.where("kind = 'irrelevant'").groupBy("kind").agg(F.avg("d").alias("effect"), F.count(F.lit(1)).alias("rows")).select("kind", "effect", none("queries"), "rows", none("up"), none("down"))
    return r(told.unionByName(plain), 9, "effect")


@query("identity_gate", """SELECT 'one_parity' AS "check", FALSE AS holds UNION ALL SELECT 'one_prompt', TRUE UNION ALL SELECT 'expected_' || coalesce(a, b), a IS NOT NULL AND b IS NOT NULL FROM (SELECT DISTINCT event_type AS a FROM events) FULL JOIN (VALUES ('view'), ('click'), ('none')) v(b) ON a = b""")
def identity_gate(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("condition"), (F.col("event_id") % 2).alias("parity"), F.lit("p").alias("prompt"))
    return D.identity_gate(e, ["parity", "prompt"], spark.createDataFrame([("view",), ("click",), ("none",)], "condition string"))


@query("population_subsets", """WITH a AS (SELECT doc_id FROM documents), b AS (SELECT doc_id FROM labels), c AS (SELECT doc_id FROM labels WHERE toxic = 0 UNION ALL SELECT -1)
SELECT 'all' AS population, (SELECT count(DISTINCT doc_id) FROM a) AS size, CAST(0 AS BIGINT) AS gone, TRUE AS subset UNION ALL SELECT 'labelled', (SELECT count(DISTINCT doc_id) FROM b), (SELECT count(DISTINCT doc_id) FROM a WHERE doc_id NOT IN (SELECT doc_id FROM b)), (SELECT count(*) = 0 FROM b WHERE doc_id NOT IN (SELECT doc_id FROM a))
UNION ALL SELECT 'clean', (SELECT count(DISTINCT doc_id) FROM c), (SELECT count(DISTINCT doc_id) FROM b WHERE doc_id NOT IN (SELECT doc_id FROM c)), (SELECT count(*) = 0 FROM c WHERE doc_id NOT IN (SELECT doc_id FROM b))""")
def population_subsets(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "toxic")
    clean = labels.where("toxic = 0").select("doc_id").union(spark.createDataFrame([(-1,)], "doc_id long"))
    return D.flow({"all": table(spark, sf, "documents"), "labelled": labels, "clean": clean}, "doc_id")


@query("checked_union", """WITH u AS (SELECT 'n' || n_nationkey AS row_id, n_name AS name FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region UNION ALL SELECT 'n3', 'again') SELECT row_id, name, count(*) OVER (PARTITION BY row_id) > 1 AS repeated FROM u""")
def checked_union(spark, sf):
    one = lambda t, k, n, p: table(spark, sf, t).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("row_id"), F.col(n).alias("name"))
    return D.union_checked([one("nation", "n_nationkey", "n_name", "n"), one("region", "r_regionkey", "r_name", "r"), spark.createDataFrame([("n3", "again")], "row_id string, name string")], "row_id")


@query("resorted_selection", """WITH t AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('7|pick|' || doc_id), doc_id) AS n FROM documents)
SELECT doc_id, lang, row_number() OVER (ORDER BY sha256('7|final|' || doc_id), doc_id) AS place FROM t WHERE n <= 25""")
def resorted_selection(spark, sf):
    from pyspark.sql.window import Window

    first = Window.partitionBy("lang").orderBy(S.stable_rank(7, "pick", F.col("doc_id")), "doc_id")
    top = table(spark, sf, "documents").select("doc_id", "lang", F.row_number().over(first).alias("n")).where("n <= 25")
    return top.select("doc_id", "lang", F.row_number().over(Window.orderBy(S.stable_rank(7, "final", F.col("doc_id")), "doc_id")).cast("long").alias("place"))  # 25 rows of a language at most


LEDGER = LONG + """, g AS (SELECT model, cluster_id, avg(value) AS e FROM long GROUP BY ALL), w AS (SELECT model, avg(e) AS estimate, stddev_samp(e) / sqrt(count(*)) AS se, count(*)::DOUBLE AS clusters FROM g GROUP BY model),
ledger AS (SELECT 'means' AS source, model, 'estimate' AS metric, estimate AS value FROM w UNION ALL SELECT 'means', model, 'se', se FROM w UNION ALL SELECT 'sizes', model, 'clusters', clusters FROM w)"""


def _ledger(spark, sf):
    pages = C.cluster_means(long_values(spark, sf), "cluster_id", "value", ("model",))
    told = I.wald(pages, by=("model",))
    return D.adapted(told, "means", ["estimate", "se"], ["model"]).unionByName(D.adapted(told, "sizes", ["clusters"], ["model"]))


@query("report_ledger", f"""WITH {LEDGER} SELECT source, model, metric, round(value, 6) AS value FROM ledger""")
def report_ledger(spark, sf):
    return r(D.finite(_ledger(spark, sf), ["value"]), 6, "value")


@query("evidence_groups", f"""WITH {LEDGER}, x AS (SELECT 'scores' AS grp, source FROM ledger WHERE metric IN ('estimate', 'se') UNION ALL SELECT 'base', source FROM ledger WHERE model = 'base') SELECT grp AS "group", count(*) AS rows, count(DISTINCT source) AS sources, count(*) >= 4 AS enough FROM x GROUP BY grp""")
def evidence_groups(spark, sf):
    return D.evidence_groups(_ledger(spark, sf), {"scores": F.col("metric").isin("estimate", "se"), "base": F.col("model") == "base"}, 4)


@query("table_cells", f"""WITH {LEDGER} SELECT model AS table_row, metric AS table_column, printf('%.3f', value) AS rendered, sha256(source || '|' || model || '|' || metric) AS row_id FROM ledger WHERE metric <> 'clusters'""")
def table_cells(spark, sf):
    return D.table_cells(_ledger(spark, sf).where("metric <> 'clusters'"), "model", "metric", "value", 3)


@query("claim_guards", f"""WITH {LONG}, g AS (SELECT model, cluster_id, avg(value) AS e FROM long GROUP BY ALL), w AS (SELECT model, avg(e) AS estimate, stddev_samp(e) / sqrt(count(*)) AS se FROM g GROUP BY model), t AS (SELECT model, estimate, round({_normal_sql('estimate / se')}, 6) AS p FROM w),
h AS (SELECT model, estimate, (count(*) OVER () - row_number() OVER (ORDER BY p, model) + 1) * p AS raised, p FROM t), a AS (SELECT model, estimate, least(1.0, max(raised) OVER (ORDER BY p, model ROWS UNBOUNDED PRECEDING)) AS adjusted FROM h)
SELECT c.model, coalesce(sign(estimate) = c.s AND (adjusted < 0.05) = c.f, FALSE) AS holds FROM (VALUES ('base', 1, FALSE), ('treat', -1, FALSE), ('third', 1, TRUE), ('absent', 1, TRUE)) c(model, s, f) LEFT JOIN a USING (model)""")
def claim_guards(spark, sf):
    pages = C.cluster_means(long_values(spark, sf), "cluster_id", "value", ("model",))
    told = I.holm(I.wald(pages, by=("model",)).withColumn("p", F.round("p", 6)), "model", "p").select("model", "estimate", "adjusted")
    claims = spark.createDataFrame([("base", 1, False), ("treat", -1, False), ("third", 1, True), ("absent", 1, True)], "model string, sign int, significant boolean")
    return D.claim_guard(told, claims, ["model"])
