"""Nested reports, recomputed releases, condition cubes and label mappings over the bound test tables, with equivalent SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cases as C
from ..operators import cubes as Q
from ..operators import metrics as M
from ..operators import reports as P
from ..sources import releases as L
from ..sources.fixtures import CELLS, cells, table
from ..sources.shared import shared_folder, shuffles_dropped, written
from .effects import CLUSTERS, _normal_sql, r
from .exports import exports
from .procedures import DRAWS, MORE_TIMES, TIMES

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


# nested reports


def _reports(spark, sf: str) -> DataFrame:
    """A JSON report of each customer: its account, and its orders as an array."""
    order = F.struct(F.col("o_orderkey").alias("row_id"), F.col("o_totalprice").alias("total"), (F.col("o_orderstatus") == "F").alias("done"))
    own = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list(order)).alias("rows"))  # the orders of one customer
    rows = F.transform(F.coalesce("rows", F.array()), lambda x: F.struct(F.lower(F.hex(x["row_id"])).alias("row_id"), x["total"].alias("total"), x["done"].alias("done")))
    account = F.struct(F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("market/segment"))
    every = table(spark, sf, "customer").join(own, "c_custkey", "left")
    return every.select(F.col("c_custkey").alias("source"), F.to_json(F.struct(account.alias("account"), rows.alias("rows"))).alias("json"))


NUMBERED = "numbered AS (SELECT o_custkey, lower(to_hex(o_orderkey)) AS row_id, o_totalprice AS total, o_orderstatus = 'F' AS done, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey, o_totalprice) - 1 AS i FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))"


@query("report_leaves", f"""WITH {NUMBERED} SELECT c_custkey AS source, '/account/balance' AS path, 'number' AS kind, c_acctbal AS number, NULL AS text FROM customer UNION ALL SELECT c_custkey, '/account/market~1segment', 'string', NULL, c_mktsegment FROM customer
UNION ALL SELECT c_custkey, '/rows', 'empty', NULL, '[]' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, '/rows/' || i || '/total', 'number', total, NULL FROM numbered
UNION ALL SELECT o_custkey, '/rows/' || i || '/row_id', 'string', NULL, row_id FROM numbered UNION ALL SELECT o_custkey, '/rows/' || i || '/done', 'boolean', NULL, CASE WHEN done THEN 'true' ELSE 'false' END FROM numbered""")
def report_leaves(spark, sf):
    return P.flattened(_reports(spark, sf), "json").withColumn("text", F.when(F.col("kind") != "number", F.col("text")))


@query("nested_ledger", f"""WITH {NUMBERED} SELECT 'account' AS role, c_custkey AS source, 'balance' AS metric, NULL AS place, c_acctbal AS value FROM customer UNION ALL SELECT 'order', o_custkey, 'total', i::VARCHAR, total FROM numbered""")
def nested_ledger(spark, sf):
    leaves = P.flattened(_reports(spark, sf), "json")
    return P.adapted(leaves, {"account": "/account/{metric}", "order": "/rows/{place}/{metric}"})


@query("linked_values", f"""WITH {NUMBERED} SELECT o_custkey AS source, 'rows[row_id=' || row_id || '].total' AS address, CASE WHEN o_orderkey % 7 = 0 THEN total + 1 ELSE total END AS number, NULL AS text, CASE WHEN o_orderkey % 7 = 0 THEN 'differs' ELSE 'ok' END AS status FROM numbered
UNION ALL SELECT c_custkey, '/account/market~1segment', NULL, 'BUILDING', CASE WHEN c_mktsegment = 'BUILDING' THEN 'ok' ELSE 'differs' END FROM customer UNION ALL SELECT c_custkey, '/account/limit', 1.0, NULL, 'missing' FROM customer""")
def linked_values(spark, sf):
    """Shown order totals (a seventh of them changed), segments and a field that no report has, against the reports."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    total = F.when(F.col("o_orderkey") % 7 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    none = F.lit(None).cast("string")
    shown = o.select(F.col("o_custkey").alias("source"), F.concat(F.lit("rows[row_id="), F.lower(F.hex("o_orderkey")), F.lit("].total")).alias("address"), total.alias("number"), none.alias("text"))
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("source"))
    shown = shown.unionByName(c.select("source", F.lit("/account/market~1segment").alias("address"), F.lit(None).cast("double").alias("number"), F.lit("BUILDING").alias("text")))
    shown = shown.unionByName(c.select("source", F.lit("/account/limit").alias("address"), F.lit(1.0).alias("number"), none.alias("text")))
    return P.resolved(shown, P.flattened(_reports(spark, sf), "json"))


# published numbers from a release

NUMBERS_SQL = f"""WITH {CLUSTERS}, acc AS (SELECT gold, avg((base_pred = gold)::INT) AS b, avg((treat_pred = gold)::INT) AS t FROM cells GROUP BY gold)
SELECT '/primary/estimate' AS path, round(avg(effect), 9) AS recomputed, TRUE AS agrees FROM clusters UNION ALL SELECT '/primary/case_weighted', round(sum(effect * cases) / sum(cases), 9), TRUE FROM clusters UNION ALL SELECT '/population/cases', CAST(sum(cases) AS DOUBLE), TRUE FROM clusters
UNION ALL SELECT '/population/pages', CAST(count(*) AS DOUBLE), TRUE FROM clusters UNION ALL SELECT '/balanced_accuracy/base', round(avg(b), 9), TRUE FROM acc UNION ALL SELECT '/balanced_accuracy/treat', round(avg(t), 9), TRUE FROM acc"""


def study_cells(spark, sf: str) -> DataFrame:
    """What a release and its published numbers take of the cells, written once for both."""
    with shuffles_dropped(spark):
        return written(cells(spark, sf).select("case_id", "cluster_id", "control", "cell_index", "gold", "base_score", "treat_score", "base_pred", "treat_pred", "treat_ok"), "cells")


def published_report(spark, sf: str, kept: DataFrame | None = None) -> DataFrame:
    """source and JSON of the study's numbers, computed from cells side by side; ``kept``: the cells, if they are written."""
    c = cells(spark, sf) if kept is None else kept
    at = F.col("cell_index")
    each = c.groupBy("case_id").agg(F.min("cluster_id").alias("cluster_id"), (C.interaction(F.col("treat_score"), at) - C.interaction(F.col("base_score"), at)).alias("d"))
    told = C.balanced_mean(C.cluster_means(each, "cluster_id", "d"))
    accuracy = [M.balanced_accuracy(c, "gold", p, ["A", "N", "R"]).withColumnRenamed("balanced_accuracy", n) for n, p in (("base", "base_pred"), ("treat", "treat_pred"))]
    one = told.crossJoin(F.broadcast(accuracy[0])).crossJoin(F.broadcast(accuracy[1]))  # one row each
    primary = F.struct(F.col("balanced").alias("estimate"), F.col("weighted").alias("case_weighted"))
    population = F.struct(F.col("cases"), F.col("clusters").alias("pages"))
    return one.select(F.lit("study").alias("source"), F.to_json(F.struct(primary.alias("primary"), population.alias("population"), F.struct("base", "treat").alias("balanced_accuracy"))).alias("json"))


RELEASED = "condition string, owner_key string, control string, case_id long, cluster_id long, cell_index int, gold string, prediction string, score double"


def released_cells(spark, sf: str, folder: str, kind: str = "json", kept: DataFrame | None = None) -> DataFrame:
    """The full cells of both conditions, released under ``folder`` with a manifest, verified and read back; ``kept``: the cells, if they are written."""
    full = exports(spark, sf, ("full",), study_cells(spark, sf) if kept is None else kept)
    sources = spark.createDataFrame([], "source string, bytes long, sha256 string")
    with shuffles_dropped(spark):
        records = L.aligned_records(full, 2, L.CELL_FIELDS)
        L.release(records, folder, ["condition", "owner_key"], sources, kind)
    return L.read_release(spark, folder, RELEASED, ["base", "treat"], kind)


@query("recomputed", NUMBERS_SQL)
def recomputed(spark, sf):
    """The published numbers, flattened from their report, against those recomputed from the verified release."""
    kept = study_cells(spark, sf)
    rows = released_cells(spark, sf, f"{shared_folder(spark)}/release-{uuid.uuid4().hex}", "parquet", kept)
    with shuffles_dropped(spark):
        published = P.flattened(published_report(spark, sf, kept), "json").where("kind = 'number'")
    found = P.recomputed(published, P.released_numbers(rows, ("base", "treat"), ["A", "N", "R"]))
    return r(found.select("path", "recomputed", "agrees"), 9, "recomputed")


# nine conditions

SCORES = {
    "a_fp16": "base_score", "a_gptq": "treat_score", "a_awq": "fourth_score", "b_fp16": "base_score + third_score", "b_gptq": "treat_score + third_score * 0.9", "b_awq": "fourth_score + third_score * 0.8",
    "c_fp16": "third_score", "c_gptq": "third_score * 1.1 + base_score * 0.01", "c_awq": "third_score * 0.9 + treat_score * 0.02",
}
CONDITIONS, MODELS = list(SCORES), ["a", "b", "c"]
CONTRASTS = {"gptq": ("gptq", "fp16"), "awq": ("awq", "fp16")}
MODEL_PAIRS = [("a", "b"), ("a", "c"), ("b", "c")]


def _corner(score: str) -> str:
    return "(" + " ".join(f"{s} max(CASE WHEN cell_index = {i} THEN {score} END)" for i, s in enumerate(("", "-", "-", "+"))) + ") / 2"


CUBE_SQL = "nine AS (SELECT case_id, min(cluster_id) AS cluster_id, " + ", ".join(f"{_corner(s)} AS {c}" for c, s in SCORES.items()) + " FROM cells GROUP BY case_id)"


def nine(spark, sf: str, folder: str | None = None) -> DataFrame:
    """The cube of nine conditions, from a release that is written, verified and read."""
    at = F.col("cell_index")
    each = cells(spark, sf).withColumns({c: F.expr(s) for c, s in SCORES.items()}).groupBy("case_id").agg(F.min("cluster_id").alias("cluster_id"), *(C.interaction(F.col(c), at).alias(c) for c in CONDITIONS))
    rows = written(each, "nine").unpivot(["case_id", "cluster_id"], CONDITIONS, "condition", "interaction")
    folder = folder or f"{shared_folder(spark)}/release-{uuid.uuid4().hex}"
    L.release(rows, folder, ["condition", "case_id"], spark.createDataFrame([], "source string, bytes long, sha256 string"), "parquet")
    back = L.read_release(spark, folder, "case_id long, cluster_id long, condition string, interaction double", CONDITIONS, "parquet")
    return written(Q.complete_cube(Q.cube(back, "case_id", "cluster_id", "condition", CONDITIONS, "interaction"), "case_id"), "cube")


@query("nine_conditions", f"WITH {CELLS}, {CUBE_SQL} SELECT case_id, cluster_id AS page, " + ", ".join(f"round({c}, 12) AS {c}" for c in CONDITIONS) + " FROM nine")
def nine_conditions(spark, sf):
    found = nine(spark, sf)
    return found.select("case_id", "page", *(F.round(F.col("values")[i], 12).alias(c) for i, c in enumerate(CONDITIONS)))


def _stats_sql() -> str:
    out = ["count(*) AS n"]
    for m in MODELS:
        for c, (a, b) in CONTRASTS.items():
            d, up = f"({m}_{a} - {m}_{b})", f"((sign({m}_{a} - {m}_{b}) + 1) / 2 - 0.5)"
            out += [f"sum({m}_{b}) AS rs_{m}_{c}", f"sum({m}_{b} * {m}_{b}) AS rq_{m}_{c}", f"sum({d}) AS ds_{m}_{c}", f"avg({d}) AS dm_{m}_{c}", f"sum({up}) AS us_{m}_{c}", f"avg({up}) AS um_{m}_{c}"]
    return ", ".join(out)


SUMS = [f"{k}_{m}_{c}" for m in MODELS for c in CONTRASTS for k in ("rs", "rq", "ds", "dm", "us", "um")]
SDS = {f"{m}_{c}": f"round((rq_{m}_{c} - rs_{m}_{c} * rs_{m}_{c} / n) / (n - 1), 12)" for m in MODELS for c in CONTRASTS}
WEIGHTINGS = {"page_balanced": ("dm", "um", "k"), "case_weighted": ("ds", "us", "n")}
ENDPOINTS_SQL = " UNION ALL ".join(
    f"SELECT draw, '{w}' AS weighting, '{a}-{b}' AS pair, '{c}' AS contrast, '{e}' AS endpoint, {x} AS value FROM scaled"
    for w, (delta, up, over) in WEIGHTINGS.items() for a, b in MODEL_PAIRS for c in CONTRASTS
    for e, x in (("standardised", f"{delta}_{a}_{c} / {over} / sd_{a}_{c} - {delta}_{b}_{c} / {over} / sd_{b}_{c}"), ("directional", f"{up}_{a}_{c} / {over} - {up}_{b}_{c} / {over}"))
)
SCALE_SQL = f"""WITH {MORE_TIMES}, {CUBE_SQL}, stats AS MATERIALIZED (SELECT cluster_id, {_stats_sql()} FROM nine GROUP BY cluster_id),
every AS (SELECT draw, cluster_id, times FROM times UNION ALL SELECT -1, cluster_id, 1 FROM stats),
sums AS (SELECT draw, sum(times) AS k, sum(times * n) AS n, {", ".join(f"sum(times * {s}) AS {s}" for s in SUMS)} FROM every JOIN stats USING (cluster_id) GROUP BY draw),
good AS (SELECT *, {", ".join(f"sqrt({v}) AS sd_{k}" for k, v in SDS.items())} FROM (SELECT * FROM sums WHERE n > 1 AND {" AND ".join(f"{v} > 0" for v in SDS.values())})),
scaled AS MATERIALIZED (SELECT * FROM good ORDER BY draw LIMIT {DRAWS + 1}), ends AS ({ENDPOINTS_SQL}),
e AS (SELECT weighting, pair, contrast, endpoint, max(value) FILTER (WHERE draw < 0) AS estimate, quantile_cont(value, 0.025) FILTER (WHERE draw >= 0) AS lower, quantile_cont(value, 0.975) FILTER (WHERE draw >= 0) AS upper, stddev_samp(value) FILTER (WHERE draw >= 0) AS se FROM ends GROUP BY ALL),
t AS (SELECT *, {_normal_sql("estimate / se")} AS p, pair || '.' || contrast || '.' || endpoint AS name FROM e),
h AS (SELECT *, (count(*) OVER (PARTITION BY weighting) - row_number() OVER (PARTITION BY weighting ORDER BY p, name) + 1) * p AS raised FROM t),
a AS (SELECT *, least(1.0, max(raised) OVER (PARTITION BY weighting ORDER BY p, name ROWS UNBOUNDED PRECEDING)) AS adjusted FROM h),
s AS (SELECT *, max(estimate) FILTER (WHERE endpoint = 'standardised') OVER g * max(estimate) FILTER (WHERE endpoint = 'directional') OVER g > 0 AS agree, count(*) FILTER (WHERE adjusted < 0.05) OVER g AS below FROM a WINDOW g AS (PARTITION BY weighting, pair, contrast))
SELECT weighting, pair, contrast, endpoint, round(estimate, 9) AS estimate, round(lower, 9) AS lower, round(upper, 9) AS upper, round(se, 9) AS se, round(p, 9) AS p, round(adjusted, 9) AS adjusted,
  CASE WHEN agree AND below = 2 THEN 'bounded_scale_robust' WHEN agree AND below = 1 THEN 'qualitative_scale_robust' ELSE 'fixed_protocol_descriptive' END AS claim FROM s"""


@query("three_model_scale", SCALE_SQL)
def three_model_scale(spark, sf, draws=DRAWS):
    found = Q.scale_report(nine(spark, sf), CONDITIONS, MODELS, CONTRASTS, MODEL_PAIRS, draws)
    numbers = ("estimate", "lower", "upper", "se", "p", "adjusted")
    return r(found.select("weighting", "pair", "contrast", "endpoint", *numbers, "claim"), 9, *numbers)


# label mappings

LABELS = ["SUPPORTS", "REFUTES", "NOT ENOUGH INFO"]
MAPPINGS = [(v, c, LABELS[(i + k) % 3]) for k, v in enumerate(("original", "cycle_1", "cycle_2")) for i, c in enumerate("ABC")]
RUNS = {"high": 0, "q4": 1, "gptq": 2, "awq": 3}
ROUTES = {"q4": ("high", "q4"), "gptq": ("high", "gptq"), "awq": ("high", "awq")}
#: The log-probabilities of a run k under variant number v.
CHOICES = {"A": "base_score + 0.01 * k * third_score", "B": "treat_score * (1 - 0.01 * v) + 0.02 * k", "C": "third_score + 0.001 * k * v * base_score"}


def _margin_sql() -> str:
    at = lambda label: "CASE " + " ".join(f"WHEN v = {k} THEN {'ABC'[(LABELS.index(label) - k) % 3]}" for k in range(3)) + " END"
    return f"({at('SUPPORTS')}) - CASE WHEN control = 'O' THEN ({at('REFUTES')}) ELSE ({at('NOT ENOUGH INFO')}) END"


MAPPED = f"""mapped AS (SELECT v, k, case_id, min(cluster_id) AS cluster_id, {_corner("m")} AS x FROM (SELECT *, {_margin_sql()} AS m FROM (SELECT v, k, case_id, cluster_id, cell_index, control, {", ".join(f"{e} AS {c}" for c, e in CHOICES.items())} FROM cells, range(3) a(v), range(4) b(k))) GROUP BY v, k, case_id)"""


def mapped_cube(spark, sf: str) -> DataFrame:
    """(variant, case_id, page, values) of four runs under three mappings, each cell scored by its own mapping."""
    number = lambda names, n: F.explode(F.array(*(F.struct(F.lit(x).alias(n), F.lit(i).alias(n[0])) for x, i in names)))
    c = cells(spark, sf).withColumn("run", number([(n, k) for n, k in RUNS.items()], "k_run")).withColumn("variant", number([(v, i) for i, v in enumerate(("original", "cycle_1", "cycle_2"))], "v_variant"))
    c = c.select("case_id", "cluster_id", "cell_index", F.when(F.col("control") == "O", "REFUTES").otherwise("NOT ENOUGH INFO").alias("negative_label"), F.col("run.k_run").alias("condition"), F.col("run.k").alias("k"), F.col("variant.v_variant").alias("variant"), F.col("variant.v").alias("v"), "base_score", "treat_score", "third_score")
    c = c.withColumn("scores", F.create_map(*(x for name, e in CHOICES.items() for x in (F.lit(name), F.expr(e)))))
    mappings = spark.createDataFrame(MAPPINGS, "variant string, choice string, label string")
    each = Q.mapped_interactions(Q.rescored(c, mappings, LABELS), ["variant", "condition", "case_id"], "cluster_id")
    return written(Q.complete_cube(Q.cube(each, ("variant", "case_id"), "page", "condition", list(RUNS), "interaction"), ("variant", "case_id")), "mapped-cube")


@query("mapping_routes", f"""WITH {TIMES}, {MAPPED}, p AS (SELECT r.route, a.cluster_id, avg(b.x - a.x) FILTER (WHERE a.v = 0) AS f, avg(b.x - a.x) FILTER (WHERE a.v = 1) AS s FROM mapped a JOIN mapped b ON a.v = b.v AND a.case_id = b.case_id AND a.k = 0 JOIN (VALUES ('q4', 1), ('gptq', 2), ('awq', 3)) r(route, k) ON b.k = r.k GROUP BY r.route, a.cluster_id),
w AS (SELECT route, avg(f) AS f, avg(s) AS s, avg(s - f) AS d, stddev_samp(s - f) / sqrt(count(*)) AS se FROM p GROUP BY route), t AS (SELECT *, CASE WHEN se > 0 THEN {_normal_sql("d / se")} WHEN d = 0 THEN 1.0 ELSE 0.0 END AS pv FROM w),
h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY pv, route) + 1) * pv AS raised FROM t), m AS (SELECT draw, route, sum(times * (s - f)) / sum(times) AS mean FROM times JOIN p USING (cluster_id) GROUP BY ALL),
i AS (SELECT route, quantile_cont(mean, 0.025) AS lower, quantile_cont(mean, 0.975) AS upper FROM m GROUP BY route)
SELECT route, round(f, 9) AS first, round(s, 9) AS second, round(d, 9) AS difference, round(se, 9) AS se, round(pv, 9) AS p, round(least(1.0, max(raised) OVER (ORDER BY pv, route ROWS UNBOUNDED PRECEDING)), 9) AS adjusted, round(lower, 9) AS lower, round(upper, 9) AS upper, sign(f) = sign(s) AS direction_stable FROM h JOIN i USING (route)""")
def mapping_routes(spark, sf, draws=DRAWS):
    found = Q.mapping_report(mapped_cube(spark, sf), list(RUNS), ROUTES, ("original", "cycle_1"), draws)
    return r(found, 9, "first", "second", "difference", "se", "p", "adjusted", "lower", "upper")


@query("mapped_interactions", f"""WITH {CELLS}, {MAPPED} SELECT CASE v WHEN 0 THEN 'original' WHEN 1 THEN 'cycle_1' ELSE 'cycle_2' END AS variant, case_id, min(cluster_id) AS page, """ + ", ".join(f"round(max(CASE WHEN k = {k} THEN x END), 12) AS {n}" for n, k in RUNS.items()) + " FROM mapped GROUP BY v, case_id")
def mapped_interactions(spark, sf):
    return mapped_cube(spark, sf).select("variant", "case_id", "page", *(F.round(F.col("values")[k], 12).alias(n) for n, k in RUNS.items()))
