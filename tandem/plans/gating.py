"""Gates of exports, layered effects, disjoint sets and overlaps over the bound test tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import audit as A
from ..operators import gates as G
from ..operators import selection as W
from ..sources.fixtures import CELLS, case_ids, table
from .effects import CASES, case_values, r
from .exports import EXPORTS, exports
from .procedures import _rank

#: Orders of a part at most, on average, where their cells are made in place.
DEALT = 1 << 15

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


# gates

ASKED = """asked AS (SELECT *, md5('prompt ' || owner_key) AS prompt, CASE WHEN condition = 'treat' AND case_id % 50 = 0 THEN 'x' ELSE md5('tokens ' || owner_key) END AS tokens, score AS hard_score, CASE WHEN condition = 'base' AND case_id % 70 = 0 THEN score + 1 ELSE score END AS probability_score, CASE WHEN probability_ok THEN 'ok' ELSE 'failed' END AS status
  FROM exports WHERE NOT (condition = 'base' AND case_id % 90 = 0))"""


def _asked(spark, sf):
    """Both exports with what was asked and scored in each stage; some tokens, scores, stages and owners are wrong on purpose."""
    e = exports(spark, sf).where("NOT (condition = 'base' AND case_id % 90 = 0)")
    tokens = F.expr("CASE WHEN condition = 'treat' AND case_id % 50 = 0 THEN 'x' ELSE md5(concat('tokens ', owner_key)) END")
    payload = lambda score: F.struct(F.expr("md5(concat('prompt ', owner_key))").alias("prompt"), tokens.alias("tokens"), score.alias("scores"))
    second = F.expr("CASE WHEN condition = 'base' AND case_id % 70 = 0 THEN score + 1 ELSE score END")
    return e.select("condition", "owner_key", "control", "case_id", "cell_index", "gold", F.lit("ok").alias("hard_status"), payload(F.col("score")).alias("hard_payload"), F.when(F.col("probability_ok"), "ok").otherwise("failed").alias("probability_status"), payload(second).alias("probability_payload"))


CONTROLS = {"full": 400, "no_evidence": 200, "knowledge_only": 200}


@query("full_pair_gate", f"""WITH {EXPORTS}, {ASKED}, j AS (SELECT l.owner_key IS NOT NULL AND r.owner_key IS NOT NULL AS there, l.control AS control, l.gold IS DISTINCT FROM r.gold AS gold, l.tokens <> r.tokens AS tokens, l.status <> 'ok' OR r.status <> 'ok' AS failed, l.hard_score IS DISTINCT FROM l.probability_score OR r.hard_score IS DISTINCT FROM r.probability_score AS scores
  FROM (SELECT * FROM asked WHERE condition = 'base') l FULL JOIN (SELECT * FROM asked WHERE condition = 'treat') r ON l.owner_key = r.owner_key),
c AS (SELECT count(*) FILTER (WHERE NOT there) AS owner_set, 0 AS owner_once, 0 AS same_control, count(*) FILTER (WHERE there AND gold) AS same_gold, 0 AS known_control, 0 AS hard_complete, 0 AS hard_prompt, count(*) FILTER (WHERE there AND tokens) AS hard_tokens, count(*) FILTER (WHERE there AND failed) AS probability_complete, 0 AS probability_prompt, count(*) FILTER (WHERE there AND tokens) AS probability_tokens, count(*) FILTER (WHERE there AND scores) AS one_pass,
  {", ".join(f"abs(count(*) FILTER (WHERE there AND control = '{c}') - {n}) AS rows_of_{c}" for c, n in CONTROLS.items())} FROM j)
SELECT name AS "check", value::BIGINT AS broken FROM (UNPIVOT (SELECT columns(*)::BIGINT FROM c) ON COLUMNS(*))""")
def full_pair_gate(spark, sf):
    e = _asked(spark, sf)
    return G.full_pair_gate(e.where("condition = 'base'"), e.where("condition = 'treat'"), ["gold"], ["prompt", "tokens"], CONTROLS)


@query("cell_gate", f"""WITH {CELLS}, v AS (SELECT * FROM (VALUES ('original', 0), ('reversed', 1)) v(variant, k)), k AS (SELECT * FROM (VALUES ('high', 0), ('q4', 1), ('gptq', 2)) c(condition, j)),
rows AS (SELECT condition, variant, case_id || ':' || cell_index AS owner_key, j, k, case_id FROM cells, v, k WHERE NOT (j = 1 AND k = 1 AND case_id % 9 = 0) AND NOT (j = 2 AND k = 1))
SELECT condition, variant, count(r.owner_key) AS owners, count(*) - count(r.owner_key) AS missing, 0::BIGINT AS extra, 0::BIGINT AS repeated, count(*) FILTER (WHERE r.j = 0 AND r.k = 1 AND r.case_id % 8 = 0) AS failed, count(*) FILTER (WHERE r.j = 2 AND r.case_id % 10 = 0) AS other_prompts, TRUE AS in_design,
  count(r.owner_key) > 0 AND count(*) = count(r.owner_key) AND count(*) FILTER (WHERE r.j = 0 AND r.k = 1 AND r.case_id % 8 = 0) = 0 AND count(*) FILTER (WHERE r.j = 2 AND r.case_id % 10 = 0) = 0 AS passes
FROM (SELECT condition, variant, case_id || ':' || cell_index AS owner_key FROM cells, v, k) d LEFT JOIN rows r USING (condition, variant, owner_key) GROUP BY condition, variant""")
def cell_gate(spark, sf):
    """Six cells of three conditions and two variants; one is absent, and rows of others lack, failed or were asked otherwise."""
    # cases are dealt once, so many to a part that what is made of them fits a task; their cells, units and rows stay there
    parts = max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "orders").count() // DEALT))
    parts += parts == int(spark.conf.get("spark.sql.shuffle.partitions"))  # else the shuffle before is taken for it, and its parts are merged by their few bytes
    c = case_ids(spark, sf).repartition(parts, "case_id").select("case_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("cell_index"))
    c = c.select("case_id", F.concat_ws(":", "case_id", "cell_index").alias("owner_key"))
    variants = spark.createDataFrame([("original", 0), ("reversed", 1)], "variant string, k int")
    conditions = spark.createDataFrame([("high", 0), ("q4", 1), ("gptq", 2)], "condition string, j int")
    of = lambda names, n: F.explode(F.array(*(F.struct(F.lit(x).alias("name"), F.lit(i).alias("i")) for i, x in enumerate(names)))).alias(n)
    prompt = F.col("prompt")
    units = c.select("owner_key", "case_id", of(("original", "reversed"), "v")).select("owner_key", "case_id", F.col("v.name").alias("variant"), F.col("v.i").alias("k"), F.md5(F.concat_ws("|", "v.name", "owner_key")).alias("prompt"))
    rows = units.select("*", of(("high", "q4", "gptq"), "c")).select("*", F.col("c.name").alias("condition"), F.col("c.i").alias("j")).where("NOT (j = 1 AND k = 1 AND case_id % 9 = 0) AND NOT (j = 2 AND k = 1)")
    asked = F.when((F.col("j") == 2) & (F.col("case_id") % 10 == 0), "other").otherwise(prompt)
    rows = rows.select("condition", "variant", "case_id", "owner_key", F.lit("ok").alias("hard_status"), F.expr("CASE WHEN j = 0 AND k = 1 AND case_id % 8 = 0 THEN 'failed' ELSE 'ok' END").alias("probability_status"), prompt.alias("hard_prompt"), asked.alias("probability_prompt"))
    return G.cell_gate(rows, units.select("case_id", "owner_key", "variant", "prompt"), conditions.join(variants).select("condition", "variant"), by=("case_id",))


# layers, sets and overlaps

BINS = "1 + (third > a)::INT + (third > b)::INT + (third > c)::INT"


@query("seven_layers", f"""WITH {CASES}, q AS (SELECT quantile_cont(third, 0.25) AS a, quantile_cont(third, 0.5) AS b, quantile_cont(third, 0.75) AS c, quantile_cont(fourth, 0.25) AS e, quantile_cont(fourth, 0.5) AS f, quantile_cont(fourth, 0.75) AS g FROM summary),
x AS (SELECT treat_all - base AS d, stratum, {BINS} AS p, 1 + (fourth > e)::INT + (fourth > f)::INT + (fourth > g)::INT AS s, base > 0 AS n, third > 0 AS t, fourth > base AS u FROM summary, q),
l AS (SELECT d, unnest([{{'dimension': 'stratum', 'label': stratum}}, {{'dimension': 'first_quartile', 'label': 'Q' || p}}, {{'dimension': 'second_quartile', 'label': 'Q' || s}}, {{'dimension': 'joint_quartile', 'label': 'Q' || p || '__Q' || s}}, {{'dimension': 'base_up', 'label': CASE WHEN n THEN 'changed' ELSE 'unchanged' END}}, {{'dimension': 'third_up', 'label': CASE WHEN t THEN 'changed' ELSE 'unchanged' END}}, {{'dimension': 'fourth_up', 'label': CASE WHEN u THEN 'changed' ELSE 'unchanged' END}}]) AS y FROM x)
SELECT y.dimension AS dimension, y.label AS label, count(*) AS cases, round(avg(d), 6) AS effect FROM l GROUP BY ALL""")
def seven_layers(spark, sf):
    v = case_values(spark, sf)
    thirds = lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    cuts = v.agg(thirds("third").alias("cuts"), thirds("fourth").alias("more"))
    x = v.join(F.broadcast(cuts))  # one row
    first, second = (F.concat(F.lit("Q"), S.frozen_bin(F.col(c), [F.col(n)[i] for i in range(3)])) for c, n in (("third", "cuts"), ("fourth", "more")))
    turned = lambda c: F.when(c, "changed").otherwise("unchanged")
    layers = A.layered(x, {"stratum": F.col("stratum"), "first_quartile": first, "second_quartile": second, "joint_quartile": F.concat_ws("__", first, second), "base_up": turned(F.col("base") > 0), "third_up": turned(F.col("third") > 0), "fourth_up": turned(F.col("fourth") > F.col("base"))})
    return r(layers.groupBy("dimension", "label").agg(F.count(F.lit(1)).alias("cases"), F.avg(F.col("treat_all") - F.col("base")).alias("effect")), 6, "effect")


def _set_sql(name: str, quotas: dict[str, int], free: str) -> str:
    quota = "CASE o_orderstatus " + " ".join(f"WHEN '{s}' THEN {n}" for s, n in quotas.items()) + " ELSE 0 END"
    return f"{name} AS (SELECT o_orderkey, o_custkey, o_orderstatus, '{name}' AS part FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_rank(3, name, 'o_orderkey')}, o_orderkey) AS n FROM orders {free}) WHERE n <= {quota})"


PILOT, DISCOVERY = {"O": 8, "F": 5}, {"O": 20, "F": 20}
SETS = _set_sql("pilot", PILOT, "") + ", " + _set_sql("discovery", DISCOVERY, "WHERE o_custkey NOT IN (SELECT o_custkey FROM pilot)")


@query("two_sets", f"WITH {SETS} SELECT * FROM pilot UNION ALL SELECT * FROM discovery")
def two_sets(spark, sf):
    return W.two_sets(table(spark, sf, "orders"), "o_orderkey", "o_custkey", "o_orderstatus", (PILOT, DISCOVERY), 3)


LEVELS = {"order": "o_orderkey::VARCHAR", "customer": "o_custkey::VARCHAR", "clerk_priority": "o_orderpriority", "date": "strftime(o_orderdate::DATE, '%Y-%m-%d')", "total": "printf('%.2f', o_totalprice)"}


@query("five_level_overlap", f"WITH a AS (SELECT * FROM orders WHERE {_rank(1, 'set', 'o_orderkey')} < '4'), b AS (SELECT * FROM orders WHERE {_rank(2, 'set', 'o_orderkey')} < '4') " + " UNION ALL ".join(
    f"SELECT '{n}' AS level, (SELECT count(DISTINCT {v}) FROM a) AS left_values, (SELECT count(DISTINCT {v}) FROM b) AS right_values, (SELECT count(DISTINCT {v}) FROM a WHERE {v} IN (SELECT {v} FROM b)) AS shared" for n, v in LEVELS.items()
))
def five_level_overlap(spark, sf):
    """Two hashed quarters of the orders at five levels, from the row itself to what many rows have."""
    o = table(spark, sf, "orders")
    a, b = (o.where(S.stable_rank(k, "set", F.col("o_orderkey")) < "4") for k in (1, 2))
    values = {"order": F.col("o_orderkey"), "customer": F.col("o_custkey"), "clerk_priority": F.col("o_orderpriority"), "date": F.date_format("o_orderdate", "yyyy-MM-dd"), "total": F.format_string("%.2f", F.col("o_totalprice"))}
    return A.overlap(a, b, {n: (v, v) for n, v in values.items()})
