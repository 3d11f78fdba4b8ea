"""Units, condition exports, their gates and lookups over the bound test tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as S
from ..operators import cases as C
from ..operators import metrics as M
from ..operators import units as U
from ..sources.fixtures import CELLS, cells, table
from ..sources.releases import CELL_FIELDS, aligned_records, context_records
from ..sources.shared import written
from ..streaming import store
from .effects import CASES, case_values, r

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE[name] = f, sql
        return f

    return add


UNITS = CELLS + """, units AS (
  SELECT 'full:' || case_id || ':' || cell_index AS owner_key, 'full' AS control, case_id, cluster_id, cell_index, CAST(cell_index // 2 AS INTEGER) AS claim_index, gold, base_score, treat_score, base_pred, treat_pred, treat_ok FROM cells
  UNION ALL
  SELECT kind || ':' || case_id || ':claim:' || (cell_index // 2), kind, case_id, min(cluster_id), NULL, CAST(cell_index // 2 AS INTEGER), NULL, max(base_score), max(treat_score), min(base_pred), min(treat_pred), bool_and(treat_ok)
  FROM cells, (VALUES ('no_evidence'), ('knowledge_only')) v(kind) GROUP BY kind, case_id, cell_index // 2)"""

EXPORTS = UNITS + """, exports AS (
  SELECT 'base' AS condition, owner_key, control, case_id, cluster_id, cell_index, claim_index, gold, base_score AS score, base_pred AS prediction, TRUE AS hard_ok, TRUE AS probability_ok FROM units
  UNION ALL SELECT 'treat', owner_key, control, case_id, cluster_id, cell_index, claim_index, gold, treat_score, treat_pred, TRUE, treat_ok FROM units)"""


def exports(spark, sf: str, controls: tuple[str, ...] = U.CONTROLS, kept: DataFrame | None = None) -> DataFrame:
    """Two exported conditions: rows (condition, owner_key, control, ..., score, prediction, hard_ok, probability_ok).

    The cells are read once, or ``kept`` in their place: both conditions, and the units without
    evidence, come from the row of a case and claim.
    """
    c = (cells(spark, sf) if kept is None else kept).withColumn("claim_index", F.expr("CAST(cell_index div 2 AS INT)"))
    fields = ["cell_index", "gold", "base_score", "treat_score", "base_pred", "treat_pred", "treat_ok"]
    if controls == ("full",):
        units = c.select(F.lit("full").alias("control"), "case_id", "cluster_id", "claim_index", *fields)
    else:
        both = c.groupBy("case_id", "claim_index").agg(
            F.min("cluster_id").alias("least_cluster"), F.max("base_score").alias("base_score"), F.max("treat_score").alias("treat_score"), F.min("base_pred").alias("base_pred"), F.min("treat_pred").alias("treat_pred"), F.bool_and("treat_ok").alias("treat_ok"),
            F.collect_list(F.struct(F.lit("full").alias("control"), "cluster_id", *fields)).alias("full"),  # two cells
        )
        other = lambda control: F.struct(F.lit(control).alias("control"), F.col("least_cluster").alias("cluster_id"), F.lit(None).cast("int").alias("cell_index"), F.lit(None).cast("string").alias("gold"), *fields[2:])
        units = both.select("case_id", "claim_index", F.explode(F.concat("full", F.array(*(other(k) for k in U.CONTROLS[1:])))).alias("u")).select("case_id", "claim_index", "u.*")
        units = units if controls == U.CONTROLS else units.where(F.col("control").isin(*controls))
    key = F.when(F.col("control") == "full", F.concat_ws(":", "control", "case_id", "cell_index")).otherwise(F.concat_ws(":", "control", "case_id", F.lit("claim"), "claim_index"))
    one = lambda name, score, prediction, ok: F.struct(F.lit(name).alias("condition"), F.col(score).alias("score"), F.col(prediction).alias("prediction"), F.lit(True).alias("hard_ok"), ok.alias("probability_ok"))
    told = F.explode(F.array(one("base", "base_score", "base_pred", F.lit(True)), one("treat", "treat_score", "treat_pred", F.col("treat_ok")))).alias("x")
    units = units.select(key.alias("owner_key"), "control", "case_id", "cluster_id", "cell_index", "claim_index", "gold", told)
    return units.select("x.condition", "owner_key", "control", "case_id", "cluster_id", "cell_index", "claim_index", "gold", "x.score", "x.prediction", "x.hard_ok", "x.probability_ok")


def kept_exports(spark, sf: str) -> DataFrame:
    """The exports, written once for queries that read them more than once."""
    return written(exports(spark, sf), "exports")


def _quartets(spark, sf: str) -> DataFrame:
    """Cases with their two claims, two evidences, four unit names and four labels as arrays."""
    by = cells(spark, sf).groupBy("case_id").agg(F.min("cluster_id").alias("page"), *(F.max(F.when(F.col("cell_index") == i, F.col("gold"))).alias(f"l{i}") for i in range(4)))
    named = lambda k: F.array(*(F.concat(F.lit(f"{k} {i} of "), F.col("case_id").cast("string")) for i in range(2)))
    units = F.array(*(F.concat_ws(":", "case_id", F.lit(str(i))) for i in range(4)))
    return by.select("case_id", "page", named("claim").alias("claims"), named("evidence").alias("evidences"), units.alias("units"), F.array("l0", "l1", "l2", "l3").alias("labels"))


@query("quartet_units", f"""WITH {CELLS} SELECT 'full:' || case_id || ':' || cell_index AS owner_key, 'full' AS control, case_id, cluster_id AS page, cell_index, CAST(cell_index // 2 AS INTEGER) AS claim_index, CAST(cell_index % 2 AS INTEGER) AS evidence_index,
  'claim ' || (cell_index // 2) || ' of ' || case_id AS claim, 'evidence ' || (cell_index % 2) || ' of ' || case_id AS evidence, gold FROM cells
UNION ALL SELECT control || ':' || case_id || ':claim:' || i, control, case_id, page, NULL, CAST(i AS INTEGER), NULL, 'claim ' || i || ' of ' || case_id, NULL, NULL
  FROM (SELECT case_id, min(cluster_id) AS page FROM cells GROUP BY case_id), (VALUES ('no_evidence'), ('knowledge_only')) v(control), range(2) t(i)""")
def quartet_units(spark, sf):
    return U.quartet_units(_quartets(spark, sf))


@query("cell_rows", f"""WITH {CELLS} SELECT case_id, cell_index, case_id || ':' || cell_index AS units, gold AS labels FROM cells""")
def cell_rows(spark, sf):
    return U.cell_rows(_quartets(spark, sf), ["units", "labels"])


@query("label_strata", """SELECT o_orderkey AS case_id, CASE WHEN o_orderstatus = 'O' THEN 'S/R' ELSE 'S/NEI' END AS stratum FROM orders""")
def label_strata(spark, sf):
    negative = F.when(F.col("o_orderstatus") == "O", "REFUTES").otherwise("NOT ENOUGH INFO")
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("case_id"), U.label_stratum(negative).alias("stratum"))


@query("export_rows", f"""WITH {EXPORTS}, treat AS MATERIALIZED (SELECT owner_key, control, score, prediction, hard_ok, probability_ok FROM exports WHERE condition = 'treat')
SELECT o.owner_key, o.control, h.score AS hard_score, p.prediction AS probability_prediction FROM treat o JOIN (SELECT owner_key, score FROM treat WHERE hard_ok) h USING (owner_key) JOIN (SELECT owner_key, prediction FROM treat WHERE probability_ok) p USING (owner_key)""")
def export_rows(spark, sf):
    e = written(exports(spark, sf).where("condition = 'treat'").select("owner_key", "control", "score", "prediction", "hard_ok", "probability_ok"), "exports")
    return U.export_rows(e.select("owner_key", "control"), {"hard": e.where("hard_ok").select("owner_key", "score"), "probability": e.where("probability_ok").select("owner_key", "prediction")})


@query("condition_cases", f"""WITH {EXPORTS} SELECT condition, case_id, min(cluster_id) AS page, round((max(CASE WHEN cell_index = 0 THEN score END) - max(CASE WHEN cell_index = 1 THEN score END) - max(CASE WHEN cell_index = 2 THEN score END) + max(CASE WHEN cell_index = 3 THEN score END)) / 2, 10) AS interaction,
  count(*) FILTER (WHERE hard_ok) AS hard, count(*) FILTER (WHERE probability_ok) AS probability FROM exports WHERE control = 'full' GROUP BY condition, case_id""")
def condition_cases(spark, sf):
    full = exports(spark, sf).where("control = 'full'")
    found = full.groupBy("condition", "case_id").agg(F.min("cluster_id").alias("page"), C.interaction(F.col("score"), F.col("cell_index")).alias("interaction"), F.count_if("hard_ok").alias("hard"), F.count_if("probability_ok").alias("probability"))
    return r(found, 10, "interaction")


@query("control_structure", f"""WITH {EXPORTS} SELECT control, count(*) AS rows, CAST(sum(coalesce(hard_ok::INT, 0)) AS BIGINT) AS hard, CAST(sum(coalesce(probability_ok::INT, 0)) AS BIGINT) AS probability FROM exports WHERE condition = 'treat' GROUP BY control""")
def control_structure(spark, sf):
    return U.control_structure(exports(spark, sf).where("condition = 'treat'"))




def _sides(spark, sf):
    e = kept_exports(spark, sf)
    left = e.where("condition = 'base'").where("NOT coalesce(control = 'full' AND cell_index = 3 AND prediction = 'A' AND gold = 'N', false)")
    return left, e.where("condition = 'treat'").where("gold IS NULL OR gold <> 'R' OR probability_ok")


@query("pair_gate", f"""WITH {EXPORTS}, a AS (SELECT * FROM exports WHERE condition = 'base' AND NOT coalesce(control = 'full' AND cell_index = 3 AND prediction = 'A' AND gold = 'N', false)), b AS (SELECT * FROM exports WHERE condition = 'treat' AND (gold IS NULL OR gold <> 'R' OR probability_ok)),
j AS (SELECT a.owner_key IS NOT NULL AND b.owner_key IS NOT NULL AS there, a.control IS NOT DISTINCT FROM b.control AS c, a.prediction IS NOT DISTINCT FROM b.prediction AS p, a.hard_ok AND b.hard_ok AS h, a.probability_ok AND b.probability_ok AS q FROM a FULL JOIN b ON a.owner_key = b.owner_key)
SELECT 'owner_set' AS "check", count(*) FILTER (WHERE NOT there) AS broken FROM j UNION ALL SELECT 'same_control', count(*) FILTER (WHERE there AND NOT c) FROM j UNION ALL SELECT 'same_prediction', count(*) FILTER (WHERE there AND NOT p) FROM j
UNION ALL SELECT 'hard_ok', count(*) FILTER (WHERE there AND NOT h) FROM j UNION ALL SELECT 'probability_ok', count(*) FILTER (WHERE there AND NOT q) FROM j""")
def pair_gate(spark, sf):
    left, right = _sides(spark, sf)
    return U.pair_gate(left, right, ["control", "prediction"], ["hard", "probability"])


@query("alignment_gate", f"""WITH {EXPORTS}, three AS (SELECT * FROM exports UNION ALL SELECT 'third', owner_key, control, case_id, cluster_id, cell_index, claim_index, CASE WHEN cell_index = 2 THEN 'R' ELSE gold END, score, prediction, hard_ok, probability_ok FROM exports WHERE condition = 'treat' AND probability_ok),
g AS (SELECT owner_key, count(*) AS rows, count(DISTINCT condition) AS n, count(DISTINCT control) AS c, count(DISTINCT coalesce(gold, '?')) AS l FROM three GROUP BY owner_key)
SELECT 'owner_set' AS "check", count(*) FILTER (WHERE rows <> 3 OR n <> 3) AS broken FROM g UNION ALL SELECT 'same_control', count(*) FILTER (WHERE c > 1) FROM g UNION ALL SELECT 'same_gold', count(*) FILTER (WHERE l > 1) FROM g""")
def alignment_gate(spark, sf):
    # the third export is made beside its rows, so that the cells are read once and nothing is written
    e = exports(spark, sf).select("condition", "owner_key", "control", "gold", "cell_index", "probability_ok")
    same = F.struct("condition", "gold")
    third = F.when((F.col("condition") == "treat") & F.col("probability_ok"), F.struct(F.lit("third").alias("condition"), F.when(F.col("cell_index") == 2, "R").otherwise(F.col("gold")).alias("gold")))
    three = e.select("owner_key", "control", F.explode(F.array_compact(F.array(same, third))).alias("x")).select("owner_key", "control", "x.*")
    return U.alignment_gate(three, 3, ["control", "gold"])


@query("subset_condition", f"""WITH {EXPORTS} SELECT owner_key, score FROM exports WHERE condition = 'base' AND case_id IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '2-HIGH')""")
def subset_condition(spark, sf):
    full = exports(spark, sf).where("condition = 'base'")
    ids = table(spark, sf, "orders").where("o_orderpriority = '2-HIGH'").select(F.col("o_orderkey").alias("case_id")).join(full.select("case_id"), "case_id", "left_semi")
    return U.subset(full, ids, "case_id").select("owner_key", "score")


@query("looked_up", """SELECT d.doc_id, l.quality, l.doc_id IS NOT NULL AS found FROM documents d LEFT JOIN labels l USING (doc_id)""")
def looked_up(spark, sf):
    return U.looked_up(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


CONTEXTS = """l AS (SELECT event_id AS sample_id, user_id AS query, CASE WHEN event_type = 'view' THEN 'irrelevant' ELSE 'gold' END AS kind, CASE WHEN value > 50 THEN 'yes' ELSE 'no' END AS target, value AS use FROM events WHERE value > 5),
r AS (SELECT event_id AS sample_id, CASE WHEN value > 250 THEN -1 ELSE user_id END AS query, CASE WHEN event_type = 'view' THEN 'irrelevant' ELSE 'gold' END AS kind, CASE WHEN value > 55 THEN 'yes' ELSE 'no' END AS target, value / 2 AS use FROM events WHERE value < 300)"""


@query("paired_contexts", f"""WITH {CONTEXTS} SELECT coalesce(l.sample_id, r.sample_id) AS sample_id, coalesce(l.kind, r.kind) AS kind, l.use AS use_l, r.use AS use_r, CASE WHEN l.sample_id IS NULL OR r.sample_id IS NULL THEN 'sample_missing' WHEN l.query <> r.query OR l.kind <> r.kind THEN 'identity_differs'
  WHEN l.kind <> 'irrelevant' AND l.target <> r.target THEN 'target_differs' ELSE 'ok' END AS status FROM l FULL JOIN r ON l.sample_id = r.sample_id""")
def paired_contexts(spark, sf):
    e = table(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") == "view", "irrelevant").otherwise("gold"))
    left = e.where("value > 5").select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("query"), "kind", F.when(F.col("value") > 50, "yes").otherwise("no").alias("target"), F.col("value").alias("use"))
    right = e.where("value < 300").select(F.col("event_id").alias("sample_id"), F.when(F.col("value") > 250, -1).otherwise(F.col("user_id")).alias("query"), "kind", F.when(F.col("value") > 55, "yes").otherwise("no").alias("target"), (F.col("value") / 2).alias("use"))
    return U.pair_contexts(left, right, ["query", "kind"], "target", "kind", ["use"])


@query("canonical_contexts", """WITH x AS (SELECT event_id::VARCHAR AS sample_id, 'c' || event_id AS claim, CASE WHEN event_id % 23 = 0 THEN ' ' ELSE 'u' || user_id END AS claimant, 'e' AS evidence, value > 20 AS relevant,
  CASE WHEN event_type = 'view' THEN 'irrelevant' WHEN event_type = 'click' THEN 'edited' ELSE 'gold' END AS context_type, CASE WHEN value > 60 THEN 'True' ELSE 'False' END AS target_true, CASE WHEN event_id % 5 = 0 THEN NULL WHEN value > 40 THEN 'True' ELSE 'False' END AS target_new FROM events),
j AS (SELECT *, CASE WHEN trim(claimant) = '' THEN 'missing_text' WHEN context_type = 'gold' AND target_new IS DISTINCT FROM target_true THEN 'gold_target' WHEN context_type = 'edited' AND (target_new IS NULL OR target_new = target_true) THEN 'edited_target' WHEN context_type = 'irrelevant' AND target_new IS NOT NULL THEN 'irrelevant_target' END AS reason FROM x)
SELECT sample_id, reason, CASE WHEN reason IS NULL THEN sha256('{"claim":"' || claim || '","claimant":"' || claimant || '","context_type":"' || context_type || '","evidence":"e","relevant":' || relevant || ',"sample_id":"' || sample_id || '","target_new":' || coalesce('"' || target_new || '"', 'null') || ',"target_true":"' || target_true || '"}') END AS digest FROM j""")
def canonical_contexts(spark, sf):
    x = table(spark, sf, "events").selectExpr("CAST(event_id AS STRING) AS sample_id", "concat('c', event_id) AS claim", "CASE WHEN event_id % 23 = 0 THEN ' ' ELSE concat('u', user_id) END AS claimant", "'e' AS evidence", "value > 20 AS relevant",
        "CASE WHEN event_type = 'view' THEN 'irrelevant' WHEN event_type = 'click' THEN 'edited' ELSE 'gold' END AS context_type", "CASE WHEN value > 60 THEN 'True' ELSE 'False' END AS target_true", "CASE WHEN event_id % 5 = 0 THEN NULL WHEN value > 40 THEN 'True' ELSE 'False' END AS target_new")
    return U.canonical_context(x, ["True", "False"], ["True", "False"])


@query("choice_logprobs", """SELECT event_id, CASE WHEN event_type = 'view' OR value % 10 < 1 THEN NULL ELSE round(ln((value % 10) / 40), 9) END AS a, CASE WHEN event_type = 'view' OR value % 10 < 1 THEN NULL ELSE round(ln(0.25), 9) END AS b FROM events""")
def choice_logprobs(spark, sf):
    part = F.col("value") % 10
    pick = lambda token, prob: F.struct(token.alias("token"), prob.alias("prob"))
    top = F.array(pick(F.lit(" a"), F.when(part < 1, F.lit(0.0)).otherwise(part / 40)), pick(F.lit("zz"), F.lit(0.1)), pick(F.when(F.col("event_type") == "view", "x").otherwise("B "), F.lit(0.25)))
    found = U.choice_logprobs(top, ["A", "B"])
    return table(spark, sf, "events").select("event_id", F.round(found["A"], 9).alias("a"), F.round(found["B"], 9).alias("b"))


@query("vocabulary_mass", """WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), t AS (SELECT vec_id, e, list_max(e) + ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e))))) AS total FROM x)
SELECT vec_id, round(e[1] - total, 9) AS first, round(e[6] - total, 9) AS sixth, round(exp(e[1] - total) + exp(e[6] - total), 9) AS mass FROM t""")
def vocabulary_mass(spark, sf):
    found = U.token_mass(F.transform("embedding", lambda x: x.cast("double")), [0, 5])
    e = table(spark, sf, "embeddings").select("vec_id", found.alias("m"))
    return e.select("vec_id", F.round(F.col("m.logprobs")[0], 9).alias("first"), F.round(F.col("m.logprobs")[1], 9).alias("sixth"), F.round("m.mass", 9).alias("mass"))


@query("mapping_pairs", f"""WITH {CELLS}, m AS (SELECT case_id, cell_index, min(cluster_id) AS page, max(CASE WHEN TRUE THEN base_score - treat_score END) AS a, max(third_score - base_score) AS b FROM cells GROUP BY ALL)
SELECT page, round(avg(b - a), 6) AS shift, count(*) AS cells, count(*) FILTER (WHERE sign(a) <> sign(b)) AS turned FROM m GROUP BY page""")
def mapping_pairs(spark, sf):
    c = cells(spark, sf)
    one = c.select("case_id", "cell_index", "cluster_id", (F.col("base_score") - F.col("treat_score")).alias("margin")).withColumn("unit", F.concat_ws(":", "case_id", "cell_index"))
    two = c.select(F.concat_ws(":", "case_id", "cell_index").alias("unit"), "cluster_id", (F.col("third_score") - F.col("base_score")).alias("margin"))
    both = C.pair(one, two, "unit", ["margin"], ("cluster_id",)).where("status = 'ok'")
    turned = F.count_if(F.signum("margin_left") != F.signum("margin_right"))
    return r(both.groupBy(F.col("cluster_id_left").alias("page")).agg(F.avg("margin_effect").alias("shift"), F.count(F.lit(1)).alias("cells"), turned.alias("turned")), 6, "shift")


@query("family_differences", f"""WITH {CASES}, a AS (SELECT cluster_id, avg(treat_all - base) AS e FROM summary GROUP BY cluster_id), b AS (SELECT cluster_id, avg(fourth - third) AS e FROM summary WHERE stratum <> '1-URGENT' GROUP BY cluster_id)
SELECT coalesce(a.cluster_id, b.cluster_id) AS cluster_id, round(b.e - a.e, 12) AS difference, CASE WHEN b.e IS NULL THEN 'only_left' ELSE 'ok' END AS status FROM a FULL JOIN b USING (cluster_id)""")
def family_differences(spark, sf):
    v = case_values(spark, sf)
    a = C.cluster_means(v.withColumn("d", F.col("treat_all") - F.col("base")), "cluster_id", "d")
    b = C.cluster_means(v.where("stratum <> '1-URGENT'").withColumn("d", F.col("fourth") - F.col("third")), "cluster_id", "d")
    return r(C.pair(a, b, "cluster_id", ["effect"]).select("cluster_id", F.col("effect_effect").alias("difference"), "status"), 12, "difference")


@query("backend_pages", f"""WITH {CELLS}, p AS (SELECT cluster_id, sum(CAST(round((treat_score - base_score) * 1e9) AS HUGEINT)) AS d, sum((treat_pred = gold)::INT - (base_pred = gold)::INT) AS h, count(*) AS n FROM cells GROUP BY cluster_id)
SELECT cluster_id, CAST(d AS DOUBLE) / n / 1e9 AS score_difference, CAST(h AS DOUBLE) / n AS accuracy_difference FROM p""")
def backend_pages(spark, sf):
    """Mean paired difference of each page; sums of whole billionths don't depend on their order."""
    right = lambda c: (F.col(c) == F.col("gold")).cast("int")
    units = F.sum(F.round((F.col("treat_score") - F.col("base_score")) * 1e9).cast("decimal(20,0)"))
    p = cells(spark, sf).groupBy("cluster_id").agg(units.cast("double").alias("d"), F.sum(right("treat_pred") - right("base_pred")).cast("double").alias("h"), F.count(F.lit(1)).alias("n"))
    return p.select("cluster_id", (F.col("d") / F.col("n") / 1e9).alias("score_difference"), (F.col("h") / F.col("n")).alias("accuracy_difference"))


@query("endpoint_summary", f"""WITH {CELLS} SELECT stratum, count(*) AS units, round(avg((base_pred = treat_pred)::INT), 9) AS agreement, round(avg((base_pred = gold)::INT), 9) AS left_accuracy, round(avg((treat_pred = gold)::INT), 9) AS right_accuracy,
  count(*) FILTER (WHERE base_pred = gold AND treat_pred <> gold) AS degraded, count(*) FILTER (WHERE base_pred <> gold AND treat_pred = gold) AS improved FROM cells GROUP BY stratum""")
def endpoint_summary(spark, sf):
    t = M.transitions(cells(spark, sf), "gold", "base_pred", "treat_pred", ("stratum",))
    n = F.col("rows")
    return r(t.select("stratum", n.alias("units"), "agreement", ((F.col("both_right") + F.col("degraded")) / n).alias("left_accuracy"), ((F.col("both_right") + F.col("improved")) / n).alias("right_accuracy"), "degraded", "improved"), 9, "agreement", "left_accuracy", "right_accuracy")


@query("context_targets", """SELECT event_id, CASE WHEN event_type = 'view' THEN 'q' || (user_id % 3) ELSE 't' || (event_id % 2) END AS target FROM events""")
def context_targets(spark, sf):
    kind = F.when(F.col("event_type") == "view", "irrelevant").otherwise("gold")
    target = S.target_label(kind, F.concat(F.lit("q"), (F.col("user_id") % 3).cast("string")), F.concat(F.lit("t"), (F.col("event_id") % 2).cast("string")))
    return table(spark, sf, "events").select("event_id", target.alias("target"))


@query("query_identities", """SELECT event_id, sha256('{"claim":"c' || (event_id % 7) || '","claimant":"u' || user_id || '"}') AS identity, CAST(count(*) OVER (PARTITION BY event_id % 7, user_id) AS BIGINT) AS contexts FROM events""")
def query_identities(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.concat(F.lit("c"), (F.col("event_id") % 7).cast("string")).alias("claim"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("claimant"))
    return e.select("event_id", S.identity("claim", "claimant").alias("identity")).withColumn("contexts", F.count(F.lit(1)).over(Window.partitionBy("identity")))


@query("shown_numbers", r"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_discount - l_tax < 0 THEN '-' ELSE '+' END || printf('%.3f', abs(round(l_discount - l_tax, 3))) AS signed, CAST(sign(round(l_discount - l_tax, 6)) AS INTEGER) AS direction,
  replace(replace(replace(l_returnflag || '_' || l_linestatus || '&' || '10%', '&', '\&'), '%', '\%'), '_', '\_') AS escaped FROM lineitem""")
def shown_numbers(spark, sf):
    d = F.col("l_discount") - F.col("l_tax")
    text = F.concat(F.col("l_returnflag"), F.lit("_"), F.col("l_linestatus"), F.lit("&"), F.lit("10%"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", S.signed(d, 3).alias("signed"), F.signum(F.round(d, 6)).cast("int").alias("direction"), S.escaped(text).alias("escaped"))


@query("released_records", f"""WITH {EXPORTS}, paired AS (SELECT owner_key FROM exports WHERE probability_ok GROUP BY owner_key HAVING count(*) = 2) SELECT condition, owner_key, control, case_id, cluster_id, cell_index, gold, prediction, round(score, 9) AS score FROM exports JOIN paired USING (owner_key)""")
def released_records(spark, sf):
    e = written(exports(spark, sf).select(*CELL_FIELDS, "probability_ok"), "exports")
    ids = C.aligned(e.where("probability_ok"), "owner_key", "condition", 2)
    return r(aligned_records(e, 2, CELL_FIELDS, ids), 9, "score")


@query("released_contexts", f"""WITH {CONTEXTS} SELECT l.sample_id, l.kind, l.use AS use_l, r.use AS use_r, v.n AS comparison FROM l JOIN r ON l.sample_id = r.sample_id, (VALUES ('first'), ('second')) v(n) WHERE l.query = r.query AND (l.kind = 'irrelevant' OR l.target = r.target)""")
def released_contexts(spark, sf):
    e = table(spark, sf, "events").withColumn("kind", F.when(F.col("event_type") == "view", "irrelevant").otherwise("gold")).where("value > 5 AND value <= 250 AND (event_type = 'view' OR value <= 50 OR value > 55)")
    left = e.select(F.col("event_id").alias("sample_id"), F.col("user_id").alias("query"), "kind", F.when(F.col("value") > 50, "yes").otherwise("no").alias("target"), F.col("value").alias("use"))
    right = left.withColumn("use", F.col("use") / 2)
    return context_records({"first": (left, right), "second": (left, right)}, ["query", "kind"], "target", "kind", ["use"])


@query("rescored", f"""WITH {CELLS}, s AS (SELECT stratum, treat_pred, CASE WHEN base_score >= third_score AND base_score >= fourth_score THEN 'A' WHEN third_score >= fourth_score THEN 'N' ELSE 'R' END AS best FROM cells) SELECT stratum, count(*) AS rows, count(*) FILTER (WHERE best <> treat_pred) AS disagree FROM s GROUP BY stratum""")
def rescored(spark, sf):
    best = S.first_argmax([("A", F.col("base_score")), ("N", F.col("third_score")), ("R", F.col("fourth_score"))])
    return cells(spark, sf).withColumn("best", best).groupBy("stratum").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("best") != F.col("treat_pred")).alias("disagree"))


@query("run_completion", """WITH x AS (SELECT label, vec_id, CAST(embedding[1] AS DOUBLE) AS s, CASE WHEN embedding[2] > 0.3 THEN 'Z' ELSE 'A' END AS c FROM embeddings), g AS (SELECT label, count(*) AS rows, count(DISTINCT vec_id) AS units, bool_and(c IN ('A', 'B')) AS labels FROM x GROUP BY label) SELECT label, rows, units, TRUE AS finite, labels, rows = 50 AND units = 50 AND labels AS complete FROM g""")
def run_completion(spark, sf):
    runs = table(spark, sf, "embeddings").select("label", "vec_id", F.col("embedding")[0].cast("double").alias("s"), F.when(F.col("embedding")[1] > 0.3, "Z").otherwise("A").alias("c"))
    return store.completion(runs, ["label"], 50, "vec_id", "s", ("c", ["A", "B"]))


@query("open_cells", """SELECT o AS stratum, i AS repeat FROM (SELECT DISTINCT o_orderpriority AS o FROM orders), range(1, 4) t(i) WHERE (o, i) NOT IN (SELECT o_orderpriority, 1 + o_orderkey % 3 FROM orders GROUP BY ALL HAVING min(o_orderkey) % 2 = 0)""")
def open_cells(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("stratum"), (F.col("o_orderkey") % 3 + 1).alias("repeat"))
    expected = orders.select("stratum").distinct().withColumn("repeat", F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))))
    finished = orders.groupBy("stratum", "repeat").agg((F.min("o_orderkey") % 2 == 0).alias("complete"))
    return store.open_cells(expected, finished, ["stratum", "repeat"])
