"""Selection, resampling, text, audits and the result store over the bound test tables, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import text as X
from ..operators import audit as A
from ..operators import cases as C
from ..operators import resampling as R
from ..operators import selection as W
from ..sources.fixtures import CELLS, CONTEXT, cells, context, table
from ..sources.shared import written
from ..streaming import store
from .effects import CASES, CLUSTERS, case_values, clusters, long_values, r

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

#: Bootstrap draws, sign flips, and clusters up to which all flips are tried.
DRAWS, FLIPS, EXACT, SEED = 10_000, 100_000, 20, R.SEED


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return add


# resampling

def _times(draws: int) -> str:
    return CLUSTERS + f""", named AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS place FROM clusters), size AS (SELECT count(*) AS n FROM named),
slots AS (SELECT d AS draw, s AS slot FROM range({draws}) t(d), range((SELECT n FROM size)) u(s)),
times AS (SELECT draw, cluster_id, count(*) AS times FROM (SELECT draw, ('0x' || substr(md5('{SEED}|' || draw || '|' || (slot // 4)), 1 + 8 * (slot % 4)::INT, 8))::BIGINT % n AS place FROM slots, size) JOIN named USING (place) GROUP BY ALL)"""


#: With the draws that are wanted, and with some more to make up for rejected ones.
TIMES, MORE_TIMES = _times(DRAWS), _times(DRAWS + DRAWS // 20)


@query("bootstrap_interval", f"""WITH {TIMES}, m AS (SELECT draw, sum(times * effect) / sum(times) AS mean FROM times JOIN clusters USING (cluster_id) GROUP BY draw)
SELECT round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper, count(*) AS valid_draws FROM m""")
def bootstrap_interval(spark, sf):
    effects = written(clusters(spark, sf), "effects")  # both the names and the values come from it
    return r(R.bootstrap_interval(effects, "cluster_id", R.multiplicities(effects, "cluster_id", DRAWS)), 6, "lower", "upper")


@query("stratified_bootstrap", f"""WITH {TIMES}, e AS (SELECT stratum, cluster_id, avg(treat_all - base) AS effect FROM summary GROUP BY ALL),
m AS (SELECT draw, stratum, sum(times * e.effect) / sum(times) AS mean FROM times JOIN e USING (cluster_id) GROUP BY ALL)
SELECT stratum, round(quantile_cont(mean, 0.025), 6) AS lower, round(quantile_cont(mean, 0.975), 6) AS upper, count(*) AS valid_draws FROM m GROUP BY stratum""")
def stratified_bootstrap(spark, sf):
    v = case_values(spark, sf).withColumn("d", F.col("treat_all") - F.col("base"))
    times = R.multiplicities(C.cluster_means(v, "cluster_id", "d"), "cluster_id", DRAWS)
    return r(R.bootstrap_interval(C.cluster_means(v, "cluster_id", "d", ("stratum",)), "cluster_id", times, ("stratum",)), 6, "lower", "upper")


@query("balanced_accuracy_bootstrap", f"""WITH {TIMES}, n AS (SELECT cluster_id, gold, count(*) AS n, count(*) FILTER (WHERE base_pred = gold) AS l, count(*) FILTER (WHERE treat_pred = gold) AS r FROM cells GROUP BY ALL),
d AS (SELECT draw, gold, sum(times * n)::DOUBLE AS n, sum(times * l)::DOUBLE AS l, sum(times * r)::DOUBLE AS r FROM times JOIN n USING (cluster_id) GROUP BY ALL),
e AS (SELECT draw, avg((r - l) / n) AS d FROM d GROUP BY draw HAVING count(*) = 3)
SELECT round(quantile_cont(d, 0.025), 6) AS lower, round(quantile_cont(d, 0.975), 6) AS upper, count(*) AS valid_draws FROM e""")
def balanced_accuracy_bootstrap(spark, sf):
    times = R.multiplicities(clusters(spark, sf), "cluster_id", DRAWS)
    return r(R.balanced_accuracy_bootstrap(cells(spark, sf), "cluster_id", "gold", "base_pred", "treat_pred", times, 3), 6, "lower", "upper")


#: Flips of a relation effects (k, x): each hexadecimal digit of a digest decides four signs, whose sums are made beforehand.
FLIPPED = f"""f_size AS (SELECT count(*) AS n FROM effects), f_named AS (SELECT row_number() OVER (ORDER BY k) - 1 AS place, x FROM effects),
f_flips AS (SELECT d AS draw FROM range((SELECT CASE WHEN n <= {EXACT} THEN pow(2, n)::BIGINT ELSE {FLIPS} END FROM f_size)) t(d)),
f_digits AS MATERIALIZED (SELECT place // 128 AS block, (place % 128) // 4 AS digit, lower(to_hex(v)) AS hex, sum(CASE WHEN (v >> (3 - (place % 4)::INT)) % 2 = 1 THEN -x ELSE x END) AS y FROM f_named, range(16) t(v) GROUP BY ALL),
f_digests AS (SELECT draw, b AS block, md5('{SEED}|' || draw || '|' || b) AS h FROM f_flips, range((SELECT CASE WHEN n <= {EXACT} THEN 0 ELSE (n + 127) // 128 END FROM f_size)) u(b)),
f_signed AS (SELECT draw, y FROM (SELECT draw, block, i AS digit, substr(h, i::INT + 1, 1) AS hex FROM f_digests, range(32) t(i)) JOIN f_digits USING (block, digit, hex)
  UNION ALL SELECT draw, CASE WHEN (draw >> place::INT) % 2 = 1 THEN -x ELSE x END FROM f_flips, f_named, f_size WHERE n <= {EXACT}),
f_sums AS (SELECT draw, abs(sum(y)) AS s FROM f_signed GROUP BY draw), f_seen AS (SELECT abs(sum(x)) AS observed FROM effects), f_counts AS (SELECT count(*) FILTER (WHERE s >= observed - 1e-9) AS k, count(*) AS draws FROM f_sums, f_seen)
SELECT round(CASE WHEN n <= {EXACT} THEN k / draws ELSE (k + 1) / (draws + 1) END, 9) AS p, draws, n AS clusters"""


@query("sign_flip", f"""WITH {CONTEXT}, effects AS (SELECT query_id AS k, avg(hit_treat::INT - hit_base::INT) AS x FROM context WHERE kind = 'gold' GROUP BY query_id), {FLIPPED} FROM f_counts, f_size""")
def sign_flip(spark, sf):
    each = context(spark, sf).where("kind = 'gold'").groupBy("query_id").agg(F.avg(F.col("hit_treat").cast("int") - F.col("hit_base").cast("int")).alias("effect"))
    return r(R.sign_flip(each, "query_id", FLIPS, exact_up_to=EXACT), 9, "p")


@query("condition_swap", f"""WITH {CELLS}, sizes AS (SELECT gold, count(*) AS m FROM cells GROUP BY gold), kinds AS (SELECT count(*) AS classes FROM sizes),
effects AS (SELECT cluster_id AS k, sum(((treat_pred = gold)::INT - (base_pred = gold)::INT)::DOUBLE / m / classes) AS x FROM cells JOIN sizes USING (gold), kinds GROUP BY cluster_id), {FLIPPED}, round((SELECT sum(x) FROM effects), 6) AS difference FROM f_counts, f_size""")
def condition_swap(spark, sf):
    return r(r(R.condition_swap(cells(spark, sf), "cluster_id", "gold", "base_pred", "treat_pred", FLIPS), 9, "p"), 6, "difference")


# selection

RANK = "sha256('{seed}|{space}|' || {value})"


def _rank(seed: int, space: str, value: str) -> str:
    return RANK.format(seed=seed, space=space, value=value)


@query("round_robin", f"""WITH h AS (SELECT o_orderkey, o_custkey, o_orderstatus, {_rank(7, 'cluster', 'o_custkey')} AS ch, {_rank(7, 'case', 'o_orderkey')} AS kh FROM orders),
t AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_custkey ORDER BY kh, o_orderkey) AS turn FROM h),
p AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY turn, ch, o_orderkey) AS place FROM t),
q AS (SELECT o_orderstatus, round_even(300 * count(*) / sum(count(*)) OVER (), 0)::BIGINT AS quota FROM orders GROUP BY o_orderstatus)
SELECT o_orderkey, o_custkey, o_orderstatus, place FROM p JOIN q USING (o_orderstatus) WHERE place <= quota""")
def round_robin(spark, sf):
    return W.round_robin(table(spark, sf, "orders"), "o_orderkey", "o_custkey", 7, stratum="o_orderstatus", total=300)


@query("round_robin_unstratified", f"""WITH h AS (SELECT doc_id, source, {_rank(5, 'cluster', 'source')} AS ch, {_rank(5, 'case', 'doc_id')} AS kh FROM documents),
t AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kh, doc_id) AS turn FROM h)
SELECT * FROM (SELECT doc_id, source, row_number() OVER (ORDER BY turn, ch, doc_id) AS place FROM t) WHERE place <= 50""")
def round_robin_unstratified(spark, sf):
    return W.round_robin(table(spark, sf, "documents").select("doc_id", "source"), "doc_id", "source", 5, total=50)


@query("lowest_ranked", f"SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY {_rank(3, 'pilot', 'c_custkey')}, c_custkey) AS n FROM customer) WHERE n <= 5")
def lowest_ranked(spark, sf):
    return W.lowest_ranked(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 3, "pilot", 5, "c_mktsegment")


@query("calibration_rows", f"SELECT p_partkey FROM part ORDER BY {_rank(11, 'calibration', 'p_partkey')}, p_partkey LIMIT 64")
def calibration_rows(spark, sf):
    return W.lowest_ranked(table(spark, sf, "part").select("p_partkey"), "p_partkey", 11, "calibration", 64)


@query("split_clusters", f"""WITH n AS (SELECT DISTINCT o_custkey FROM orders), p AS (SELECT o_custkey, row_number() OVER (ORDER BY {_rank(9, 'split', 'o_custkey')}, o_custkey) AS place, count(*) OVER () AS n FROM n)
SELECT o_orderkey, o_custkey, CASE WHEN place <= round_even(n * 0.2, 0) THEN 'recovery' ELSE 'main' END AS part FROM orders JOIN p USING (o_custkey)""")
def split_clusters(spark, sf):
    return W.split_clusters(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 9, 0.2)


def _greedy_sql(kinds: list[str], k: int) -> str:
    parts, chosen = [], []
    for i, kind in enumerate(kinds):
        used = "".join(f" AND query_id NOT IN (SELECT query_id FROM g{j})" for j in range(i))
        parts.append(f"""g{i} AS (SELECT sample_id, query_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY h, sample_id) AS turn FROM (SELECT sample_id, query_id, kind, {_rank(13, 'greedy', 'sample_id')} AS h FROM context WHERE kind = '{kind}'{used})) WHERE turn = 1 ORDER BY h, sample_id LIMIT {k})""")
        chosen.append(f"SELECT * FROM g{i}")
    return ", ".join(parts) + " " + " UNION ALL ".join(chosen)


@query("greedy_disjoint", f"WITH {CONTEXT}, " + _greedy_sql(["gold", "conflicting", "irrelevant"], 3))
def greedy_disjoint(spark, sf):
    return W.greedy_disjoint(context(spark, sf).select("sample_id", "query_id", "kind"), "sample_id", "query_id", "kind", ["gold", "conflicting", "irrelevant"], 13, 3)


@query("fresh_clusters", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def fresh_clusters(spark, sf):
    o = table(spark, sf, "orders")
    return W.without_exposed(o.select("o_orderkey", "o_custkey"), o.where("o_orderpriority = '1-URGENT'"), "o_custkey")


@query("design_gaps", """WITH d AS (SELECT r_name, s FROM (VALUES ('AFRICA'), ('AMERICA'), ('ASIA'), ('EUROPE'), ('MIDDLE EAST'), ('NOWHERE')) a(r_name), (VALUES ('BUILDING'), ('MACHINERY'), ('NONE')) b(s))
SELECT r_name, s AS c_mktsegment FROM d WHERE NOT EXISTS (SELECT 1 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey WHERE r.r_name = d.r_name AND c_mktsegment = d.s)""")
def design_gaps(spark, sf):
    found = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return W.missing_cells(found, {"r_name": ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", "NOWHERE"], "c_mktsegment": ["BUILDING", "MACHINERY", "NONE"]})


@query("id_digest", "SELECT lang, count(*) AS ids, sha256(string_agg(doc_id::VARCHAR, chr(10) ORDER BY doc_id::VARCHAR) || chr(10)) AS digest FROM documents GROUP BY lang")
def id_digest(spark, sf):
    return W.id_digest(table(spark, sf, "documents"), "doc_id", ("lang",))


@query("quartile_strata", f"""WITH {CASES}, q AS (SELECT quantile_cont(third, 0.25) AS a, quantile_cont(third, 0.5) AS b, quantile_cont(third, 0.75) AS c FROM summary),
x AS (SELECT case_id, treat_all - base AS d, stratum, 1 + (third > a)::INT + (third > b)::INT + (third > c)::INT AS bin FROM summary, q),
l AS (SELECT d, unnest(['all:all', 'bin:' || bin, 'stratum:' || stratum, 'parity:' || (case_id % 2)]) AS layer FROM x)
SELECT layer, count(*) AS cases, round(avg(d), 6) AS effect FROM l GROUP BY layer""")
def quartile_strata(spark, sf):
    v = case_values(spark, sf)
    cuts = v.agg(F.percentile("third", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("cuts"))
    x = v.join(F.broadcast(cuts)).withColumn("bin", S.frozen_bin(F.col("third"), [F.col("cuts")[i] for i in range(3)]))
    layers = F.explode(F.array(F.lit("all:all"), F.concat(F.lit("bin:"), "bin"), F.concat(F.lit("stratum:"), "stratum"), F.concat(F.lit("parity:"), F.col("case_id") % 2)))
    return r(x.select(layers.alias("layer"), (F.col("treat_all") - F.col("base")).alias("d")).groupBy("layer").agg(F.count(F.lit(1)).alias("cases"), F.avg("d").alias("effect")), 6, "effect")


# scalar functions

CHOICES = CELLS + """, s AS (SELECT case_id, cell_index, gold, -base_score AS a, -treat_score AS b, -third_score AS c FROM cells)"""


def _choices(spark, sf):
    return cells(spark, sf).selectExpr("case_id", "cell_index", "gold", "-base_score AS a", "-treat_score AS b", "-third_score AS c")


@query("choice_scores", f"""WITH {CHOICES} SELECT case_id, cell_index, CASE WHEN a >= b AND a >= c THEN 'A' WHEN b >= c THEN 'B' ELSE 'C' END AS choice,
  round(a - greatest(a, b, c) - ln(exp(a - greatest(a, b, c)) + exp(b - greatest(a, b, c)) + exp(c - greatest(a, b, c))), 11) AS log_a,
  round(CASE gold WHEN 'N' THEN a - b WHEN 'R' THEN a - c END, 11) AS margin, (sign(a - b) + 1) / 2 AS direction FROM s""")
def choice_scores(spark, sf):
    s = _choices(spark, sf)
    scores = {k: F.col(k.lower()) for k in "ABC"}
    return s.select(
        "case_id",
        "cell_index",
        S.first_argmax([*scores.items()]).alias("choice"),
        F.round(S.log_softmax([*scores.values()])[0], 11).alias("log_a"),
        F.round(S.margin({"A": F.col("a"), "N": F.col("b"), "R": F.col("c")}, "A", F.col("gold")), 11).alias("margin"),
        S.direction(F.col("a") - F.col("b")).alias("direction"),
    )


@query("mapped_margins", f"""WITH {CHOICES} SELECT case_id, cell_index, round(CASE WHEN case_id % 2 = 0 THEN (CASE gold WHEN 'N' THEN a - b WHEN 'R' THEN a - c WHEN 'A' THEN 0 END) ELSE (CASE gold WHEN 'N' THEN c - a WHEN 'R' THEN c - b WHEN 'A' THEN 0 END) END, 11) AS margin FROM s""")
def mapped_margins(spark, sf):
    turn = lambda *labels: F.create_map(*(x for c, n in zip("ABC", labels) for x in (F.lit(c), F.lit(n))))
    mapping = F.when(F.col("case_id") % 2 == 0, turn("A", "N", "R")).otherwise(turn("N", "R", "A"))
    m = S.mapped_margin({k: F.col(k.lower()) for k in "ABC"}, mapping, F.lit("A"), F.col("gold"))
    return _choices(spark, sf).select("case_id", "cell_index", F.round(m, 11).alias("margin"))


@query("context_use", """SELECT event_id, CASE WHEN event_type = 'view' THEN lower(trim(a)) = lower(trim(b)) ELSE lower(trim(b)) = 'yes' END AS used,
  round(CASE WHEN p > 0 AND p < 1 AND q > 0 AND q < 1 THEN CASE WHEN q >= p THEN (q - p) / (1 - p) ELSE (q - p) / p END END, 9) AS share,
  round(1 / (1 + exp(-(ln(p) - ln(1 - p) - 0.5))), 9) AS unbiased
FROM (SELECT event_id, event_type, (value + 1) / 400 AS p, (value + event_id % 37) / 400 AS q, CASE WHEN event_id % 3 = 0 THEN ' Yes' ELSE 'no' END AS a, CASE WHEN event_id % 4 = 0 THEN 'YES ' ELSE 'No' END AS b FROM events)""")
def context_use(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "event_type", "(value + 1) / 400 AS p", "(value + event_id % 37) / 400 AS q", "CASE WHEN event_id % 3 = 0 THEN ' Yes' ELSE 'no' END AS a", "CASE WHEN event_id % 4 = 0 THEN 'YES ' ELSE 'No' END AS b")
    kind = F.when(F.col("event_type") == "view", "irrelevant").otherwise("gold")
    return e.select("event_id", S.binary_use(kind, F.col("a"), F.col("b"), F.lit("yes")).alias("used"), F.round(S.continuous_use(F.col("p"), F.col("q")), 9).alias("share"), F.round(S.without_bias(F.col("p"), F.lit(0.5)), 9).alias("unbiased"))


#: White space as a character class of DuckDB's patterns.
WHITE_SQL = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@query("parse_choice", rf"""WITH x AS (SELECT conv_id, turn, upper(regexp_replace(text, '\A{WHITE_SQL}+|{WHITE_SQL}+\z', '', 'g')) AS t FROM conversations)
SELECT conv_id, turn, CASE WHEN t IN ('A', 'T', 'E') THEN t END AS choice, CASE WHEN t IS NULL THEN 'invalid_response_type' WHEN t = '' THEN 'empty_response' WHEN length(t) > 1 THEN 'not_single_choice' WHEN t NOT IN ('A', 'T', 'E') THEN 'disallowed_choice' END AS reason FROM x""")
def parse_choice(spark, sf):
    choice, reason = S.parse_choice(F.col("text"), ["A", "T", "E"])
    return table(spark, sf, "conversations").select("conv_id", "turn", choice.alias("choice"), reason.alias("reason"))


@query("rendered_prompts", """SELECT conv_id, count(*) AS messages, sha256(string_agg(role || ': ' || trim(text), chr(10) || chr(10) ORDER BY turn, role, text)) AS digest FROM conversations GROUP BY conv_id""")
def rendered_prompts(spark, sf):
    line = F.struct("turn", "role", "text")
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), F.array_sort(F.collect_list(line)).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: F.concat(x["role"], F.lit(": "), F.trim(x["text"]))), "\n\n")
    return c.select("conv_id", "messages", F.sha2(text, 256).alias("digest"))


# texts

DIGITS = r"[0-9]+(?:[.,][0-9]+)*"
PLAIN_NEGATIONS = ["no", "not", "never", "none", "nothing", "neither", "nor", "nobody", "nowhere", "without", "cannot"]
WORDS_SQL = r"list_transform(regexp_extract_all({t}, '[\p{{L}}\p{{M}}\p{{N}}_]+|[^\p{{L}}\p{{M}}\p{{N}}_\s]'), lambda w: replace(lower(w), 'ß', 'ss'))"


@query("token_signatures", rf"""WITH w AS (SELECT doc_id, text, {WORDS_SQL.format(t='text')} AS words FROM documents)
SELECT doc_id, len(words) AS tokens, sha256(array_to_string(words, ' ')) AS tokens_digest, array_to_string(list_sort(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')), ' ') AS numbers,
  array_to_string(list_sort(list_filter(words, lambda w: w IN ('no', 'not', 'never', 'none', 'nothing', 'neither', 'nor', 'nobody', 'nowhere', 'without', 'cannot') OR ends_with(w, 'n''t'))), ' ') AS negations FROM w""")
def token_signatures(spark, sf):
    """Digit runs and negating words as SQL can express them; ``edit_signatures_whole`` has the full definitions."""
    d = table(spark, sf, "documents").withColumn("words", X.tokens(F.col("text")))
    return d.select("doc_id", F.size("words").cast("long").alias("tokens"), F.sha2(F.array_join("words", " "), 256).alias("tokens_digest"), F.array_join(F.array_sort(F.regexp_extract_all("text", F.lit(DIGITS), F.lit(0))), " ").alias("numbers"), F.array_join(F.array_sort(F.filter("words", lambda w: w.isin(PLAIN_NEGATIONS))), " ").alias("negations"))


NORMAL_TEXT_SQL = rf"sha256(replace(lower(regexp_replace(regexp_replace(coalesce(text, ''), '\A{WHITE_SQL}+|{WHITE_SQL}+\z', '', 'g'), '{WHITE_SQL}+', ' ', 'g')), 'ß', 'ss'))"


@query("text_overlap", rf"""WITH d AS (SELECT DISTINCT {NORMAL_TEXT_SQL} AS v FROM documents), b AS (SELECT DISTINCT {NORMAL_TEXT_SQL} AS v FROM benchmark),
i AS (SELECT DISTINCT doc_id::VARCHAR AS v FROM documents), j AS (SELECT DISTINCT item_id::VARCHAR AS v FROM benchmark)
SELECT 'text' AS level, (SELECT count(*) FROM d) AS left_values, (SELECT count(*) FROM b) AS right_values, (SELECT count(*) FROM d JOIN b USING (v)) AS shared
UNION ALL SELECT 'id', (SELECT count(*) FROM i), (SELECT count(*) FROM j), (SELECT count(*) FROM i JOIN j USING (v))""")
def text_overlap(spark, sf):
    return A.overlap(table(spark, sf, "documents"), table(spark, sf, "benchmark"), {"text": (S.text_digest(F.col("text")), S.text_digest(F.col("text"))), "id": (F.col("doc_id"), F.col("item_id"))})


# audits

QUARTET_ROWS = """rows AS (SELECT l_orderkey AS case_id, CASE WHEN l_orderkey % 17 = 0 AND l_quantity > 40 THEN 'other' ELSE 'real' END AS kind, 'c' || (cell // 2) AS claim,
  CASE WHEN l_orderkey % 13 = 0 AND cell = 3 THEN ' ' ELSE 'e' || (cell % 2) END AS evidence, CASE WHEN l_orderkey % 11 = 0 THEN 'p' || cell ELSE 'p' END AS page,
  'u' || l_orderkey || '-' || CASE WHEN l_orderkey % 19 = 0 THEN 0 ELSE cell END AS unit,
  CASE WHEN cell IN (0, 3) THEN 'Y' WHEN l_orderkey % 5 = 0 AND cell = 1 THEN 'Y' WHEN l_orderkey % 7 = 0 THEN 'Q' ELSE 'N' END AS label
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS cell FROM lineitem))"""


@query("quartet_audit", f"""WITH {QUARTET_ROWS}, g AS (SELECT case_id, count(*) AS rows, bool_and(kind = 'real') AS all_real, bool_and(trim(claim) <> '') AS hc, bool_and(trim(evidence) <> '') AS he, count(DISTINCT unit) AS nu,
  count(DISTINCT claim) AS nc, count(DISTINCT evidence) AS ne, count(DISTINCT page) AS np, count(DISTINCT claim || '-' || evidence) AS cells, count(*) FILTER (WHERE label = 'Y') AS yes,
  count(DISTINCT CASE WHEN label <> 'Y' THEN label END) AS nn, min(CASE WHEN label <> 'Y' THEN label END) AS neg, string_agg(CASE WHEN label = 'Y' THEN 'Y' ELSE 'n' END, '' ORDER BY claim, evidence, label) AS shape FROM rows GROUP BY case_id),
x AS (SELECT case_id, rows, neg, CASE WHEN rows <> 4 THEN 'row_count' WHEN NOT all_real THEN 'non_real' WHEN NOT hc THEN 'invalid_claim' WHEN NOT he THEN 'invalid_evidence' WHEN nu <> 4 THEN 'duplicate_unique_id'
  WHEN nc <> 2 OR ne <> 2 OR np <> 1 THEN 'dimensions' WHEN cells <> 4 THEN 'duplicate_cartesian_cell' WHEN yes <> 2 OR nn <> 1 OR shape NOT IN ('YnnY', 'nYYn') THEN 'label_pattern' WHEN neg NOT IN ('N') THEN 'unsupported_label' END AS reason FROM g)
SELECT case_id, rows, reason, CASE WHEN reason IS NULL THEN neg END AS negative_label FROM x""")
def quartet_audit(spark, sf):
    from ..sources.fixtures import ORDER
    from pyspark.sql.window import Window

    lines = table(spark, sf, "lineitem").withColumn("cell", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER)) - 1)
    rows = lines.selectExpr(
        "l_orderkey AS case_id",
        "CASE WHEN l_orderkey % 17 = 0 AND l_quantity > 40 THEN 'other' ELSE 'real' END AS kind",
        "concat('c', cell div 2) AS claim",
        "CASE WHEN l_orderkey % 13 = 0 AND cell = 3 THEN ' ' ELSE concat('e', cell % 2) END AS evidence",
        "CASE WHEN l_orderkey % 11 = 0 THEN concat('p', cell) ELSE 'p' END AS page",
        "concat('u', l_orderkey, '-', CASE WHEN l_orderkey % 19 = 0 THEN 0 ELSE cell END) AS unit",
        "CASE WHEN cell IN (0, 3) THEN 'Y' WHEN l_orderkey % 5 = 0 AND cell = 1 THEN 'Y' WHEN l_orderkey % 7 = 0 THEN 'Q' ELSE 'N' END AS label",
    )
    return A.audit_quartets(rows, "case_id", "kind", "claim", "evidence", "page", "unit", "label", "real", "Y", ["N"])


@query("violations", f"""WITH {CELLS}, v AS (SELECT stratum, count(*) FILTER (WHERE NOT (base_score > 1)) AS large_score, count(*) FILTER (WHERE base_pred <> treat_pred) AS same_label, count(*) FILTER (WHERE NOT treat_ok) AS complete FROM cells GROUP BY stratum)
SELECT stratum, 'large_score' AS "check", large_score AS broken FROM v UNION ALL SELECT stratum, 'same_label', same_label FROM v UNION ALL SELECT stratum, 'complete', complete FROM v""")
def violations(spark, sf):
    return A.violations(cells(spark, sf), {"large_score": F.col("base_score") > 1, "same_label": F.col("base_pred") == F.col("treat_pred"), "complete": F.col("treat_ok")}, ("stratum",))


@query("functional_keys", "SELECT l_suppkey, count(DISTINCT l_partkey) AS values FROM lineitem GROUP BY l_suppkey HAVING count(DISTINCT l_partkey) > 1")
def functional_keys(spark, sf):
    return A.functional(table(spark, sf, "lineitem"), "l_suppkey", "l_partkey")


@query("ledger", """WITH a AS (SELECT 'segment' AS kind, c_mktsegment AS name, count(*) AS rows, round(avg(c_acctbal), 4) AS metric FROM customer GROUP BY ALL UNION ALL SELECT 'priority', o_orderpriority, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY ALL)
SELECT *, sha256(kind || '|' || name || '|' || rows) AS row_id FROM a""")
def ledger(spark, sf):
    a = table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("c_acctbal"), 4).alias("metric")).withColumn("kind", F.lit("segment"))
    b = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("name")).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("o_totalprice"), 4).alias("metric")).withColumn("kind", F.lit("priority"))
    return A.ledger(a.unionByName(b), ["kind", "name", "rows"]).select("kind", "name", "rows", "metric", "row_id")


@query("population_flow", """SELECT c_mktsegment, count(*) AS orders, count(DISTINCT o_custkey) AS customers, count(*) FILTER (WHERE o_orderstatus = 'F') AS kept, count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_custkey END) AS kept_customers
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment""")
def population_flow(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    kept = F.col("o_orderstatus") == "F"
    return o.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.count_if(kept).alias("kept"), F.countDistinct(F.when(kept, F.col("o_custkey"))).alias("kept_customers"))


@query("split_membership", """WITH m AS (SELECT o_orderkey, 1 AS o, 'urgent' AS name FROM orders WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT o_orderkey, 2, 'open' FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey, 3, 'large' FROM orders WHERE o_totalprice > 100000)
SELECT o_orderkey, string_agg(name, ',' ORDER BY o) AS splits FROM m GROUP BY o_orderkey""")
def split_membership(spark, sf):
    name = F.array_compact(F.array(F.when(F.col("o_orderpriority") == "1-URGENT", F.lit("urgent")), F.when(F.col("o_orderstatus") == "O", F.lit("open")), F.when(F.col("o_totalprice") > 100000, F.lit("large"))))
    return table(spark, sf, "orders").select("o_orderkey", F.array_join(name, ",").alias("splits")).where("splits <> ''")


# store

STORE = """arriving AS (SELECT user_id::VARCHAR || '-' || (event_id % 50) AS owner_key, CASE WHEN event_type IN ('click', 'view') THEN 'hard' ELSE 'probability' END AS stage,
  CASE WHEN value > 5 THEN 'ok' ELSE 'error' END AS status, sha256((event_id % 3)::VARCHAR) AS payload_sha256, event_id FROM events)"""


def _arriving(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 50).cast("string")).alias("owner_key"),
        F.when(F.col("event_type").isin("click", "view"), "hard").otherwise("probability").alias("stage"),
        F.when(F.col("value") > 5, "ok").otherwise("error").alias("status"),
        F.sha2((F.col("event_id") % 3).cast("string"), 256).alias("payload_sha256"),
        "event_id",
    )


@query("store_ingest", f"""WITH {STORE}, stored AS (SELECT DISTINCT ON (owner_key, stage) owner_key, stage, payload_sha256 FROM arriving WHERE event_id % 4 = 0 ORDER BY owner_key, stage, payload_sha256, status),
e AS (SELECT owner_key, stage, min(status) AS status, min(payload_sha256) AS payload_sha256, count(DISTINCT payload_sha256 || status) AS versions FROM arriving WHERE event_id % 4 <> 0 GROUP BY ALL)
SELECT e.owner_key, e.stage, CASE WHEN versions > 1 OR e.payload_sha256 <> s.payload_sha256 THEN 'conflict' WHEN s.payload_sha256 IS NULL THEN 'added' END AS outcome FROM e LEFT JOIN stored s USING (owner_key, stage)
WHERE versions > 1 OR s.payload_sha256 IS NULL OR e.payload_sha256 <> s.payload_sha256""")
def store_ingest(spark, sf):
    all_ = _arriving(spark, sf)
    first = all_.where("event_id % 4 = 0").groupBy("owner_key", "stage").agg(F.min(F.struct("payload_sha256", "status")).alias("s")).select("owner_key", "stage", "s.status", "s.payload_sha256")
    new, conflicts = store.ingest(first, all_.where("event_id % 4 <> 0").drop("event_id"))
    return new.select("owner_key", "stage", F.lit("added").alias("outcome")).unionByName(conflicts.withColumn("outcome", F.lit("conflict")))


@query("store_progress", f"""WITH {STORE} SELECT stage, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'error') AS error, count(*) = 600 AS complete FROM arriving GROUP BY stage""")
def store_progress(spark, sf):
    return store.progress(_arriving(spark, sf), 600, ["hard", "probability"])


@query("dependency_errors", f"""WITH {STORE}, p AS (SELECT split_part(owner_key, '-', 1) AS parent, stage, min(status) AS ps FROM arriving WHERE event_id % 3 = 0 GROUP BY ALL)
SELECT a.event_id, a.stage, CASE WHEN ps IS NULL THEN 'missing_parent' WHEN ps = 'error' THEN 'query_' || a.stage || '_dependency_error' END AS error_code FROM arriving a LEFT JOIN p ON split_part(a.owner_key, '-', 1) = p.parent AND a.stage = p.stage""")
def dependency_errors(spark, sf):
    a = _arriving(spark, sf).withColumn("parent", F.split_part("owner_key", F.lit("-"), F.lit(1)))
    parents = a.where("event_id % 3 = 0").groupBy(F.col("parent").alias("owner_key"), "stage").agg(F.min("status").alias("status"))
    return store.dependency_errors(a.select("event_id", "stage", "parent"), parents, "parent").select("event_id", "stage", "error_code")


@query("windowed_counts", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS rows FROM events GROUP BY ALL")
def windowed_counts(spark, sf):
    return store.windowed_counts(table(spark, sf, "events"), "ts", "event_type").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))
