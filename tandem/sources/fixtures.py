"""Bindings of the engine's inputs to the test tables, in Spark and as SQL with the same rows.

cells: four scored cells for each order with four lines or more. A case is an order, its
cluster the customer; two conditions (base, treat) score every cell.
context: paired observations in the unit interval with missing values, from events.
models: the four score columns of cells' cases, as long rows (case, cluster, model, value).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate", "l_returnflag", "l_linestatus")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    by_order = Window.partitionBy("l_orderkey")
    numbered = (
        lines.withColumn("cell_index", (F.row_number().over(by_order.orderBy(*ORDER)) - 1).cast("int"))
        .withColumn("of", F.count(F.lit(1)).over(by_order))
        .where("of >= 4 AND cell_index < 4")
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus")
    return numbered.join(orders, numbered["l_orderkey"] == orders["o_orderkey"]).selectExpr(
        "l_orderkey AS case_id",
        "o_custkey AS cluster_id",
        "o_orderpriority AS stratum",
        "o_orderstatus AS control",
        "cell_index",
        "l_returnflag AS gold",
        "l_extendedprice * (1 - l_discount) / 10000 AS base_score",
        "l_extendedprice * (1 - l_tax) / 10000 AS treat_score",
        "CASE WHEN l_discount < 0.06 THEN l_returnflag WHEN l_discount < 0.08 THEN 'N' ELSE 'A' END AS base_pred",
        "CASE WHEN l_tax < 0.05 THEN l_returnflag WHEN l_quantity < 25 THEN 'R' ELSE 'N' END AS treat_pred",
        "l_quantity / 50 AS third_score",
        "l_extendedprice / 10000 - l_tax AS fourth_score",
        "l_tax < 0.079 AS treat_ok",
    )


def case_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """case_id of every case of ``cells`` (its cells are 0 to 3): lines are counted, not numbered, so only keys are sent."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("of")).where("of >= 4")
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(F.col("l_orderkey").alias("case_id"))


CELLS = """cells AS (
  SELECT n.l_orderkey AS case_id, o.o_custkey AS cluster_id, o.o_orderpriority AS stratum, o.o_orderstatus AS control,
    CAST(n.cell AS INTEGER) AS cell_index, n.l_returnflag AS gold,
    l_extendedprice * (1 - l_discount) / 10000 AS base_score, l_extendedprice * (1 - l_tax) / 10000 AS treat_score,
    CASE WHEN l_discount < 0.06 THEN l_returnflag WHEN l_discount < 0.08 THEN 'N' ELSE 'A' END AS base_pred,
    CASE WHEN l_tax < 0.05 THEN l_returnflag WHEN l_quantity < 25 THEN 'R' ELSE 'N' END AS treat_pred,
    l_quantity / 50 AS third_score, l_extendedprice / 10000 - l_tax AS fourth_score, l_tax < 0.079 AS treat_ok
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
      l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) - 1 AS cell, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM lineitem) n
  JOIN orders o ON n.l_orderkey = o.o_orderkey WHERE n.lines >= 4 AND n.cell < 4)"""


def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, kind, hit_base, hit_treat, use_base, use_treat (null where missing)."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS sample_id",
        "user_id AS query_id",
        "CASE WHEN event_type IN ('click', 'view') THEN 'gold' WHEN event_type IN ('purchase') THEN 'conflicting' ELSE 'irrelevant' END AS kind",
        "value > 40 AS hit_base",
        "value > 45 AS hit_treat",
        "CASE WHEN event_id % 7 = 0 THEN NULL ELSE (value % 50) / 25 - 1 END AS use_base",
        "CASE WHEN event_id % 11 = 0 THEN NULL ELSE (value % 40) / 20 - 1 END AS use_treat",
    )


CONTEXT = """context AS (
  SELECT event_id AS sample_id, user_id AS query_id,
    CASE WHEN event_type IN ('click', 'view') THEN 'gold' WHEN event_type IN ('purchase') THEN 'conflicting' ELSE 'irrelevant' END AS kind,
    value > 40 AS hit_base, value > 45 AS hit_treat,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE (value % 50) / 25 - 1 END AS use_base,
    CASE WHEN event_id % 11 = 0 THEN NULL ELSE (value % 40) / 20 - 1 END AS use_treat FROM events)"""
