"""Nested reports as rows: leaves by JSON pointer, adapters by patterns of them, links from shown values to their sources."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .metrics import balanced_accuracy

LEAF = ("path", "kind", "number", "text")


def _pointer(path: Column, key: Column, pos: Column) -> Column:
    """One step further: ``~`` and ``/`` of a field name are written ~0 and ~1, an element is its place."""
    name = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))
    return F.concat(path, F.lit("/"), F.coalesce(name, pos.cast("string")))


def flattened(reports: DataFrame, json: str, keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """The leaves of JSON of any shape and depth as rows: ``keys``, path (a JSON pointer), kind, number, text.

    kind is number, string, boolean, null, or empty for {} and []. Text that isn't JSON is an
    error. Each level is one lateral explosion of VARIANT values, so no schema is needed and
    no report is ever one task's recursion.
    """
    spark = reports.sparkSession
    level = reports.select(*keys, F.lit("").alias("path"), F.parse_json(json).alias("v")).where("v IS NOT NULL")
    out: DataFrame | None = None
    while True:
        # what has no elements comes back as it is, with its kind; only leaves are asked for their shape
        exploded = level.lateralJoin(spark.tvf.variant_explode_outer(F.col("v").outer()))
        leaf = F.col("pos").isNull()
        path = F.when(leaf, F.col("path")).otherwise(_pointer(F.col("path"), F.col("key"), F.col("pos")))
        step = written(exploded.select(*keys, path.alias("path"), F.when(leaf, F.col("v")).otherwise(F.col("value")).alias("v"), leaf.alias("leaf")), "report-level")
        shape = F.schema_of_variant("v")
        kind = F.when(shape == "VOID", "null").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape.rlike("^(OBJECT|ARRAY)<"), "empty").otherwise("number")
        told = step.where("leaf").select(*keys, "path", kind.alias("kind"), "v").select(*keys, "path", "kind", F.when(F.col("kind") == "number", F.try_variant_get("v", "$", "double")).alias("number"), F.try_variant_get("v", "$", "string").alias("text"))
        out = told if out is None else out.unionByName(told)
        level = step.where("NOT leaf").drop("leaf")
        if level.limit(1).count() == 0:
            return out


def adapted(leaves: DataFrame, patterns: dict[str, str], keys: tuple[str, ...] = ("source",)) -> DataFrame:
    """Ledger rows from leaves whose path fits a pattern, such as /models/{model}/contrasts/{contrast}/{metric}.

    ``patterns``: by role. Braces name one step each; the names of all patterns are columns, null
    where a pattern lacks them. A step ``*`` may be anything and isn't kept. The number of a leaf
    comes once for every role that it fits; leaves that aren't numbers are left out.
    """
    names = sorted({n for p in patterns.values() for n in re.findall(r"\{(\w+)\}", p)})
    out: DataFrame | None = None
    for role, pattern in patterns.items():
        steps = [s if s.startswith("{") or s == "*" else re.escape(s) for s in pattern.split("/")]
        order = re.findall(r"\{(\w+)\}", pattern)
        regex = "^" + "/".join("([^/]+)" if s.startswith("{") else "[^/]+" if s == "*" else s for s in steps) + "$"
        plain = lambda c: F.replace(F.replace(c, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~"))
        value = lambda n, order=order, regex=regex: plain(F.regexp_extract("path", regex, order.index(n) + 1)) if n in order else F.lit(None).cast("string")
        told = leaves.where((F.col("kind") == "number") & F.col("path").rlike(regex)).select(F.lit(role).alias("role"), *keys, *(value(n).alias(n) for n in names), F.col("number").alias("value"))
        out = told if out is None else out.unionByName(told)
    return out


#: A row by its identity, then the steps below it: rows[row_id=1f].metrics.a[2]
BY_ROW = r"^rows\[row_id=([0-9a-f]+)\]\.(.+)$"


def resolved(references: DataFrame, leaves: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """``references`` (source, address, number, text) with ``status``: what the addressed leaf of the source says.

    An address is a JSON pointer, or ``rows[row_id=...]`` and steps with dots. Numbers agree
    within a relative or absolute tolerance, anything else exactly. status: ok, differs,
    missing, or row_not_unique.
    """
    row = r"^(/rows/[0-9]+)/row_id$"
    rows = leaves.where(F.col("path").rlike(row)).groupBy("source", F.col("text").alias("row")).agg(F.min(F.regexp_extract("path", row, 1)).alias("prefix"), F.count(F.lit(1)).alias("rows"))
    steps = F.regexp_replace(F.replace(F.regexp_extract("address", BY_ROW, 2), F.lit("."), F.lit("/")), r"\[([0-9]+)\]", "/$1")
    asked = references.withColumn("row", F.when(F.col("address").rlike(BY_ROW), F.regexp_extract("address", BY_ROW, 1))).join(rows, ["source", "row"], "left")
    asked = asked.withColumn("path", F.when(F.col("row").isNull(), F.col("address")).otherwise(F.concat("prefix", F.lit("/"), steps)))
    found = leaves.select("source", "path", F.col("kind").alias("found_kind"), F.col("number").alias("found_number"), F.col("text").alias("found_text"))
    met = asked.join(found, ["source", "path"], "left")
    near = F.abs(F.col("number") - F.col("found_number")) <= F.greatest(F.lit(tolerance), tolerance * F.greatest(F.abs("number"), F.abs("found_number")))
    same = F.when(F.col("number").isNotNull(), near).otherwise(F.col("text").eqNullSafe(F.col("found_text")))
    status = F.when(F.col("rows") > 1, "row_not_unique").when(F.col("found_kind").isNull(), "missing").when(F.coalesce(same, F.lit(False)), "ok").otherwise("differs")
    return met.select("source", "address", "number", "text", status.alias("status"))


# published numbers from released rows


def released_numbers(rows: DataFrame, conditions: tuple[str, str], labels: list[str]) -> DataFrame:
    """(path, value) of what a two-condition study publishes, from its released cells alone.

    Rows: condition, case_id, cluster_id, cell_index, gold, prediction, score. Every case has its
    four cells once in both conditions, with the same cluster and gold labels; else it is an error.
    """
    cell = lambda i, name, c: F.max(F.when((F.col("cell_index") == i) & (F.col("condition") == name), F.col(c)))
    interaction = lambda name: (cell(0, name, "score") - cell(1, name, "score") - cell(2, name, "score") + cell(3, name, "score")) / 2
    left, right = conditions
    # a bit for each of the eight cells: a distinct count would send every row with all its columns
    place = F.when(F.col("condition") == left, 0).when(F.col("condition") == right, 4) + F.when(F.col("cell_index").between(0, 3), F.col("cell_index"))
    bit = reduce(lambda c, i: c.when(place == i, 1 << i), range(1, 8), F.when(place == 0, 1))
    cases = rows.groupBy("case_id").agg(
        F.min("cluster_id").alias("page"), (interaction(right) - interaction(left)).alias("effect"), F.count(F.lit(1)).alias("rows"), F.bit_or(bit).alias("cells"), (F.min("cluster_id") == F.max("cluster_id")).alias("one_page"),
        *((cell(i, left, "gold") == cell(i, right, "gold")).alias(f"gold_{i}") for i in range(4)),
    )
    whole = (F.col("rows") == 8) & (F.col("cells") == 255) & F.col("one_page")
    for i in range(4):
        whole &= F.coalesce(F.col(f"gold_{i}"), F.lit(False))
    guard = F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("cells of case "), F.col("case_id").cast("string"), F.lit(" aren't paired"))).cast("boolean"))
    pages = cases.where(guard).groupBy("page").agg(F.avg("effect").alias("effect"), F.sum("effect").alias("sum"), F.count(F.lit(1)).alias("cases"))
    told = pages.agg(F.avg("effect").alias("/primary/estimate"), (F.sum("sum") / F.sum("cases")).alias("/primary/case_weighted"), F.sum("cases").cast("double").alias("/population/cases"), F.count(F.lit(1)).cast("double").alias("/population/pages"))
    out = told.unpivot([], told.columns, "path", "value")
    for name in conditions:
        metric = balanced_accuracy(rows.where(F.col("condition") == name), "gold", "prediction", labels)
        out = out.unionByName(metric.select(F.lit(f"/balanced_accuracy/{name}").alias("path"), F.col(metric.columns[0]).alias("value")))
    return out


def recomputed(published: DataFrame, numbers: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """Published leaves (path, number) beside recomputed ones (path, value), with whether they agree within an absolute tolerance."""
    both = published.select("path", F.col("number").alias("published")).join(numbers, "path", "full_outer")
    return both.select("path", "published", F.col("value").alias("recomputed"), F.coalesce(F.abs(F.col("published") - F.col("value")) <= tolerance, F.lit(False)).alias("agrees"))
