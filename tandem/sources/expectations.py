"""Expectations of a scan or a write, measured while its rows pass: no second scan."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .readers import canonical_text, scan_lines
from .shared import written


class Expectations:
    """Named aggregates and what they must be: a value, or a function that says whether it will do.

    ``rows``, ``labels`` and ``finite`` add the usual ones. They are observed in the very job
    that writes the rows, so they cost no scan of their own.
    """

    def __init__(self) -> None:
        self.measures: dict[str, Column] = {}
        self.wanted: dict[str, Any] = {}

    def expect(self, name: str, measure: Column, wanted: Any | Callable[[Any], bool]) -> Expectations:
        self.measures[name], self.wanted[name] = measure, wanted
        return self

    def rows(self, wanted: int) -> Expectations:
        return self.expect("rows", F.count(F.lit(1)), wanted)

    def labels(self, column: str, wanted: dict[str, int]) -> Expectations:
        """How many rows each label has; no other label, and no null, may occur."""
        for label, n in wanted.items():
            self.expect(f"{column} {label}", F.count_if(F.col(column) == label), n)
        return self.expect(f"other {column}", F.count_if(~F.coalesce(F.col(column).isin(*wanted), F.lit(False))), 0)

    def finite(self, *columns: str) -> Expectations:
        """Values that are null or not finite: none."""
        for c in columns:
            value = F.col(c).cast("double")
            self.expect(f"{c} not finite", F.count_if(~F.coalesce(F.abs(value) < float("inf"), F.lit(False))), 0)
        return self

    def within(self, column: str, low: float, high: float) -> Expectations:
        return self.expect(f"{column} outside {low} to {high}", F.count_if(~F.coalesce(F.col(column).between(low, high), F.lit(False))), 0)

    def holds(self, name: str, condition: Column) -> Expectations:
        return self.expect(f"not {name}", F.count_if(~F.coalesce(condition, F.lit(False))), 0)

    def broken(self, found: dict[str, Any]) -> list[str]:
        """What was found otherwise than wanted, in the order of expectation."""
        return [f"{name} is {found[name]}" + ("" if callable(wanted) else f", not {wanted}") for name, wanted in self.wanted.items() if not (wanted(found[name]) if callable(wanted) else found[name] == wanted)]


def checked(frame: DataFrame, expectations: Expectations, label: str) -> DataFrame:
    """``frame`` written into the shared folder and read again; rows that break an expectation are never given out."""
    seen = Observation(label)
    out = written(frame.observe(seen, *(m.alias(n) for n, m in expectations.measures.items())), label)
    if broken := expectations.broken(seen.get):
        raise ValueError(f"{label}: " + "; ".join(broken))
    return out


#: A released result of two stages, each payload with the digest of its canonical JSON.
STAGES = "owner_key string, metadata string, metadata_sha256 string, hard_payload string, hard_payload_sha256 string, hard_status string, hard_error_code string, probability_payload string, probability_payload_sha256 string, probability_status string, probability_error_code string"
METADATA = "sample_id string, table_id string, gold_label string, control string, table_truncated boolean"
PAYLOAD = "scored_label string, hard_label_method string, direct_logit_method string"


def scan_condition(spark: SparkSession, path: str, labels: dict[str, int], tables: int, most_of_a_table: int, methods: tuple[str, str], name: str = "condition") -> DataFrame:
    """One condition of a gated study: owner_key, sample_id, table_id, gold_label, hard_label, probability_label.

    One scan of the lines checks every payload against its digest, both stages complete, their
    labels equal and known, whole tables under full control, and the population: rows and labels
    as ``labels`` has them. The owners (unique) and tables (``tables``, of ``most_of_a_table``
    rows at most) are counted on the narrow rows that the scan has written.
    """
    raw = scan_lines(spark, path, STAGES)
    rows = raw.select("*", F.from_json("metadata", METADATA).alias("m"), F.from_json("hard_payload", PAYLOAD).alias("h"), F.from_json("probability_payload", PAYLOAD).alias("p"))
    hashed = lambda c: F.sha2(canonical_text(F.col(c)), 256) == F.col(f"{c}_sha256")
    checks = Expectations().rows(sum(labels.values())).labels("gold_label", labels)
    for stage in ("metadata", "hard_payload", "probability_payload"):
        checks.holds(f"{stage} as hashed", F.col(f"{stage}_ok"))
    for what in ("complete", "whole", "owned", "agreeing", "by_method"):
        checks.holds(what, F.col(what))
    told = rows.select(
        "owner_key", "m.sample_id", "m.table_id", "m.gold_label", F.col("h.scored_label").alias("hard_label"), F.col("p.scored_label").alias("probability_label"),
        *(hashed(c).alias(f"{c}_ok") for c in ("metadata", "hard_payload", "probability_payload")),
        ((F.col("hard_status") == "ok") & (F.col("probability_status") == "ok") & F.col("hard_error_code").isNull() & F.col("probability_error_code").isNull()).alias("complete"),
        ((F.col("m.control") == "full") & ~F.col("m.table_truncated") & (F.col("m.table_id") != "")).alias("whole"),
        ((F.col("m.sample_id") != "") & (F.col("owner_key") == F.concat("m.sample_id", F.lit("|full")))).alias("owned"),
        ((F.col("h.scored_label") == F.col("p.scored_label")) & F.col("h.scored_label").isin(*labels)).alias("agreeing"),
        ((F.col("h.hard_label_method") == methods[0]) & (F.col("p.direct_logit_method") == methods[1])).alias("by_method"),
    )
    out = checked(told, checks, name).select("owner_key", "sample_id", "table_id", "gold_label", "hard_label", "probability_label")
    sizes = out.groupBy("table_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("tables"), F.max("n").alias("most")).first()
    owners = out.groupBy("owner_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).count()
    if owners or sizes.tables != tables or (sizes.most or 0) != most_of_a_table:
        raise ValueError(f"{name}: {'an owner comes twice; ' if owners else ''}{sizes.tables} tables of {sizes.most} rows at most, not {tables} of {most_of_a_table}")
    return out
