"""Ranks over any number of rows: ranges sorted side by side, counted, and shifted by what lies before them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import written

#: monotonically_increasing_id() has the row's place in its partition in so many bits.
PLACE_BITS = 33


@dataclass(frozen=True)
class Ranges:
    """``rows`` with ``part`` (the range) and ``at``; ``runs``: of each part and group its first ``at``, ``start`` in the group, rows, and the group's ``total``."""

    rows: DataFrame
    runs: DataFrame
    within: tuple[str, ...]

    def placed(self, place: str = "place", total: str | None = None) -> DataFrame:
        """The rows with their gapless place from 0 in their group, and if named the group's size."""
        runs = self.runs.select(F.col("part").alias("__part"), F.col("first").alias("__first"), F.col("start").alias("__start"), F.col("total").alias("__total"), *(F.col(c).alias(f"__{c}") for c in self.within))
        same = F.col("part") == F.col("__part")
        for c in self.within:
            same &= F.col(c).eqNullSafe(F.col(f"__{c}"))
        out = self.rows.join(runs, same).withColumn(place, F.col("__start") + F.col("at") - F.col("__first"))
        out = out.withColumn(total, F.col("__total")) if total else out
        return out.drop("__part", "__first", "__start", "__total", *(f"__{c}" for c in self.within))


def ranges(rows: DataFrame, by: list[str | Column], within: tuple[str, ...] = ()) -> Ranges:
    """``rows`` in sorted ranges of (within, by), written once, with the runs of each group in each range.

    A group of any size is spread over as many ranges as it fills, so no task sorts or ranks
    a whole group; what is summed up afterwards is a row for each range and group. Rows that
    tie in all of ``by`` stay in one range: give a column that tells them apart if they may be many.
    Ranges are cut from a sample, for which ``rows`` is run once more: write costly rows first.
    """
    order = [*within, *by]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    kept = written(dealt.withColumn("part", F.shiftright("at", PLACE_BITS)), "ranges")
    runs = kept.groupBy("part", *within).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("count"))
    before = Window.partitionBy(*within).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*within)
    runs = runs.withColumn("start", F.coalesce(F.sum("count").over(before), F.lit(0))).withColumn("total", F.sum("count").over(whole))
    return Ranges(kept, written(runs, "runs"), within)


def ranked(rows: DataFrame, by: list[str | Column], within: tuple[str, ...] = (), place: str = "place") -> DataFrame:
    """``rows`` with ``place``, gapless from 0 in each group of ``within``, in the order of ``by``."""
    return ranges(rows, by, within).placed(place).drop("part", "at")
