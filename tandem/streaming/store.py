"""A two-stage result store: a unit's stage is written once, replays are no-ops, conflicts are reported.

``ingest`` is the batch step; ``stream_into`` runs it for every micro-batch of a stream, so
a restarted query replays batches without effect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

KEY = ["owner_key", "stage"]


def digest(*columns: str):
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256)


def ingest(stored: DataFrame, arriving: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to add, conflicts). Rows: owner_key, stage, status, payload_sha256.

    Of several arrivals of one key with one payload, one is added; arrivals that differ from
    the stored payload, or from each other, are conflicts and none of them is added.
    """
    each = arriving.groupBy(*KEY).agg(F.min(F.struct("payload_sha256", "status")).alias("least"), F.countDistinct("payload_sha256", "status").alias("versions"))
    each = each.select(*KEY, F.col("least.status").alias("status"), F.col("least.payload_sha256").alias("payload_sha256"), "versions")
    known = stored.select(*KEY, F.col("payload_sha256").alias("stored_sha256"))
    met = each.join(known, KEY, "left")
    new = met.where("stored_sha256 IS NULL AND versions = 1").select(*KEY, "status", "payload_sha256")
    conflicts = met.where("versions > 1 OR payload_sha256 <> stored_sha256").select(*KEY)
    return new, conflicts


def dependency_errors(children: DataFrame, parents: DataFrame, parent: str) -> DataFrame:
    """Children with the error that a failed or missing parent gives them."""
    p = parents.select(F.col("owner_key").alias(parent), "stage", F.col("status").alias("parent_status"))
    joined = children.join(p, [parent, "stage"], "left")
    code = F.when(F.col("parent_status").isNull(), "missing_parent").when(F.col("parent_status") == "error", F.concat(F.lit("query_"), F.col("stage"), F.lit("_dependency_error")))
    return joined.withColumn("error_code", code)


def progress(stored: DataFrame, registered: int, stages: list[str]) -> DataFrame:
    """Completed and failed units of each stage, and whether the stage is complete."""
    counts = stored.groupBy("stage").agg(F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("error"))
    return counts.where(F.col("stage").isin(stages)).withColumn("complete", F.col("ok") + F.col("error") == registered)


def stream_into(arriving: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Every micro-batch of ``arriving`` ingested into the Parquet store at ``path``; conflicts go to ``<path>-conflicts``."""

    def step(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        try:
            stored = spark.read.parquet(path)
        except Exception as missing:  # the first batch makes the store
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            stored = spark.createDataFrame([], "owner_key string, stage string, status string, payload_sha256 string")
        batch = batch.persist()
        new, conflicts = ingest(stored, batch)
        new.write.mode("append").parquet(path)
        conflicts.withColumn("batch", F.lit(number)).write.mode("append").parquet(f"{path}-conflicts")
        batch.unpersist()

    return arriving.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Tumbling-window counts with a watermark; works on streams and tables."""
    frame = events.withWatermark(time, late) if events.isStreaming else events
    return frame.groupBy(F.window(time, window).alias("w"), key).agg(F.count(F.lit(1)).alias("rows")).select(F.col("w.start").alias("start"), key, "rows")


def bind_identity(spark: SparkSession, path: str, identity: dict[str, str]) -> str:
    """Bind a store to its run once: ``bound``, or ``known`` if it is bound to the same; another identity is an error."""
    wanted = sorted((str(k), str(v)) for k, v in identity.items())
    try:
        stored = sorted((r["key"], r["value"]) for r in spark.read.parquet(path).collect())  # a few fields
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        spark.createDataFrame(wanted, "key string, value string").coalesce(1).write.mode("errorifexists").parquet(path)
        return "bound"
    if stored != wanted:
        raise ValueError("the store belongs to another run")
    return "known"


def open_cells(expected: DataFrame, finished: DataFrame, key: list[str], complete: str = "complete") -> DataFrame:
    """Cells of a design that have no complete result yet: what a resumed run has to do, and nothing else."""
    return expected.join(finished.where(complete).select(*key).distinct(), key, "left_anti")


def completion(runs: DataFrame, key: list[str], units: int, unit: str, score: str, allowed: tuple[str, list[str]]) -> DataFrame:
    """For each run: whether all units are there once, scores are finite and labels allowed."""
    label, names = allowed
    found = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(unit).alias("units"), F.bool_and(F.coalesce(~F.isnan(score) & (F.abs(score) < float("inf")), F.lit(False))).alias("finite"), F.bool_and(F.coalesce(F.col(label).isin(names), F.lit(False))).alias("labels"))
    return found.withColumn("complete", (F.col("rows") == units) & (F.col("units") == units) & F.col("finite") & F.col("labels"))
