"""Sinks: releases with manifests, write-once and idempotent publication, complete exports, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import only_fields, reject_fields

#: Fields that a released table may not hold at any depth.
TEXT_FIELDS = {"text", "claim", "evidence", "prompt", "html", "messages"}
#: Rows of a published file at most: the manifest reads each file as one value.
FILE_ROWS = 1 << 17


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file, bytes and sha256 of the data files under a published folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def content_digest(frame: DataFrame) -> DataFrame:
    """Number of rows and an order-free digest of them: equal tables have equal digests however they are split."""
    row = F.sha2(F.to_json(F.struct(*sorted(frame.columns)), {"ignoreNullFields": "false"}), 256)
    part = F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")
    return frame.select(part.alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.sum("p").cast("string").alias("digest"))


def publish(frame: DataFrame, folder: str, keys: list[str], columns: list[str] | None = None, kind: str = "json") -> DataFrame:
    """Write once: the allowed columns, without texts, in key order by ranges; returns the manifest.

    Files hold ``FILE_ROWS`` rows at most. An existing folder is an error. Spark's committer makes the folder appear whole, with
    ``_SUCCESS`` last.
    """
    released = reject_fields(only_fields(frame, columns or frame.columns), TEXT_FIELDS)
    ordered = released.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("errorifexists").option("maxRecordsPerFile", FILE_ROWS).format(kind).save(folder)
    return manifest(frame.sparkSession, folder)


def publish_idempotently(frame: DataFrame, folder: str, keys: list[str]) -> str:
    """``written``, or ``unchanged`` if the folder holds the same rows; different rows are an error."""
    spark = frame.sparkSession
    try:
        stored = spark.read.parquet(folder)
    except Exception as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        publish(frame, folder, keys, kind="parquet")
        return "written"
    stored = stored.select(*frame.columns)
    if frame.exceptAll(stored).unionByName(stored.exceptAll(frame)).limit(1).count():
        raise ValueError(f"{folder} holds other rows")
    return "unchanged"


def export_complete(stored: DataFrame, registered: DataFrame, folder: str, key: str, stages: list[str]) -> DataFrame:
    """Publish a store once every registered unit has every stage; returns the manifest."""
    wanted = registered.select(key).distinct().join(F.broadcast(registered.sparkSession.createDataFrame([(s,) for s in stages], "stage string")))
    open_ = wanted.join(stored.select(key, "stage"), [key, "stage"], "left_anti").limit(1).count()
    if open_:
        raise ValueError("units are not complete")
    return publish(stored, folder, [key, "stage"])


def metrics_csv(frame: DataFrame, folder: str, columns: list[str]) -> None:
    """A small table of metrics as one CSV file with a header and blanks for missing values."""
    only_fields(frame, columns).coalesce(1).write.mode("errorifexists").option("header", True).option("nullValue", "").option("emptyValue", "").csv(folder)


def markdown(frame: DataFrame, order: list[str]) -> DataFrame:
    """A small table as one Markdown text."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in frame.columns)), F.lit(" |"))
    head = "| " + " | ".join(frame.columns) + " |\n|" + "---|" * len(frame.columns) + "\n"
    rows = frame.select(F.struct(*order, line.alias("line_")).alias("r")).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return rows.select(F.concat(F.lit(head), F.array_join(F.transform("rs", lambda r: r["line_"]), "\n")).alias("markdown"))
