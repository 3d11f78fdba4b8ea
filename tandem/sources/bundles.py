"""Report bundles: results, their text, the sources they rest on, and a manifest with its own digest, written last."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .readers import inventory
from .sinks import markdown

RESULTS, TEXT, SOURCES, MANIFEST = "results", "analysis", "sources", "manifest"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """path and sha256 of the data files of a bundle's parts (a few small files)."""
    found = inventory(spark, folder, exclude=r"(^|/)([._][^/]*)$").where(~F.col("path").startswith(f"{MANIFEST}/"))
    return found.select("path", "bytes", "sha256")


def _sealed(files: list) -> dict:
    body = {"files": {f.path: f.sha256 for f in sorted(files, key=lambda f: f.path)}}
    return body | {"manifest_sha256": hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()}


def write_bundle(results: DataFrame, folder: str, keys: list[str], sources: DataFrame, parameters: dict[str, str]) -> dict:
    """A small result table as JSON and Markdown with its sources (role, path, sha256) and parameters; the manifest comes last.

    Sources must be named and digested, or nothing is written. An existing folder is an error.
    Returns the manifest: the digest of every file, and its own.
    """
    spark = results.sparkSession
    told = sources.select("role", "path", "sha256")
    bad = told.where("role IS NULL OR role = '' OR path IS NULL OR sha256 IS NULL OR NOT sha256 RLIKE '^[0-9a-f]{64}$'").limit(1).count()
    if bad or told.limit(1).count() == 0:
        raise ValueError("a report needs sources, each with its role, path and digest")
    results.coalesce(1).sortWithinPartitions(*keys).write.mode("errorifexists").json(f"{folder}/{RESULTS}")
    markdown(results, keys).coalesce(1).write.mode("errorifexists").text(f"{folder}/{TEXT}")
    setting = spark.createDataFrame([("parameter", k, v) for k, v in sorted(parameters.items())], "role string, path string, sha256 string")
    told.unionByName(setting).coalesce(1).sortWithinPartitions("role", "path").write.mode("errorifexists").json(f"{folder}/{SOURCES}")
    sealed = _sealed(_files(spark, folder).collect())  # a few files
    spark.createDataFrame([(json.dumps(sealed, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(f"{folder}/{MANIFEST}")
    return sealed


def read_bundle(spark: SparkSession, folder: str, schema: str, sources: DataFrame | None = None) -> DataFrame:
    """The results of a bundle that is as its manifest says; if given, ``sources`` (role, sha256) as they are now must agree.

    A file that was added, lost or changed, a manifest that was, or a source that differs is an error.
    """
    told = json.loads(spark.read.text(f"{folder}/{MANIFEST}").first()[0])
    now = _sealed(_files(spark, folder).collect())
    if told != now:
        names = {*told.get("files", {}), *now["files"]}
        wrong = sorted(n for n in names if told.get("files", {}).get(n) != now["files"].get(n)) or [MANIFEST]
        raise ValueError(f"{wrong[0]} isn't what the manifest says")
    if sources is not None:
        kept = spark.read.schema("role string, path string, sha256 string").json(f"{folder}/{SOURCES}").where("role <> 'parameter'")
        drift = kept.select("role", F.col("sha256").alias("then")).join(sources.select("role", "sha256"), "role", "full_outer").where("NOT `then` <=> sha256").limit(1).collect()
        if drift:
            raise ValueError(f"source {drift[0].role} has changed")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{RESULTS}")
