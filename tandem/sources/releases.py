"""Text-free releases of aligned conditions, with manifests, sealed results and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.schema import only_fields, reject_fields
from ..operators.units import alignment_gate, pair_contexts, subset
from .sinks import TEXT_FIELDS, manifest, publish

#: Fields of a released cell.
CELL_FIELDS = ["condition", "owner_key", "control", "case_id", "cluster_id", "cell_index", "gold", "prediction", "score"]


def aligned_records(exports: DataFrame, conditions: int, columns: list[str], ids: DataFrame | None = None, same: tuple[str, ...] = ("control", "case_id", "gold")) -> DataFrame:
    """The allowed fields of N conditions whose owners must be the same with the same metadata; of an id list only, if given."""
    exports = exports.select(*dict.fromkeys((*only_fields(exports, columns).columns, "condition", "owner_key", *same)))
    if ids is not None:
        exports = subset(exports, ids, ids.columns[0])
    broken = alignment_gate(exports, conditions, [*same]).where("broken > 0").collect()  # a row for each check
    if broken:
        raise ValueError("conditions aren't aligned: " + ", ".join(f"{b['check']} {b['broken']}" for b in broken))
    return reject_fields(only_fields(exports, columns), TEXT_FIELDS)


def context_records(comparisons: dict[str, tuple[DataFrame, DataFrame]], identity: list[str], target: str, kind: str, values: list[str]) -> DataFrame:
    """Paired scalars of several comparisons; a pair that doesn't match is an error."""
    out = None
    for name, (left, right) in comparisons.items():
        pairs = pair_contexts(left, right, identity, target, kind, values)
        guard = F.when(F.col("status") == "ok", True).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), "status")).cast("boolean"))
        told = pairs.where(guard).drop("status").withColumn("comparison", F.lit(name))
        out = told if out is None else out.unionByName(told)
    return reject_fields(out, TEXT_FIELDS)


def source_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source, bytes and sha256 of every file that a release was made from."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("source"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def release(records: DataFrame, folder: str, keys: list[str], sources: DataFrame, kind: str = "json") -> DataFrame:
    """Records (lines of JSON, or Parquet) under ``folder``/records, their files and sources under ``folder``/manifest, written last; returns the manifest."""
    files = publish(records, f"{folder}/records", keys, kind=kind)
    told = files.select(F.lit("record").alias("kind"), F.col("file").alias("name"), "bytes", "sha256").unionByName(sources.select(F.lit("source").alias("kind"), F.col("source").alias("name"), "bytes", "sha256"))
    told.repartition(1).write.mode("errorifexists").json(f"{folder}/manifest")  # one file of names; the digests are made by many tasks
    return read_release_manifest(records.sparkSession, folder)


def read_release_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("kind string, name string, bytes long, sha256 string").option("mode", "FAILFAST").json(f"{folder}/manifest")


def verify_release(spark: SparkSession, folder: str, sources: DataFrame | None = None) -> None:
    """Files and sources as the manifest has them; anything added, lost or changed is an error."""
    told = read_release_manifest(spark, folder)
    now = manifest(spark, f"{folder}/records").select(F.lit("record").alias("kind"), F.col("file").alias("name"), "sha256")
    if sources is not None:
        now = now.unionByName(sources.select(F.lit("source").alias("kind"), F.col("source").alias("name"), "sha256"))
    else:
        told = told.where("kind = 'record'")
    drift = now.join(told.select("kind", "name", F.col("sha256").alias("then")), ["kind", "name"], "full_outer").where("NOT sha256 <=> then")
    if found := drift.limit(1).collect():
        raise ValueError(f"{found[0]['kind']} {found[0]['name']} isn't what the manifest says")


def seal(results: DataFrame, folder: str, keys: list[str]) -> str:
    """A small result table written once as JSON, its digest beside it; returns the digest."""
    results.coalesce(1).sortWithinPartitions(*keys).write.mode("errorifexists").json(f"{folder}/result")
    digest = manifest(results.sparkSession, f"{folder}/result").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256).alias("digest"))  # one file
    digest.write.mode("errorifexists").text(f"{folder}/digest")
    return digest.first()[0]


def unsealed(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """A sealed result, read back; a digest that differs is an error."""
    now = manifest(spark, f"{folder}/result").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("sha256")), "\n"), 256)).first()[0]
    if spark.read.text(f"{folder}/digest").first()[0] != now:
        raise ValueError("the result isn't what its digest says")
    return spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/result")


def read_release(spark: SparkSession, folder: str, schema: str, conditions: list[str] | None = None, kind: str = "json") -> DataFrame:
    """Records of a verified release; the conditions it must hold, if named, are checked."""
    verify_release(spark, folder)
    rows = spark.read.schema(schema).option("mode", "FAILFAST").format(kind).load(f"{folder}/records")
    if conditions is not None:
        present = sorted(r[0] for r in rows.select("condition").distinct().limit(len(conditions) + 1).collect())
        if present != sorted(conditions):
            raise ValueError(f"the release holds {', '.join(present)}")
    return rows
