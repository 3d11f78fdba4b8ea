"""Sources: strict line files, objects, claim tables, id lists, archives, databases, file inventories."""

from __future__ import annotations

import csv
import hashlib
import io
import json
import os
import sqlite3
import tarfile
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_lines(spark: SparkSession, path: str | list[str], schema: str | T.StructType) -> DataFrame:
    """Line-wise JSON objects of a fixed schema in one scan: a blank line, or one that isn't such an object, fails."""
    line = F.col("value")
    fails = lambda why: F.raise_error(F.lit(why)).cast("string")
    told = F.when(F.trim(line) == "", fails("blank line in a line file")).when(~line.rlike(r"^\s*\{"), fails("a line is no object")).otherwise(line)
    return spark.read.text(path).select(F.from_json(told, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str | T.StructType, blank_lines: bool = False) -> DataFrame:
    """Line-wise JSON of a fixed schema; a broken line fails the read, and so does a blank one unless allowed.

    Blank lines are looked for at once; ``scan_lines`` finds them in the one scan that reads the rows.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if not blank_lines and spark.read.text(path).where(F.trim("value") == "").limit(1).count():
        raise ValueError("blank line in a line file")
    return rows


def read_object(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """{table: [claims, labels, caption]} as a row for each claim; lists of unequal length fail."""
    table = F.explode(F.from_json("value", "map<string,array<string>>")).alias("table_id", "parts")
    parts = spark.read.text(path, wholetext=True).select(table)
    claims, labels = F.from_json(F.col("parts")[0], "array<string>"), F.from_json(F.col("parts")[1], "array<int>")
    caption = F.col("parts")[2]
    whole = parts.select("table_id", claims.alias("claims"), labels.alias("labels"), caption.alias("caption"))
    equal = F.when(F.size("claims") == F.size("labels"), F.arrays_zip("claims", "labels")).otherwise(F.raise_error(F.lit("claims and labels differ in number")).cast("array<struct<claims:string,labels:int>>"))
    each = whole.select("table_id", "caption", F.posexplode(equal).alias("claim_index", "c"))
    return each.select("table_id", "claim_index", F.col("c.claims").alias("claim"), F.col("c.labels").alias("label"), "caption")


def read_serialised_tables(spark: SparkSession, path: str, separator: str = "#") -> DataFrame:
    """Delimited tables, each as one text: ``Row i: a | b`` for every record, the first being row 0.

    Cells stay as they are; quoted cells may hold separators and line breaks. A table without
    rows, or with an empty row, fails.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = list(csv.reader(io.StringIO(value, newline=""), delimiter=separator))
                if not rows or not all(rows):
                    raise ValueError(f"{name} has no rows or an empty row")
                texts.append("\n".join(f"Row {i}: " + " | ".join(row) for i, row in enumerate(rows)))
                counts.append(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32())], names=["file", "text", "rows"])

    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")
    return files.mapInArrow(run, "file string, text string, rows int")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Claims of a line-wise manifest: the key must be table and claim number, and no path may leave the project."""
    rows = read_jsonl(spark, path, "sample_id string, table_id string, claim_index int, label int, path string")
    derived = F.col("sample_id").eqNullSafe(F.concat_ws(":", "table_id", "claim_index"))
    inside = F.col("path").isNotNull() & ~F.col("path").rlike(r"^/|^[A-Za-z][A-Za-z0-9+.-]*:|(^|/)\.\.(/|$)")
    message = F.concat(F.lit("a key that its row doesn't give, or a path that leaves the project: "), F.coalesce("sample_id", F.lit("null")))
    guard = F.when(derived & inside, True).otherwise(F.raise_error(message).cast("boolean"))
    return rows.where(guard)


def read_split(ids: DataFrame, quartets: DataFrame, expected: int, key: str = "case_id") -> DataFrame:
    """The quartets of a named split, all of which must exist and be as many as expected."""
    found = quartets.join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")
    if (n := ids.count()) != expected or found.count() != n:
        raise ValueError("the split's ids and quartets differ in number")
    return found


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """One id for each line; empty or repeated ids fail."""
    ids = spark.read.text(path).select(F.col("value").alias("id"))
    bad = ids.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR trim(id) = ''").limit(1)
    if bad.count():
        raise ValueError("an id list holds an empty or repeated id")
    return ids


def agreeing(frame: DataFrame, key: str, content: Column, file: Column, files: int) -> DataFrame:
    """Keys with whether all files hold them with the same content."""
    each = frame.select(key, content.alias("content"), file.alias("file"))
    return each.groupBy(key).agg((F.countDistinct("file") == files).alias("everywhere"), (F.countDistinct("content") == 1).alias("same"))


def scan_files(spark: SparkSession, glob: str, schema: str, key: str, files: int, rows_each: int | None = None) -> DataFrame:
    """The rows that all line files of a glob hold alike, once: only the fields of ``schema`` are read and compared.

    The number of files, the rows of each, and a key that a file lacks, holds twice or with other
    content than the others are errors.
    """
    names = T.StructType.fromDDL(schema).names
    rows = spark.read.text(glob).select(F.col("_metadata.file_path").alias("file"), F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "r.*")
    content = F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)
    sizes = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("files"), F.min("n").alias("least"), F.max("n").alias("most")).first()
    if sizes.files != files or (rows_each is not None and (sizes.least != rows_each or sizes.most != rows_each)):
        raise ValueError(f"{sizes.files} files of {sizes.least} to {sizes.most} rows, not {files}" + ("" if rows_each is None else f" of {rows_each}"))
    each = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.countDistinct("file").alias("__files"), F.countDistinct(content).alias("__contents"), *(F.first(c).alias(c) for c in names if c != key))
    whole = F.col(key).isNotNull() & (F.col("__n") == files) & (F.col("__files") == files) & (F.col("__contents") == 1)
    guard = F.when(whole, True).otherwise(F.raise_error(F.concat(F.lit("the files differ at "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("boolean"))
    return each.where(guard).select(*names)


def first_of(*columns: str) -> Column:
    """Duplicated fields of two stages as one: they must agree where both are present."""
    a, b = (F.col(c) for c in columns)
    return F.when(a.isNull() | b.isNull() | a.eqNullSafe(b), F.coalesce(a, b)).otherwise(F.raise_error(F.lit("duplicated fields differ")))


#: Files below WHOLE bytes are digested by Spark's own reader; larger ones in pieces of CHUNK bytes.
WHOLE, CHUNK = 1 << 30, 8 << 20


def inventory(spark: SparkSession, root: str, exclude: str = r"(^|/)(\.git|__pycache__)(/|$)", whole: int = WHOLE, chunk: int = CHUNK) -> DataFrame:
    """path (below ``root``), bytes and sha256 of every file of any size; symbolic links are an error.

    Spark lists and reads the files, so any store will do. Its reader holds a file as one value
    and stops at 2 GB, so files from ``whole`` bytes on are streamed in their task instead, in
    constant memory, through pyarrow's file systems (local, HDFS, and the object stores it knows).
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    below = F.expr(f"substring_index(path, '{root.rstrip('/').rsplit('/', 1)[-1]}/', -1)")
    named = listed.select(below.alias("below"), "path", F.col("length").alias("bytes"), "content").where(~F.col("below").rlike(exclude))
    linked = F.when(_is_link("path", "below"), F.raise_error(F.concat(F.lit("a symbolic link: "), F.col("below"))).cast("string"))
    small = named.where(F.col("bytes") < whole).select("below", "bytes", F.coalesce(linked, F.sha2("content", 256)).alias("sha256"))
    large = named.where(F.col("bytes") >= whole).select("below", "path", "bytes").repartition("path")
    streamed = large.select("below", "bytes", F.coalesce(linked, _streamed(chunk)("path")).alias("sha256"))
    # Spark gives no task an empty file; its list of files has them
    every = spark.createDataFrame([(unquote(f).replace("file:///", "file:/"),) for f in listed.inputFiles()], "path string")
    empty = every.join(listed.select("path"), "path", "left_anti").select(below.alias("below"), "path").where(~F.col("below").rlike(exclude))
    empty = empty.select("below", F.lit(0).cast("long").alias("bytes"), F.coalesce(linked, F.sha2(F.lit(""), 256)).alias("sha256"))
    return small.unionByName(streamed).unionByName(empty).withColumnRenamed("below", "path")


@F.arrow_udf(T.BooleanType())
def _is_link(paths: pa.Array, below: pa.Array) -> pa.Array:
    """Whether a local file, or a folder between it and the root, is a symbolic link; other stores have none."""
    out = []
    for path, name in zip(paths.to_pylist(), below.to_pylist(), strict=True):
        local = path.removeprefix("file://").removeprefix("file:") if urlsplit(path).scheme in ("", "file") else None
        steps = name.count("/") + 1
        out.append(local is not None and any(os.path.islink(local.rsplit("/", k)[0] if k else local) for k in range(steps)))
    return pa.array(out, pa.bool_())


def _streamed(chunk: int):
    @F.arrow_udf(T.StringType())
    def digest(paths: pa.Array) -> pa.Array:
        out = []
        for path in paths.to_pylist():
            uri = quote(path, safe=":/")
            store, name = pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:/", "file:///"))
            state = hashlib.sha256()
            with store.open_input_stream(name) as file:
                while piece := file.read(chunk):
                    state.update(piece)
            out.append(state.hexdigest())
        return pa.array(out, pa.string())

    return digest


def inventory_differences(now: DataFrame, recorded: DataFrame) -> DataFrame:
    """Files that were added, removed or changed against a recorded inventory."""
    a, b = now.select("path", F.col("sha256").alias("now")), recorded.select("path", F.col("sha256").alias("then"))
    kind = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("now") != F.col("then"), "changed")
    return a.join(b, "path", "full_outer").select("path", kind.alias("difference")).where("difference IS NOT NULL")


def read_archive(spark: SparkSession, path: str, members: str = ".jsonl", forbidden: tuple[bytes, ...] = ()) -> DataFrame:
    """Lines of the members of tar.gz archives (archive, member, line_number, line).

    Unsafe members (links, absolute paths, parent steps) and forbidden byte strings fail. A
    gzip stream can't be split: the task of an archive holds its compressed bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    for member in tar:
                        if not member.isfile() or member.name.startswith("/") or ".." in member.name.split("/"):
                            raise ValueError(f"unsafe member {member.name}")
                        if not member.name.endswith(members):
                            continue
                        lines = []
                        for n, line in enumerate(tar.extractfile(member)):
                            if any(f in line for f in forbidden):
                                raise ValueError(f"forbidden content in {member.name}")
                            lines.append((name, member.name, n, line.decode().rstrip("\n")))
                            if len(lines) == 10_000:
                                yield _lines(lines)
                                lines = []
                        if lines:
                            yield _lines(lines)

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
    return files.mapInArrow(run, "archive string, member string, line_number long, line string")


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["archive", "member", "line_number", "line"])


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """Rows of a query over each SQLite file under ``path``, opened from its bytes in the task that holds it, whole."""
    names = [f.name for f in T.StructType.fromDDL(schema).fields]
    arrow = {f.name: {"long": pa.int64(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}[f.dataType.simpleString()] for f in T.StructType.fromDDL(schema).fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with sqlite3.connect(":memory:") as db:
                    db.deserialize(content)
                    found = db.execute(sql)
                    while rows := found.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], arrow[n]) for i, n in enumerate(names)], names=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


@F.arrow_udf(T.StringType())
def canonical_text(texts: pa.Array) -> pa.Array:
    """JSON text in a fixed form: sorted keys, no spaces, non-ASCII kept; not-a-number fails."""

    def strict(name):
        raise ValueError(f"{name} is not allowed")

    return pa.array([None if t is None else json.dumps(json.loads(t, parse_constant=strict), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t in texts.to_pylist()], pa.string())


def canonical_json(column: Column) -> Column:
    """A struct as canonical JSON."""
    return canonical_text(F.to_json(column, {"ignoreNullFields": "false"}))


def read_config(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A strict configuration: exactly the fields of the schema, none missing, none null, none beside them."""
    fields = T.StructType.fromDDL(schema).names
    raw = spark.read.text(path, wholetext=True)
    keys = F.json_object_keys("value")
    ok = F.array_sort(keys) == F.lit(sorted(fields))
    told = read_object(spark, path, schema)
    if not raw.select(F.coalesce(ok, F.lit(False))).first()[0] or told.where(" OR ".join(f"`{f}` IS NULL" for f in fields)).count():
        raise ValueError(f"{path} has other fields than {', '.join(fields)}")
    return told


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """Context results of either schema version: fields of the first stage payload, or of the row itself in the older one."""
    payload = "struct<analysis_context_type:string,bcu:boolean,context_identity_sha256:string,target_new:string>"
    rows = read_jsonl(spark, path, f"sample_id string, query_identity_sha256 string, hard_status string, probability_status string, hard_payload {payload}, probability_payload struct<ccu:double,ccu_target_label:string>, analysis_context_type string, context_identity_sha256 string, target_new string")
    both = lambda c: first_of(c, f"hard_payload.{c}").alias(c)
    return rows.select("sample_id", "query_identity_sha256", both("analysis_context_type"), both("context_identity_sha256"), both("target_new"), F.col("hard_payload.bcu").alias("bcu"), F.col("probability_payload.ccu").alias("ccu"), F.col("probability_payload.ccu_target_label").alias("ccu_target_label"), (F.col("hard_status") == "ok").alias("hard_ok"), (F.col("probability_status") == "ok").alias("probability_ok"))


def frozen(spark: SparkSession, root: str, recorded: DataFrame, denied: str) -> DataFrame:
    """The inventory of a frozen tree; a denied path or any difference to the recorded inventory is an error."""
    now = inventory(spark, root)
    if bad := now.where(F.col("path").rlike(denied)).limit(1).collect():
        raise ValueError(f"{bad[0].path} may not be here")
    if bad := inventory_differences(now, recorded).limit(1).collect():
        raise ValueError(f"{bad[0].path} is {bad[0].difference}")
    return now
