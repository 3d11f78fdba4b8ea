"""WARC archives with an index of their records (operator 8).

Writing: payload digests are grouped on a narrow table (sums combined before the shuffle,
so a payload that a third of the pages share costs one row per task) and name the response
of each group; then each task writes its pages as gzip members of one archive file in the
shared folder and returns the index: file, offset, length, URL, digest. The index is
committed by Spark's Parquet writer. A task that ran twice leaves a file that no index row
names, so lost executors and repeated attempts cannot add or change records.

Reading: the index alone selects records; the selection is dealt by stretches of each
file, sorted by offset, and neighbouring byte ranges are fetched in one read.

Defined results: a null html is the empty payload; payloads under 100 bytes are always
responses; of pages with equal larger payloads those of the smallest page_id are
responses and all others revisits that refer to it; rows with a null page_id are always
responses and never referred to; a null URL leaves out the target header; control
characters in a URL are percent-encoded in the header, the index keeps it as it is.
Very long payloads are whole records; repeated rows are records of their own.
An empty table gives an empty index.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_key, mapped, possible_members, shared_folder, written

SMALL, DATE = 100, "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Reads are joined over gaps up to GAP bytes, up to READ bytes in all.
GAP, READ = 1 << 16, 1 << 22

INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long, length long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def filesystem(uri: str):
    """A pyarrow file system and the path in it: local, HDFS or an object store, by the URI's scheme."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(hashlib.md5(f'{page_id}:{digest}'.encode()).hexdigest())}>"


def record(page_id: int | None, url: str | None, digest: str, body: bytes, first: int | None) -> bytes:
    """One WARC record; ``first``: the page that holds the payload, if this one revisits it."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = http + body if first is None else http
    head = [f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        head.append(f"WARC-Target-URI: {safe}")
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first, digest)}", f"Refers-To-Page-ID: {first}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(["WARC/1.1", *head]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The headers of a record, its payload, and the payload's length and digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if not lines[0].startswith("WARC/") or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    http, _, body = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    length = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if not revisit and (len(body) != length or hashlib.sha256(body).hexdigest() != digest):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return fields | {"revisit": revisit, "payload": body, "payload_bytes": length, "digest": digest}


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        begin = next((b for b in batches if b.num_rows), None)
        if begin is None:
            return
        files, path = filesystem(folder)
        files.create_dir(path, recursive=True)
        name = f"{path}/{uuid.uuid4().hex}.warc.gz"
        offset = 0
        with files.open_output_stream(name, compression=None) as out:  # members are compressed one by one
            for batch in chain([begin], batches):
                rows = []
                for page_id, url, digest, html, first in zip(*(c.to_pylist() for c in batch.columns)):
                    body = (html or "").encode()
                    member = gzip.compress(record(page_id, url, digest, body, first), compresslevel=5, mtime=0)
                    out.write(member)
                    rows.append((page_id, url, digest, len(body), "response" if first is None else "revisit", first, name, offset, len(member)))
                    offset += len(member)
                kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in INDEX.split(", ")])

    return run


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Archives of all ``pages`` under ``folder``; returns their index, written beside them."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    whole = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.sha2(F.encode(payload, "UTF-8"), 256).alias("digest"), "html")
    narrow = written(whole.select("page_id", "digest", (F.octet_length(F.coalesce("html", F.lit(""))) >= SMALL).alias("large")), "payload-digests")
    known = narrow.where(F.col("large") & F.col("page_id").isNotNull())
    firsts = known.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    revisits = by_key(known, firsts, ["digest"], "n").where(F.col("page_id") != F.col("first")).select("page_id", "digest", "first").distinct()
    revisits = written(revisits, "revisits")
    # only pages that may be revisits are moved
    told = possible_members(whole, "page_id", revisits.select("page_id"))
    columns = ("page_id", "url", "digest", "html", "first")
    sure = told.where("NOT possible").withColumn("first", F.lit(None).cast("long")).select(*columns)
    told = sure.unionByName(told.where("possible").join(revisits, ["page_id", "digest"], "left").select(*columns))
    return written(mapped(told, _write(folder), INDEX), "warc-index")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = filesystem(folder)
        name, handle = None, None
        for batch in batches:
            wanted = [*zip(*(batch.column(i).to_pylist() for i in range(4)))]
            rows, at = [], 0
            while at < len(wanted):
                archive, start, length, _ = wanted[at]
                stop, end = at + 1, start + length
                while stop < len(wanted) and wanted[stop][0] == archive and 0 <= wanted[stop][1] - end <= GAP and wanted[stop][1] + wanted[stop][2] - start <= READ:
                    end = wanted[stop][1] + wanted[stop][2]
                    stop += 1
                if archive != name:
                    if handle is not None:
                        handle.close()
                    name, handle = archive, files.open_input_file(archive)
                data = handle.read_at(end - start, start)
                for _, offset, length, url in wanted[at:stop]:
                    found = parse(gzip.decompress(data[offset - start : offset - start + length]))
                    page, first = found.get("Page-ID"), found.get("Refers-To-Page-ID")
                    rows.append((page and int(page), url, found["payload_bytes"], found["digest"], found["WARC-Type"], first and int(first)))
                at = stop
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in RECORDS.split(", ")])
        if handle is not None:
            handle.close()

    return run


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that ``index`` selects, by sorted and joined byte-range reads."""
    stretch = F.expr(f"offset div {READ}")
    dealt = index.select("archive", "offset", "length", "url").repartition("archive", stretch).sortWithinPartitions("archive", "offset")
    return mapped(dealt, _read(folder), RECORDS)


def archive_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def op8_indexed_warc(spark, sf_dir: str) -> DataFrame:
    folder = archive_folder(spark)
    index = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
