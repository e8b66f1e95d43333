"""WARC archives: writing, and reading by boundary-chain verification."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.plans.session import cut, shared_folder, ship, small_enough

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 1000
#: Bounds a file, which is read as one row, and the records that are chained together; one record may be longer than a file's bound.
FILE_BYTES = 64 << 20
#: Records are written apart by their size: of the first class up to so many bytes, of each further one STEP times as many.
SMALL, STEP = 16 << 10, 16
MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
FIELD = re.compile(rb"([!#-'*+\-.0-9A-Z^-z|~]+):[ \t]*([^\r\n]*)\r\n")
CANDIDATE = "path string, at bigint, next bigint, size bigint, type string, record_id string, refers_to string, target string, claimed string, payload_bytes bigint, payload_sha1 string"


def record_id(key: Column, digest: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(key.cast("string"), F.lit("null")), F.lit(":"), digest, F.lit(">"))


def records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Rows (record, class): each row of pages as the text of a WARC record without its last line end.

    Of rows with equal payloads of least_bytes or more, that with the largest key is a response and the others are
    revisits that refer to it. Null html is an empty payload. Line ends in urls are escaped; a null url
    is written as the record's id. Rows that repeat the response's key and payload are responses too;
    where all keys of a payload are null, all its rows are responses.
    """
    body = F.coalesce(F.col(html), F.lit(""))
    size = F.octet_length(body)
    digest = F.sha1(body.cast("binary"))
    rows = pages.select(F.col(key).alias("key"), F.col(url).cast("string").alias("url"), body.alias("body"), size.alias("n"), digest.alias("digest"))
    # The map holds revisits only, with no payload: pages are not shuffled to find out that most have no equal.
    first = cut(rows.where(F.col("n") >= least_bytes).groupBy("digest").agg(F.max("key").alias("top"), F.count("*").alias("m")).where("m > 1 and top is not null").select("digest", "top"))
    first = F.broadcast(first) if small_enough(first, 100) else first
    rows = rows.join(first, "digest", "left")
    later = F.col("top").isNotNull() & ~F.col("key").eqNullSafe(F.col("top"))
    own = record_id(F.col("key"), F.col("digest"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.octet_length(http) + F.when(later, 0).otherwise(F.col("n"))
    target = F.replace(F.replace(F.coalesce("url", F.substring_index(F.ltrim(own, F.lit("<")), ">", 1)), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(later, "revisit").otherwise("response"), F.lit("\r\nWARC-Record-ID: "), own, F.lit("\r\nWARC-Target-URI: "), target, F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(later, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), record_id(F.col("top"), F.col("digest")))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), block.cast("string"), F.lit("\r\n\r\n"),
    )
    return rows.select(F.concat(head, http, F.when(later, F.lit("")).otherwise(F.col("body")), F.lit("\r\n")).alias("record"), size_class(F.col("url"), F.col("body")).alias("class"))


def size_class(url: Column, html: Column) -> Column:
    """0 for pages of up to SMALL bytes, with the url's; 1 for up to STEP times as many, and so on."""
    size = F.octet_length(F.coalesce(html, F.lit(""))) + F.octet_length(F.coalesce(url, F.lit("")))
    return F.greatest(F.lit(0), F.ceil(F.log(size / F.lit(float(SMALL))) / F.log(F.lit(float(STEP))))).cast("int")


def write(pages: DataFrame, path: str, **options) -> None:
    """Writes the records of pages to files below path, in a store that all executors share.

    Pages of a class of sizes share files, as many in each as FILE_BYTES allows by the class's largest: a file's length is
    bounded by bytes, not by a count. There are few classes (a page of 2 GB is of the fifth), and one pass for each that there is.
    """
    names = {"url": "url", "html": "html"} | {k: v for k, v in options.items() if k in ("url", "html")}
    found = sorted({r[0] for r in pages.select(size_class(F.col(names["url"]).cast("string"), F.col(names["html"])).alias("c")).distinct().collect() if r[0] is not None})
    rows = records(pages, **options)
    for c in found or [0]:
        most = max(1, FILE_BYTES // (SMALL * STEP**c))
        rows.where(F.col("class") == c).select("record").write.option("lineSep", "\r\n").option("maxRecordsPerFile", most).option("compression", "none").text(f"{path}/{c}")


def candidates(path: str, data: bytes) -> list[tuple]:
    """A row for each place in data that reads as a record: its offset, its successor's, and its fields.

    Places in payloads count too here: only the chain from the file's start tells them apart. Payloads are hashed only of
    those that it reaches in data, so that what stands in payloads costs no hashing.
    """
    out, bodies = [], []
    for m in MAGIC.finditer(data):
        at, fields = m.end(), {}
        while f := FIELD.match(data, at):
            fields.setdefault(f[1].lower(), f[2].strip())
            at = f.end()
        length = fields.get(b"content-length", b"")
        if data[at : at + 2] != b"\r\n" or not length.isdigit() or len(length) > 18:
            continue
        start, end = at + 2, at + 2 + int(length)
        if data[end : end + 4] != b"\r\n\r\n":
            continue
        body = start
        if fields.get(b"content-type", b"").startswith(b"application/http"):
            split = data.find(b"\r\n\r\n", start, end)
            body = split + 4 if split >= 0 else end
        text = {k: v.decode("utf-8", "replace") for k, v in fields.items()}
        out.append((path, m.start(), end + 4, len(data), text.get(b"warc-type"), text.get(b"warc-record-id"), text.get(b"warc-refers-to"), text.get(b"warc-target-uri"), text.get(b"warc-payload-digest"), end - body))
        bodies.append((body, end))
    seen = reachable(np.array([r[1] for r in out], np.int64), np.array([r[2] for r in out], np.int64))
    return [(*r, hashlib.sha1(memoryview(data)[a:b]).hexdigest() if on else None) for r, (a, b), on in zip(out, bodies, seen, strict=True)]


def reachable(at: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which records the chain of successors from offset 0 visits; `at` ascends. Pointer jumping: log2(n) rounds."""
    n = len(at)
    jump = np.searchsorted(at, after)
    jump = np.where((jump < n) & (at[np.minimum(jump, n - 1)] == after), jump, n)
    jump = np.append(jump, n)
    seen = np.append(at == 0, False)
    for _ in range(n.bit_length()):
        seen[jump[seen]] = True
        jump = jump[jump]
    return seen[:n]


def chain(rows: pd.DataFrame) -> pd.DataFrame:
    """The records of one file that its chain reaches; whole: whether the chain goes to the file's end."""
    rows = rows.sort_values("at", kind="stable")
    rows = rows[reachable(rows["at"].to_numpy(np.int64), rows["next"].to_numpy(np.int64))]
    return rows.assign(whole=bool(len(rows)) and rows["next"].iloc[-1] == rows["size"].iloc[-1])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of the WARC files (not compressed) below path: CANDIDATE's columns and whole.

    Tasks read files and emit a candidate for every place that reads as a record, with its successor's offset;
    then each file's candidates are chained from its start. A file's group is bounded by the file's
    length; of payloads, only lengths and digests are shuffled. Reads through Spark, so any store does.
    """
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("bigint") else pa.string()) for x in CANDIDATE.split(", ")])
        for b in batches:
            for i in range(b.num_rows):
                found = candidates(b.column(0)[i].as_py(), b.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)] if found else [pa.array([], t) for t in schema.types], schema=schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInArrow(run, CANDIDATE).groupBy("path").applyInPandas(chain, CANDIDATE + ", whole boolean")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """pages written to archives in the shared folder and read back: the columns of read, checkpointed; the archives are removed."""
    spark = pages.sparkSession
    path = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    try:
        write(pages, path, **options)
        return cut(read(spark, path))
    finally:
        remove(spark, path)


def visits(back: DataFrame, kind: str = "bigint") -> DataFrame:
    """Rows (key, payload_bytes, payload_digest, record_type, refers_to) of records that `records` wrote; keys are of the type kind.

    A revisit's payload is that of the response that it refers to.
    """
    keyed = lambda c: F.nullif(F.regexp_extract(c, r"(?s)^<urn:x-page:(.*):[0-9a-f]{40}>$", 1), F.lit("null")).cast(kind)
    told = back.where("type in ('response', 'revisit')").select("type", "record_id", "refers_to", "payload_bytes", "payload_sha1")
    answered = told.where("type = 'response'").select(keyed(F.col("record_id")).alias("key"), "payload_bytes", F.col("payload_sha1").alias("payload_digest"), F.col("type").alias("record_type"), F.lit(None).cast(kind).alias("refers_to"))
    source = told.where("type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_sha1").alias("payload_digest"))
    again = told.where("type = 'revisit'").select("record_id", "refers_to").join(source, "refers_to", "left")
    return answered.unionByName(again.select(keyed(F.col("record_id")).alias("key"), "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), keyed(F.col("refers_to")).alias("refers_to")))
