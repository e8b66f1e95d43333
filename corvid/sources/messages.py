"""Mail as a source: raw messages from files and archives, parsed once into a typed row."""

from __future__ import annotations

import bz2
import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions import fixed
from corvid.functions.html import visible_text
from corvid.plans.session import ship

FIELD = re.compile(rb"[!-9;-~]+:")
INDENT = re.compile(rb"(?:\xe2\x80[\x80-\x8b]|\xc2\xa0)+")
SHIFT = re.compile(r"\+[A-Za-z0-9+/]{2,}-?")
TAG = re.compile(r"</?[a-zA-Z][^>]*>")


def repair(raw: bytes) -> bytes:
    """Raw mail without what strays before its first header, with plain spaces for Unicode folds, and a line between header and body."""
    lines = raw.split(b"\n")
    first = next((i for i, x in enumerate(lines) if FIELD.match(x)), 0)
    out = b"\n".join(INDENT.sub(b" ", x, count=1).replace(b"\xc2\xa0", b" ") if INDENT.match(x) else x.replace(b"\xc2\xa0", b" ") for x in lines[first:])
    return out if b"\n\n" in out or b"\r\n\r\n" in out else out + b"\n\n"


def recover_utf7(text: str) -> str:
    """HTML that is UTF-7 under another name, decoded; anything else as it is."""
    if TAG.search(text) or "+ADw" not in text or not any(m in text for m in ("+AD4", "+AD0", "+ACI")) or len(found := SHIFT.findall(text)) < 4:
        return text
    try:
        out = text.encode("ascii").decode("utf-7")
    except UnicodeError:
        return text
    return out if len(TAG.findall(out)) >= 2 and len(SHIFT.findall(out)) < len(found) else text


def decode_part(part) -> str:
    """A text part by its declared charset, else UTF-8, Windows-1252 or Latin-1, the first that fits."""
    payload = part.get_payload(decode=True)
    if payload is None:
        return ""
    for charset in dict.fromkeys([part.get_content_charset() or "utf-8", "utf-8", "cp1252", "latin-1"]):
        try:
            return recover_utf7(payload.decode(charset))
        except (LookupError, UnicodeDecodeError):
            continue
    return recover_utf7(payload.decode("utf-8", "replace"))


def leaves(message) -> Iterator[tuple[int, int, object]]:
    """(place, depth, part) of a message's parts; what is inside an attached message is not entered."""
    todo, n = [(0, message)], 0
    while todo:
        depth, part = todo.pop()
        yield n, depth, part
        n += 1
        if part.is_multipart() and part.get_content_type() != "message/rfc822":
            todo += [(depth + 1, x) for x in reversed(part.get_payload())]


FIELDS = [
    ("status", "string"), ("error", "string"), ("subject", "string"), ("sender", "string"), ("recipient", "string"), ("date", "string"), ("message_id", "string"), ("headers", "array<struct<ord:int,name:string,value:string>>"),
    ("n_parts", "int"), ("max_depth", "int"), ("body_plain", "string"), ("body_html", "string"), ("body", "string"), ("body_source", "string"), ("attachments", "array<struct<filename:string,content_type:string,disposition:string,content_id:string,payload:binary>>"),
]
SCHEMA = ", ".join(f"{n} {t}" for n, t in FIELDS)


def parse(raw: bytes) -> dict:
    """A message as a row of FIELDS. It never raises: status is ok, limit_exceeded or error."""
    row = dict.fromkeys([n for n, _ in FIELDS])
    try:
        message = message_from_bytes(repair(raw), policy=policy.compat32)
        text = lambda v: re.sub(r"\s+", " ", str(v)).strip() if v is not None else None
        row |= {"status": "ok", "subject": text(message["Subject"]), "sender": text(message["From"]), "recipient": text(message["To"]), "date": text(message["Date"]), "message_id": text(message["Message-ID"])}
        row["headers"] = [{"ord": i, "name": k, "value": text(v)} for i, (k, v) in enumerate(message.items())]
        plain, html, files, count, deepest = [], [], [], 0, 0
        for _, depth, part in leaves(message):
            count, deepest = count + 1, max(deepest, depth)
            if count > fixed.MAX_PARTS or deepest > fixed.MAX_DEPTH:
                return row | {"status": "limit_exceeded", "error": "parts or depth", "n_parts": count, "max_depth": deepest}
            if part.is_multipart() and part.get_content_type() != "message/rfc822":
                continue
            kind, disposition = part.get_content_type(), part.get_content_disposition() or ""
            if disposition == "attachment" or part.get_filename() or kind == "message/rfc822" or not kind.startswith("text/"):
                payload = part.get_payload(decode=True) if not part.is_multipart() else part.get_payload(0).as_bytes()
                files.append({"filename": part.get_filename(), "content_type": kind, "disposition": disposition, "content_id": part.get("Content-ID"), "payload": payload or b""})
            elif kind == "text/html":
                html.append(decode_part(part))
            else:
                plain.append(decode_part(part))
        row |= {"n_parts": count, "max_depth": deepest, "attachments": files, "body_plain": "\n".join(plain), "body_html": "\n".join(html)}
        if len(files) > fixed.MAX_ATTACHMENTS or len(row["body_plain"]) + len(row["body_html"]) > fixed.MAX_TEXT:
            return row | {"status": "limit_exceeded", "error": "attachments or text", "attachments": []}
        row["body_source"] = "plain" if row["body_plain"].strip() else "html" if html else "none"
        row["body"] = row["body_plain"] if row["body_source"] == "plain" else visible_text(row["body_html"])
        return row
    except Exception as bad:  # mail is hostile input: a message that breaks the parser is a row, not the job's end
        return row | {"status": "error", "error": f"{type(bad).__name__}: {bad}"[:300]}


def arrow_schema() -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(f"path string, member string, msg_id string, {SCHEMA}"))


def parse_messages(raw: DataFrame) -> DataFrame:
    """raw (path, member, content) as parsed rows; msg_id is the content's SHA-256."""
    ship(raw.sparkSession)

    schema = arrow_schema()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [{"path": p, "member": m, "msg_id": i, **parse(c or b"")} for p, m, c, i in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return raw.select("path", "member", "content", F.sha2("content", 256).alias("msg_id")).mapInArrow(run, f"path string, member string, msg_id string, {SCHEMA}")


def files(spark: SparkSession, path: str, pattern: str = "*.eml", recursive: bool = True) -> DataFrame:
    """(path, member, content) of message files up to the size limit; longer ones are left unread (see too_long)."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return raw.where(F.col("length") <= fixed.MAX_FILE_BYTES).select("path", F.lit("").alias("member"), "content")


def listed(raw: DataFrame, most: int | None = None) -> DataFrame:
    """Files in the order of their lower-cased paths, the first `most` if that is given."""
    rows = raw.orderBy(F.lower("path"), "path")
    return rows if most is None else rows.limit(most)


def too_long(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.where(F.col("length") > fixed.MAX_FILE_BYTES).select("path", F.col("length").alias("size_bytes"), F.lit("limit_exceeded").alias("status"))


def members(path: str, data: bytes, wanted: str = "") -> Iterator[tuple[str, bytes]]:
    """The messages in a tar, zip, mbox or compressed mbox, told apart by their first bytes."""
    if data[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir() and wanted in info.filename:
                    yield info.filename, z.read(info)
        return
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
    elif data[:3] == b"BZh":
        data = bz2.decompress(data)
    if data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile() and wanted in info.name:
                    yield info.name, t.extractfile(info).read()
        return
    name = path.rsplit("/", 1)[-1]
    for i, part in enumerate(x for x in re.split(rb"(?m)^From .*(?:\r?\n)", data) if x.strip()):
        yield f"{name}#{i}", part


def archive(spark: SparkSession, path: str, wanted: str = "", most: int | None = None) -> DataFrame:
    """(path, member, content) of the messages in archives, the first `most` of each if that is given. An archive is one task's work: it can't be split."""
    ship(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, c in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                for m, data in islice(members(p, c.as_py(), wanted), most):
                    yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([m]), pa.array([data], pa.binary())], ["path", "member", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, member string, content binary")


def training_text(parsed: DataFrame) -> DataFrame:
    """Messages as corpus rows: subject and body, normalized."""
    from corvid.functions.text import normalize, text_hash

    t = normalize(F.concat_ws(" ", "subject", "body"))
    return parsed.where("status = 'ok'").select(F.concat_ws("/", "path", "member").alias("source_file"), t.alias("text")).withColumn("text_hash", text_hash(F.col("text")))
