"""Media columns: signatures found by Aho-Corasick, confirmed by format validators; types corrected, embedded media carved."""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.warc import remove
from corvid.plans.session import cut, shared_folder, ship

UNKNOWN = "application/octet-stream"
FRAME = 576
RATE = 16_000
#: Types whose structure does not tell the length: such a file goes up to the next one that is confirmed.
OPEN = frozenset(["audio/flac"])
#: Fixed values: (magic bytes, their offset in the format, the format's validator).
SIGNATURES = [
    (b"\x89PNG\r\n\x1a\n", 0, "png"),
    (b"\xff\xd8\xff", 0, "jpeg"),
    (b"GIF87a", 0, "gif"),
    (b"GIF89a", 0, "gif"),
    (b"BM", 0, "bmp"),
    (b"RIFF", 0, "riff"),
    (b"fLaC", 0, "flac"),
    (b"OggS", 0, "ogg"),
    (b"%PDF-", 0, "pdf"),
    (b"PK\x03\x04", 0, "zip"),
    (b"\x1f\x8b\x08", 0, "gzip"),
    (b"ftyp", 4, "mp4"),
]


def u16(d, i):
    return int.from_bytes(d[i : i + 2], "big")


def u32(d, i):
    return int.from_bytes(d[i : i + 4], "big")


def l32(d, i):
    return int.from_bytes(d[i : i + 4], "little")


class Told:
    """What is known of one file's bytes. Validators that follow chains of blocks ask here, so that a step is taken once, from however many signatures."""

    def __init__(self, d: bytes):
        self.d = d
        self.ends: dict[tuple[str, int], int] = {}
        self.places: dict[bytes, list[int]] = {}
        self.zips: dict[int, int] | None = None
        self.moov: dict[int, bool] = {}
        self.gap = (0, -1)  # from a place to the first zero byte after it

    def end(self, kind: str, at: int, step) -> int:
        """The last place of the chain from at: that from which step gives None."""
        path, i = [], at
        while (known := self.ends.get((kind, i))) is None:
            path.append(i)
            if (after := step(i)) is None:
                known = i
                break
            i = after
        for x in path:
            self.ends[kind, x] = known
        return known

    def has_moov(self, at: int, step) -> bool:
        """Whether one of the boxes from at on is the index of a film."""
        path, i = [], at
        while (known := self.moov.get(i)) is None:
            path.append(i)
            if (after := step(i)) is None:
                known = False
                break
            if self.d[i + 4 : i + 8] == b"moov":
                known = True
                break
            i = after
        for x in path:
            self.moov[x] = known
        return known

    def after(self, what: bytes, at: int) -> int:
        """The first place of what at or after at; -1 if there is none."""
        if what not in self.places:
            self.places[what] = [m.start() for m in re.finditer(re.escape(what), self.d)]
        found = self.places[what]
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def zero(self, at: int) -> int:
        """The first zero byte at or after at; -1 if there is none."""
        if not self.gap[0] <= at <= self.gap[1]:
            found = self.d.find(b"\0", at)
            self.gap = at, found if found >= 0 else len(self.d)
        return self.gap[1] if self.gap[1] < len(self.d) else -1

    def archives(self) -> dict[int, int]:
        """For each zip archive with a well-formed end its first byte, and the place after its last one."""
        if self.zips is None:
            d, self.zips = self.d, {}
            for m in re.finditer(b"PK\x05\x06", d):
                end = m.start()
                if end + 22 > len(d):
                    break
                size, start = l32(d, end + 12), l32(d, end + 16)
                at, stop = end - size - start, end + 22 + int.from_bytes(d[end + 20 : end + 22], "little")
                if at >= 0 and stop <= len(d) and (not size or d[at + start : at + start + 4] == b"PK\x01\x02"):
                    self.zips.setdefault(at, stop)
        return self.zips


# Each validator takes the bytes, an offset and what is known of the bytes, and gives (type, length) if a whole, well-formed file starts there, else None.


def png(d: bytes, at: int, told: Told):
    i, first = at + 8, True
    while i + 12 <= len(d):
        size, kind = u32(d, i), d[i + 4 : i + 8]
        if i + 12 + size > len(d) or first and (kind != b"IHDR" or size != 13) or zlib.crc32(memoryview(d)[i + 4 : i + 8 + size]) != u32(d, i + 8 + size):
            return None
        i, first = i + 12 + size, False
        if kind == b"IEND":
            return "image/png", i - at
    return None


def jpeg(d: bytes, at: int, told: Told):
    i, frame = at + 2, False
    while i + 4 <= len(d) and d[i] == 0xFF:
        mark = d[i + 1]
        if mark == 0xFF:
            i += 1
            continue
        if mark == 0xD9:
            return ("image/jpeg", i + 2 - at) if frame else None
        if mark in (0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            return None
        size = u16(d, i + 2)
        if size < 2 or i + 2 + size > len(d):
            return None
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            if size != 8 + 3 * d[i + 9]:
                return None
            frame = True
        i += 2 + size
        if mark == 0xDA:
            while True:  # entropy-coded data goes on to a marker that is not a stuffed byte or a restart
                i = d.find(b"\xff", i)
                if i < 0 or i + 1 >= len(d):
                    return None
                if d[i + 1] == 0 or 0xD0 <= d[i + 1] <= 0xD7:
                    i += 2
                else:
                    break
    return ("image/jpeg", i + 2 - at) if frame and d[i : i + 2] == b"\xff\xd9" else None


def gif(d: bytes, at: int, told: Told):
    if at + 13 > len(d):
        return None
    i = at + 13 + (3 << (d[at + 10] & 7) + 1 if d[at + 10] & 0x80 else 0)
    blocks = lambda i: told.end("gif", i, lambda k: k + 1 + d[k] if k < len(d) and d[k] else None) + 1
    images = 0
    while i < len(d):
        if d[i] == 0x3B:
            return ("image/gif", i + 1 - at) if images else None
        if d[i] == 0x21:
            i = blocks(i + 2)
        elif d[i] == 0x2C and i + 10 < len(d):
            i = blocks(i + 11 + (3 << (d[i + 9] & 7) + 1 if d[i + 9] & 0x80 else 0))
            images += 1
        else:
            return None
    return None


def bmp(d: bytes, at: int, told: Told):
    if at + 26 > len(d):
        return None
    size, start, head = l32(d, at + 2), l32(d, at + 10), l32(d, at + 14)
    if head not in (12, 40, 52, 56, 64, 108, 124) or d[at + 6 : at + 10] != bytes(4) or not 14 + head <= start <= size or at + size > len(d):
        return None
    return "image/bmp", size


def riff(d: bytes, at: int, told: Told):
    if at + 12 > len(d):
        return None
    end = at + 8 + l32(d, at + 4)
    kind = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/x-msvideo"}.get(d[at + 8 : at + 12])
    if kind is None or end > len(d):
        return None
    i, seen = at + 12, []
    while i + 8 <= end:
        size = l32(d, i + 4)
        seen.append(d[i : i + 4])
        i += 8 + size + size % 2
        if i > end + 1:
            return None
    if kind == "audio/wav" and not (b"fmt " in seen and b"data" in seen) or not seen:
        return None
    return kind, end - at


def flac(d: bytes, at: int, told: Told):
    i, first = at + 4, True
    while i + 4 <= len(d):
        kind, size = d[i], int.from_bytes(d[i + 1 : i + 4], "big")
        if first and (kind & 0x7F or size != 34) or i + 4 + size > len(d):
            return None
        i, first = i + 4 + size, False
        if kind & 0x80:  # frames follow, whose lengths are not told: they go to the end
            return ("audio/flac", len(d) - at) if i + 1 < len(d) and d[i] == 0xFF and d[i + 1] & 0xFC == 0xF8 else None
    return None


def ogg(d: bytes, at: int, told: Told):
    def page(i):
        """Where the page at i ends; None if there is none."""
        if i + 27 > len(d) or d[i : i + 4] != b"OggS" or d[i + 4]:
            return None
        table = d[i + 27 : i + 27 + d[i + 26]]
        end = i + 27 + d[i + 26] + sum(table)
        return None if len(table) < d[i + 26] or end > len(d) else end

    if at + 27 > len(d) or not d[at + 5] & 2:
        return None
    last = told.end("ogg", at, lambda i: None if i + 5 < len(d) and d[i + 5] & 4 else page(i))
    end = page(last)
    return None if end is None else ("application/ogg", end - at)


def pdf(d: bytes, at: int, told: Told):
    if not d[at + 5 : at + 6].isdigit():
        return None
    end = told.after(b"%%EOF", at)
    if end < 0 or not at <= told.after(b"startxref", at) < end:
        return None
    while (further := told.after(b"%%EOF", end + 5)) >= 0 and not end <= told.after(b"%PDF-", end) < further and end <= told.after(b"startxref", end) < further:
        end = further
    return "application/pdf", end + 5 - at


def zipped(d: bytes, at: int, told: Told):
    stop = told.archives().get(at)
    return None if stop is None else ("application/zip", stop - at)


def gzipped(d: bytes, at: int, told: Told):
    if at + 18 > len(d) or d[at + 3] & 0xE0:
        return None
    flags, start = d[at + 3], at + 10
    if flags & 4:
        start += 2 + int.from_bytes(d[start : start + 2], "little")
    for _ in range((flags >> 3 & 1) + (flags >> 4 & 1)):
        if (zero := told.zero(start)) < 0:
            return None
        start = zero + 1
    start += flags & 2
    if start >= len(d) or d[start] & 6 == 6:  # no such kind of block
        return None
    read, i, step = zlib.decompressobj(31), at, 256
    try:
        while i < len(d) and not read.eof:
            block = d[i : i + step]
            step = min(65536, 4 * step)
            more = read.decompress(block, 1 << 20)
            while read.unconsumed_tail:  # what it holds is not kept
                more = read.decompress(read.unconsumed_tail, 1 << 20)
            del more
            i += len(block)
    except zlib.error:
        return None
    return ("application/gzip", i - len(read.unused_data) - at) if read.eof else None


def mp4(d: bytes, at: int, told: Told):
    def box(i):
        """Where the box at i ends; None if there is none."""
        if i + 8 > len(d):
            return None
        size, head = u32(d, i), 8
        if size == 1 and i + 16 <= len(d):
            size, head = int.from_bytes(d[i + 8 : i + 16], "big"), 16
        return None if size < head or i + size > len(d) or not all(32 <= x < 127 for x in d[i + 4 : i + 8]) else i + size

    if box(at) is None or not told.has_moov(at, box):
        return None
    return "video/mp4", told.end("mp4", at, box) - at


VALIDATORS = {"png": png, "jpeg": jpeg, "gif": gif, "bmp": bmp, "riff": riff, "flac": flac, "ogg": ogg, "pdf": pdf, "zip": zipped, "gzip": gzipped, "mp4": mp4}


@cache
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for magic, back, name in SIGNATURES:
        out.add_word(magic.decode("latin-1"), (len(magic) - 1 + back, name))
    out.make_automaton()
    return out


def sniff(data: bytes | None) -> tuple[str, int, list[tuple[int, int, str]]]:
    """(type, length, embedded): what starts at offset 0, how long its structure says that it is, and the files within.

    embedded lists (offset, length, type) of the valid files that start later, the outermost ones only, in order. Data
    that no validator confirms at its start is UNKNOWN, with its own length.
    """
    data = data or b""
    kind, length, found, covered = UNKNOWN, len(data), [], 0
    known = Told(data)
    starts = sorted((end - back, name) for end, (back, name) in automaton().iter(data.decode("latin-1")))
    for at, name in starts:
        if at < 0 or at and at < covered:
            continue
        if told := VALIDATORS[name](data, at, known):
            if at == 0:
                kind, length = told
            else:
                if found and found[-1][2] in OPEN:
                    found[-1] = (found[-1][0], min(found[-1][1], at - found[-1][0]), found[-1][2])
                found.append((at, told[1], told[0]))
                covered = at + (told[1] if told[0] not in OPEN else 1)
    return kind, length, found


def wav(payload: bytes) -> bytes:
    """payload as the samples of an 8-bit mono WAV file."""
    pad = len(payload) % 2
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + pad) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, RATE, RATE, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + bytes(pad)


def samples(media: bytes) -> bytes:
    """The sample bytes of a WAV file."""
    i = 12
    while i + 8 <= len(media):
        size = l32(media, i + 4)
        if media[i : i + 4] == b"data":
            return media[i + 8 : i + 8 + size]
        i += 8 + size + size % 2
    raise ValueError("no data chunk")


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_bytes, media, declared): each whole text's bytes, padded to whole frames, as a WAV file.

    Null texts are empty ones, which fill one frame. The type is declared as unknown.
    """
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [padded(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([wav(p) for _, p in rows], pa.binary())], ["key", "n_bytes", "media"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_bytes bigint, media binary").withColumn("declared", F.lit(UNKNOWN))


def inspect(media: DataFrame, key: str = "key", content: str = "media", declared: str = "declared") -> DataFrame:
    """Rows (key, declared, type, corrected, length, whole, carved) for the rows of a media column.

    type is what the signature and structure at the start prove, else what was declared; corrected tells whether
    they differ; length is what the structure says, and whole whether that is all of the content; carved has the
    offset, length, type and bytes of each file found inside, the outermost ones only. Null content is
    empty: its type stays as declared (UNKNOWN if that is null too).
    """
    ship(media.sparkSession)
    kind = media.schema[key].dataType.simpleString()
    schema = f"key {kind}, declared string, type string, corrected boolean, length bigint, whole boolean, carved array<struct<offset:bigint,length:bigint,type:string,content:binary>>"
    part = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("content", pa.binary())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for told, data in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                data = data.as_py() or b""
                found, length, inside = sniff(data)
                real = found if found != UNKNOWN else told or UNKNOWN
                out.append((told, real, real != (told or UNKNOWN), length, length == len(data), [{"offset": o, "length": n, "type": t, "content": data[o : o + n]} for o, n, t in inside]))
            if out:
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.bool_(), part], strict=True))], ["key", "declared", "type", "corrected", "length", "whole", "carved"])

    return media.select(F.col(key).alias("key"), F.col(declared).alias("declared"), F.col(content).alias("content")).mapInArrow(run, schema)


FEATURES = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, media_type string, corrected boolean, carved_files int, carved_bytes bigint"


def features(media: bytes, declared: str = UNKNOWN) -> tuple:
    """FEATURES of a stored WAV file, from its own bytes; corrected tells whether its type was declared otherwise, carved_* what other files its samples hold."""
    kind, length, inside = sniff(media)
    if kind != "audio/wav" or length != len(media):
        raise ValueError("the stored file is not whole")
    payload = samples(media)
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    signs = x >= 128
    feature = f"type={kind};frames={len(x) // FRAME};peak={int(abs(x - 128).max())};mean={x.sum() / len(x):.4f};rms={np.sqrt(((x - 128) ** 2).sum() / len(x)):.4f};crossings={int((signs[1:] != signs[:-1]).sum())};carved={len(inside)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, kind, kind != declared, len(inside), sum(n for _, n, _ in inside)


def measure(stored: DataFrame) -> DataFrame:
    """Rows (key, n_bytes, and FEATURES) for the rows of store: computed from the stored files as read back."""
    ship(stored.sparkSession)

    @F.pandas_udf(FEATURES)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for files, declared in batches:
            yield pd.DataFrame([features(x, told) for x, told in zip(files, declared, strict=True)], columns=names)

    return stored.select("key", "n_bytes", run("media", "declared").alias("r")).select("key", "n_bytes", "r.*")


def round_trip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """measure's rows for docs whose files were written to a table in the shared folder and read back; checkpointed, and the table removed."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    try:
        store(docs, key, text).write.option("compression", "zstd").parquet(path)
        return cut(measure(spark.read.parquet(path)))
    finally:
        remove(spark, path)
