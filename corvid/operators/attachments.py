"""Attachments and PDF bytes."""

from __future__ import annotations

import re
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions import fixed, urls


def magic_format(payload: Column) -> Column:
    """The first format of the table whose signature a payload starts with."""
    out = None
    for name, signatures in fixed.MAGIC:
        for s in signatures:
            cond = F.startswith(payload, F.unhex(F.lit(s.hex())))
            out = F.when(cond, name) if out is None else out.when(cond, name)
    return out


def extension(filename: Column) -> Column:
    return F.when(F.contains(F.coalesce(filename, F.lit("")), F.lit(".")), F.lower(F.substring_index(filename, ".", -1))).otherwise("")


def anomaly(filename: Column, content_type: Column, detected: Column) -> Column:
    """What does not fit among extension, content type and signature; null if all do. OOXML files are zip archives."""
    ext = extension(filename)
    known = F.create_map(*[x for k, v in fixed.CONTENT_TYPES.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))])
    expected = F.try_element_at(known, F.lower(content_type))
    office = detected.eqNullSafe("zip") & ext.isin("docx", "xlsx", "pptx")
    return F.nullif(F.concat_ws("; ", F.when((ext != "") & detected.isNotNull() & (detected != ext) & ~office, F.concat(F.lit("extension ."), ext, F.lit(" but content is "), detected)), F.when((ext != "") & (F.size(F.coalesce(expected, F.array().cast("array<string>"))) > 0) & ~F.array_contains(expected, ext), F.concat(F.lit("extension ."), ext, F.lit(" but declared as "), content_type))), F.lit(""))


def record(filename: Column, content_type: Column, payload: Column) -> Column:
    detected = magic_format(payload)
    return F.struct(
        filename.alias("filename"), content_type.alias("content_type"), F.hex(F.substring(payload, 1, 16)).alias("magic_bytes_hex"), detected.alias("magic_detected_format"), extension(filename).alias("extension"),
        anomaly(filename, content_type, detected).alias("anomaly"), F.md5(payload).alias("hash_md5"), F.sha1(payload).alias("hash_sha1"), F.sha2(payload, 256).alias("hash_sha256"), F.octet_length(payload).cast("long").alias("size_bytes"),
    )


def attachment_role(disposition: Column, content_id: Column, content_type: Column) -> Column:
    """inline_resource for referenced inline images, else attachment."""
    inline = (F.lower(F.coalesce(disposition, F.lit(""))) == "inline") | (F.coalesce(content_id, F.lit("")) != "")
    return F.when(inline & F.startswith(F.lower(F.coalesce(content_type, F.lit(""))), F.lit("image/")), "inline_resource").otherwise("attachment")


# fixed values: indicators in a PDF by their names, with a severity; those that are a behaviour; those that are context only
PDF_INDICATORS = {
    "javascript": (["JavaScript", "JS"], "high"), "open_action": (["OpenAction"], "medium"), "additional_action": (["AA"], "high"), "launch_action": (["Launch"], "critical"), "embedded_file": (["EmbeddedFile", "Filespec", "EmbeddedFiles"], "high"), "acroform": (["AcroForm"], "low"),
    "xfa": (["XFA"], "high"), "uri": (["URI"], "low"), "submit_form": (["SubmitForm"], "high"), "rich_media": (["RichMedia", "Movie", "Sound", "3D"], "high"), "remote_goto": (["GoToR", "GoToE"], "low"), "import_data": (["ImportData"], "high"), "jbig2": (["JBIG2Decode"], "low"),
    "object_stream": (["ObjStm", "XRefStm"], "info"), "uri_nested_redirect": ([], "high"), "uri_tracked_redirect": ([], "high"), "public_site_landing": ([], "high"),
}
PDF_BEHAVIOURS = ["launch_action", "javascript", "submit_form", "import_data", "xfa", "embedded_file", "rich_media", "additional_action", "uri_nested_redirect", "uri_tracked_redirect", "public_site_landing"]
PDF_OPENERS = ["javascript", "launch_action", "submit_form", "rich_media", "import_data"]
PDF_CONTEXT = ["uri", "remote_goto", "jbig2", "object_stream", "acroform"]
REDIRECT_PARAMS = ["url", "u", "uri", "target", "to", "dest", "destination", "redirect", "redirect_uri", "return", "returnurl", "next", "continue", "__url"]
TRACKING_PARAMS = ["uid", "analytics", "track", "click", "pixel", "count", "campaign", "visitor", "session"]
TRACKING_PATHS = ["analytics", "tracking", "track", "pixel", "count"]


def unescape_names(body: Column) -> Column:
    """#41 in a PDF name becomes A."""
    parts = F.split(body, "#(?=[0-9a-fA-F]{2})")
    decoded = F.transform(F.slice(parts, 2, 1 << 30), lambda x: F.concat(F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("long")), F.substring(x, 3, 1 << 30)))
    return F.concat(F.element_at(parts, 1), F.array_join(decoded, ""))


def pdf_scan(payload: Column) -> Column:
    """(indicators as a map of counts, objects, streams, eof, encrypted, urls) of a PDF's bytes, read as Latin-1."""
    text = F.decode(payload, "ISO-8859-1")
    body = F.when(text.rlike("#[0-9a-fA-F]{2}"), unescape_names(text)).otherwise(text)
    found = F.array_distinct(F.regexp_extract_all(body, F.lit(r"https?://[^\s<>()\[\]{}\"']+"), F.lit(0)))
    by_name = {k: F.regexp_count(body, F.lit(rf"/(?:{'|'.join(names)})(?![A-Za-z0-9])")) for k, (names, _) in PDF_INDICATORS.items() if names}
    by_url = {"uri_nested_redirect": lambda u: F.size(nested_redirects(u)) > 0, "uri_tracked_redirect": lambda u: tracked(u) & (F.size(nested_redirects(u)) > 0), "public_site_landing": public_landing}
    counts = by_name | {k: F.size(F.filter(found, f)) for k, f in by_url.items()}
    names = F.map_from_arrays(F.array(*map(F.lit, counts)), F.array(*counts.values()))
    return F.struct(F.map_filter(names, lambda k, v: v > 0).alias("names"), F.regexp_count(body, F.lit(r"\b\d+\s+\d+\s+obj\b")).alias("objects"), F.regexp_count(body, F.lit(r"\bstream\b")).alias("streams"), F.regexp_count(body, F.lit("%%EOF")).alias("eof"), body.rlike(r"/Encrypt(?![A-Za-z0-9])").alias("encrypted"), found.alias("urls"))


def pdf_indicators(names: Column) -> Column:
    """The indicators as (severity, count, key), the worst first, then the most frequent."""
    rank = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}
    table = F.create_map(*[x for k, (_, level) in PDF_INDICATORS.items() for x in (F.lit(k), F.struct(F.lit(rank[level]).alias("rank"), F.lit(level).alias("severity")))])
    rows = F.array_sort(F.transform(F.map_entries(names), lambda e: F.struct(F.element_at(table, e["key"])["rank"].alias("rank"), (-e["value"]).alias("back"), e["key"].alias("key"))))
    return F.transform(rows, lambda r: F.struct(F.element_at(table, r["key"])["severity"].alias("severity"), (-r["back"]).alias("count"), r["key"].alias("key")))


def pdf_behaviours(names: Column) -> Column:
    """What a PDF does by its indicators, the worst first; opening counts only beside something that acts."""
    has = lambda k: F.map_contains_key(names, k)
    acts = has(PDF_OPENERS[0])
    for k in PDF_OPENERS[1:]:
        acts = acts | has(k)
    return F.array_compact(F.array(*[F.when(has(k), k) for k in PDF_BEHAVIOURS], F.when(has("open_action") & acts, "open_action")))


def pdf_risk(names: Column, encrypted: Column | None = None) -> Column:
    context = F.size(F.array_intersect(F.map_keys(names), F.array(*map(F.lit, PDF_CONTEXT)))) > 0
    done = pdf_behaviours(names)
    return F.when(F.array_contains(done, "launch_action"), "critical").when(F.size(done) > 0, "high").when(F.lit(False) if encrypted is None else encrypted, "medium").when(context, "low").otherwise("clean")


def tracked(url: Column) -> Column:
    """Whether a URL's place or its parameters' names speak of tracking."""
    u = F.lower(F.coalesce(url, F.lit("")))
    place = F.concat_ws(" ", urls.host(u), urls.path(u))
    names = F.transform(F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&"), lambda kv: F.substring_index(kv, "=", 1))
    return place.rlike("|".join(TRACKING_PATHS)) | F.exists(names, lambda n: n.rlike("|".join(TRACKING_PARAMS)))


def public_landing(url: Column) -> Column:
    """Whether a URL leads to a page or form that anyone can put up (hosts and paths are fixed values)."""
    h, p = urls.host(url), F.lower(urls.path(url))
    return ((h == "sites.google.com") & p.startswith("/view/")) | h.isin("forms.gle", "forms.office.com") | ((h == "docs.google.com") & p.startswith("/forms/"))


def uri_evidence(scans: DataFrame, key: str, found: str = "urls", samples: int = 5) -> DataFrame:
    """Rows (key, url_count, nested_redirect_count, tracked_redirect_count, public_site_landing_count, samples) over a message's different URLs (array column)."""
    u = F.col(found)
    nested = F.filter(u, lambda x: F.size(nested_redirects(x)) > 0)
    return scans.select(key, F.size(u).alias("url_count"), F.size(nested).alias("nested_redirect_count"), F.size(F.filter(nested, tracked)).alias("tracked_redirect_count"), F.size(F.filter(u, public_landing)).alias("public_site_landing_count"), F.slice(u, 1, samples).alias("samples"))


def severity_flag(severity: Column) -> Column:
    s = F.lower(F.coalesce(severity, F.lit("")))
    return F.when(s.isin("critical", "high"), "HIGH").when(s == "medium", "MEDIUM").otherwise("INFO")


def nested_redirects(url: Column) -> Column:
    """URLs within a URL: those in its parameters, whole ones for redirect parameters, and those that decoding brings to light; percent-decoded up to three times, ten at most."""
    pattern = F.lit(r"(?i)https?://[^\s<>()\[\]{}\"']+")
    u = F.coalesce(url, F.lit(""))
    pairs = F.split(F.regexp_extract(u, r"\?([^#]*)", 1), "&")

    def inside(kv):
        value = urls.percent_decoded(F.substring_index(F.regexp_replace(kv, "^[^=]*=", "\u0001"), "\u0001", -1))
        whole = F.lower(F.substring_index(kv, "=", 1)).isin(REDIRECT_PARAMS) & value.rlike("(?i)^https?://")
        return F.when(whole, F.array(value)).otherwise(F.regexp_extract_all(value, pattern, F.lit(0)))

    decoded = urls.percent_decoded(u)
    more = F.when(decoded != u, F.filter(F.regexp_extract_all(decoded, pattern, F.lit(0)), lambda x: ~x.startswith(F.substring_index(u, "?", 1)))).otherwise(F.array().cast("array<string>"))
    return F.slice(F.array_distinct(F.concat(F.flatten(F.transform(pairs, inside)), more)), 1, 10)


def coerced(payload: Column, kind: Column) -> Column:
    """(payload, warning) of an attachment's raw payload: kind tells whether it is `bytes`, an undecoded `text`, or nothing that can be read."""
    told = lambda p, w: F.struct(p.alias("payload"), F.lit(w).cast("string").alias("warning"))
    none = F.lit(None).cast("binary")
    return (
        F.when(payload.isNull() | kind.isNull(), told(none, "Attachment payload empty or not decodable"))
        .when(kind == "bytes", told(payload, None))
        .when(kind == "text", told(payload, "Attachment payload was not decoded by email parser"))
        .otherwise(F.struct(none.alias("payload"), F.concat(F.lit("Unsupported attachment payload type: "), kind).alias("warning")))
    )


PDF_URL = r"(?i)https?://[^\s<>()\[\]{}\"']+"


def evidence_of(found: Column, count: Column) -> Column:
    """The evidence of URLs found = array of (object, url): counts over different URLs with what is nested in them, samples of hosts, and signatures."""
    told = F.transform(found, lambda x: F.struct(x["object"].alias("object"), x["url"].alias("url"), nested_redirects(x["url"]).alias("nested")))
    told = F.transform(told, lambda x: F.struct(x["object"].alias("object"), x["url"].alias("url"), x["nested"].alias("nested"), F.array_join(F.concat(F.array(x["url"]), x["nested"]), "|").alias("signature")))
    signatures = F.transform(told, lambda x: x["signature"])
    once = F.filter(told, lambda x, i: F.array_position(signatures, x["signature"]) == i + 1)
    redirects = lambda x: F.size(x["nested"]) > 0
    lands = lambda x: F.exists(F.when(redirects(x), x["nested"]).otherwise(F.array(x["url"])), public_landing)
    hosts = lambda x: F.array_distinct(F.filter(F.transform(F.concat(F.array(x["url"]), x["nested"]), lambda u: F.regexp_replace(urls.host(u), r"^\.+|\.+$", "")), lambda h: h != ""))
    label = lambda x: F.when(x["object"].isNotNull(), F.concat(F.lit("object "), x["object"])).otherwise("PDF URI")
    samples = F.array_distinct(F.transform(F.filter(once, lambda x: redirects(x) | lands(x)), lambda x: F.concat(label(x), F.lit(": "), F.array_join(hosts(x), " -> "))))
    n = lambda test: F.size(F.filter(once, test))
    return F.struct(
        count.alias("url_count"), F.size(found).alias("uri_action_url_count"), n(redirects).alias("nested_redirect_count"), n(lambda x: redirects(x) & tracked(x["url"])).alias("tracked_redirect_count"), n(lands).alias("public_site_landing_count"),
        F.slice(samples, 1, 5).alias("samples"), F.slice(F.array_sort(F.array_distinct(signatures)), 1, 50).alias("signatures"),
    )


def object_evidence(body: Column) -> Column:
    """The evidence of a PDF's text (Latin-1): the URLs of those objects that hold /URI, with their numbers; without such, all URLs."""
    every = F.regexp_extract_all(body, F.lit(PDF_URL), F.lit(0))
    objects = F.filter(F.regexp_extract_all(body, F.lit(r"(?is)\d+\s+\d+\s+obj.*?(?:endobj|$)"), F.lit(0)), lambda o: F.contains(o, F.lit("/URI")))
    name = lambda o: F.regexp_replace(F.regexp_extract(o, r"(?i)^(\d+\s+\d+)\s+obj", 1), r"\s+", " ")
    acts = F.flatten(F.transform(objects, lambda o: F.transform(F.regexp_extract_all(o, F.lit(PDF_URL), F.lit(0)), lambda u: F.struct(name(o).alias("object"), u.alias("url")))))
    plain = F.transform(every, lambda u: F.struct(F.lit(None).cast("string").alias("object"), u.alias("url")))
    return evidence_of(F.when(F.size(acts) > 0, acts).otherwise(plain), F.size(every))


def merged_evidence(items: Column) -> Column:
    """Several pieces of evidence as one, in order: URLs add up; redirects and landings only of pieces that have a signature that none before has (or none at all)."""
    zero = F.struct(
        *[F.lit(0).alias(k) for k in ("url_count", "uri_action_url_count", "nested_redirect_count", "tracked_redirect_count", "public_site_landing_count")],
        *[F.array().cast("array<string>").alias(k) for k in ("samples", "signatures")],
    )

    def add(acc, x):
        fresh = (F.size(x["signatures"]) == 0) | (F.size(F.array_except(x["signatures"], acc["signatures"])) > 0)
        more = lambda k: (acc[k] + F.when(fresh, x[k]).otherwise(0)).alias(k)
        both = lambda k: F.array_distinct(F.concat(acc[k], x[k])).alias(k)
        return F.struct((acc["url_count"] + x["url_count"]).alias("url_count"), (acc["uri_action_url_count"] + x["uri_action_url_count"]).alias("uri_action_url_count"), more("nested_redirect_count"), more("tracked_redirect_count"), more("public_site_landing_count"), both("samples"), both("signatures"))

    return F.aggregate(F.filter(items, lambda x: x.isNotNull()), zero, add, lambda a: F.struct(*[a[k].alias(k) for k in ("url_count", "uri_action_url_count", "nested_redirect_count", "tracked_redirect_count", "public_site_landing_count")], F.slice(a["samples"], 1, 5).alias("samples"), F.slice(F.array_sort(a["signatures"]), 1, 50).alias("signatures")))


def pdf_structure(payload: Column, most_bytes: int = fixed.MAX_PDF_BYTES) -> Column:
    """(text, objects, walked, error) of what a PDF's compressed streams hold, which a scan of its bytes does not see.

    Streams with /FlateDecode as their only filter are inflated, up to most_bytes in all and 5,000 streams; what they spell
    (object streams above all) is returned as Latin-1. A stream that cannot be inflated is told in error, and the others still count.
    """
    head = re.compile(rb"(\d+)\s+\d+\s+obj\b(.{0,4096}?)\bstream\r?\n", re.S)

    @F.pandas_udf("text string, objects int, walked int, error string")
    def run(values: pd.Series) -> pd.DataFrame:
        def walk(raw):
            if not raw or not raw.startswith(b"%PDF"):
                return None, 0, 0, None
            out, left, n, bad = [], most_bytes, 0, None
            for m in head.finditer(raw):
                if n >= 5000 or left <= 0:
                    break
                words = m[2]
                if b"/FlateDecode" not in words and b"/Fl " not in words or b"/Image" in words or re.search(rb"/Filter\s*\[\s*/(?!FlateDecode\s*\])", words):
                    continue
                n += 1
                try:
                    data = zlib.decompressobj().decompress(raw[m.end() : m.end() + left], left)
                except zlib.error as e:
                    bad = bad or f"object {m[1].decode()}: {e}"
                    continue
                left -= len(data)
                out.append(data.decode("latin-1"))
            return "\n".join(out), len(re.findall(rb"\b\d+\s+\d+\s+obj\b", raw)), n, bad

        return pd.DataFrame([walk(None if v is None else bytes(v)) for v in values], columns=["text", "objects", "walked", "error"])

    return run(payload)


def pdf_security(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """rows with a column pdf: (is_pdf, risk_level, suspicious, indicators, behaviors, evidence, encrypted, objects, streams, parser, error, summary) of each payload.

    A payload that isn't a PDF is not_pdf; one of more than 25 MiB is not scanned. What its bytes show and what its compressed
    streams hold are counted together, and the two pieces of URL evidence merged.
    """
    p = F.col(payload)
    is_pdf = F.coalesce(F.startswith(p, F.unhex(F.lit(b"%PDF".hex()))), F.lit(False))
    fits = F.octet_length(p) <= fixed.MAX_PDF_BYTES
    scan = F.when(is_pdf & fits, p)
    inner = rows.withColumn("corvid_raw", scan).withColumn("corvid_in", pdf_structure(F.col("corvid_raw")))
    inner = inner.withColumn("corvid_a", pdf_scan(F.coalesce("corvid_raw", F.lit(b"")))).withColumn("corvid_b", pdf_scan(F.encode(F.coalesce("corvid_in.text", F.lit("")), "ISO-8859-1")))
    names = F.map_zip_with(F.col("corvid_a.names"), F.col("corvid_b.names"), lambda k, a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))
    inner = inner.withColumn("corvid_n", names)
    seen = merged_evidence(F.array(object_evidence(F.decode(F.coalesce("corvid_raw", F.lit(b"")), "ISO-8859-1")), object_evidence(F.coalesce("corvid_in.text", F.lit("")))))
    n, encrypted = F.col("corvid_n"), F.col("corvid_a.encrypted")
    found = pdf_indicators(n)
    words = F.array_join(F.transform(F.slice(found, 1, 8), lambda x: F.concat(x["key"], F.lit(" x"), x["count"].cast("string"))), "; ")
    summary = F.when(~is_pdf, "Not a PDF document").when(~fits, F.concat(F.lit("PDF too large for deep static scan ("), F.octet_length(p).cast("string"), F.lit(" bytes)"))).otherwise(F.coalesce(F.nullif(words, F.lit("")), F.lit("No active PDF features detected")))
    risk = F.when(~is_pdf, "not_pdf").when(~fits, "medium").otherwise(pdf_risk(n, encrypted))
    done = F.when(is_pdf & fits, pdf_behaviours(n)).otherwise(F.array().cast("array<string>"))
    parser = F.when(~is_pdf, "not_pdf").when(~fits, "skipped-size-limit").otherwise("streams")
    error = F.when(is_pdf & ~fits, "PDF exceeds static analysis size limit").otherwise(F.col("corvid_in.error"))
    out = F.struct(is_pdf.alias("is_pdf"), risk.alias("risk_level"), (F.size(done) > 0).alias("suspicious"), found.alias("indicators"), done.alias("behaviors"), seen.alias("evidence"), (is_pdf & fits & encrypted).alias("encrypted"), F.col("corvid_a.objects").alias("objects"), F.col("corvid_a.streams").alias("streams"), parser.alias("parser"), error.alias("error"), summary.alias("summary"))
    return inner.withColumn("pdf", out).drop("corvid_raw", "corvid_in", "corvid_a", "corvid_b", "corvid_n")
