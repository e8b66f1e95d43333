"""Text as column expressions: normalization, fingerprints, labels, placeholders."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions import fixed


def nfkc(text: Column) -> Column:
    """Compatibility composition. Only texts that aren't ASCII go to Python, in Arrow batches; Spark has no such function."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")

    return F.coalesce(run(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def spaces_for_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B-\x1F\x7F-\x9F]", " ")


def strip_tags(html: Column) -> Column:
    """HTML without tags, a space for each, with the five common entities decoded."""
    out = F.regexp_replace(html, r"<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"')):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return out


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def normalize(text: Column, compose: bool = True) -> Column:
    """Null-safe model normalization: NFKC (unless compose is false), controls to spaces, tags off, lower case, single spaces."""
    t = F.coalesce(text, F.lit(""))
    t = spaces_for_controls(nfkc(t) if compose else t)
    return collapse(F.lower(F.when(t.rlike(r"<[a-zA-Z][^>]*>"), strip_tags(t)).otherwise(t)))


def text_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def template(normalized: Column) -> Column:
    """A normalized text with its URLs, addresses, ids and numbers replaced by their kind."""
    t = F.regexp_replace(normalized, r"(?U)https?://\S+|www\.\S+", " URL ")
    t = F.regexp_replace(t, r"[a-z0-9._%+\-]+@[a-z0-9.\-]+", " EMAIL ")
    t = F.regexp_replace(t, r"(?U)\b[0-9a-f]{16,}\b", " ID ")
    t = F.regexp_replace(t, r"(?U)\b\d+\b", " NUM ")
    t = collapse(F.translate(F.regexp_replace(t, r"(?U)[^\w]+", " "), "_", " "))
    return F.coalesce(F.nullif(t, F.lit("")), normalized)


def template_hash(normalized: Column) -> Column:
    t = template(normalized)
    return F.when(t == "", "").otherwise(F.sha2(t, 256))


def parse_label(value: Column) -> Column:
    """0, 1 or null: numbers other than 0 and 1 are null before any synonym is tried."""
    raw = value.cast("string")
    number = F.trim(raw).try_cast("double")
    word = F.regexp_replace(F.lower(F.trim(raw)), r"(?U)[\s_\-]+", " ")
    return F.when(number.isNotNull(), F.when(number == 0, 0).when(number == 1, 1)).when(word.isin(fixed.LEGITIMATE_LABELS), 0).when(word.isin(fixed.PHISHING_LABELS), 1)


def placeholders(text: Column) -> Column:
    """Private and noisy values replaced by labels, in the fixed order."""
    for pattern, label in fixed.PLACEHOLDERS:
        text = F.regexp_replace(text, pattern, label.replace("$", r"\$"))
    return text


def mark_links(html: Column) -> Column:
    """Anchors keep their text, followed by a sign that they lead somewhere."""
    return F.regexp_replace(html, r"(?is)(<a\b[^>]*\bhref\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)[^>]*>)(.*?)(</a\s*>)", r"$1$2 [URL LINK]$3")


def compact(body: Column, has_links: Column | None = None) -> Column:
    """A body for a model: tags off, placeholders in, white space tidied; a URL label at its end if only its HTML had links."""
    t = F.coalesce(body, F.lit(""))
    t = F.when(t.rlike(r"(?s)</?[A-Za-z][A-Za-z0-9:-]*(?:\s[^>]*)?/?>"), strip_tags(mark_links(t))).otherwise(t)
    t = placeholders(spaces_for_controls(t))
    if has_links is not None:
        t = F.when(has_links & ~F.contains(t, F.lit("[URL LINK]")), F.concat(F.rtrim(t), F.lit("\n[URL LINK]"))).otherwise(t)
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"[ \t]+", " "), r" *\n *", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def strip_invisible(text: Column) -> Column:
    """Format characters and variation selectors off."""
    return F.regexp_replace(nfkc(text), r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]", "")


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def clip(text: Column, limit: int) -> Column:
    """At most limit characters, cut at the last space if there is one, with an ellipsis."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_replace(head, r"\s+\S*\z", "")
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.rtrim(F.when(cut == "", head).otherwise(cut)), F.lit("…")))


def defang(url: Column) -> Column:
    """A URL that no program follows: [://] for ://, and [.] for the dots of its authority."""
    scheme, authority, rest = (F.regexp_extract(url, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)(.*)$", i) for i in (1, 2, 3))
    return F.when(scheme == "", F.replace(url, F.lit("."), F.lit("[.]"))).otherwise(F.concat(scheme, F.lit("[://]"), F.replace(authority, F.lit("."), F.lit("[.]")), rest))


def html_like(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?is)<\s*(?:!doctype\s+html|html|body|table|div|span|p|br|a|img|style|head)\b"), F.lit(False))


def overlapping(text: Column, limit: int, overlap: int | None = None) -> Column:
    """Pieces of at most limit characters that cover a text, each starting overlap (at most a third of limit) before the last one's end.

    A piece ends at the last blank line, else line, sentence or space, in its last 35 %, if there is one.
    """
    back = min(overlap if overlap is not None else limit // 8, limit // 3)

    def pieces(t: str) -> list[str]:
        out, at = [], 0
        while at < len(t):
            end = min(len(t), at + limit)
            if end < len(t):
                low = at + int(limit * 0.65)
                for mark in ("\n\n", "\n", ". ", " "):
                    found = t.rfind(mark, low, end)
                    if found >= 0:
                        end = found + len(mark)
                        break
            out.append(t[at:end])
            if end == len(t):
                break
            at = max(at + 1, end - back)
        return out

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pieces(t or ""))

    return run(text)


def anonymize(text: Column) -> Column:
    """Private values and the names after salutations and titles replaced by labels, in the fixed order."""
    for pattern, label in fixed.ANONYMOUS:
        text = F.regexp_replace(text, pattern, label)
    return text
