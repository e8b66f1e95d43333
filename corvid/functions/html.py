"""Visible text of HTML, for Python leaves and as an Arrow function."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: elements that start a new line, that hold no text, and styles that hide
BLOCKS = frozenset("address article aside blockquote dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
SILENT = frozenset("script style head template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = re.compile(r"(?is)(?:display\s*:\s*none|visibility\s*:\s*hidden|opacity\s*:\s*0(?:\D|$)|font-size\s*:\s*0(?:\D|$))")
SIGNATURE = re.compile(r"(?:^|[-_])(?:email[-_]?signature|mail[-_]?signature|signature)(?:$|[-_])", re.I)
NOT_ACTION = re.compile(r"(?:^|[-_])(?:email[-_]?signature|mail[-_]?signature|signature|footer)(?:$|[-_])", re.I)


class Reader(HTMLParser):
    """Collects text outside hidden elements, and anchors with the elements about them."""

    def __init__(self, drop_signatures: bool):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[tuple[str, bool, bool]] = []  # name, hides its content, marks a signature or footer
        self.hidden = 0
        self.drop = drop_signatures
        self.links: list[dict] = []
        self.anchor: dict | None = None

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag in BLOCKS or tag == "br":
            self.out.append("\n")
        if tag == "img" and not self.hidden and a.get("alt", "").strip():
            self.out.append(f" {a['alt'].strip()} ")
        names = [a.get("id", ""), *a.get("class", "").split()]
        marked = tag == "footer" or any(NOT_ACTION.search(x) for x in names)
        hides = tag in SILENT or "hidden" in a or a.get("aria-hidden", "").strip().lower() == "true" or bool(HIDDEN.search(a.get("style", ""))) or self.drop and any(SIGNATURE.search(x) for x in names)
        if tag == "a" and a.get("href"):
            role = "unsubscribe" if "unsubscribe" in a.get("rel", "").lower().split() else "signature_or_footer" if marked or any(m for _, _, m in self.open) else "body_action"
            self.anchor = {"url": a["href"].strip(), "display_text": "", "role": role}
            self.links.append(self.anchor)
        if tag not in VOID:
            self.open.append((tag, hides, marked))
            self.hidden += hides

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag == "a":
            self.anchor = None
        if any(x[0] == tag for x in self.open):
            while True:
                name, hides, _ = self.open.pop()
                self.hidden -= hides
                if name == tag:
                    break
        if tag in BLOCKS:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)
        if self.anchor is not None:
            self.anchor["display_text"] += data


def read(html: str | None, drop_signatures: bool = False) -> Reader:
    reader = Reader(drop_signatures)
    reader.feed(html or "")
    reader.close()
    return reader


def visible_text(html: str | None, drop_signatures: bool = False) -> str:
    """The text that a reader sees, a line for each block; inline elements join what they part."""
    lines = (x.strip() for x in "".join(read(html, drop_signatures).out).splitlines())
    return re.sub(" {2,}", " ", "\n".join(x for x in lines if x)).strip()


def visible(html: Column, drop_signatures: bool = False) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: visible_text(h, drop_signatures))

    return run(F.coalesce(html, F.lit("")))


def anchors(html: Column) -> Column:
    """Anchors as (url, display_text, role), in order."""

    @F.pandas_udf("array<struct<url:string,display_text:string,role:string>>")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: [{**x, "display_text": " ".join(x["display_text"].split())[:120]} for x in read(h).links])

    return run(F.coalesce(html, F.lit("")))


# fixed values: elements and attributes that a preview may not hold
ACTIVE = frozenset("script style iframe object embed form input button textarea select meta link base svg math template head".split())
UNSAFE = frozenset("src srcset href action formaction background poster data xlink:href".split())


class Cleaner(HTMLParser):
    """Rebuilds a page without what could act or load."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.out: list[str] = []
        self.inside: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in ACTIVE:
            if tag not in VOID:
                self.inside.append(tag)
            return
        if self.inside:
            return
        if tag == "img":
            alt = dict(attrs).get("alt") or "image"
            self.out.append(f"[{alt.replace('<', '&lt;')}]")
            return
        kept = [(k, v or "") for k, v in attrs if k not in UNSAFE and not k.startswith("on") and not (k == "style" and re.search(r"(?i)url\s*\(|expression|position\s*:\s*fixed|@import", v or ""))]
        self.out.append("<" + tag + "".join(f' {k}="{v.replace(chr(34), "&quot;")}"' for k, v in kept) + ">")

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag in ACTIVE and tag not in VOID and self.inside:
            self.inside.pop()

    def handle_endtag(self, tag):
        if tag in ACTIVE:
            if tag in self.inside:
                while self.inside.pop() != tag:
                    pass
        elif not self.inside and tag not in VOID:
            self.out.append(f"</{tag}>")

    def handle_data(self, data):
        if not self.inside:
            self.out.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def safe_preview(html: str | None) -> str:
    """A page that can be shown: no scripts, forms, loads or handlers; images become their alternative texts."""
    c = Cleaner()
    c.feed(html or "")
    c.close()
    return "".join(c.out)


def preview(html: Column) -> Column:
    @F.pandas_udf("string")
    def run(pages: pd.Series) -> pd.Series:
        return pages.map(safe_preview)

    return run(html)
