"""Main text of HTML pages by composite text density."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.plans.session import ship

TAG = re.compile(r"<!--(?:.*?-->|.*)|<!\[CDATA\[(?:.*?\]\]>|.*)|<[!?][^>]*+>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+(?:>|\Z))", re.S)
ATTR = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody thead tfoot tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, and the elements beyond which it does not look.
CLOSES = {"li": (frozenset(["li"]), frozenset(["ul", "ol", "menu", "dir"])), "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])), "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])), "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])), "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])), "option": (frozenset(["option"]), frozenset(["select", "datalist"])), "body": (frozenset(["head"]), frozenset())}
CLOSES |= dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset(["tbody", "thead", "tfoot"]), frozenset(["table"])))
PARAGRAPH = (frozenset(["p"]), frozenset("button caption html object table td th article section div body li blockquote main aside header footer nav form".split()))
#: Elements that hold no main text.
DROPPED = frozenset("head script style title noscript template iframe object embed svg math canvas audio video map nav footer aside form button select datalist input textarea dialog menu noembed noframes xmp".split())
ROLES = frozenset("navigation banner contentinfo complementary search searchbox dialog alertdialog alert form menu menubar toolbar tablist".split())
#: Words of class names and ids of what is not main text.
WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promos promoted promotion sidebar sidebars rail menu menus submenu nav navbar navigation navi breadcrumb breadcrumbs "
    "footer foot footers header headers masthead topbar navmenu comment comments commentlist commentary disqus respond reply replies cookie cookies consent gdpr notice notices notification notifications alert popup popover modal overlay banner banners "
    "newsletter subscribe subscription signup signin login share sharing shares social socials related recommended recommendations recommendation trending widget widgets toolbar pagination pager paywall disclaimer skip search form".split()
)
#: Words that say nothing beside one of WORDS in a class name or id: `comments-area` speaks of comments, `comment-theory` of something else.
NEUTRAL = frozenset("area bar block body bottom box button buttons center col column container content desktop fixed float global group head holder inner item items left link links list main middle mobile mod module outer page panel primary right row secondary section site slot sticky text title top unit view wide widget wrap wrapper zone".split())
KEPT = frozenset("html body main article".split())
#: What the density of an element whose name speaks of boilerplate, and of all that it holds, is multiplied by; and how many times the rest of the text it must hold to stay all the same.
NAMED, FAR = 0.1, 20
#: Blocks of running text: beside the path within an article they stay, however short.
TEXTUAL = frozenset("blockquote dd dl dt figcaption figure h1 h2 h3 h4 h5 h6 header hgroup li ol p pre table ul".split())
SPLIT = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z0-9])(?=[A-Z])")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("chars", "density", "depth", "dropped", "kids", "link_chars", "link_tags", "name", "parent", "soft", "tags")

    def __init__(self, name, parent, dropped=False, soft=False):
        self.name, self.parent, self.kids, self.dropped, self.soft = name, parent, [], dropped, soft
        self.depth = parent.depth + 1 if parent else 0
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = 0.0


def boilerplate(name: str, attrs: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element is no main text by its kind, and whether its class or id speaks of such: each part of a name is one of WORDS or NEUTRAL, and one at least of WORDS."""
    if name in DROPPED or name == "header" and not in_article:
        return True, False
    soft = False
    if "=" in attrs or "hidden" in attrs:
        for m in ATTR.finditer(attrs.rstrip("/>")):
            key, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and HIDDEN.search(value) or key == "role" and value.lower() in ROLES:
                return True, False
            if key in ("class", "id") and name not in KEPT:
                for word in value.split():
                    parts = [x.lower() for x in SPLIT.split(word) if x]
                    told = WORDS.intersection(parts)
                    if told and all(x in told or x in NEUTRAL or x.isdigit() for x in parts) and not (in_article and {"header", "headers"}.issuperset(told)):
                        soft = True
    return False, soft


def parse(html: str) -> Node:
    """The tree of a page: nodes whose kids are nodes and strings, with the end tags that HTML implies."""
    root = here = Node("#root", None)
    opened: dict[str, list[Node]] = {}
    at = 0

    def close(names, limits):
        """Ends the innermost open element among names, if none of limits is further in."""
        nonlocal here
        x = here if here.name in names else max((opened[n][-1] for n in names if opened.get(n)), key=lambda y: y.depth, default=None)
        if x is None or x is not here and any(opened[n][-1].depth > x.depth for n in limits if opened.get(n)):
            return
        while here is not x.parent:
            opened[here.name].pop()
            here = here.parent

    for m in iter(lambda: TAG.search(html, at), None):
        if m.start() > at:
            here.kids.append(html[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            if html.startswith("<![CDATA[", m.start()):
                continue
        elif m["end"]:
            if name in BLOCKS or name in CLOSES:
                close((name,), ())
            else:
                close((name,), BLOCKS)
        else:
            if name in BLOCKS:
                close(*PARAGRAPH)
            if name in CLOSES:
                close(*CLOSES[name])
            elif name in BLOCKS and here.name == "head":
                close(("head",), ())
            dropped, soft = boilerplate(name, m["attrs"], bool(opened.get("article") or opened.get("main")))
            node = Node(name, here, dropped, soft)
            here.kids.append(node)
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I).search(html, at)
                stop = end.start() if end else len(html)
                if name in ("textarea", "title"):
                    node.kids.append(html[at:stop])
                at = stop
                if end:
                    over = html.find(">", stop)
                    at = over + 1 if over >= 0 else len(html)
            elif name not in VOID:
                here = node
                opened.setdefault(name, []).append(node)
    if at < len(html):
        here.kids.append(html[at:])
    return root


def walk(node: Node) -> list[Node]:
    """The nodes that may hold main text, parents before kids."""
    out, todo = [], [node]
    while todo:
        x = todo.pop()
        out.append(x)
        todo += [k for k in reversed(x.kids) if isinstance(k, Node) and not k.dropped]
    return out


def densities(nodes: list[Node]) -> None:
    """Composite text density of each node: characters per tag, less the more of them are links, and less for what is named as boilerplate."""
    for x in nodes:
        x.chars, x.tags, x.link_chars, x.link_tags = 0, 0, 0, 0
    for x in reversed(nodes):
        x.chars += sum(len("".join(unescape(k).split())) for k in x.kids if isinstance(k, str))
        if x.name == "a":
            x.link_chars, x.link_tags = x.chars, x.link_tags + 1
        if x.parent is not None:
            p = x.parent
            p.chars += x.chars
            p.tags += x.tags + 1
            p.link_chars += x.link_chars
            p.link_tags += x.link_tags
    top = nodes[0]
    share = top.link_chars / max(1, top.chars)
    weight = {id(top.parent): 1.0}
    for x in nodes:
        weight[id(x)] = weight.get(id(x.parent), 1.0) * (NAMED if x.soft else 1.0)
        c, t, lc, lt = x.chars, max(1, x.tags), max(1, x.link_chars), max(1, x.link_tags)
        base = log(c / max(1, c - x.link_chars) * x.link_chars + share * c + e)
        x.density = weight[id(x)] * c / t * log(max(c / lc * (x.tags or 1) / lt, 1.0) + e - 1) / max(base, 1e-9) if c else 0.0


def open_kids(x: Node) -> list[Node]:
    return [k for k in x.kids if isinstance(k, Node) and not k.dropped]


def mostly_links(x: Node) -> bool:
    return x.link_tags > 1 and 3 * x.link_chars >= 2 * x.chars


def select(nodes: list[Node]) -> list[tuple[Node, float]]:
    """The tops of the subtrees that hold the main text, in page order, each with the density that named elements in it must reach.

    The subtree with the greatest sum of its nodes' kids' densities, and beside the path from it to the body (or to
    the article or main element about it, where there is one), headings and those subtrees that are as dense as the path's
    least dense node; within an article or main element also short blocks of running text.
    """
    best, most = None, 0.0
    above = ("#root", "html") if any(x.name == "body" for x in nodes) else ()
    for x in nodes:
        if x.name in above:
            continue
        kids = open_kids(x)
        total = sum(k.density for k in kids) or (0.0 if any(isinstance(k, Node) for k in x.kids) else x.density)
        if total > most:
            best, most = x, total
    if best is None:
        best = next((x for x in nodes if x.chars), None)
        if best is None:
            return []
    # a block of running text is part of what it stands in
    while (best.name not in BLOCKS or best.name in TEXTUAL) and best.parent is not None and best.parent.parent is not None and best.parent.name != "html":
        best = best.parent
    path = [best]
    while path[-1].parent is not None:
        path.append(path[-1].parent)
    body = next((i for i, x in enumerate(path) if x.name == "body"), len(path) - 1)
    path = path[: body + 1]
    least = min(x.density for x in path)
    ends = [i for name in ("article", "main") for i in [max((i for i, x in enumerate(path) if x.name == name), default=-1)] if i >= 0]
    within = bool(ends)
    path = path[: ends[0] + 1] if within else path
    kids = [k.density for k in open_kids(best) if k.density] or [best.density]
    needed = max(least, sum(kids) / len(kids) / 2)
    if any(isinstance(k, str) and k.strip() for x in path[1:] for k in x.kids):
        # text that stands beside the path belongs to no subtree of its own
        return [(path[-1], needed)]
    on_path = {id(x) for x in path}
    chosen = {id(best)}
    for x in path[1:]:
        for k in open_kids(x):
            if id(k) in on_path or not k.chars or mostly_links(k) or k.soft and k.density < needed or k.name == "article" and 2 * k.chars < best.chars:
                continue
            if k.name in HEADINGS or k.density >= least or within and k.name in TEXTUAL:
                chosen.add(id(k))
    return [(x, needed) for x in nodes if id(x) in chosen]


def blocks(top: Node, needed: float) -> list[str]:
    """The texts of a subtree's blocks in page order, with white space turned into single spaces.

    Left out are lists and other groups of blocks that are mostly links, elements that are named as boilerplate and less dense
    than needed, unless they hold most of the subtree by far, and articles within, if they are the lesser part of it.
    """
    out: list[str] = []
    line: list[str] = []

    def flush():
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    inner, named, todo = 0, 0, open_kids(top)
    while todo:  # the outermost named elements and articles within
        x = todo.pop()
        if x.soft:
            named += x.chars
        elif x.name == "article":
            inner += x.chars
        else:
            todo += open_kids(x)
    plain = top.chars - named
    lesser = 2 * inner <= plain

    def left_out(x: Node) -> bool:
        if x.dropped:
            return True
        if x.soft and x.density < needed and x.chars <= FAR * (plain + 3 * inner):  # what is marked as an article counts fourfold
            return True
        if 2 * x.chars > top.chars:
            return False
        return x.name == "article" and lesser or x.name in BLOCKS and x.name not in ("p", "li", "td", "th") and x.name not in HEADINGS and mostly_links(x)

    todo = [top]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(unescape(x))
        elif x is top or not left_out(x):
            if x.name in BLOCKS:
                flush()
                todo.append(None)
            elif x.name in ("br", "td", "th"):
                line.append(" ")
            todo += reversed(x.kids)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The main text of a page; empty if it has none."""
    root = parse(html or "")
    for _ in range(2):
        nodes = walk(root)
        if len(nodes) > 1 or any(isinstance(k, str) and k.strip() for k in root.kids):
            densities(nodes)
            if text := "\n\n".join(b for top, needed in select(nodes) for b in blocks(top, needed)):
                return text
        # a page whose whole body is a form
        todo = [root]
        while todo:
            x = todo.pop()
            x.dropped &= x.name != "form"
            todo += [k for k in x.kids if isinstance(k, Node)]
    return ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Rows (key, url, text, n_chars) for the rows of pages: the main text of the whole html.

    Null html and pages without text give an empty text. Markup that is cut off, or not closed, is read as
    far as it goes. Names of classes and ids only weigh on densities: what is named as boilerplate must be that much denser, or
    hold most of the text. Repeated rows give repeated rows; other columns are not read.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([main_text(t) for t in texts], dtype=object)

    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), run(F.col(html)).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
