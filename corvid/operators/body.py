"""Lines of bodies: what a model should read of a reply or a forward. Line rules are array expressions, so nothing is shuffled."""

from __future__ import annotations

import re
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import fixed


def lines(text: Column) -> Column:
    """A text's lines, without the white space at their ends."""
    return F.transform(F.split(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", ""))


def joined(ls: Column) -> Column:
    t = F.regexp_replace(F.array_join(ls, "\n"), r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(t, r"\n{3,}", "\n\n")


def first_where(ls: Column, test) -> Column:
    """The least place, from 0, at which test(line, place) holds; null if there is none."""
    return F.array_min(F.filter(F.transform(ls, lambda x, i: F.when(test(x, i), i)), lambda i: i.isNotNull()))


def meaningful(ls: Column, end: Column) -> Column:
    """How many of the first `end` lines aren't blank."""
    return F.size(F.filter(F.slice(ls, 1, end), lambda x: F.trim(x) != ""))


def without_tail(ls: Column) -> Column:
    """(lines, removed): blank lines at the end, and all from the first boilerplate line after 1 line of text, or sign-off after 2."""
    last = F.coalesce(F.array_max(F.transform(ls, lambda x, i: F.when(F.trim(x) != "", i + 1))), F.lit(0))
    body = F.slice(ls, 1, last)
    # the running number of lines of text before each line, computed once
    seen = F.aggregate(body, F.array().cast("array<int>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + (F.trim(x) != "").cast("int"))))
    before = lambda i: F.when(i == 0, 0).otherwise(F.get(seen, i - 1))
    cut = F.array_min(F.transform(body, lambda x, i: F.when((x.rlike(fixed.BOILERPLATE_LINE) & (before(i) >= 1)) | (x.rlike(fixed.SIGN_OFF) & (before(i) >= 2)), i)))
    end = F.coalesce(cut, last)
    return F.struct(F.slice(ls, 1, end).alias("lines"), (last - end).alias("removed"))


def without_quotes(ls: Column) -> Column:
    kept = F.filter(ls, lambda x: ~F.ltrim(x).startswith(">"))
    return F.struct(kept.alias("lines"), (F.size(ls) - F.size(kept)).alias("removed"))


def without_forward_headers(ls: Column) -> Column:
    """(lines, removed): the blank and header lines that a forwarded message starts with."""
    start = F.coalesce(first_where(ls, lambda x, i: (F.trim(x) != "") & ~F.trim(x).rlike(fixed.FORWARDED_HEADER)), F.size(ls))
    return F.struct(F.slice(ls, start + 1, F.greatest(F.size(ls) - start, F.lit(0))).alias("lines"), start.alias("removed"))


def reply_header_at(ls: Column) -> Column:
    """Where a reply's header block starts: From:, and 2 more headers in the next 6 lines before other text follows a header."""

    def count(i):
        near = F.slice(ls, i + 2, 6)
        step = lambda acc, x: F.when(acc["over"] | (F.trim(x) == ""), acc).when(F.trim(x).rlike(fixed.REPLY_HEADER), F.struct((acc["n"] + 1).alias("n"), acc["over"].alias("over"))).otherwise(F.struct(acc["n"].alias("n"), (acc["n"] > 0).alias("over")))
        return F.aggregate(near, F.struct(F.lit(0).alias("n"), F.lit(False).alias("over")), step, lambda acc: acc["n"])

    return first_where(ls, lambda x, i: F.when(x.rlike(fixed.REPLY_FROM), count(i) >= 2).otherwise(False))


def separator_at(ls: Column) -> Column:
    """Where a thread's separator stands: a ruled line, with 2 headers in the next 8 lines."""
    near = lambda i: F.size(F.filter(F.slice(ls, i + 2, 8), lambda x: F.trim(x).rlike(fixed.FORWARDED_HEADER)))
    return first_where(ls, lambda x, i: F.when(x.rlike(fixed.SEPARATOR), near(i) >= 2).otherwise(False))


def strip_noise(rows: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, text, removed_lines, removed_chars), one for each row of rows: runs of 8 or more encoded lines with 4096 characters or more in all are taken out.

    Lines are rows; a run is what lies between two changes of kind (gaps and islands). A group is one text: rows have numbers of
    their own, so that neither repeated nor null keys bring texts together.
    """
    t = F.replace(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    ls = rows.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("row"), t.alias("text")).select("key", "row", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("bare", F.trim("line"))
    ls = ls.withColumn("noise", F.col("bare").rlike("^[A-Za-z0-9+/=_-]{64,}$") & (F.size(F.array_distinct(F.split("bare", ""))) >= 12))
    w = Window.partitionBy("row").orderBy("pos")
    ls = ls.withColumn("turn", (F.col("noise") != F.lag("noise", 1, False).over(w)).cast("int")).withColumn("run", F.sum("turn").over(w))
    runs = ls.groupBy("row", "run").agg(F.first("key").alias("key"), F.first("noise").alias("noise"), F.count("*").alias("n"), F.sum(F.length("bare")).alias("chars"), F.sum(F.length("line")).alias("whole"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("part"))
    runs = runs.withColumn("gone", F.col("noise") & (F.col("n") >= 8) & (F.col("chars") >= 4096))
    out = runs.groupBy("row").agg(F.first("key").alias("key"), F.sum(F.when(F.col("gone"), F.col("n")).otherwise(0)).alias("removed_lines"), F.sum(F.when(F.col("gone"), F.col("whole")).otherwise(0)).alias("removed_chars"), F.array_sort(F.collect_list(F.when(~F.col("gone"), F.struct("run", "part")))).alias("kept"))
    return out.select("key", joined(F.transform(F.flatten(F.transform("kept", lambda r: r["part"])), lambda x: x["line"])).alias("text"), "removed_lines", "removed_chars")


def without_encoded(raw: Column) -> Column:
    """A raw message to show: runs of 4 or more base64 or quoted-printable lines become a line that tells how many there were.

    A base64 run starts with a line of 20 characters or more and goes on over lines of 4 or more; a shorter run stays as it is.
    """
    b64, qp = re.compile(r"[A-Za-z0-9+/]+=*"), re.compile(r"=[0-9A-Fa-f]{2}|=$")

    def kinds(bare):
        """Of each line: (kind, its run); kinds are b, q and nothing."""
        inside, run, last = False, 0, ""
        for x in bare:
            fits = len(x) >= 4 and b64.fullmatch(x) is not None
            inside = fits and (inside or len(x) >= 20)
            kind = "b" if inside else "q" if qp.search(x) else ""
            run += kind != last
            last = kind
            yield kind, run

    def shown(text):
        lines = text.splitlines(keepends=True)
        out = []
        told = list(zip(kinds(x.strip() for x in lines), lines, strict=True))
        for (kind, _), part in groupby(told, key=lambda t: t[0]):
            part = [x for _, x in part]
            if kind and len(part) >= 4:
                size = f", ~{sum(map(len, part)) * 3 // 4 // 1024} KB" if kind == "b" else ""
                out.append(f"[... {'base64' if kind == 'b' else 'quoted-printable'} content removed ({len(part)} rows{size}) ...]\n")
            else:
                out += part
        return "".join(out)

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else shown(v))

    # only texts that have such lines at all go to Python
    t = F.coalesce(raw, F.lit(""))
    some = t.rlike(r"(?m)^\s*[A-Za-z0-9+/]{20,}=*\s*$") | t.rlike(r"=[0-9A-Fa-f]{2}") | t.rlike(r"(?m)=\s*$")
    return F.coalesce(run(F.when(some, t)), t)


def layer(text: Column) -> Column:
    """(context, lines, removed_quoted, removed_headers, removed_tail): the conversation layer that a model should read.

    In order of precedence: after a forward marker with its headers off; before a reply marker; before a reply's header block; before a
    thread's separator; all. Quoted lines go from all but forwards, tails from all.
    """
    ls = lines(text)
    forward = first_where(ls, lambda x, i: x.rlike(fixed.FORWARD_MARKER))
    reply = first_where(ls, lambda x, i: x.rlike(fixed.REPLY_MARKER) & (meaningful(ls, i) > 0))
    header = first_where(ls, lambda x, i: F.lit(False) | (i == reply_header_at(ls)) & (meaningful(ls, i) > 0))
    separator = first_where(ls, lambda x, i: F.lit(False) | (i == separator_at(ls)) & (meaningful(ls, i) > 0))
    context = F.when(forward.isNotNull(), "forwarded").when(reply.isNotNull(), "reply").when(header.isNotNull(), "reply_header").when(separator.isNotNull(), "thread_separator").otherwise("normal")
    cut = F.coalesce(reply, header, separator, F.size(ls))
    after = without_forward_headers(F.slice(ls, forward + 2, F.size(ls)))
    kept = without_quotes(F.slice(ls, 1, cut))
    body = F.when(forward.isNotNull(), after["lines"]).otherwise(kept["lines"])
    tail = without_tail(body)
    return F.struct(context.alias("context"), tail["lines"].alias("lines"), F.when(forward.isNotNull(), 0).otherwise(kept["removed"]).alias("removed_quoted"), F.when(forward.isNotNull(), after["removed"]).otherwise(F.size(ls) - cut).alias("removed_headers"), tail["removed"].alias("removed_tail"))


def evidence_segments(text: Column) -> Column:
    """Sentences and lines of 8 characters or more, the first of each apart from case."""
    # by name alone, trim would get an element's place as the characters to take off
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda x: F.trim(x))
    return F.array_distinct(F.transform(F.filter(parts, lambda x: F.length(x) >= 8), F.lower))
