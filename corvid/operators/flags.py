"""Flags, severity and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def flag(cond: Column, level: str, field: str, message: str) -> Column:
    return F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), F.lit(message).alias("message")))


def flags(*rules: Column) -> Column:
    """The flags whose rules hold, in the rules' order."""
    return F.filter(F.array(*rules), lambda x: x.isNotNull())


def level_counts(rows: DataFrame, key: str, level: str = "level") -> DataFrame:
    c = lambda v: F.count_if(F.col(level) == v).alias(v.lower())
    return rows.groupBy(key).agg(c("HIGH"), c("MEDIUM"), c("LOW"), c("INFO"))


def severity(high: Column, medium: Column, low: Column, verdict: Column | None = None) -> Column:
    """A verdict's own severity, else that of the worst flag."""
    out = F.when(high > 0, "CRITICAL").when(medium > 0, "SUSPICIOUS").when(low > 0, "WATCH").otherwise("LOW")
    return out if verdict is None else F.when(verdict == "phishing", "CRITICAL").when(verdict == "suspicious", "SUSPICIOUS").when(verdict == "legitimate", "LOW").otherwise(out)


def level_rank(level: Column) -> Column:
    return F.when(level == "HIGH", 0).when(level == "MEDIUM", 1).when(level == "LOW", 2).otherwise(3)


def top_alerts(rows: DataFrame, key: str, order: list, most: int = 5) -> DataFrame:
    """The first alerts of each key: a top-k report. Window's group limit keeps k rows of a key in each task before the shuffle."""
    return rows.withColumn("alert_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("alert_rank") <= most)


def abuse_label(score: Column, whitelisted: Column) -> Column:
    return F.when(whitelisted, "clean").when(score.isNull(), "unknown").when(score >= 75, "malicious").when(score >= 25, "suspicious").when(score == 0, "clean").otherwise("low_risk")


def score_risk(score: Column) -> Column:
    return F.when(score.isNull(), "unknown").when(score >= 75, "high").when(score >= 25, "medium").otherwise("low")


def hop_role(place: Column, size: Column) -> Column:
    return F.when(place == 0, "recipient").when(place == size - 1, "sender").when(place == 1, "injection").otherwise("relay")


def first_json(text: Column) -> Column:
    """The outermost braces of a model's answer, without fences; null if they hold no JSON."""
    body = F.regexp_extract(F.regexp_replace(F.coalesce(text, F.lit("")), r"```(?:json)?", ""), r"(?s)\{.*\}", 0)
    return F.when(F.try_parse_json(body).isNotNull(), body)


def message_flags(c=F.col) -> Column:
    """The flags of a message's report, in their order, from (spf, dkim, dmarc, has_dkim, reply_to_mismatch, reply_to_legitimate, return_path_mismatch, is_bulk, html_only, display_name_spoofing, injection_ip)."""
    status = lambda k: F.upper(F.coalesce(c(k), F.lit("")))
    named = lambda cond, level, field, message: F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(field).alias("field"), message.alias("message")))
    return F.filter(
        F.array(
            named(c("spf").isNull() | (c("spf") != "pass"), "MEDIUM", "SPF", F.coalesce(F.concat(F.lit("SPF "), F.upper(c("spf"))), F.lit("SPF missing"))),
            named((status("dkim") != "") & (c("dkim") != "pass"), "MEDIUM", "DKIM", F.concat(F.lit("DKIM "), status("dkim"))),
            flag(((status("dkim") == "") | (c("dkim") == "pass")) & ~c("has_dkim"), "MEDIUM", "DKIM", "DKIM missing"),
            named(c("dmarc").isNull() | ~c("dmarc").isin("pass", "bestguesspass"), "MEDIUM", "DMARC", F.coalesce(F.concat(F.lit("DMARC "), F.upper(c("dmarc"))), F.lit("DMARC missing"))),
            flag(c("reply_to_mismatch"), "HIGH", "Reply-To", "Reply-To differs from From"),
            flag(~c("reply_to_mismatch") & c("reply_to_legitimate"), "INFO", "Reply-To", "Reply-To differs as it does in common routing"),
            named(c("return_path_mismatch"), "", "Return-Path", F.lit("Return-Path differs from From")).withField("level", F.when(c("is_bulk"), "LOW").otherwise("MEDIUM")),
            flag(c("html_only"), "INFO", "Body", "body is HTML only"),
            flag(c("display_name_spoofing"), "HIGH", "Display Name", "display name shows another address"),
            flag(c("injection_ip").isNotNull(), "INFO", "Received", "injection server has an address"),
        ),
        lambda x: x.isNotNull(),
    )


def indicators(rows: DataFrame, key: str, **groups: str) -> DataFrame:
    """Rows (key, kind, indicator, ord): each group's different values in order of first sight, defanged for URLs and domains. groups: kind = array column."""
    from corvid.functions.text import defang

    one = F.flatten(F.array(*[kinds(F.col(col), kind) for kind, col in groups.items()]))
    r = rows.select(F.col(key), F.inline(one)).where("value is not null and value != ''")
    r = r.groupBy(key, "kind", "value").agg(F.min("ord").alias("ord"))
    return r.select(key, "kind", F.when(F.col("kind").isin("url", "domain", "ip", "sender"), defang(F.col("value"))).otherwise(F.col("value")).alias("indicator"), "ord")


def kinds(values: Column, kind: str) -> Column:
    return F.transform(F.coalesce(values, F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(kind).alias("kind"), v.alias("value"), i.alias("ord")))
