"""Reputation lookups: distinct keys out, results joined back."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.functions import fixed, urls
from corvid.operators.context import short_text
from corvid.plans.session import cut


def plan(rows: DataFrame, key: str, **entities: str) -> DataFrame:
    """Rows (entity_type, entity_key, n_messages): every different key to look up, once."""
    one = F.array(*[F.struct(F.lit(t).alias("entity_type"), F.col(c).cast("string").alias("entity_key")) for t, c in entities.items()])
    return rows.select(F.col(key), F.inline(one)).where("entity_key is not null and entity_key != ''").groupBy("entity_type", "entity_key").agg(F.countDistinct(key).alias("n_messages"))


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str) -> DataFrame:
    """rows with the table's columns, null where it has nothing. Spark broadcasts the table if its size allows."""
    return rows.join(table.withColumnRenamed(table_key, key), key, "left")


def vendor_status(malicious: Column, suspicious: Column, harmless: Column) -> Column:
    return F.when(malicious > 0, "malicious").when(suspicious > 0, "suspicious").when(harmless > 0, "clean").otherwise("unknown")


def utc_minute(epoch: Column) -> Column:
    """Whole seconds since 1970 as a UTC minute, in any session time zone. Years have four digits at least and no plus sign; seconds whose days don't fit a date give null."""
    second = F.pmod(epoch, F.lit(86400))
    day = F.date_from_unix_date(((epoch - second) / 86400).try_cast("int"))
    year = F.year(day).cast("string")
    two = lambda n: F.lpad(n.cast("int").cast("string"), 2, "0")
    return F.concat(F.when(F.year(day).between(0, 999), F.lpad(year, 4, "0")).otherwise(year), F.lit("-"), two(F.month(day)), F.lit("-"), two(F.day(day)), F.lit(" "), two(F.floor(second / 3600)), F.lit(":"), two(F.floor(F.pmod(second, F.lit(3600)) / 60)), F.lit(" UTC"))


def vendor_file(payload: Column) -> Column:
    """A vendor's JSON about a file as a typed struct; missing counts are 0."""
    get = lambda k: F.get_json_object(payload, f"$.data.attributes.{k}")
    n = lambda k: F.coalesce(get(f"last_analysis_stats.{k}").try_cast("int"), F.lit(0))
    bad, doubt, silent, fine = n("malicious"), n("suspicious"), n("undetected"), n("harmless")
    total = bad + doubt + silent + fine
    return F.struct(
        F.when(bad > 0, "malicious").when(doubt > 0, "suspicious").when(total > 0, "clean").otherwise("unknown").alias("status"), bad.alias("malicious"), doubt.alias("suspicious"), silent.alias("undetected"), total.alias("total_engines"),
        F.concat_ws(" / ", (bad + doubt).cast("string"), total.cast("string")).alias("detection_ratio"), F.coalesce(get("popular_threat_classification.suggested_threat_label"), F.lit("")).alias("threat_label"), F.coalesce(get("type_description"), F.lit("")).alias("file_type"),
        utc_minute(get("first_submission_date").try_cast("long")).alias("first_submission"), utc_minute(get("last_analysis_date").try_cast("long")).alias("last_analysis"),
    )


def two_step(rows: DataFrame, key: str, addresses: DataFrame, scores: DataFrame) -> DataFrame:
    """rows with the worst score of the addresses that their domain (key) resolves to: addresses (domain, ip), scores (ip, score)."""
    worst = addresses.join(scores, "ip", "left").groupBy("domain").agg(F.max("score").alias("score"), F.count("*").alias("n_addresses"))
    return rows.join(worst.withColumnRenamed("domain", key), key, "left")


# ------------------------------------------------------------------ context that a vendor's users gave


def elements(value: Column) -> Column:
    """The elements of a JSON list, as JSON texts: a list's own; of an object its data, items or results, or itself if it reads as one item, else its values; a single value otherwise."""
    v = F.trim(F.coalesce(value, F.lit("")))
    listed = lambda x: F.from_json(x, "array<string>")
    inner = F.coalesce(*[F.when(F.startswith(F.ltrim(F.get_json_object(v, f"$.{k}")), F.lit("[")), F.get_json_object(v, f"$.{k}")) for k in ("data", "items", "results")])
    alone = F.coalesce(*[F.get_json_object(v, f"$.{k}") for k in ("attributes", "title", "severity", "context")]).isNotNull()
    values = F.map_values(F.from_json(v, "map<string,string>"))
    return F.when(v.isin("", "null", "[]", "{}"), F.array().cast("array<string>")).when(F.startswith(v, F.lit("[")), listed(v)).when(F.startswith(v, F.lit("{")) & inner.isNotNull(), listed(inner)).when(F.startswith(v, F.lit("{")) & ~alone, values).otherwise(F.array(v))


def details(value: Column) -> Column:
    """A JSON value as short texts: an object's `key: value`, a list's elements, or the value."""
    v = F.trim(F.coalesce(value, F.lit("")))
    pairs = F.transform(F.filter(F.map_entries(F.from_json(v, "map<string,string>")), lambda e: e["value"].isNotNull() & ~e["value"].isin("", "[]", "{}")), lambda e: short_text(F.concat(e["key"], F.lit(": "), e["value"])))
    each = F.transform(F.filter(F.from_json(v, "array<string>"), lambda x: x.isNotNull() & (x != "")), lambda x: short_text(x))
    found = F.when(v == "", F.array().cast("array<string>")).when(F.startswith(v, F.lit("{")), pairs).when(F.startswith(v, F.lit("[")), each).otherwise(F.array(short_text(v)))
    return F.slice(found, 1, 8)


def shared_context(attributes: Column) -> Column:
    """The first 10 items (severity, title, source, date, details) of what a vendor's users said of a file, from the JSON of its attributes."""
    get = lambda x, *keys: F.coalesce(*[F.nullif(F.get_json_object(x, f"$.{k}"), F.lit("")) for k in keys])
    raw = get(attributes, "crowdsourced_context", "crowdsourced_contexts", "crowdsourced_context_items")

    def item(x):
        own = F.get_json_object(x, "$.attributes")
        x = F.when(F.startswith(F.ltrim(F.coalesce(own, F.lit(""))), F.lit("{")), own).otherwise(x)
        level = F.upper(F.coalesce(get(x, "severity", "level", "type"), F.lit("INFO")))
        said = [details(F.get_json_object(x, f"$.{k}")) for k in ("details", "description", "classification_description", "contextual_indicators", "metadata")]
        return F.struct(
            F.when(level.isin("HIGH", "MEDIUM", "LOW", "INFO", "SUCCESS"), level).otherwise("INFO").alias("severity"),
            short_text(F.coalesce(get(x, "title", "name", "summary", "context", "indicator"), F.lit("Crowdsourced context")), 180).alias("title"),
            short_text(get(x, "source", "source_name", "provider"), 120).alias("source"),
            utc_minute(get(x, "timestamp", "date", "created", "created_at").try_cast("long")).alias("date"),
            F.slice(F.concat(*said), 1, 8).alias("details"),
        )

    return F.slice(F.transform(F.filter(elements(raw), lambda x: F.startswith(F.ltrim(x), F.lit("{"))), item), 1, 10)


# ------------------------------------------------------------------ destinations


def public_ip(ip: Column) -> Column:
    """Whether an IPv4 or IPv6 address is globally routable. IPv4 is an expression; only IPv6 goes to Python."""

    @F.pandas_udf("boolean")
    def six(values: pd.Series) -> pd.Series:
        def test(v):
            try:
                return bool(v) and ipaddress.ip_address(v).is_global
            except ValueError:
                return False

        return values.map(test)

    bare = F.regexp_replace(F.trim(F.coalesce(ip, F.lit(""))), r"^\[|\]$", "")
    return urls.public_ipv4(bare) | (F.contains(bare, F.lit(":")) & six(F.when(F.contains(bare, F.lit(":")), bare)))


def destination_guard(url: Column, addresses: Column) -> Column:
    """Why a URL must not be fetched, or an empty text: only http(s), with a host, without credentials, and with addresses (array; resolved elsewhere) that are all public IPv4."""
    u = F.coalesce(F.trim(url), F.lit(""))
    scheme = F.lower(F.regexp_extract(u, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    authority = F.regexp_extract(u, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)
    return (
        F.when(~scheme.isin("http", "https"), "Only HTTP(S) destinations are allowed")
        .when(urls.host(u) == "", "Destination hostname is missing")
        .when(F.regexp_extract(authority, "^([^@]+)@", 1) != "", "Destination URLs containing credentials are not allowed")
        .when(addresses.isNull() | (F.size(addresses) == 0), "Destination DNS lookup returned no addresses")
        .when(F.exists(addresses, lambda a: ~urls.public_ipv4(a)), "Private, loopback, reserved, or otherwise non-public destinations are blocked")
        .otherwise("")
    )


def destinations(rows: DataFrame, key: str, url: str, hops: DataFrame, blocked: DataFrame, most: int = fixed.MAX_REDIRECTS) -> DataFrame:
    """Rows (key, final_url, final_host, destination_status, destination_match, redirect_count): each URL followed through hops (url, location).

    blocked (url): those that the guard refuses; a chain that meets one ends there. A chain of more than `most` redirects is
    unavailable. Each round is one join; rows whose URL leads no further are not joined again.
    """
    h = hops.select(F.col("url").alias("at"), "location").dropDuplicates(["at"])
    b = blocked.select(F.col("url").alias("at"), F.lit(True).alias("refused")).distinct()
    live = rows.select(F.col(key).alias("key"), F.col(url).alias("first"), F.col(url).alias("at"), F.lit(0).alias("n"))
    done = None
    for i in range(most + 2):
        met = cut(live.join(b, "at", "left").join(h, "at", "left"))
        go_on = met["refused"].isNull() & met["location"].isNotNull() & F.lit(i <= most)
        over = go_on & (F.col("n") >= most)
        stop = met.where(~go_on | over).select("key", "first", "at", "n", F.when(F.col("first").isNull() | (F.col("first") == ""), "skipped").when(F.col("refused"), "blocked").when(over, "unavailable").alias("state"))
        done = stop if done is None else done.unionByName(stop)
        live = met.where(go_on & ~over).select("key", "first", F.col("location").alias("at"), (F.col("n") + 1).alias("n"))
    same = urls.same_registered_domain(urls.host(F.col("first")), urls.host(F.col("at")))
    state = F.coalesce("state", F.when(same, "match").otherwise("mismatch"))
    return done.select("key", F.coalesce("at", F.lit("")).alias("final_url"), urls.host(F.col("at")).alias("final_host"), state.alias("destination_status"), (state == "match").alias("destination_match"), F.when(F.col("state") == "unavailable", F.col("n") + 1).otherwise(F.col("n")).alias("redirect_count"))


class Lookups:
    """What a job looks things up in: for each kind of entity a reference table (entity_key, …), or a function that makes one of the keys to look up."""

    def __init__(self, **providers):
        self.providers = providers

    def results(self, keys: DataFrame) -> dict[str, DataFrame]:
        """A table (entity_key, …) for each kind that has a provider; keys: the rows of plan(). Functions see each different key once."""
        return {kind: p(keys.where(F.col("entity_type") == kind).select("entity_key")) if callable(p) else p for kind, p in self.providers.items()}

    def joined(self, rows: DataFrame, keys: DataFrame, **columns: str) -> DataFrame:
        """rows with each kind's results beside the column that has its keys, as a struct named by the kind; null where nothing is known."""
        for kind, found in self.results(keys).items():
            if kind in columns:
                rest = [c for c in found.columns if c != "entity_key"]
                rows = rows.join(found.select(F.col("entity_key").alias(columns[kind]), F.struct(*rest).alias(kind)), columns[kind], "left")
        return rows
