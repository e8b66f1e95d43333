"""Headers, hops and authentication results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import fixed, urls


def header(headers: DataFrame, name: str) -> DataFrame:
    """Rows (msg_id, value): the first header of that name, with single spaces. headers: (msg_id, ord, name, value)."""
    found = headers.where(F.lower("name") == name.lower()).groupBy("msg_id").agg(F.min(F.struct("ord", "value")).alias("f"))
    return found.select("msg_id", F.trim(F.regexp_replace("f.value", r"(?U)\s+", " ")).alias("value"))


def header_values(headers: DataFrame, name: str) -> DataFrame:
    """Rows (msg_id, values): all headers of that name, in order."""
    rows = headers.where(F.lower("name") == name.lower()).groupBy("msg_id").agg(F.array_sort(F.collect_list(F.struct("ord", "value"))).alias("f"))
    return rows.select("msg_id", F.transform("f", lambda x: F.trim(F.regexp_replace(x["value"], r"(?U)\s+", " "))).alias("values"))


def bulk_signals(names: Column, auto_submitted: Column, precedence: Column) -> Column:
    """The sorted signals of mass mail in a message's header names, with the values of two headers."""
    known = F.create_map(*[x for h in fixed.BULK_HEADERS for x in (F.lit(h.lower()), F.lit(h))])
    present = F.array_distinct(F.filter(F.transform(names, lambda n: F.try_element_at(known, F.lower(n))), lambda x: x.isNotNull()))
    extra = F.filter(F.array(F.when(F.lower(F.trim(auto_submitted)) != "no", F.concat(F.lit("Auto-Submitted="), F.lower(F.trim(auto_submitted)))), F.when(F.lower(F.trim(precedence)).isin("bulk", "list", "junk"), F.concat(F.lit("Precedence="), F.lower(F.trim(precedence))))), lambda x: x.isNotNull())
    return F.array_sort(F.concat(present, extra))


def reply_to_legitimate(sender: Column, reply: Column, bulk: Column) -> Column:
    """Whether a Reply-To that differs from From is harmless: the same registered domain, or mass mail from a no-reply address to a general one."""
    same = urls.same_registered_domain(urls.domain(sender), urls.domain(reply))
    general = bulk & urls.local_part(sender).isin(fixed.NO_REPLY_LOCALS) & urls.local_part(reply).isin(fixed.GENERIC_REPLY_LOCALS)
    return F.coalesce(sender.isNotNull() & reply.isNotNull() & (same | general), F.lit(False))


def display_name_spoofing(sender: Column) -> Column:
    """The address that a From's display name shows, if it is of another domain than the sender's; else null."""
    shown = F.regexp_extract(F.regexp_extract(sender, r"^(.*)<", 1), r"(?U)[\w.+\-]+@[\w.\-]+\.\w+", 0)
    return F.when((shown != "") & (urls.domain(shown) != urls.domain(urls.address(sender))), shown)


def clean_host(raw: Column) -> Column:
    h = F.regexp_replace(F.regexp_replace(F.trim(raw), r"^\[|\]$", ""), r"%[^\]\s]*$", "")
    return F.nullif(F.regexp_replace(h, r"[.,;]+$", ""), F.lit(""))


def hop(raw: Column) -> Column:
    """A Received header as (from_host, by_host, for_address, tls_version, tls_cipher, received_at, ips)."""
    get = lambda p, i=1: F.nullif(F.regexp_extract(raw, p, i), F.lit(""))
    stamp = F.regexp_replace(F.regexp_replace(F.trim(F.substring_index(raw, ";", -1)), r"^\w{3},\s*", ""), r"\s*\([^)]*\)\s*$", "")
    stamp = F.regexp_replace(stamp, r"\s+(?:GMT|UT|UTC|Z)$", " +0000")
    at = F.try_to_timestamp(F.regexp_replace(stamp, r"\s+", " "), F.lit("d MMM yyyy HH:mm:ss xx"))
    ips = F.array_distinct(F.filter(F.regexp_extract_all(raw, F.lit(r"\[?([0-9a-fA-F:.]+)\]?"), F.lit(1)), urls.ip_host))
    return F.struct(
        clean_host(get(r"(?i)\bfrom\s+(\[[^\]]+\]|[^\s;()]+)")).alias("from_host"), clean_host(get(r"(?i)\bby\s+(\[[^\]]+\]|[^\s;()]+)")).alias("by_host"), get(r"(?i)\bfor\s+<([^>]+)>").alias("for_address"),
        get(r"(?i)(?:version=)?(TLSv?[\d.]+)\s+(?:cipher|version)=([\w\-]+)").alias("tls_version"), get(r"(?i)(?:version=)?(TLSv?[\d.]+)\s+(?:cipher|version)=([\w\-]+)", 2).alias("tls_cipher"),
        F.when(F.contains(raw, F.lit(";")), at).alias("received_at"), ips.alias("all_ips"),
    )


def preferred_ip(ips: Column) -> Column:
    """The first public address, else the first."""
    return F.coalesce(F.try_element_at(F.filter(ips, urls.public_ipv4), F.lit(1)), F.try_element_at(ips, F.lit(1)))


def route(hops: DataFrame, key: str, pos: str, at: str) -> DataFrame:
    """hops with their place on the way from sender to recipient, from 1: by time if every hop of a message has one, else in reverse order."""
    whole = F.min(F.col(at).isNotNull()).over(Window.partitionBy(key))
    w = Window.partitionBy(key).orderBy(F.when(F.col("whole"), F.col(at)), F.desc(pos))
    return hops.withColumn("whole", whole).withColumn("route_ord", F.row_number().over(w)).drop("whole")


def auth_priority(status: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in fixed.AUTH_PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.coalesce(status, F.lit("unknown")))), F.lit(50))


def auth_results(rows: DataFrame, key: str, raw: str) -> DataFrame:
    """Rows (key, ord, proto, status, identity) of the spf, dkim and dmarc results in a header text."""
    parts = F.filter(F.split(F.col(raw), r"(?i)(?=\b(?:spf|dkim|dmarc)\s*=)"), lambda x: x.rlike(r"(?i)^(?:spf|dkim|dmarc)\s*="))
    r = rows.select(F.col(key), F.posexplode(parts).alias("ord", "part"))
    p = r"(?i)^(spf|dkim|dmarc)\s*=\s*([a-zA-Z0-9_-]+)"
    r = r.withColumn("proto", F.upper(F.regexp_extract("part", p, 1))).withColumn("status", F.lower(F.regexp_extract("part", p, 2)))
    return r.where("proto != ''").select(key, "ord", "proto", "status", F.nullif(F.regexp_extract("part", r"(?i)\b(?:header|smtp)\.[a-zA-Z0-9_-]+\s*=\s*([^\s;]+)", 1), F.lit("")).alias("identity"))


def worst(rows: DataFrame, keys: list[str], status: str = "status", order: str = "ord") -> DataFrame:
    """Of each key the worst status, the first at a tie, and how many results it has. One aggregation."""
    top = F.max(F.struct(auth_priority(F.col(status)).alias("p"), (-F.col(order)).alias("back"), F.col(status).alias("status"))).alias("top")
    return rows.groupBy(*keys).agg(top, F.count("*").alias("n_results")).select(*keys, "top.status", (-F.col("top.back")).alias(order), "n_results")


def spf_status(raw: Column) -> Column:
    return F.lower(F.regexp_extract(raw, r"^\s*([A-Za-z0-9_-]+)", 1))


def merged_results(keys: list[str], **sources: DataFrame) -> DataFrame:
    """The worst status of each key over several sources of results (…, ord, status), with the source that it is from; earlier sources win ties."""
    from functools import reduce

    tagged = [df.select(*keys, (F.col("ord") + F.lit(i * 1000)).alias("ord"), "status", F.lit(name).alias("source")) for i, (name, df) in enumerate(sources.items())]
    rows = reduce(DataFrame.unionByName, tagged)
    top = F.max(F.struct(auth_priority(F.col("status")).alias("p"), (-F.col("ord")).alias("back"), "status", "source")).alias("top")
    return rows.groupBy(*keys).agg(top, F.count("*").alias("n_results")).select(*keys, "top.status", "top.source", "n_results")


def shown_status(effective: Column, direct: Column, arc: Column, received: Column, has_signature: Column | None = None) -> Column:
    """The status to show: the first known one, `present` for a signature without a result, else none."""
    signed = F.when(has_signature, "present") if has_signature is not None else F.lit(None).cast("string")
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in (effective, direct, arc, received)], signed, F.lit("none"))


def sender_domains(sender: Column, return_path: Column, reply_to: Column) -> Column:
    """The different domains of a message's sender addresses, in that order."""
    return F.array_distinct(F.filter(F.array(*[urls.domain(urls.address(c)) for c in (sender, return_path, reply_to)]), lambda d: F.coalesce(d != "", F.lit(False))))


def spf_sender_ip(received_spf: Column, auth: Column, last_hop_ips: Column, second_ip: Column) -> Column:
    """The address that SPF is about: client-ip of the last Received-SPF (array) that has a public one, else smtp.remote-ip of Authentication-Results, else the last hop's first public address, else the second hop's sender (IPv4)."""
    clients = F.transform(F.reverse(F.coalesce(received_spf, F.array().cast("array<string>"))), lambda h: F.regexp_extract(h, r"(?i)client-ip=([\d.a-fA-F:]+)", 1))
    remote = F.regexp_extract(F.coalesce(auth, F.lit("")), r"(?i)smtp\.remote-ip=([\d.]+)", 1)
    first = lambda a: F.try_element_at(F.filter(a, urls.public_ipv4), F.lit(1))
    return F.coalesce(first(clients), F.when(urls.public_ipv4(remote), remote), first(F.coalesce(last_hop_ips, F.array().cast("array<string>"))), second_ip)
