"""Addresses, hosts and URLs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions import fixed


def address(raw: Column) -> Column:
    """The address between angle brackets, else the first bare one, else null."""
    return F.coalesce(F.nullif(F.regexp_extract(raw, r"<([^>]+)>", 1), F.lit("")), F.nullif(F.regexp_extract(raw, r"(?U)[\w.+\-]+@[\w.\-]+", 0), F.lit("")))


def domain(addr: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(addr, F.lit("")), r"(?U)@([\w.\-]+)", 1))


def local_part(addr: Column) -> Column:
    """What stands before the last @, in lower case."""
    return F.lower(F.trim(F.regexp_extract(F.coalesce(addr, F.lit("")), r"(?s)^(.*)@[^@]*$", 1)))


def registered_domain(host: Column) -> Column:
    """The last two labels: no list of public suffixes is consulted."""
    return F.substring_index(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", ""), ".", -2)


def same_registered_domain(a: Column, b: Column) -> Column:
    return F.coalesce((a != "") & (b != "") & (registered_domain(a) == registered_domain(b)), F.lit(False))


def repair_userinfo(url: Column) -> Column:
    """https://[anything]@host becomes https://host."""
    return F.regexp_replace(F.trim(url), r"(?i)^(https?://)\[[^\]/?#@]*\]@(.+)$", "$1$2")


def host(url: Column) -> Column:
    """The lower-cased host, empty if there is none; user info and port are left out."""
    return F.lower(F.regexp_extract(F.coalesce(repair_userinfo(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1))


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(repair_userinfo(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def with_scheme(value: Column) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(v == "", "").when(F.startswith(v, F.lit("//")), F.concat(F.lit("https:"), v)).when(F.startswith(F.lower(v), F.lit("www.")) | ~F.contains(v, F.lit("://")), F.concat(F.lit("http://"), v)).otherwise(v)


def web_candidate(value: Column) -> Column:
    """Whether a value is a web URL, or reads as one without its scheme."""
    v = F.trim(F.coalesce(value, F.lit("")))
    scheme = F.lower(F.regexp_extract(v, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    bare = F.regexp_replace(v, r"[.,;)]+$", "").rlike(r"(?iU)^(?:[^\W_][\w\-]*\.)+[^\W_]{2,}$")
    return F.when(v == "", False).when(scheme != "", scheme.isin("http", "https")).otherwise(F.startswith(F.lower(v), F.lit("www.")) | bare)


def dedupe_key(url: Column) -> Column:
    """The URL with scheme and authority in lower case, and / for an empty path."""
    u = repair_userinfo(url)
    scheme, authority, p, rest = (F.regexp_extract(u, r"(?s)^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(.*)$", i) for i in (1, 2, 3, 4))
    return F.when(scheme == "", u).otherwise(F.concat(F.lower(scheme), F.lit("://"), F.lower(authority), F.when(p == "", "/").otherwise(p), rest))


def sld(h: Column) -> Column:
    """The label before the last one, or the whole of a single label."""
    parts = F.split(F.regexp_replace(h, r"\.+$", ""), r"\.")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-2))).otherwise(h)


def shortener(h: Column, p: Column) -> Column:
    """Why a URL may be a short link's, or an empty text."""
    labels = F.split(h, r"\.")
    name = F.when(F.size(labels) >= 2, F.try_element_at(labels, F.lit(-2))).otherwise(h)
    token = F.substring_index(F.regexp_replace(p, r"^/+|/+$", ""), "/", 1)
    short = (F.length(name) <= 5) & (F.length(h) <= 12) & token.rlike(r"^[A-Za-z0-9_-]{4,12}$")
    mixed = token.rlike("[A-Za-z]") & token.rlike("[0-9]")
    return F.when(short & mixed, "compact host with short opaque path containing letters and digits").when(short, "compact host with short opaque path").otherwise("")


def ip_host(h: Column) -> Column:
    """Whether a host is an IPv4 or IPv6 address."""
    bare = F.regexp_replace(F.coalesce(h, F.lit("")), r"^\[|\]$", "")
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    four = rf"{octet}(?:\.{octet}){{3}}"
    six = rf"^(?:[0-9a-fA-F]{{1,4}}:){{7}}[0-9a-fA-F]{{1,4}}$|^(?:[0-9a-fA-F]{{1,4}}:){{6}}{four}$|^(?=.*::)(?!.*::.*::)(?!.*:::)(?!:[^:])(?:[0-9a-fA-F]{{0,4}}:){{2,7}}(?:[0-9a-fA-F]{{1,4}}|{four})?$"
    return bare.rlike(f"^{four}$") | bare.rlike(six)


def public_ipv4(ip: Column) -> Column:
    """Whether an IPv4 address is globally routable (the special ranges are fixed values)."""
    parts = F.transform(F.split(ip, r"\."), lambda x: x.try_cast("long"))
    number = F.aggregate(parts, F.lit(0).cast("long"), lambda acc, x: acc * 256 + x)
    special = [("0.0.0.0", 8), ("10.0.0.0", 8), ("100.64.0.0", 10), ("127.0.0.0", 8), ("169.254.0.0", 16), ("172.16.0.0", 12), ("192.0.0.0", 24), ("192.0.2.0", 24), ("192.168.0.0", 16), ("198.18.0.0", 15), ("198.51.100.0", 24), ("203.0.113.0", 24), ("224.0.0.0", 4), ("240.0.0.0", 4)]
    inside = F.lit(False)
    for base, bits in special:
        low = sum(int(x) << 8 * (3 - i) for i, x in enumerate(base.split(".")))
        inside = inside | number.between(low, low + (1 << 32 - bits) - 1)
    return F.coalesce((F.size(parts) == 4) & ip_host(ip) & ~inside, F.lit(False))


def homoglyphs_replaced(h: Column) -> Column:
    return F.translate(F.lower(h), "".join(fixed.HOMOGLYPHS), "".join(fixed.HOMOGLYPHS.values()))


def has_homoglyphs(h: Column) -> Column:
    return F.lower(h).rlike("[" + "".join(fixed.HOMOGLYPHS) + "]")


def punycode_decoded(h: Column) -> Column:
    """Labels that start with xn-- in Unicode; malformed ones stay."""
    return F.array_join(F.transform(F.split(F.regexp_replace(F.lower(h), r"\.+$", ""), r"\."), lambda x: F.when(F.startswith(x, F.lit("xn--")), F.coalesce(F.reflect(F.lit("java.net.IDN"), F.lit("toUnicode"), x), x)).otherwise(x)), ".")


def percent_decoded(value: Column, times: int = 3) -> Column:
    """Percent escapes decoded up to `times` times; + stays, and a value with a bad escape stays as it is."""
    for _ in range(times):
        value = F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)
    return value


def url_id(url: Column) -> Column:
    """URL-safe Base64 of the UTF-8 URL, without padding or line ends."""
    return F.regexp_replace(F.translate(F.regexp_replace(F.base64(F.encode(url, "utf-8")), r"[\r\n]", ""), "+/", "-_"), "=+$", "")
