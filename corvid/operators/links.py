"""Links: extraction, lookalike domains, indicators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import fixed, urls


def hrefs(html: Column) -> Column:
    """The targets of a page's anchors, in order."""
    return F.transform(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)<a\b[^>]*\bhref\s*=\s*[\"']?([^\s\"'<>]+)"), F.lit(1)), lambda x: F.trim(x))


def text_urls(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?iU)\b(?:https?://|ftp://|www\.)(?:[^\W_][\w\-]*\.)+[^\W_]{2,}(?::\d{1,5})?(?:/[^\s\"'<>\]\)]*)?"), F.lit(0))


def links(rows: DataFrame, key: str, html: str | None = None, text: str | None = None, most: int | None = None) -> DataFrame:
    """Rows (key, ord, url, host, source, is_ip, shortener): the web links of each row, the first of each dedupe key; most: rows with more have none."""
    def tagged(found: Column, source: str, base: int) -> Column:
        return F.transform(found, lambda u, i: F.struct((i + base).alias("ord"), u.alias("url"), F.lit(source).alias("source")))

    parts = ([tagged(hrefs(F.col(html)), "html", 0)] if html else []) + ([tagged(text_urls(F.col(text)), "text", 1 << 20)] if text else [])
    found = F.concat(*parts)
    r = rows.select(F.col(key), F.inline(found)).withColumn("url", F.regexp_replace("url", r"[.,;)]+$", ""))
    r = r.where(urls.web_candidate(F.col("url"))).withColumn("url", urls.repair_userinfo(urls.with_scheme(F.col("url")))).withColumn("k", urls.dedupe_key(F.col("url")))
    r = r.groupBy(key, "k").agg(F.min(F.struct("ord", "url", "source")).alias("f")).select(key, "f.*")
    h = urls.host(F.col("url"))
    r = r.withColumn("host", h).where("host != ''").withColumn("is_ip", urls.ip_host(F.col("host"))).withColumn("shortener", urls.shortener(F.col("host"), urls.path(F.col("url"))))
    if most is not None:
        many = r.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > most).select(key)
        r = r.join(many, key, "left_anti")
    return r


def brand_table(spark, brands: list[str] | None = None) -> DataFrame:
    return spark.createDataFrame([(i, b) for i, b in enumerate(brands or fixed.BRANDS)], "brand_ord int, brand string")


#: Brands that hosts are compared with, at most: their table is broadcast.
MAX_BRANDS = 1000


def lookalikes(hosts: DataFrame, brands: DataFrame, most: int = 2, least_length: int = 5) -> DataFrame:
    """Rows (host, brand, technique, edit_distance) of different hosts (host) against brands (brand_ord, brand).

    Brands are tried in order up to the first that the host belongs to. A broadcast join with the brand list, of MAX_BRANDS
    at most; hosts are made distinct first, so the product is of different hosts only. At most one technique for a host and brand:
    a small edit distance, confusable characters, or a deceptive prefix or character exchange.
    """
    h = hosts.select(F.lower("host").alias("host")).distinct().where((F.col("host") != "") & ~urls.ip_host(F.col("host")))
    h = h.withColumn("norm", urls.homoglyphs_replaced(F.col("host"))).withColumn("sld", urls.sld(F.col("norm"))).withColumn("confusable", urls.has_homoglyphs(F.col("host"))).withColumn("decoded", urls.punycode_decoded(F.col("host")))
    puny = h.where(F.col("decoded") != F.col("host")).select("host", F.lit("-").alias("brand"), F.lit("punycode_idna").alias("technique"), F.lit(None).cast("int").alias("edit_distance"))
    plain = h.where(F.col("decoded") == F.col("host"))
    lone = plain.where("confusable and norm != host").select("host", F.lit("-").alias("brand"), F.lit("unicode_homoglyph").alias("technique"), F.lit(None).cast("int").alias("edit_distance"))
    if brands.limit(MAX_BRANDS + 1).count() > MAX_BRANDS:
        raise ValueError(f"more than {MAX_BRANDS} brands: every host is compared with each")
    b = brands.withColumn("b_sld", urls.sld(F.col("brand")))
    exact = (F.col("host") == F.col("brand")) | F.endswith(F.col("host"), F.concat(F.lit("."), F.col("brand")))
    j = plain.join(F.broadcast(b), F.lit(True)).withColumn("stop", F.min(F.when(exact, F.col("brand_ord"))).over(Window.partitionBy("host"))).where("stop is null or brand_ord < stop")
    d = F.levenshtein("sld", "b_sld")
    near = (F.length("sld") >= least_length) & (F.length("b_sld") >= least_length) & (F.abs(F.length("sld") - F.length("b_sld")) <= most) & d.between(1, most)
    glyph = F.col("confusable") & (F.col("norm") != F.col("host")) & ((F.col("norm") == F.col("brand")) | F.endswith(F.col("norm"), F.concat(F.lit("."), F.col("brand"))) | (d <= most))
    bare = F.regexp_replace("norm", r"^www\.", "")
    prefixed = F.lit(False)
    for p in fixed.DECEPTIVE_PREFIXES:
        prefixed = prefixed | (F.startswith(bare, F.lit(p)) & (F.levenshtein(urls.sld(F.substring(bare, len(p) + 1, 1 << 20)), F.col("b_sld")) <= 1))
    swapped = F.replace(F.replace(F.translate("sld", "01", "oi"), F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    typo = prefixed | ((swapped != F.col("sld")) & (swapped == F.col("b_sld")))
    technique = F.when(near, "edit_distance").when(glyph, "homoglyph").when(typo, "typosquatting")
    named = j.withColumn("technique", technique).where("technique is not null").select("host", "brand", "technique", F.when(near, d).alias("edit_distance"))
    return puny.unionByName(lone).unionByName(named)


def display_mismatch(display: Column, h: Column) -> Column:
    """Whether a link's text names a host of another registered domain than the link's."""
    shown = urls.host(urls.with_scheme(F.regexp_extract(F.coalesce(display, F.lit("")), r"(?iU)(?:(?:https?://|ftp://|www\.)(?:[^\W_][\w\-]*\.)+[^\W_]{2,}|(?<![@\w.-])(?:[^\W_][\w\-]*\.)+[^\W_]{2,}(?![\w.-]))", 0)))
    return F.coalesce((shown != "") & (h != "") & ~urls.same_registered_domain(shown, h), F.lit(False))
