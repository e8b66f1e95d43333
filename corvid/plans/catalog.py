"""The named queries: an operator applied to the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corvid.functions import fixed, text, urls
from corvid.operators import attachments, body, campaigns, corpus, enrich, flags, headers, links, scoring
from corvid.plans.session import cut, spread, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def values(column: str) -> str:
    """SQL: column in a list of fixed values."""
    return ", ".join("'" + x.replace("'", "''") + "'" for x in column)


# ------------------------------------------------------------------ text

NORM = r"trim(regexp_replace(lower(regexp_replace(coalesce({0}, ''), '[\x00-\x08\x0B-\x1F\x7F]', ' ', 'g')), '\s+', ' ', 'g'))"
N_TEXT = NORM.format("text")


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(f"select doc_id, {N_TEXT} as normalized, length({N_TEXT})::bigint as n from documents")
def norm01_normalize(spark, sf_dir):
    n = text.normalize(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", n.alias("normalized")).withColumn("n", F.length("normalized").cast("long"))


@query("select doc_id, coalesce(text, '') as value, text is null as was_null from documents")
def norm02_null_safe(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("value"), F.col("text").isNull().alias("was_null"))


COUNTED = ["[URL LINK]", "[EMAIL ADDRESS]", "[IBAN]", "[IP ADDRESS]", "[CARD OR ACCOUNT NUMBER]", "[PHONE NUMBER]", "[OBFUSCATED DATA]"]
RE2_PLACEHOLDERS = [
    (r"(?i)(^|[^\p{L}\p{N}_])(?:(?:https?://|ftp://|www\.)[^\s<>\"'']+|mailto:[^\s<>\"'']+)", r"\1[URL LINK]"),
    (r"\b(?:[A-Za-z0-9._%+-]+)@(?:[A-Za-z0-9.-]+\.[A-Za-z]{2,})\b", "[EMAIL ADDRESS]"),
    (r"(?i)\b[A-Z]{2}\d{2}[A-Z0-9]{11,30}\b", "[IBAN]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP ADDRESS]"),
    (r"\b(?:\d[ -]?){13,19}\b", "[CARD OR ACCOUNT NUMBER]"),
    (r"(^|[^\p{L}\p{N}_])\+?\d[\d .()/-]{7,}\d\b", r"\1[PHONE NUMBER]"),
    (r"(^|[^A-Za-z0-9@_+=./-])[A-Za-z0-9][A-Za-z0-9@_+=./-]{159,}", r"\1[OBFUSCATED DATA]"),
]


def placeholder_sql(column: str) -> str:
    for pattern, label in RE2_PLACEHOLDERS:
        column = f"regexp_replace({column}, '{pattern}', '{label}', 'g')"
    return column


@query("select doc_id, " + ", ".join(f"len(string_split(t, '{x}')) - 1 as c{i}" for i, x in enumerate(COUNTED)) + f" from (select doc_id, {placeholder_sql('text')} as t from documents)")
def norm03_placeholders(spark, sf_dir):
    rows = spread(documents(spark, sf_dir)).select("doc_id", text.placeholders(F.col("text")).alias("t"))
    return rows.select("doc_id", *[(F.size(F.split("t", r"\Q" + x + r"\E")) - 1).cast("long").alias(f"c{i}") for i, x in enumerate(COUNTED)])


@query(r"""select page_id, length(regexp_replace(html, '(?is)(<a\b[^>]*\bhref\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s>]+)[^>]*>)(.*?)(</a\s*>)', '\1\2 [URL LINK]\3', 'g'))::bigint as n from pages""")
def norm04_mark_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(text.mark_links(F.col("html"))).cast("long").alias("n"))


@query()
def norm05_model_input(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.normalize(text.compact(F.col("html"))).alias("model_input"))


@query(r"select doc_id, regexp_replace(text, '[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]', '', 'g') as visible from documents")
def norm06_strip_invisible(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.strip_invisible(F.col("text")).alias("visible"))


@query(r"select doc_id, trim(regexp_replace(lower(replace(text, chr(0), ' ')), '\s+', ' ', 'g')) as normalized from documents")
def norm08_hard_negative(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.collapse(F.lower(F.replace("text", F.lit("\0"), F.lit(" ")))).alias("normalized"))


@query(r"""select doc_id, case when length(text) <= 120 then text else rtrim(case when regexp_replace(left(text, 120), '\s+\S*$', '') = '' then left(text, 120) else regexp_replace(left(text, 120), '\s+\S*$', '') end) || '…' end as clipped from documents""")
def norm09_clip(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", text.clip(F.col("text"), 120).alias("clipped"))


@query(r"""select page_id, replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"') as stripped from pages""")
def htm04_strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("stripped"))


@query(r"select page_id, regexp_matches(html, '(?is)<\s*(?:!doctype\s+html|html|body|table|div|span|p|br|a|img|style|head)\b') as is_html from pages union all select doc_id, regexp_matches(text, '(?is)<\s*(?:!doctype\s+html|html|body|table|div|span|p|br|a|img|style|head)\b') from documents")
def mim05_html_like(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.html_like(F.col("html")).alias("is_html")).unionByName(documents(spark, sf_dir).select(F.col("doc_id").alias("page_id"), text.html_like(F.col("text")).alias("is_html")))


# ------------------------------------------------------------------ corpus

TEMPLATE = N_TEXT
for _p, _r in ((r"https?://\S+|www\.\S+", " URL "), (r"[a-z0-9._%+\-]+@[a-z0-9.\-]+", " EMAIL "), (r"\b[0-9a-f]{16,}\b", " ID "), (r"\b\d+\b", " NUM "), (r"[^\p{L}\p{M}\p{N}_]+", " ")):
    TEMPLATE = f"regexp_replace({TEMPLATE}, '{_p}', '{_r}', 'g')"
TEMPLATE = rf"trim(regexp_replace(replace({TEMPLATE}, '_', ' '), '\s+', ' ', 'g'))"
WORDS = "len([w for w in string_split_regex(t, '\\s+') if w <> ''])"
INVALID = f"t in ({values(fixed.PLACEHOLDER_TEXTS)})"
ROWS = f"select doc_id as ord, {N_TEXT} as t, pmod as label, source, 'd' || doc_id as source_file from (select *, doc_id % 2 as pmod from documents)"
VALID = f"select ord, t as text, label::int as label, source, source_file, sha256(t) as text_hash from r where not ({INVALID}) and label is not null and length(t) >= 40 and {WORDS} >= 5 and length(t) <= 200000"
CLEAN = "select * from (select *, row_number() over (partition by text_hash order by ord) as rn from valid where text_hash not in (select text_hash from valid group by 1 having count(distinct label) > 1)) where rn = 1"


def labelled(spark, sf_dir):
    """documents as corpus rows; the label is doc_id's parity, so that copies can conflict."""
    return documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), "text", F.pmod("doc_id", F.lit(2)).alias("label"), "source", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("source_file"))


@query(f"""with r as ({ROWS}) select count(*) as n_rows, count_if({INVALID}) as invalid_text, count_if(label is null) as invalid_label, count_if(not ({INVALID}) and length(t) < 40) as too_short,
    count_if(not ({INVALID}) and {WORDS} < 5) as too_few_words, count_if(length(t) > 200000) as too_long, count_if(not ({INVALID}) and label is not null and length(t) >= 40 and {WORDS} >= 5 and length(t) <= 200000) as valid from r""")
def cln01_reject_counts(spark, sf_dir):
    return corpus.reject_counts(labelled(spark, sf_dir))


@query(f"with r as ({ROWS}), valid as ({VALID}) select ord, text, label, source, source_file, text_hash from ({CLEAN})")
def cln01_clean(spark, sf_dir):
    return corpus.clean(labelled(spark, sf_dir))


LABEL_CASES = ["1", "0", " 1.0 ", "2", "Spam", "not_phishing", "Safe  Email", "ham", "phishing-email", "maybe", "", "legit", "FRAUD"]


@query(f"""with v as (select doc_id, [{values(LABEL_CASES)}][(doc_id % {len(LABEL_CASES)}) + 1] as raw from documents), n as (select *, try_cast(trim(raw) as double) as num, regexp_replace(lower(trim(raw)), '[\\s_\\-]+', ' ', 'g') as w from v)
    select doc_id, raw, case when num is not null then case when num = 0 then 0 when num = 1 then 1 end when w in ({values(fixed.LEGITIMATE_LABELS)}) then 0 when w in ({values(fixed.PHISHING_LABELS)}) then 1 end as label from n""")
def cln02_parse_label(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, LABEL_CASES)), (F.pmod("doc_id", F.lit(len(LABEL_CASES))) + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", raw.alias("raw")).withColumn("label", text.parse_label(F.col("raw")))


@query(f"select doc_id, sha256({N_TEXT}) as text_hash, min(doc_id) over (partition by {N_TEXT}) = doc_id as is_first from documents")
def cln05_text_hash(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", text.text_hash(text.normalize(F.col("text"))).alias("text_hash"))
    first = rows.groupBy("text_hash").agg(F.min("doc_id").alias("first"))
    return rows.join(first, "text_hash").select("doc_id", "text_hash", (F.col("doc_id") == F.col("first")).alias("is_first"))


@query(f"select doc_id, case when tp = '' then sha256(n) else sha256(tp) end as template_hash from (select doc_id, {N_TEXT} as n, {TEMPLATE} as tp from documents)")
def cln06_template_hash(spark, sf_dir):
    return spread(documents(spark, sf_dir)).select("doc_id", text.template_hash(text.normalize(F.col("text"))).alias("template_hash"))


TEMPLATE_OF_TEXT = TEMPLATE.replace(N_TEXT, "text")


@query(f"""with r as ({ROWS}), valid as ({VALID}), c as ({CLEAN}), h as (select *, sha256(coalesce(nullif({TEMPLATE_OF_TEXT}, ''), text)) as template_hash from c)
    select ord, label, source, template_hash from (select *, row_number() over (partition by label, template_hash order by ord) as k from h where template_hash not in (select template_hash from h group by 1 having count(distinct label) > 1)) where k = 1""")
def cln07_template_dedup(spark, sf_dir):
    return corpus.dedupe_templates(labelled(spark, sf_dir)).select("ord", "label", "source", "template_hash")


@query(f"""with r as (select doc_id as ord, sha256({N_TEXT}) as text_hash, (doc_id % 3 = 0)::int as label from documents),
    w as (select *, row_number() over p as n, first_value(label) over p as f from r window p as (partition by text_hash order by ord)),
    k as (select *, bool_or(label <> f) over (partition by text_hash order by ord rows unbounded preceding) as clash from w) select ord, text_hash, label from k where n = 1 or clash""")
def cln08_append(spark, sf_dir):
    rows = documents(spark, sf_dir).select(F.col("doc_id").alias("ord"), text.text_hash(text.normalize(F.col("text"))).alias("text_hash"), (F.pmod("doc_id", F.lit(3)) == 0).cast("int").alias("label"))
    return corpus.append_new(rows)


@query("select doc_id, source, lower(source) like 'synthetic\\_%' escape '\\' or lower(source) in ('kaggle_phishing_and_legitimate_emails') as is_synthetic from (select doc_id, case when doc_id % 7 = 0 then 'Synthetic_' || source when doc_id % 11 = 0 then 'kaggle_phishing_and_legitimate_emails' else source end as source from documents)")
def cmp01_synthetic_mask(spark, sf_dir):
    s = F.when(F.pmod("doc_id", F.lit(7)) == 0, F.concat(F.lit("Synthetic_"), "source")).when(F.pmod("doc_id", F.lit(11)) == 0, F.lit(fixed.SYNTHETIC_SOURCES[0])).otherwise(F.col("source"))
    return documents(spark, sf_dir).select("doc_id", s.alias("source")).withColumn("is_synthetic", corpus.is_synthetic(F.col("source")))


@query()
def cmp02_campaigns(spark, sf_dir):
    # exploded, so that the filter is not moved below and each text is normalized once
    rows = spread(documents(spark, sf_dir)).select(F.explode(F.array(text.normalize(F.col("text")))).alias("text")).where(F.length("text").between(fixed.MIN_CHARS, fixed.MAX_CHARS))
    return campaigns.campaigns(rows.select(text.text_hash(F.col("text")).alias("text_hash"), "text"))


@query()
def cmp03_campaign_split(spark, sf_dir):
    rows = corpus.clean(labelled(spark, sf_dir)).withColumn("campaign_id", F.concat(F.lit("campaign:"), text.template_hash(F.col("text"))))
    return campaigns.split(cut(rows.drop("text")), ["label", "source"])


@query()
def cmp04_source_holdout(spark, sf_dir):
    rows = corpus.valid(labelled(spark, sf_dir)).drop("text").withColumn("whole", F.lit("all")).withColumn("one", F.lit(1))
    sized = rows.groupBy("whole", "source").agg(F.count("*").alias("n"))
    return sized.groupBy("whole").applyInPandas(holdout, "source string, split string")


def holdout(pdf):
    """Whole sources to splits; a row for each source comes in."""
    import pandas as pd

    told = campaigns.assign(list(zip(pdf["source"], pdf["n"].tolist(), strict=True)), campaigns.SHARES, "42", "all")
    return pd.DataFrame({"source": list(told), "split": list(told.values())})


@query("""with r as (select doc_id, quality, sha256('42:' || doc_id) as h from labels), n as (select min(n) as n from (select count(*) as n from r group by quality))
    select doc_id, quality from (select *, row_number() over (partition by quality order by h, doc_id) as k from r), n where k <= n""")
def cmp05_undersample(spark, sf_dir):
    return corpus.undersample(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("""select coalesce(source, '*') as source, coalesce(lang, '*') as lang, count(*) as n_rows, count_if(label = 1) as n_positive from (select *, doc_id % 2 as label from documents) group by grouping sets ((source), (lang), ())""")
def cmp09_profile(spark, sf_dir):
    return corpus.profile(documents(spark, sf_dir).withColumn("label", F.pmod("doc_id", F.lit(2))).select("source", "lang", "label"), ["source", "lang"])


@query("select count(*) as total, count_if(quality = 1) as positive, count_if(quality = 0) as negative, max(doc_id) as last_added from labels")
def cmp10_table_stats(spark, sf_dir):
    return table(spark, sf_dir, "labels").agg(F.count("*").alias("total"), F.count_if(F.col("quality") == 1).alias("positive"), F.count_if(F.col("quality") == 0).alias("negative"), F.max("doc_id").alias("last_added"))


SPLIT_SQL = "case when ('0x' || left(sha256(doc_id::varchar), 8))::bigint / 4294967296.0 < 0.7 then 'train' when ('0x' || left(sha256(doc_id::varchar), 8))::bigint / 4294967296.0 < 0.7 + 0.1 then 'validation' else 'test' end"


@query(f"""with r as (select sha256({N_TEXT}) as text_hash, doc_id % 2 as label, source, {SPLIT_SQL} as split, 'c' || (doc_id % 50) as campaign_id from documents)
    select 'label_domain' as rule, count_if(label not in (0, 1)) as violations from r union all select 'unknown_split', count_if(split not in ('train', 'validation', 'test')) from r
    union all select 'banned_source', count_if(lower(source) like 'ubuntu\\_%' escape '\\') from r union all select 'synthetic_outside_train', count_if(lower(source) like 'synthetic\\_%' escape '\\' and split <> 'train') from r
    union all select 'text_hash_in_several_splits', count_if(n > 1) from (select count(distinct split) as n from r group by text_hash)
    union all select 'campaign_id_in_several_splits', count_if(n > 1) from (select count(distinct split) as n from r group by campaign_id)
    union all select 'text_hash_in_several_labels', count_if(n > 1) from (select count(distinct label) as n from r group by text_hash)""")
def val01_constraints(spark, sf_dir):
    rows = documents(spark, sf_dir).select(text.text_hash(text.normalize(F.col("text"))).alias("text_hash"), F.pmod("doc_id", F.lit(2)).alias("label"), "source", F.concat(F.lit("c"), F.pmod("doc_id", F.lit(50)).cast("string")).alias("campaign_id"), "doc_id")
    return corpus.constraint_counts(rows.withColumn("split", corpus.hash_split(rows, "doc_id")))


@query("select quality as label, count(*) as n, round((select count(*) from labels) / ((select count(distinct quality) from labels) * count(*)), 9) as weight from labels group by quality")
def val02_class_weights(spark, sf_dir):
    return corpus.class_weights(table(spark, sf_dir, "labels").select(F.col("quality").alias("label"))).withColumn("weight", F.round("weight", 9))


@query(f"select {SPLIT_SQL} as split, source, doc_id % 2 as label, count(*) as n from documents group by all")
def val02_split_audit(spark, sf_dir):
    rows = documents(spark, sf_dir)
    return rows.select(corpus.hash_split(rows, "doc_id").alias("split"), "source", F.pmod("doc_id", F.lit(2)).alias("label")).groupBy("split", "source", "label").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ sources and sinks, as far as the tables go


@query(f"select doc_id, text as body, {N_TEXT} as text, case when lower(lang) = 'en' then 0 else 1 end as label from documents")
def src10_labelled_table(spark, sf_dir):
    d = documents(spark, sf_dir)
    return d.select("doc_id", F.col("text").alias("body"), text.normalize(F.col("text")).alias("text"), text.parse_label(F.when(F.lower("lang") == "en", "Safe Email").otherwise("Phishing Email")).alias("label"))


@query(f"""select doc_id, trim(source || ' ' || text) as text, case when doc_id % 3 = 0 then 'row-' || doc_id || '-' || left(sha256(trim(source || ' ' || text)), 16) else 'h' || doc_id end as source_file from documents""")
def src12_subject_body(spark, sf_dir):
    t = F.trim(F.concat_ws(" ", "source", "text"))
    published = F.when(F.pmod("doc_id", F.lit(3)) == 0, F.lit("")).otherwise(F.concat(F.lit("h"), F.col("doc_id").cast("string")))
    return documents(spark, sf_dir).select("doc_id", t.alias("text"), F.coalesce(F.nullif(F.trim(published), F.lit("")), F.concat_ws("-", F.lit("row"), F.col("doc_id").cast("string"), F.left(F.sha2(t, 256), F.lit(16)))).alias("source_file"))


@query("select list || '-' || y || '-' || lpad(m::varchar, 2, '0') as archive from (select unnest(['ubuntu-users', 'ubuntu-security-announce']) as list), range(2022, 2026) t(y), range(1, 13) u(m)")
def src14_archive_names(spark, sf_dir):
    years = spark.range(2022, 2026).withColumnRenamed("id", "y")
    months = F.explode(F.sequence(F.lit(1), F.lit(12))).alias("m")
    lists = F.explode(F.array(F.lit("ubuntu-users"), F.lit("ubuntu-security-announce"))).alias("list")
    return years.select("y", months).select("y", "m", lists).select(F.concat_ws("-", "list", F.col("y").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0")).alias("archive"))


@query(f"select distinct sha256({N_TEXT}) as text_hash from documents")
def src27_hashes(spark, sf_dir):
    return documents(spark, sf_dir).select(text.text_hash(text.normalize(F.col("text"))).alias("text_hash")).distinct()


@query(f"""with n as (select doc_id, text, sha256({N_TEXT}) as text_hash from documents where doc_id % 2 = 0), e as (select distinct sha256({N_TEXT}) as text_hash from documents where doc_id % 2 = 1)
    select doc_id, case when length(text) < 10 then 'error' when e.text_hash is not null then 'duplicate' else 'added' end as status from n left join e using (text_hash)""")
def snk03_upsert_status(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "text", text.text_hash(text.normalize(F.col("text"))).alias("text_hash"))
    odd = F.pmod("doc_id", F.lit(2)) == 1
    return corpus.upsert_status(rows.where(~odd), rows.where(odd)).select("doc_id", "status")


@query("select doc_id, source from documents where sha256(text) not in (select sha256(text) from documents where doc_id % 10 = 0)")
def snk04_remove_by_hash(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("h", F.sha2("text", 256))
    return d.join(d.where(F.pmod("doc_id", F.lit(10)) == 0).select("h"), "h", "left_anti").select("doc_id", "source")


# ------------------------------------------------------------------ headers and hops, on addresses made from the tables


def senders(spark, sf_dir):
    """customer rows as From, Reply-To and Return-Path addresses."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey").cast("string")
    local = F.element_at(F.array(*map(F.lit, [*fixed.NO_REPLY_LOCALS, "anna", "Max.M"])), (F.pmod("c_custkey", F.lit(12)) + 1).cast("int"))
    reply = F.element_at(F.array(*map(F.lit, [*fixed.GENERIC_REPLY_LOCALS, "joe"])), (F.pmod("c_custkey", F.lit(15)) + 1).cast("int"))
    d1 = F.concat(F.lit("Mail."), F.lit("shop"), F.pmod("c_custkey", F.lit(20)).cast("string"), F.lit(".Example.com"))
    d2 = F.concat(F.lit("x.other"), F.pmod("c_custkey", F.lit(3)).cast("string"), F.lit(".org"))
    sender = F.when(F.pmod("c_custkey", F.lit(4)) == 0, F.concat(F.lit('"Team a@b.net" <'), local, F.lit("@"), d1, F.lit(">"))).otherwise(F.concat(local, F.lit("@"), d1))
    return c.select("c_custkey", sender.alias("sender"), F.concat(F.lit("R "), k, F.lit(" <"), reply, F.lit("@"), F.when(F.pmod("c_custkey", F.lit(5)) == 0, F.lit("other.example.com")).otherwise(d2), F.lit(">")).alias("reply"), (F.pmod("c_custkey", F.lit(2)) == 0).alias("bulk"))


SENDERS = f"""select c_custkey, case when c_custkey % 4 = 0 then '"Team a@b.net" <' || l || '@' || d1 || '>' else l || '@' || d1 end as sender, 'R ' || c_custkey || ' <' || r || '@' || case when c_custkey % 5 = 0 then 'other.example.com' else d2 end || '>' as reply, c_custkey % 2 = 0 as bulk
    from (select c_custkey, [{values([*fixed.NO_REPLY_LOCALS, 'anna', 'Max.M'])}][(c_custkey % 12) + 1] as l, [{values([*fixed.GENERIC_REPLY_LOCALS, 'joe'])}][(c_custkey % 15) + 1] as r, 'Mail.shop' || (c_custkey % 20) || '.Example.com' as d1, 'x.other' || (c_custkey % 3) || '.org' as d2 from customer)"""
ADDRESS = r"coalesce(nullif(regexp_extract({0}, '<([^>]+)>', 1), ''), nullif(regexp_extract({0}, '[\p{{L}}\p{{N}}_.+\-]+@[\p{{L}}\p{{N}}_.\-]+', 0), ''))"
PARTS = f"select *, {ADDRESS.format('sender')} as a, {ADDRESS.format('reply')} as b from ({SENDERS})"
REGISTERED = r"array_to_string(string_split(regexp_replace(lower({0}), '\.+$', ''), '.')[-2:], '.')"


@query(rf"select c_custkey, a as address, lower(regexp_extract(a, '@([\p{{L}}\p{{N}}_.\-]+)', 1)) as domain, {REGISTERED.format(chr(39).join(['regexp_extract(a, ', '@(.+)$', ', 1)']))} as registered, lower(trim(regexp_extract(a, '^(.*)@[^@]*$', 1))) as local_part from ({PARTS})")
def hdr03_addresses(spark, sf_dir):
    a = F.col("address")
    return senders(spark, sf_dir).select("c_custkey", urls.address(F.col("sender")).alias("address")).select("c_custkey", "address", urls.domain(a).alias("domain"), urls.registered_domain(urls.domain(a)).alias("registered"), urls.local_part(a).alias("local_part"))


@query(rf"""select c_custkey, ra = rb or (bulk and la in ({values(fixed.NO_REPLY_LOCALS)}) and lb in ({values(fixed.GENERIC_REPLY_LOCALS)})) as legitimate, ra = rb as same_domain
    from (select *, {REGISTERED.format("regexp_extract(a, '@(.+)$', 1)")} as ra, {REGISTERED.format("regexp_extract(b, '@(.+)$', 1)")} as rb, lower(regexp_extract(a, '^(.*)@', 1)) as la, lower(regexp_extract(b, '^(.*)@', 1)) as lb from ({PARTS}))""")
def hdr10_reply_to(spark, sf_dir):
    r = senders(spark, sf_dir).select("c_custkey", urls.address(F.col("sender")).alias("a"), urls.address(F.col("reply")).alias("b"), "bulk")
    return r.select("c_custkey", headers.reply_to_legitimate(F.col("a"), F.col("b"), F.col("bulk")).alias("legitimate"), urls.same_registered_domain(urls.domain(F.col("a")), urls.domain(F.col("b"))).alias("same_domain"))


@query("select c_custkey, case when c_custkey % 4 = 0 then 'a@b.net' end as shown from customer")
def hdr11_display_name(spark, sf_dir):
    return senders(spark, sf_dir).select("c_custkey", headers.display_name_spoofing(F.col("sender")).alias("shown"))


@query("""select ip, not (a in (0, 10, 127) or a >= 224 or (a = 100 and b between 64 and 127) or (a = 169 and b = 254) or (a = 172 and b between 16 and 31) or (a = 192 and b = 168) or (a = 198 and b in (18, 19))) as public from (select *, split_part(ip, '.', 1)::int as a, split_part(ip, '.', 2)::int as b from (select (user_id % 256) || '.' || (event_id % 256) || '.1.' || (event_id % 250) as ip from events))""")
def hdr12_public_ip(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    m = lambda c, n: F.pmod(c, F.lit(n)).cast("string")
    ip = F.concat_ws(".", m("user_id", 256), m("event_id", 256), F.lit("1"), m("event_id", 250))
    rows = e.select(ip.alias("ip"))
    return rows.withColumn("public", urls.public_ipv4(F.col("ip")))


EVENT_STATUS = "case event_type when 'click' then 'fail' when 'view' then 'pass' when 'purchase' then 'softfail' when 'signup' then 'none' else 'odd' end"


@query(f"""with e as (select user_id, event_id, {EVENT_STATUS} as status from events), p as (select *, case status when 'fail' then 100 when 'softfail' then 85 when 'none' then 60 when 'pass' then 0 else 50 end as p from e)
    select user_id, status, event_id, n_results from (select *, row_number() over (partition by user_id order by p desc, event_id) as k, count(*) over (partition by user_id) as n_results from p) where k = 1""")
def rcv09_worst_status(spark, sf_dir):
    s = F.when(F.col("event_type") == "click", "fail").when(F.col("event_type") == "view", "pass").when(F.col("event_type") == "purchase", "softfail").when(F.col("event_type") == "signup", "none").otherwise("odd")
    return headers.worst(table(spark, sf_dir, "events").select("user_id", "event_id", s.alias("status")), ["user_id"], order="event_id")


@query("""with h as (select l_orderkey, l_linenumber, case when l_orderkey % 3 = 0 and l_linenumber = 1 then null else l_shipdate end as t from lineitem), w as (select *, bool_and(t is not null) over (partition by l_orderkey) as whole from h)
    select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by case when whole then t end, l_linenumber desc)::int as route_ord from w""")
def rcv06_route_order(spark, sf_dir):
    at = F.when((F.pmod("l_orderkey", F.lit(3)) == 0) & (F.col("l_linenumber") == 1), None).otherwise(F.col("l_shipdate"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", at.alias("at"))
    return headers.route(rows, "l_orderkey", "l_linenumber", "at").select("l_orderkey", "l_linenumber", "route_ord")


AUTH = ["spf=pass smtp.mailfrom=a.com; dkim=fail header.d=b.com; dkim=pass header.d=c.com", "dmarc=none header.from=x.org", "spf=softfail; dmarc=bestguesspass", "mx.net; none"]


@query(f"""with r as (select c_custkey, [{values(AUTH)}][(c_custkey % 4) + 1] as raw from customer), x as (select c_custkey, unnest(regexp_extract_all(raw, '(?:spf|dkim|dmarc)=[a-z]+')) as m, generate_subscripts(regexp_extract_all(raw, '(?:spf|dkim|dmarc)=[a-z]+'), 1) as i from r)
    select c_custkey, upper(split_part(m, '=', 1)) as proto, split_part(m, '=', 2) as status from x""")
def rcv07_auth_results(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, AUTH)), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    return headers.auth_results(table(spark, sf_dir, "customer").select("c_custkey", raw.alias("raw")), "c_custkey", "raw").select("c_custkey", "proto", "status")


@query("""select c_custkey, 'mail' || c_custkey || '.example.com' as from_host, 'mx.example.net' as by_host, 'a@b.com' as for_address, regexp_extract(raw, 'version=(TLSv[0-9.]+)', 1) as tls_version, regexp_extract(raw, 'cipher=([A-Z0-9_]+)', 1) as tls_cipher,
    strptime(regexp_extract(raw, '; Tue, ([0-9]+ Jan 2024 [0-9:]+)', 1), '%d %b %Y %H:%M:%S') - interval 1 hour as received_at, regexp_extract_all(raw, '\\[([0-9.]+)\\]', 1) as all_ips
    from (select c_custkey, 'from mail' || c_custkey || '.example.com ([203.0.113.' || (c_custkey % 250) || ']) by mx.example.net. with ESMTPS (version=TLSv1.3 cipher=TLS_AES_256) for <a@b.com>; Tue, 2 Jan 2024 10:00:' || lpad((c_custkey % 60)::varchar, 2, '0') || ' +0100 (CET)' as raw from customer)""")
def rcv01_hops(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.concat(F.lit("from mail"), k.cast("string"), F.lit(".example.com ([203.0.113."), F.pmod(k, F.lit(250)).cast("string"), F.lit("]) by mx.example.net. with ESMTPS (version=TLSv1.3 cipher=TLS_AES_256) for <a@b.com>; Tue, 2 Jan 2024 10:00:"), F.lpad(F.pmod(k, F.lit(60)).cast("string"), 2, "0"), F.lit(" +0100 (CET)"))
    return table(spark, sf_dir, "customer").select("c_custkey", headers.hop(raw).alias("hop")).select("c_custkey", "hop.*").withColumn("received_at", F.col("received_at").cast("timestamp_ntz"))


# ------------------------------------------------------------------ links and lookalikes


@query(r"""with x as (select page_id, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["'']?([^\s"''<>]+)', 1)) as url from pages) select page_id, url, count(*) as n from x group by all""")
def lnk01_hrefs(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(links.hrefs(F.col("html"))).alias("url")).groupBy("page_id", "url").agg(F.count("*").alias("n"))


@query(r"""select page_id, 1048576::int as ord, url, 'text' as source, lower(regexp_extract(url, '://([^/?#:]*)', 1)) as host, regexp_matches(url, '://[0-9.]+([:/]|$)') as is_ip, '' as shortener from pages
    union all select page_id, (row_number() over (partition by page_id, n) - 1)::int, u, 'html', lower(regexp_extract(u, '://([^/?#:]*)', 1)), regexp_matches(u, '://[0-9.]+([:/]|$)'), '' from (select page_id, 1 as n, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*\bhref\s*=\s*["\'']?(https?://[^\s"\''<>]+)', 1)) as u from pages)""")
def lnk01_links(spark, sf_dir):
    return links.links(table(spark, sf_dir, "pages").withColumn("own", F.concat(F.lit("see "), F.col("url"), F.lit("."))), "page_id", html="html", text="own")


HOST = r"lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1))"


@query(rf"select page_id, {HOST} as host, {REGISTERED.format(HOST)} as registered, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1) as path from pages")
def lnk06_url_parts(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", urls.host(u).alias("host"), urls.registered_domain(urls.host(u)).alias("registered"), urls.path(u).alias("path"))


@query(r"""select page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1).lower() || '://' || lower(regexp_extract(url, '://([^/?#]*)', 1)) || case when regexp_extract(url, '://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '://[^/?#]*([^?#]*)', 1) end || regexp_extract(url, '://[^?#]*(.*)$', 1) as dedupe_key from pages""")
def lnk02_dedupe_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.dedupe_key(F.col("url")).alias("dedupe_key"))


@query(rf"""with h as (select page_id, {HOST} as host, split_part(trim(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '/'), '/', 1) as token from pages), s as (select *, string_split(host, '.')[-2] as sld from h)
    select page_id, case when length(sld) <= 5 and length(host) <= 12 and regexp_matches(token, '^[A-Za-z0-9_-]{{4,12}}$') then 'compact host with short opaque path' || case when regexp_matches(token, '[A-Za-z]') and regexp_matches(token, '[0-9]') then ' containing letters and digits' else '' end else '' end as reason from s""")
def lnk08_shortener(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.shortener(urls.host(F.col("url")), urls.path(F.col("url"))).alias("reason"))


@query(r"select page_id, regexp_extract(url, '^([a-zA-Z]+)://', 1) || '[://]' || replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '[.]') || regexp_extract(url, '://[^/?#]*(.*)$', 1) as safe from pages")
def lnk13_defang(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.defang(F.col("url")).alias("safe"))


HOSTS = ["paypa1.com", "www.paypal.com", "paypal.com", "arnazon.com", "amaz0n.it", "micros0ft.com", "secure-paypal.com", "netfl1x.com", "mail.google.com", "gooogle.com", "example.org", "faceboook.com", "linkedln.com", "dropbox.co", "spotlfy.com"]


@query(f"""with h as (select distinct [{values(HOSTS)}][(page_id % {len(HOSTS)}) + 1] as host from pages), s as (select host, string_split(host, '.')[-2] as sld from h), b as (select unnest([{values(fixed.BRANDS)}]) as brand, generate_subscripts([{values(fixed.BRANDS)}], 1) as o),
    j as (select host, sld, brand, o, string_split(brand, '.')[-2] as bs, min(case when host = brand or host like '%.' || brand then o end) over (partition by host) as stop from s, b)
    select host, brand, levenshtein(sld, bs)::int as edit_distance from j where (stop is null or o < stop) and length(sld) >= 5 and length(bs) >= 5 and abs(length(sld) - length(bs)) <= 2 and levenshtein(sld, bs) between 1 and 2""")
def lka07_lookalikes(spark, sf_dir):
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.pmod("page_id", F.lit(len(HOSTS))) + 1).cast("int"))
    found = links.lookalikes(table(spark, sf_dir, "pages").select(host.alias("host")), links.brand_table(spark))
    return found.where("technique = 'edit_distance'").select("host", "brand", "edit_distance")


@query("select p_partkey, levenshtein(lower(p_brand), 'brand#12')::int as distance from part")
def lka01_levenshtein(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.levenshtein(F.lower("p_brand"), F.lit("brand#12")).alias("distance"))


@query("select page_id, rtrim(replace(replace(to_base64(encode(url)), '+', '-'), '/', '_'), '=') as url_id from pages")
def enr07_url_id(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.url_id(F.col("url")).alias("url_id"))


# ------------------------------------------------------------------ bodies


@query(r"""select doc_id, len(l)::int as n_lines, len([x for x in l if not starts_with(ltrim(x), '>')])::int as kept from (select doc_id, string_split(replace(text, chr(13), chr(10)), chr(10)) as l from documents)""")
def bcx03_quoted_lines(spark, sf_dir):
    ls = body.lines(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", F.size(ls).alias("n_lines"), F.size(body.without_quotes(ls)["lines"]).alias("kept"))


BODIES = [
    "Hello all\nplease pay\nBest regards,\nBob\n+1 555", "News\nUnsubscribe here\nfooter", "On Monday Bob wrote:\nold text", "hi\n\nfrom: a@b.c\nsent: today\nto: me\n\nolder", "---------- Forwarded message ----------\nFrom: x\nSubject: y\n\nThe real text\nof it",
    "yes\n> quoted\n> more\nend", "text one\n==========\nFrom: a\nTo: b\nbody", "Thanks,\nBob", "On it.\nIl giorno 3 marzo Anna ha scritto:\n> ciao",
]
LAYERS = [("normal", 2, 0, 3), ("normal", 1, 0, 2), ("normal", 2, 0, 0), ("reply_header", 1, 0, 0), ("forwarded", 2, 0, 0), ("normal", 2, 2, 0), ("thread_separator", 1, 0, 0), ("normal", 2, 0, 0), ("reply", 1, 0, 0)]


@query("select i, context, n, quoted, tail from (values " + ", ".join(f"({i}, '{c}', {n}, {q}, {t})" for i, (c, n, q, t) in enumerate(LAYERS)) + ") v(i, context, n, quoted, tail)")
def bcx01_layers(spark, sf_dir):
    rows = spark.createDataFrame(list(enumerate(BODIES)), "i int, text string").withColumn("l", body.layer(F.col("text")))
    return rows.select("i", "l.context", F.size(F.filter("l.lines", lambda x: F.trim(x) != "")).alias("n"), F.col("l.removed_quoted").alias("quoted"), F.col("l.removed_tail").alias("tail"))


@query("select doc_id, 0::bigint as removed_lines, 0::bigint as removed_chars from documents")
def mim06_noise_runs(spark, sf_dir):
    return body.strip_noise(documents(spark, sf_dir), "doc_id", "text").select(F.col("key").alias("doc_id"), "removed_lines", "removed_chars")


# ------------------------------------------------------------------ attachments

PAYLOADS = "case doc_id % 6 when 0 then '%PDF-1.7 ' || text when 1 then 'GIF89a' || text when 2 then '<?xml ?>' || text when 3 then 'BM' || text when 4 then '#!/bin/sh ' || text else text end"


@query(f"""with p as (select doc_id, {PAYLOADS} as b from documents) select doc_id, md5(b) as hash_md5, sha1(encode(b)) as hash_sha1, sha256(b) as hash_sha256, octet_length(encode(b))::bigint as size_bytes,
    case when starts_with(b, '%PDF') then 'pdf' when starts_with(b, 'MZ') then 'exe' when starts_with(b, 'GIF89a') then 'gif' when starts_with(b, 'BM') then 'bmp' when starts_with(b, '<?xml') then 'xml' when starts_with(b, '#!/') then 'sh' when starts_with(b, 'BZh') then 'bz2' end as magic_detected_format from p""")
def att01_records(spark, sf_dir):
    b = F.expr(PAYLOADS.replace("||", "||")).cast("binary")
    r = documents(spark, sf_dir).select("doc_id", attachments.record(F.lit("a.pdf"), F.lit("application/pdf"), b).alias("r"))
    return r.select("doc_id", "r.hash_md5", "r.hash_sha1", "r.hash_sha256", "r.size_bytes", "r.magic_detected_format")


PDF_BODY = "'%PDF-1.4\n1 0 obj << /Type /Catalog /OpenAction 2 0 R ' || case doc_id % 4 when 0 then '/J#61vaScript (x)' when 1 then '/URI (http://a.b/c)' when 2 then '/L#61unch /JS' else '' end || ' >> endobj\n' || text || '\n%%EOF'"


@query(f"""with b as (select doc_id, replace(replace({PDF_BODY}, 'J#61va', 'Java'), 'L#61unch', 'Launch') as b from documents) select doc_id, len(regexp_extract_all(b, '\\b\\d+\\s+\\d+\\s+obj\\b'))::int as objects, len(regexp_extract_all(b, '%%EOF'))::int as eof,
    case doc_id % 4 when 0 then 'high' when 1 then 'low' when 2 then 'critical' else 'clean' end as risk, case doc_id % 4 when 0 then ['javascript', 'open_action'] when 1 then [] when 2 then ['launch_action', 'javascript', 'open_action'] else [] end::varchar[] as behaviours from b""")
def pdf02_scan(spark, sf_dir):
    r = documents(spark, sf_dir).select("doc_id", attachments.pdf_scan(F.expr(PDF_BODY.replace("\n", "\\n")).cast("binary")).alias("s"))
    return r.select("doc_id", "s.objects", "s.eof", attachments.pdf_risk(F.col("s.names"), F.col("s.encrypted")).alias("risk"), attachments.pdf_behaviours(F.col("s.names")).alias("behaviours"))


EVIDENCE = [["https://sites.google.com/view/x", "https://a.b/?url=https%3A%2F%2Fc.d"], ["https://t.co/?click_id=1&u=http%3A%2F%2Fx.y"], [], ["https://forms.gle/1", "https://docs.google.com/forms/d", "https://docs.google.com/x"]]


@query("select s_suppkey, [2, 1, 0, 3][i] as url_count, [1, 1, 0, 0][i] as nested_redirect_count, [0, 1, 0, 0][i] as tracked_redirect_count, [1, 0, 0, 2][i] as public_site_landing_count from (select s_suppkey, s_suppkey % 4 + 1 as i from supplier)")
def pdf11_uri_evidence(spark, sf_dir):
    found = F.element_at(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in EVIDENCE]), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int"))
    return attachments.uri_evidence(table(spark, sf_dir, "supplier").select("s_suppkey", found.alias("urls")), "s_suppkey").drop("samples")


# ------------------------------------------------------------------ scores

SCORE = "round(('0x' || left(sha256('s' || doc_id), 8))::bigint / 4294967296.0, 3)"


def scored(spark, sf_dir):
    """labels with a score that SQL can compute too."""
    p = F.round(F.conv(F.substring(F.sha2(F.concat(F.lit("s"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0, 3)
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic"), p.alias("p")).withColumn("predicted", (F.col("p") >= 0.5).cast("int"))


SCORED = f"select doc_id, quality as label, toxic, {SCORE} as p, ({SCORE} >= 0.5)::int as predicted from labels"


@query("""with d as (select doc_id, len([w for w in string_split_regex(text, '\\s+') if w <> '']) as n from documents), s as (select doc_id, n, case when n <= 60 then [0] else list_distinct(range(0, n - 60 + 1, 45) || [n - 60]) end as a from d),
    o as (select doc_id, n, list_sort(a) as a from s) select doc_id, i::int as chunk, (case when len(a) > 8 then a[(round_even(i * (len(a) - 1) / 7.0, 0))::int + 1] else a[i + 1] end)::int as start from o, range(0, 8) t(i) where i < least(len(a), 8)""")
def chk01_windows(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", text.words(F.col("text")).alias("tokens"))
    return scoring.chunks(rows, "doc_id", "tokens", payload=60, overlap=15).select("doc_id", "chunk", "start")


@query("""with d as (select doc_id, [w for w in string_split_regex(text, '\\s+') if w <> ''] as w from documents), s as (select doc_id, w, len(w) as n, case when len(w) <= 510 then [0] else list_sort(list_distinct(range(0, len(w) - 510 + 1, 382) || [len(w) - 510])) end as a from d),
    o as (select doc_id, w, i::int as chunk, case when len(a) > 8 then a[(round_even(i * (len(a) - 1) / 7.0, 0))::int + 1] else a[i + 1] end as start from s, range(0, 8) t(i) where i < least(len(a), 8))
    select doc_id, chunk, '[CLS]' || case when len(w) = 0 then '' else ' ' end || array_to_string(w[start + 1:start + 510], ' ') || ' [SEP]' as tokens from o""")
def chk02_prepared(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", text.words(F.col("text")).alias("tokens"))
    return scoring.chunks(rows, "doc_id", "tokens").select("doc_id", "chunk", F.array_join("tokens", " ").alias("tokens"))


LOGITS = "select label as owner, vec_id as chunk, embedding[1]::double as logit_neg, embedding[2]::double as logit_pos from embeddings"


def logits(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("owner"), F.col("vec_id").alias("chunk"), F.col("embedding")[0].cast("double").alias("logit_neg"), F.col("embedding")[1].cast("double").alias("logit_pos"))


@query(f"select owner, chunk, round(logit_pos - logit_neg, 9) as margin from (select *, row_number() over (partition by owner order by logit_pos - logit_neg desc, chunk) as k from ({LOGITS})) where k = 1")
def scr01_best_chunk(spark, sf_dir):
    return scoring.best_chunk(logits(spark, sf_dir)).select("owner", "chunk", F.round("margin", 9).alias("margin"))


@query(f"select chunk, round(1 / (1 + exp(-(logit_pos - logit_neg) / 1.5)), 9) as p from ({LOGITS})")
def cal01_probability(spark, sf_dir):
    return logits(spark, sf_dir).select("chunk", F.round(scoring.probability(F.col("logit_pos") - F.col("logit_neg"), 1.5), 9).alias("p"))


@query(f"select doc_id, case when p >= 0.65 then 'phishing' when p <= 0.35 then 'legitimate' else 'uncertain' end as decision from ({SCORED})")
def cal02_decision(spark, sf_dir):
    return scored(spark, sf_dir).select("doc_id", scoring.decision(F.col("p")).alias("decision"))


@query(f"""with b as (select p, count(*) as n, sum(label) as pos from ({SCORED}) group by p), c as (select p, sum(n) over (order by p desc) as cn, sum(pos) over (order by p desc) as cp, (select sum(pos) from b) as t from b)
    select p as threshold, round(2.0 * cp / (cn + t), 9) as f1 from c order by 2.0 * cp / (cn + t) desc, p limit 1""")
def cal04_best_f1(spark, sf_dir):
    return scoring.best_f1(scored(spark, sf_dir)).withColumn("f1", F.round("f1", 9))


@query(f"""with b as (select abs(p - 0.5) as d, count(*) as n, sum(((p >= 0.5)::int = label)::int) as r from ({SCORED}) group by 1), c as (select d, sum(n) over (order by d desc) / (select sum(n) from b) as cov, sum(r) over (order by d desc) / sum(n) over (order by d desc) as acc from b)
    select round(d, 9) as half_width, round(cov, 9) as coverage, round(acc, 9) as accuracy from c where cov >= 0.8 order by (acc >= 0.95) desc, case when acc < 0.95 then -acc end nulls first, d limit 1""")
def cal05_band(spark, sf_dir):
    r = scoring.selective_band(scored(spark, sf_dir))
    return r.select(*[F.round(c, 9).alias(c) for c in r.columns])


CONFUSION = """count_if(predicted = 1 and label = 1) as tp, count_if(predicted = 1 and label = 0) as fp, count_if(predicted = 0 and label = 1) as fn, count_if(predicted = 0 and label = 0) as tn"""
RATIOS = "tp, fp, fn, tn, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) as \"precision\", round(coalesce(tp / nullif(tp + fn, 0), 0), 9) as recall, round((tp + tn) / (tp + fp + fn + tn), 9) as accuracy, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) as f1"


def rounded(df, *names):
    return df.select(*[F.round(c, 9).alias(c) if c in ("precision", "recall", "accuracy", "f1", *names) else F.col(c) for c in df.columns])


@query(f"select {RATIOS} from (select {CONFUSION} from ({SCORED}))")
def met01_confusion(spark, sf_dir):
    return rounded(scoring.confusion(scored(spark, sf_dir)))


@query(f"""with s as ({SCORED}), k as (select *, row_number() over (partition by label order by sha256('42:' || doc_id), doc_id) as k from s), m as (select unnest([0.5, 0.1, 0.05, 0.02])::double as scenario), n as (select scenario, round_even((select count(*) from s where label = 0) * scenario / (1 - scenario), 0) as most from m)
    select scenario, {RATIOS} from (select scenario, {CONFUSION} from k, n where label = 0 or k <= most group by scenario)""")
def met03_prevalence(spark, sf_dir):
    return rounded(scoring.prevalence(scored(spark, sf_dir), "doc_id"))


@query(f"select source, {RATIOS} from (select source, {CONFUSION} from ({SCORED}) join documents using (doc_id) group by source)")
def met04_by_source(spark, sf_dir):
    return rounded(scoring.confusion(scored(spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "source"), "doc_id"), "source"))


@query("select round(quantile_cont(value, 0.01), 6) as p01, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95, round(quantile_cont(value, 1.0), 6) as p100 from events")
def met05_percentiles(spark, sf_dir):
    p = F.percentile("value", [0.01, 0.5, 0.95, 1.0])
    return table(spark, sf_dir, "events").agg(p.alias("p")).select(*[F.round(F.col("p")[i], 6).alias(n) for i, n in enumerate(("p01", "p50", "p95", "p100"))])


@query(f"select round(least(floor(p * 10), 9) / 10, 9) as bin, count(*) as n, round(avg(p), 9) as mean, round(stddev_pop(p), 9) as sd from ({SCORED}) group by 1")
def met06_histogram(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumn("bin", F.round(F.least(F.floor(F.col("p") * 10), F.lit(9)) / 10, 9))
    return rows.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p"), 9).alias("mean"), F.round(F.stddev_pop("p"), 9).alias("sd"))


@query(r"select lang, count(*) as n, round(avg(length(text)), 6) as mean_chars, round(median(length(text)), 6) as median_chars, max(length(text))::bigint as max_chars, round(avg(len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))), 6) as mean_words from documents group by lang")
def eda01_lengths(spark, sf_dir):
    n = F.length("text")
    return documents(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.round(F.avg(n), 6).alias("mean_chars"), F.round(F.percentile(n, 0.5), 6).alias("median_chars"), F.max(n).cast("long").alias("max_chars"), F.round(F.avg(F.regexp_count("text", F.lit(r"[\p{L}\p{N}_]+"))), 6).alias("mean_words"))


@query(r"with w as (select unnest(regexp_extract_all(lower(text), '\p{L}{3,}')) as word from documents) select word, count(*) as n from w group by word order by n desc, word limit 30")
def eda03_top_words(spark, sf_dir):
    words = F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word")
    return documents(spark, sf_dir).select(words).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(30)


@query(r"select doc_id, length(regexp_replace(text, '[\p{L}\p{M}\p{N}\s]', '', 'g'))::bigint as specials from documents")
def eda03_special_chars(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.length(F.regexp_replace("text", r"[\p{L}\p{M}\p{N}\s]", "")).cast("long").alias("specials"))


# ------------------------------------------------------------------ flags and enrichment

LEVELS = "case event_type when 'click' then 'HIGH' when 'view' then 'LOW' when 'purchase' then 'MEDIUM' else 'INFO' end"


def alerts(spark, sf_dir):
    level = F.when(F.col("event_type") == "click", "HIGH").when(F.col("event_type") == "view", "LOW").when(F.col("event_type") == "purchase", "MEDIUM").otherwise("INFO")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", level.alias("level"))


@query(f"with c as (select user_id, count_if(l = 'HIGH') as high, count_if(l = 'MEDIUM') as medium, count_if(l = 'LOW') as low, count_if(l = 'INFO') as info from (select user_id, {LEVELS} as l from events) group by user_id) select *, case when high > 0 then 'CRITICAL' when medium > 0 then 'SUSPICIOUS' when low > 0 then 'WATCH' else 'LOW' end as severity from c")
def flg04_severity(spark, sf_dir):
    c = flags.level_counts(alerts(spark, sf_dir), "user_id")
    return c.withColumn("severity", flags.severity(F.col("high"), F.col("medium"), F.col("low")))


@query(f"select user_id, event_id, level, alert_rank::int as alert_rank from (select *, row_number() over (partition by user_id order by case level when 'HIGH' then 0 when 'MEDIUM' then 1 else 2 end, event_id) as alert_rank from (select user_id, event_id, {LEVELS} as level from events) where level <> 'INFO') where alert_rank <= 5")
def flg05_top_alerts(spark, sf_dir):
    return flags.top_alerts(alerts(spark, sf_dir).where("level != 'INFO'"), "user_id", [flags.level_rank(F.col("level")), "event_id"]).select("user_id", "event_id", "level", "alert_rank")


@query(f"with u as (select {HOST} as k, 'domain' as t, page_id from pages union all select url, 'url', page_id from pages) select t as entity_type, k as entity_key, count(distinct page_id) as n_messages from u where k <> '' group by all")
def enr13_lookup_plan(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("host", urls.host(F.col("url")))
    return enrich.plan(p, "page_id", domain="host", url="url")


@query("select s_suppkey, n_name, case when s_acctbal >= 7500 then 'malicious' when s_acctbal >= 2500 then 'suspicious' when s_acctbal = 0 then 'clean' else 'low_risk' end as status from supplier left join nation on s_nationkey = n_nationkey")
def enr10_reputation_join(spark, sf_dir):
    s = enrich.lookup(table(spark, sf_dir, "supplier"), "s_nationkey", table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_nationkey")
    return s.select("s_suppkey", "n_name", flags.abuse_label((F.col("s_acctbal") / 100).cast("double"), F.lit(False)).alias("status"))


@query("select event_id, strftime(to_timestamp(event_id * 86399) at time zone 'UTC', '%Y-%m-%d %H:%M') || ' UTC' as at from events")
def enr15_utc_minute(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", enrich.utc_minute(F.col("event_id") * 86399).alias("at"))


@query(f"select user_id, bool_and(event_type in ('purchase', 'signup')) as finished, count(*) as n from events group by user_id")
def str05_terminal(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.bool_and(F.col("event_type").isin("purchase", "signup")).alias("finished"), F.count("*").alias("n"))


@query("select event_id, user_id from events where event_id not in (select event_id from events where event_id % 3 = 0)")
def str07_resume(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.join(e.where(F.pmod("event_id", F.lit(3)) == 0).select("event_id"), "event_id", "left_anti").select("event_id", "user_id")


@query(f"""with r as ({ROWS}), valid as ({VALID}), c as ({CLEAN}) select source, label, count(*) as n from c group by all""")
def entry_profile(spark, sf_dir):
    """The flagship: documents cleaned, without conflicts and copies, counted by source and label."""
    return corpus.clean(labelled(spark, sf_dir)).groupBy("source", "label").agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ messages, HTML and streams


def eml(spark, sf_dir):
    """documents as raw messages with headers, a plain and an HTML part, and an attachment."""
    crlf = "\r\n"
    k = F.col("doc_id").cast("string")
    head = F.concat(F.lit("From: Ann <ann@a.example>" + crlf + "To: bob@b.example" + crlf + "Subject: note "), k, F.lit(crlf + "Message-ID: <"), k, F.lit("@a.example>" + crlf + 'MIME-Version: 1.0' + crlf + 'Content-Type: multipart/mixed; boundary="=x="' + crlf + crlf))
    plain = F.concat(F.lit("--=x=" + crlf + "Content-Type: text/plain; charset=utf-8" + crlf + "Content-Transfer-Encoding: 8bit" + crlf + crlf), F.coalesce("text", F.lit("")), F.lit(crlf))
    html = F.lit("--=x=" + crlf + "Content-Type: text/html; charset=utf-8" + crlf + crlf + "<p>Pa<span>y</span>Pal</p><p hidden>no</p>" + crlf)
    file = F.concat(F.lit("--=x=" + crlf + 'Content-Type: application/pdf; name="a.pdf"' + crlf + 'Content-Disposition: attachment; filename="a.pdf"' + crlf + crlf + "%PDF-1.4 "), k, F.lit(crlf + "--=x=--" + crlf))
    return documents(spark, sf_dir).select("doc_id", F.lit("t").alias("path"), k.alias("member"), F.concat(head, plain, html, file).cast("binary").alias("content"))


@query(r"select doc_id, 'ok' as status, 'note ' || doc_id as subject, case when regexp_matches(coalesce(text, ''), '\S') then 'plain' else 'html' end as body_source, 1 as n_files, sha256('%PDF-1.4 ' || doc_id) as file_hash from documents")
def src01_messages(spark, sf_dir):
    from corvid.sources.messages import parse_messages

    r = parse_messages(eml(spark, sf_dir))
    return r.select(F.col("member").cast("long").alias("doc_id"), "status", "subject", "body_source", F.size("attachments").alias("n_files"), F.sha2(F.col("attachments")[0]["payload"], 256).alias("file_hash"))


@query()
def htm01_visible_text(spark, sf_dir):
    from corvid.functions.html import visible

    return table(spark, sf_dir, "pages").select("page_id", visible(F.col("html")).alias("text"))


@query(r"""select page_id, regexp_extract(a, 'href="([^"]*)"', 1) as url, trim(replace(replace(replace(regexp_extract(a, '>([^<]*)<', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) as display_text, 'body_action' as role
    from (select page_id, unnest(regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>')) as a from pages)""")
def lnk09_anchor_roles(spark, sf_dir):
    from corvid.functions.html import anchors

    return table(spark, sf_dir, "pages").select("page_id", F.inline(anchors(F.col("html"))))


@query("select date_trunc('day', ts) as start, event_type, count(*) as n, round(sum(value), 4) as total from events group by all")
def str_tumbling(spark, sf_dir):
    from corvid.streaming import jobs

    return jobs.drain(jobs.tumbling(jobs.stream(spark, f"{sf_dir}/events.parquet")), "complete").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("select distinct user_id, event_type from events")
def str01_dedup(spark, sf_dir):
    from corvid.streaming import jobs

    return jobs.drain(jobs.first_within(jobs.stream(spark, f"{sf_dir}/events.parquet"), ["user_id", "event_type"], "3650 days").select("user_id", "event_type"))


@query("""with e as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events), s as (select user_id, ts, sum(case when p is null or ts - p >= interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k from e)
    select user_id, min(ts) as start, count(*) as n from s group by user_id, k""")
def str_sessions(spark, sf_dir):
    from corvid.streaming import jobs

    return jobs.sessions(table(spark, sf_dir, "events"))


# ------------------------------------------------------------------ policy, on facts made from the customers' keys

from corvid.operators import policy  # noqa: E402


def case_rows(spark, sf_dir):
    """customer keys as facts: every word and truth value comes from a part of the key's hash."""
    h = lambda i: F.conv(F.substring(F.sha2(F.col("c_custkey").cast("string"), 256), 2 * i + 1, 2), 16, 10).cast("int")
    pick = lambda i, words: F.element_at(F.array(*[F.lit(w) for w in words]), F.pmod(h(i), F.lit(len(words))) + 1)
    rows = table(spark, sf_dir, "customer").select("c_custkey", pick(0, policy.ACTIONS).alias("requested_action"), pick(1, policy.CHANNELS).alias("action_channel"), *[(F.pmod(h(i + 2), F.lit(5)) == 0).alias(b) for i, b in enumerate(policy.BOOLEANS)], F.pmod(h(17), F.lit(2)).alias("n_links"), F.pmod(h(18), F.lit(2)).alias("n_attachments"), F.when(h(19) % 3 == 0, "").otherwise("quote").alias("evidence_phrase"), (h(20) / 255.0).cast("double").alias("confidence"))
    return rows.withColumns({"spf": pick(21, STATUSES), "dkim": pick(22, STATUSES), "dmarc": pick(23, STATUSES), "link_status": pick(24, REPUTATIONS), "file_status": pick(25, REPUTATIONS), "hop_status": pick(26, REPUTATIONS), "domain_status": F.lit(None).cast("string"), "pdf_risk": pick(27, ["clean", "low", "medium", "clean", "high", "clean", "clean"]), "classifier": pick(28, ["phishing", "legitimate", "uncertain"]), **{n: F.pmod(h(29 + i), F.lit(9)) == 0 for i, n in enumerate(("display_name_spoofing", "reply_to_mismatch", "brand_mismatch"))}, "anomaly": F.pmod(h(20), F.lit(9)) == 1, "ip_link": F.pmod(h(21), F.lit(9)) == 1, "lookalike": F.pmod(h(22), F.lit(9)) == 1, "link_mismatch": F.pmod(h(23), F.lit(9)) == 1})


STATUSES = ["pass", "fail", "none", "softfail", "bestguesspass"]
REPUTATIONS = ["clean", "unknown", "clean", "suspicious", "clean", "clean", "clean", "clean", "clean", "malicious", "clean"]


def case_sql() -> str:
    h = lambda i: f"('0x' || substr(sha256(c_custkey::varchar), {2 * i + 1}, 2))::int"
    pick = lambda i, words: f"[{values(words)}][{h(i)} % {len(words)} + 1]"
    cols = [f"{pick(0, policy.ACTIONS)} as a0", f"{pick(1, policy.CHANNELS)} as c0", *[f"{h(i + 2)} % 5 = 0 as {b}" for i, b in enumerate(policy.BOOLEANS)], f"{h(17)} % 2 as n_links", f"{h(18)} % 2 as n_attachments", f"case when {h(19)} % 3 = 0 then '' else 'quote' end as e0", f"{h(20)} / 255.0 as f0"]
    cols += [f"{pick(21, STATUSES)} as spf", f"{pick(22, STATUSES)} as dkim", f"{pick(23, STATUSES)} as dmarc", f"{pick(24, REPUTATIONS)} as link_status", f"{pick(25, REPUTATIONS)} as file_status", f"{pick(26, REPUTATIONS)} as hop_status", f"{pick(27, ['clean', 'low', 'medium', 'clean', 'high', 'clean', 'clean'])} as pdf_risk", f"{pick(28, ['phishing', 'legitimate', 'uncertain'])} as classifier"]
    cols += [f"{h(29 + i)} % 9 = 0 as {n}" for i, n in enumerate(("display_name_spoofing", "reply_to_mismatch", "brand_mismatch"))] + [f"{h(20 + i)} % 9 = 1 as {n}" for i, n in enumerate(("anomaly", "ip_link", "lookalike", "link_mismatch"))]
    return f"""with f as (select c_custkey, {', '.join(cols)} from customer),
    l as (select *, (a0 = 'visit_link' and n_links = 0) or (a0 = 'open_attachment' and n_attachments = 0) as lost, (c0 = 'supplied_link' and n_links = 0) or (c0 = 'supplied_attachment' and n_attachments = 0) as unclear from f),
    k as (select *, case when lost then 'informational' else a0 end as action, case when lost then 'none' when unclear then 'unclear' else c0 end as channel, case when lost then '' else e0 end as phrase,
        (asks_to_click_link or c0 = 'supplied_link') and not (n_links = 0 and (c0 = 'supplied_link' or a0 = 'visit_link')) as click, (asks_to_open_attachment or c0 = 'supplied_attachment') and not (n_attachments = 0 and (c0 = 'supplied_attachment' or a0 = 'open_attachment')) as opens from l),
    m as (select *, a0 not in ('none', 'informational', 'other') and phrase = '' as groundless, channel in ('supplied_link', 'external_form', 'supplied_attachment', 'email_reply') or click or opens as supplied, urgency_present and a0 not in ('none', 'informational', 'other') as urgent, asks_for_sensitive_information or asks_for_payment as sensitive from k),
    r as (select *, case when (structured_extortion and asks_for_payment) or (asks_for_credentials and (action = 'provide_credentials' or supplied) and channel <> 'normal_known_procedure') or asks_to_bypass_procedure or (impersonation_or_deception and (sensitive or (asks_to_change_account_settings and supplied))) then 'malicious'
            when sensitive or (supplied and (asks_to_change_account_settings or action = 'verify_account' or asks_to_verify_account or action = 'claim_reward' or asks_to_claim_reward or (financial_pretext_present and threat_or_consequence_present) or (financial_incentive_present and urgency_present))) or (urgent and (supplied or sensitive)) then 'suspicious' else 'benign' end as content,
        case when display_name_spoofing or reply_to_mismatch or brand_mismatch then 'spoofing_evidence' when dmarc in ('pass', 'bestguesspass') or (spf = 'pass' and dkim = 'pass') then 'verified' else 'uncertain' end as identity,
        case when 'malicious' in (link_status, file_status, hop_status) or pdf_risk in ('high', 'critical') then 'malicious' when 'suspicious' in (link_status, file_status, hop_status) or pdf_risk = 'medium' or anomaly or ip_link or lookalike or link_mismatch then 'uncertain' else 'clean' end as technical from m)"""


@query(case_sql() + " select c_custkey, action as requested_action, channel as action_channel, case when lost or unclear or groundless then 'high' else 'low' end as ambiguity, round(case when groundless then least(f0, 0.49) else f0 end, 9) as confidence, click as asks_to_click_link from r")
def pol05_correlated(spark, sf_dir):
    r = policy.correlated(case_rows(spark, sf_dir))
    return r.select("c_custkey", "requested_action", "action_channel", "ambiguity", F.round("confidence", 9).alias("confidence"), "asks_to_click_link")


@query(case_sql() + " select c_custkey, content from r")
def pol06_content_risk(spark, sf_dir):
    return policy.correlated(case_rows(spark, sf_dir)).select("c_custkey", policy.content_risk()["risk"].alias("content"))


@query(case_sql() + " select c_custkey, identity from r")
def pol07_identity_risk(spark, sf_dir):
    return case_rows(spark, sf_dir).select("c_custkey", policy.identity_risk().alias("identity"))


@query(case_sql() + " select c_custkey, technical from r")
def pol08_technical_risk(spark, sf_dir):
    return case_rows(spark, sf_dir).select("c_custkey", policy.technical_risk().alias("technical"))


@query(case_sql() + """ select c_custkey, case when technical = 'malicious' or content = 'malicious' or (content = 'suspicious' and (identity = 'spoofing_evidence' or technical = 'uncertain')) or (classifier = 'phishing' and channel in ('supplied_link', 'external_form', 'supplied_attachment') and identity <> 'verified') then 'phishing'
    when (classifier = 'phishing' and channel in ('supplied_link', 'external_form', 'supplied_attachment')) or content = 'suspicious' or identity = 'spoofing_evidence' or technical = 'uncertain' then 'review' else 'legitimate' end as verdict from r""")
def pol11_verdict(spark, sf_dir):
    r = policy.correlated(case_rows(spark, sf_dir)).withColumns({"content": policy.content_risk()["risk"], "identity": policy.identity_risk(), "technical": policy.technical_risk()})
    return r.select("c_custkey", policy.verdict(F.col("content"), F.col("identity"), F.col("technical"), F.col("classifier"), F.col("action_channel")).alias("verdict"))


ANSWERS = ['```json\n{"requested_action": "Payment", "action_channel": "LINK", "confidence": 1.7, "asks_for_payment": "yes"}\n```', 'Sure: {"requested_action": "dance", "confidence": "0.25", "asks_for_payment": 0} done', "no json", '{"requested_action": "verify-account", "action_channel": "phone", "confidence": null, "asks_for_payment": true}']


@query("select c_custkey, [true, true, false, true][i] as has_json, ['pay_or_transfer', 'none', 'none', 'verify_account'][i] as requested_action, ['supplied_link', 'unclear', 'unclear', 'phone_or_other'][i] as action_channel, [1.0, 0.25, 0.5, 0.5][i]::double as confidence, [true, false, false, true][i] as asks_for_payment from (select c_custkey, c_custkey % 4 + 1 as i from customer)")
def pol02_answer_facts(spark, sf_dir):
    answer = F.element_at(F.array(*map(F.lit, ANSWERS)), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    r = table(spark, sf_dir, "customer").select("c_custkey", flags.first_json(answer).alias("j"))
    return r.select("c_custkey", F.col("j").isNotNull().alias("has_json"), *policy.facts(F.col("j"))).select("c_custkey", "has_json", "requested_action", "action_channel", "confidence", "asks_for_payment")


@query(r"""with q as (select doc_id, trim(regexp_replace(substr(text, 20, 60), '\s+', ' ', 'g')) as q from documents) select doc_id, q <> '' as exact, case when length(q) >= 40 then true end as near from q""")
def pol03_grounding(spark, sf_dir):
    quote = text.collapse(F.substring("text", 20, 60))  # upper case can be longer
    near = F.when(F.length(quote) >= 40, policy.grounded(F.concat(F.upper(F.substring(quote, 1, 58)), F.lit("xx")), F.col("text")))
    return documents(spark, sf_dir).select("doc_id", policy.grounded(F.upper(quote), F.col("text")).alias("exact"), near.alias("near"))


@query("select user_id, event_id as section, round(value, 6) as score, event_type from (select *, row_number() over (partition by user_id order by value desc, event_id) as k from events) where k = 1")
def pol12_best_candidate(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("section"), F.col("value").alias("score"), "event_type")
    return policy.best_candidate(e, "user_id").withColumn("score", F.round("score", 6))


@query("select s_suppkey, case when s_acctbal is null then 'unknown' when s_acctbal >= 75 then 'high' when s_acctbal >= 25 then 'medium' else 'low' end as risk, case when s_suppkey % 5 = 0 then 'recipient' when s_suppkey % 5 = 4 then 'sender' when s_suppkey % 5 = 1 then 'injection' else 'relay' end as role from (select s_suppkey, s_acctbal from supplier)")
def rcv14_hop_role(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", flags.score_risk(F.col("s_acctbal")).alias("risk"), flags.hop_role(F.pmod("s_suppkey", F.lit(5)), F.lit(5)).alias("role"))


@query("""with h as (select c_custkey, ['List-Id', 'X-Mailer', 'Precedence', 'x-campaign', 'X-SG-EID', 'Subject', 'List-Help'][1:(c_custkey % 8)] as names from customer), s as (select c_custkey, [x for x in ['List-Id', 'X-Mailer', 'Precedence', 'X-Campaign', 'X-SG-EID', 'List-Help'] if list_contains([lower(y) for y in names], lower(x))] as p from h)
    select c_custkey, len(p) + (case when c_custkey % 8 >= 3 then 1 else 0 end) as n_signals, len(p) + (case when c_custkey % 8 >= 3 then 1 else 0 end) >= 4 as bulk from s""")
def hdr08_bulk_signals(spark, sf_dir):
    names = F.slice(F.array(*[F.lit(x) for x in ("List-Id", "X-Mailer", "Precedence", "x-campaign", "X-SG-EID", "Subject", "List-Help")]), F.lit(1), F.pmod("c_custkey", F.lit(8)).cast("int"))
    s = headers.bulk_signals(names, F.lit(None).cast("string"), F.when(F.pmod("c_custkey", F.lit(8)) >= 3, "Bulk"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(s).cast("long").alias("n_signals"), (F.size(s) >= fixed.BULK_SIGNALS).alias("bulk"))


def report_rows(spark, sf_dir):
    r = case_rows(spark, sf_dir)
    k = F.col("c_custkey")
    return r.select("c_custkey", F.when(k % 11 != 0, F.col("spf")).alias("spf"), "dkim", "dmarc", (k % 3 == 0).alias("has_dkim"), "reply_to_mismatch", (k % 5 == 0).alias("reply_to_legitimate"), (k % 4 == 0).alias("return_path_mismatch"), (k % 2 == 0).alias("is_bulk"), (k % 6 == 0).alias("html_only"), "display_name_spoofing", F.when(k % 7 == 0, "1.2.3.4").alias("injection_ip"))


@query(case_sql() + """, q as (select *, case when c_custkey % 11 <> 0 then spf end as s from r) select c_custkey,
    (s is null or s <> 'pass')::int + (dkim <> 'pass' or c_custkey % 3 <> 0)::int + (dmarc not in ('pass', 'bestguesspass'))::int + (c_custkey % 4 = 0 and c_custkey % 2 <> 0)::int as medium,
    reply_to_mismatch::int + display_name_spoofing::int as high, (c_custkey % 4 = 0 and c_custkey % 2 = 0)::int as low, (not reply_to_mismatch and c_custkey % 5 = 0)::int + (c_custkey % 6 = 0)::int + (c_custkey % 7 = 0)::int as info from q""")
def flg01_message_flags(spark, sf_dir):
    f = report_rows(spark, sf_dir).select("c_custkey", flags.message_flags().alias("f"))
    n = lambda v: F.size(F.filter("f", lambda x: x["level"] == v)).alias(v.lower())
    return f.select("c_custkey", n("MEDIUM"), n("HIGH"), n("LOW"), n("INFO"))


@query(rf"""with h as (select page_id, {HOST} as host, url from pages) select page_id, 'domain' as kind, replace(host, '.', '[.]') as indicator from h where host <> '' union all
    select page_id, 'url', regexp_extract(url, '^([a-zA-Z]+)://', 1) || '[://]' || replace(regexp_extract(url, '://([^/?#]*)', 1), '.', '[.]') || regexp_extract(url, '://[^/?#]*(.*)$', 1) from h union all select page_id, 'hash', sha256(url) from h""")
def ioc01_indicators(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.array("url", "url").alias("urls"), F.array(urls.host(F.col("url"))).alias("hosts"), F.array(F.sha2("url", 256)).alias("hashes"))
    return flags.indicators(p, "page_id", url="urls", domain="hosts", hash="hashes").select("page_id", "kind", "indicator")


@query(f"select round(sum(w * case when label = 1 then -ln(least(greatest(p, 0.001), 0.999)) else -ln(1 - least(greatest(p, 0.001), 0.999)) end) / sum(w), 9) as loss from (select *, 1.0 / (1 + doc_id % 4) as w from ({SCORED}))")
def chk04_weighted_loss(spark, sf_dir):
    r = scored(spark, sf_dir).select(F.least(F.greatest("p", F.lit(0.001)), F.lit(0.999)).alias("p"), "label", (1.0 / (1 + F.pmod("doc_id", F.lit(4)))).alias("weight"))
    return scoring.weighted_loss(r).select(F.round("loss", 9).alias("loss"))


@query(f"""with b as (select owner, logit_pos - logit_neg as m from (select *, row_number() over (partition by owner order by logit_pos - logit_neg desc, chunk) as k from ({LOGITS})) where k = 1), s as (select (m >= 0.1)::int as predicted, (owner % 2)::int as label from b) select {RATIOS} from (select {CONFUSION} from s)""")
def met02_email_metrics(spark, sf_dir):
    b = scoring.best_chunk(logits(spark, sf_dir))
    return rounded(scoring.confusion(b.select((F.col("margin") >= 0.1).cast("int").alias("predicted"), (F.col("owner") % 2).cast("int").alias("label"))))


@query()
def cal03_temperature(spark, sf_dir):
    rows = scored(spark, sf_dir).select(((F.col("p") - 0.5) * 8).alias("margin"), "label")
    return spark.createDataFrame([(float(scoring.fit_temperature(rows)),)], "temperature double")


@query("select regexp_extract(p_brand, '#(.)', 1) as g, count(*) as n, count(distinct p_brand) as brands from part group by 1")
def enr06_group_summary(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.regexp_extract("p_brand", "#(.)", 1).alias("g")).agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))


# ------------------------------------------------------------------ the remaining single expressions

RAW_URLS = ["//a.example.com/x", "www.b.example.org", "c.example.net/path", "http://d.example.com", "mailto:x@y.z", "not a url", "", "ftp://e.example.com/f", "https://[tok]@f.example.com/q", "HTTPS://G.example.com"]


@query(f"""select page_id, u as raw, ['https://a.example.com/x', 'http://www.b.example.org', 'http://c.example.net/path', 'http://d.example.com', 'http://mailto:x@y.z', 'http://not a url', '', 'ftp://e.example.com/f', 'https://[tok]@f.example.com/q', 'HTTPS://G.example.com'][i] as full_url,
    [false, true, false, true, false, false, false, false, true, true][i] as candidate, regexp_replace(u, '^(https?://)\\[[^\\]/?#@]*\\]@(.+)$', '\\1\\2', 'i') as repaired from (select page_id, page_id % 10 + 1 as i, [{values(RAW_URLS)}][page_id % 10 + 1] as u from pages)""")
def lnk03_candidates(spark, sf_dir):
    r = table(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(*map(F.lit, RAW_URLS)), (F.pmod("page_id", F.lit(10)) + 1).cast("int")).alias("raw"))
    return r.select("page_id", "raw", urls.with_scheme(F.col("raw")).alias("full_url"), urls.web_candidate(F.col("raw")).alias("candidate"), urls.repair_userinfo(F.col("raw")).alias("repaired"))


SHOWN = ["Visit www.paypal.com now", "click here", "https://x.example.com", "go to other.org"]


@query(f"select page_id, [true, false, not ends_with(host, '.example.com') and host <> 'example.com', true][page_id % 4 + 1] and host <> '' as mismatch from (select page_id, {HOST} as host from pages)")
def lnk07_display_mismatch(spark, sf_dir):
    shown = F.element_at(F.array(*map(F.lit, SHOWN)), (F.pmod("page_id", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", links.display_mismatch(shown, urls.host(F.col("url"))).alias("mismatch"))


@query(r"select doc_id, regexp_matches(text, '[^\x00-\x7F]') as non_ascii from documents")
def lnk10_non_ascii(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.col("text").rlike(r"[^\x00-\x7F]").alias("non_ascii"))


@query("""with t as (select page_id, unnest(['Reset now', 'reset NOW', 'go', 'https://x.y', 'Open ' || (page_id % 3), 'View it']) as label, unnest([1, 2, 3, 4, 5, 6]) as o from pages)
    select page_id, list(label order by o) as labels from (select page_id, arg_min(label, o) as label, min(o) as o from t where length(label) >= 4 and label not like 'http%' group by page_id, lower(label)) group by page_id""")
def lnk12_call_texts(spark, sf_dir):
    t = F.posexplode(F.array(F.lit("Reset now"), F.lit("reset NOW"), F.lit("go"), F.lit("https://x.y"), F.concat(F.lit("Open "), F.pmod("page_id", F.lit(3)).cast("string")), F.lit("View it"))).alias("o", "label")
    r = table(spark, sf_dir, "pages").select("page_id", t).where((F.length("label") >= 4) & ~F.col("label").startswith("http"))
    r = r.groupBy("page_id", F.lower("label").alias("k")).agg(F.min(F.struct("o", "label")).alias("f"))
    return r.groupBy("page_id").agg(F.slice(F.transform(F.array_sort(F.collect_list("f")), lambda x: x["label"]), 1, 8).alias("labels"))


GLYPHS = ["pаypal.com", "раypal.com", "plain.com", "gооgle.it", "ı.net"]


@query(f"select s_suppkey, h as host, translate(lower(h), '{''.join(fixed.HOMOGLYPHS)}', '{''.join(fixed.HOMOGLYPHS.values())}') as norm, h <> 'plain.com' as confusable, string_split(translate(lower(h), '{''.join(fixed.HOMOGLYPHS)}', '{''.join(fixed.HOMOGLYPHS.values())}'), '.')[-2] as sld from (select s_suppkey, [{values(GLYPHS)}][s_suppkey % 5 + 1] as h from supplier)")
def lka02_homoglyphs(spark, sf_dir):
    h = F.element_at(F.array(*map(F.lit, GLYPHS)), (F.pmod("s_suppkey", F.lit(5)) + 1).cast("int"))
    r = table(spark, sf_dir, "supplier").select("s_suppkey", h.alias("host"))
    return r.select("s_suppkey", "host", urls.homoglyphs_replaced(F.col("host")).alias("norm"), urls.has_homoglyphs(F.col("host")).alias("confusable")).withColumn("sld", urls.sld(F.col("norm")))


ADDRESSES = ["8.8.8.8", "256.1.1.1", "[2001:db8::1]", "::", "1:2:3:4:5:6:7:8", "10:00:05", "host.com", "1.2.3", "::ffff:1.2.3.4", "a::b::c"]


@query(f"select s_suppkey, [{values(ADDRESSES)}][s_suppkey % 10 + 1] as host, [true, false, true, true, true, false, false, false, true, false][s_suppkey % 10 + 1] as is_ip from supplier")
def lka05_ip_hosts(spark, sf_dir):
    h = F.element_at(F.array(*map(F.lit, ADDRESSES)), (F.pmod("s_suppkey", F.lit(10)) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", h.alias("host"), urls.ip_host(h).alias("is_ip"))


NESTED = ["https://a.b/r?url=https%3A%2F%2Fx.org%2F1&u=2", "https://a.b/r?u=https%253A%252F%252Fy.org", "https://a.b/", "https://a.b/?q=1&next=http://z.net"]


@query("select s_suppkey, [['https://x.org/1'], ['https://y.org'], [], ['http://z.net']][s_suppkey % 4 + 1]::varchar[] as nested from supplier")
def pdf07_nested_redirects(spark, sf_dir):
    u = F.element_at(F.array(*map(F.lit, NESTED)), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", attachments.nested_redirects(u).alias("nested"))


NAMES = ["report.PDF", "archive.tar.gz", "noext", None, "page.html"]


@query("select s_suppkey, ['pdf', 'gz', '', '', 'html'][s_suppkey % 5 + 1] as ext, case when s_suppkey % 2 = 0 then 'inline_resource' else 'attachment' end as role from supplier")
def att03_extension_and_role(spark, sf_dir):
    n = F.element_at(F.array(*[F.lit(x) for x in NAMES]), (F.pmod("s_suppkey", F.lit(5)) + 1).cast("int"))
    even = F.pmod("s_suppkey", F.lit(2)) == 0
    return table(spark, sf_dir, "supplier").select("s_suppkey", attachments.extension(n).alias("ext"), attachments.attachment_role(F.when(even, "inline"), F.lit(None).cast("string"), F.lit("image/png")).alias("role"))


@query("select s_suppkey, case s_suppkey % 5 when 0 then 'HIGH' when 1 then 'HIGH' when 2 then 'MEDIUM' else 'INFO' end as level, case when s_suppkey % 3 = 0 then 'bad type' end as anomaly from supplier")
def flg02_severities(spark, sf_dir):
    s = F.element_at(F.array(*[F.lit(x) for x in ("critical", "high", "Medium", "low", None)]), (F.pmod("s_suppkey", F.lit(5)) + 1).cast("int"))
    a = F.element_at(F.array(*[F.lit(x) for x in ("bad type", "PDF risk high", "  ")]), (F.pmod("s_suppkey", F.lit(3)) + 1).cast("int"))
    kept = F.when(~F.trim(a).startswith("PDF risk "), F.nullif(F.trim(a), F.lit("")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", attachments.severity_flag(s).alias("level"), kept.alias("anomaly"))


SPF = ["pass (sender ok) client-ip=1.2.3.4", "Fail (bad)", " softfail x", "(odd)"]


@query("select s_suppkey, ['pass', 'fail', 'softfail', ''][s_suppkey % 4 + 1] as status, [0, 100, 85, 50][s_suppkey % 4 + 1] as priority from supplier")
def rcv08_spf_status(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, SPF)), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", headers.spf_status(raw).alias("status")).withColumn("priority", headers.auth_priority(F.col("status")))


@query("select s_suppkey, list_distinct_first as ips from (select s_suppkey, case when s_suppkey % 2 = 0 then ['9.9.9.' || (s_suppkey % 250), '10.0.0.1', '8.8.4.4'] else ['10.0.0.1', '8.8.4.4'] end as list_distinct_first from supplier)")
def rcv13_routing_ips(spark, sf_dir):
    own = F.when(F.pmod("s_suppkey", F.lit(2)) == 0, F.concat(F.lit("9.9.9."), F.pmod("s_suppkey", F.lit(250)).cast("string")))
    all_ips = F.array_distinct(F.array_compact(F.concat(F.array(own), F.array(F.lit("10.0.0.1"), F.lit("8.8.4.4"), F.lit("10.0.0.1")))))
    return table(spark, sf_dir, "supplier").select("s_suppkey", all_ips.alias("ips"))


@query("select s_suppkey, case when s_suppkey % 2 = 0 then '8.8.4.4' else '10.0.0.1' end as ip from supplier")
def rcv03_preferred_ip(spark, sf_dir):
    ips = F.when(F.pmod("s_suppkey", F.lit(2)) == 0, F.array(F.lit("10.0.0.1"), F.lit("8.8.4.4"))).otherwise(F.array(F.lit("10.0.0.1"), F.lit("192.168.1.1")))
    return table(spark, sf_dir, "supplier").select("s_suppkey", headers.preferred_ip(ips).alias("ip"))


@query("""with l as (select doc_id, string_split(text, chr(10)) as a from documents), p as (select doc_id, unnest(a) as x, generate_subscripts(a, 1) as i from l), m as (select doc_id, x, i, count_if(trim(x) <> '') over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) as before from p),
    t as (select doc_id, min(i) as cut from m where regexp_matches(trim(x), '(?i)^(thanks|thank you|regards|cheers)\\s*,?\\s*$') and before >= 2 group by doc_id) select doc_id, t.cut is not null as has_tail from documents left join t using (doc_id)""")
def bcx02_tail(spark, sf_dir):
    ls = body.lines(F.col("text"))
    return documents(spark, sf_dir).select("doc_id", (body.without_tail(ls)["removed"] > 0).alias("has_tail"))


@query("""with s as (select doc_id, unnest(regexp_split_to_array(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), '\\n+')) as x from documents) select doc_id, count(distinct lower(trim(x))) as n from s where length(trim(x)) >= 8 group by doc_id""")
def bcx08_segments(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.size(body.evidence_segments(F.col("text"))).cast("long").alias("n")).where("n > 0")


def last_mark(mark: str) -> str:
    """SQL: where the window w, which ends at e, has its last mark's end; null without one."""
    return f"case when strpos(reverse(w), reverse({mark})) > 0 then e - strpos(reverse(w), reverse({mark})) + 1 end"


@query(f"""with recursive s(doc_id, t, pos, e, piece) as (select doc_id, t, 0, {{0}}, 0 from (select doc_id, coalesce(text, '') as t, 0 as pos from documents), lateral (select least(length(t), pos + 1200) as e), lateral (select substring(t, pos + 781, e - pos - 780) as w) where length(t) > 0
    union all select doc_id, t, pos, {{0}}, piece + 1 from (select doc_id, t, greatest(pos + 1, e - 150) as pos, piece from s where e < length(t)), lateral (select least(length(t), pos + 1200) as e), lateral (select substring(t, pos + 781, e - pos - 780) as w))
    select doc_id, piece::int as piece, substring(t, pos + 1, e - pos) as text from s""".replace("{0}", f"case when e < length(t) then coalesce({', '.join(last_mark(m) for m in ('chr(10) || chr(10)', 'chr(10)', repr('. '), repr(' ')))}, e) else e end"))
def bcx07_chunks(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.posexplode(text.overlapping(F.col("text"), 1200, 150)).alias("piece", "text"))


@query()
def htm02_without_signatures(spark, sf_dir):
    from corvid.functions.html import visible

    return table(spark, sf_dir, "pages").select("page_id", visible(F.concat(F.col("html"), F.lit("<div class='email-signature'>sig</div>")), drop_signatures=True).alias("text"))


@query()
def htm03_preview(spark, sf_dir):
    from corvid.functions.html import preview

    return table(spark, sf_dir, "pages").select("page_id", preview(F.col("html")).alias("html"))


@query("select doc_id, 4::int as n_parts, 1::int as max_depth from documents where text is not null and trim(text) <> ''")
def mim01_structure(spark, sf_dir):
    from corvid.sources.messages import parse_messages

    return parse_messages(eml(spark, sf_dir)).where("trim(body_plain) != ''").select(F.col("member").cast("long").alias("doc_id"), "n_parts", "max_depth")


VENDOR = ['{"data": {"attributes": {"last_analysis_stats": {"malicious": 3, "suspicious": 1, "harmless": 60, "undetected": 6}}}}', '{"data": {"attributes": {"last_analysis_stats": {"suspicious": 2, "harmless": 10}}}}', '{"data": {"attributes": {"last_analysis_stats": {"harmless": 5}}}}', "{}"]


@query("select s_suppkey, ['malicious', 'suspicious', 'clean', 'unknown'][i] as status, ['4 / 70', '2 / 12', '0 / 5', '0 / 0'][i] as detection_ratio from (select s_suppkey, s_suppkey % 4 + 1 as i from supplier)")
def enr02_vendor_file(spark, sf_dir):
    j = F.element_at(F.array(*map(F.lit, VENDOR)), (F.pmod("s_suppkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select("s_suppkey", enrich.vendor_file(j).alias("r")).select("s_suppkey", "r.status", "r.detection_ratio")


@query("select n_nationkey, max(s_acctbal) as score, count(*) as n_addresses from nation join supplier on s_nationkey = n_nationkey group by 1 union all select n_nationkey, null, null from nation where n_nationkey not in (select s_nationkey from supplier)")
def enr11_domain_reputation(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    return enrich.two_step(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", s.select(F.col("s_nationkey").alias("domain"), F.col("s_suppkey").alias("ip")), s.select(F.col("s_suppkey").alias("ip"), F.col("s_acctbal").alias("score")))


@query("select 40 as rows, 40 as distinct_texts, 0 as too_short, 0 as too_few_words, 0 as forbidden")
def gen02_generator_checks(spark, sf_dir):
    cats = spark.createDataFrame([("delivery", "en", ["Your parcel from {entity} for {event} was handed over today as planned.", "{entity} has packed the goods for {event} and will send them on Monday."], ["Kind regards", "The team"]), ("delivery", "it", ["Il pacco di {entity} per {event} arriva domani come previsto.", "{entity} ha preparato la merce per {event} e la spedisce presto."], ["Saluti", "Il gruppo"])], "category string, language string, templates array<string>, signatures array<string>")
    rows = corpus.hard_negatives(spark, cats, [f"Firm {x}" for x in "ABCDE"], ["the fair", "the opening", "the course", "the meeting"])
    return corpus.generator_checks(rows, ["password", "click here"])


@query("""with s as (select doc_id, quality as label, case when quality = 1 then 0.5 else 2.0 end as w from labels), n as (select doc_id, greatest(1, 1 + doc_id % 3) as k from labels) select doc_id, round(w / k, 9) as chunk_weight from s join n using (doc_id)""")
def chk03_chunk_weights(spark, sf_dir):
    r = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, 0.5).otherwise(2.0).alias("w"), (1 + F.pmod("doc_id", F.lit(3))).alias("k"))
    return r.select("doc_id", F.round(F.col("w") / F.col("k"), 9).alias("chunk_weight"))


@query("select conv_id, count(*) as n_turns, list(role order by turn) as roles from conversations group by conv_id")
def pol15_sections(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]).alias("roles"))


from corvid.operators import classify  # noqa: E402

GUESS = ", ".join(f"{{'n': len([w for w in ws if w in ({values(v)})]), 'o': -{i}, 'l': '{k}'}}" for i, (k, v) in enumerate(classify.FUNCTION_WORDS.items()))


@query(rf"""with w as (select doc_id, text, [x for x in string_split_regex(regexp_replace(lower(text), '[^\p{{L}}]+', ' ', 'g'), '\s+') if x <> ''] as ws from documents), c as (select doc_id, text, unnest([{GUESS}]) as c from w)
    select doc_id, case when any_value(length(text)) < 20 or max(c.n) = 0 then 'unknown' else arg_max(c.l, c.n * 100 + c.o) end as guess from c group by doc_id""")
def eda02_language_guess(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", classify.language_guess(F.col("text")).alias("guess"))


@query()
def scr02_stand_in_logits(spark, sf_dir):
    d = documents(spark, sf_dir).where("text is not null")
    model = classify.fit(d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"))
    return classify.logits(model, d, "doc_id")


PUBLIC = f"select sha256({N_TEXT}) as text_hash, doc_id % 2 as label, source, {SPLIT_SQL} as split from documents where doc_id % 10 < 8"


@query(f"""with p as ({PUBLIC}), s as (select distinct sha256({N_TEXT}) as text_hash, min(doc_id) over (partition by sha256({N_TEXT})) % 4 // 2 as label from documents where doc_id % 10 >= 8), f as (select * from s where text_hash not in (select text_hash from p)),
    h as (select least((floor(0.1 * (select count(*) from p where split = 'train') / (1 - 0.1))::bigint) // 2, (select count(*) from f where label = 0), (select count(*) from f where label = 1)) as half), k as (select *, row_number() over (partition by label order by sha256('42:' || text_hash)) as k from f)
    select text_hash, label, source, split from p union all select text_hash, label, 'synthetic_x', 'train' from k, h where k <= half""")
def cmp07_compose(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("text_hash", text.text_hash(text.normalize(F.col("text"))))
    old = F.pmod("doc_id", F.lit(10)) < 8
    public = d.where(old).select("text_hash", F.pmod("doc_id", F.lit(2)).alias("label"), "source", corpus.hash_split(d, "doc_id").alias("split"))
    extra = d.where(~old).groupBy("text_hash").agg(F.floor(F.pmod(F.min("doc_id"), F.lit(4)) / 2).alias("label")).withColumn("source", F.lit("synthetic_x"))
    return corpus.compose(public, extra)


@query("""select c_custkey, case when c_custkey % 3 = 0 then 'fail' when c_custkey % 2 = 0 then 'softfail' else 'pass' end as status, case when c_custkey % 3 = 0 then 'arc' when c_custkey % 2 = 0 then 'spf_header' else 'direct' end as source, 3 as n_results from customer""")
def rcv10_merged_results(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.lit(0).alias("ord"))
    k = F.col("c_custkey")
    return headers.merged_results(["c_custkey"], direct=c.withColumn("status", F.lit("pass")), arc=c.withColumn("status", F.when(k % 3 == 0, "fail").otherwise("pass")), spf_header=c.withColumn("status", F.when(k % 2 == 0, "softfail").otherwise("pass")))


@query("select c_custkey, case c_custkey % 4 when 0 then 'pass' when 1 then 'fail' when 2 then 'present' else 'none' end as shown from customer")
def rcv11_shown_status(spark, sf_dir):
    m = F.pmod("c_custkey", F.lit(4))
    none = F.lit(None).cast("string")
    return table(spark, sf_dir, "customer").select("c_custkey", headers.shown_status(F.when(m == 0, "pass"), F.when(m == 1, "fail").otherwise(""), none, none, m == 2).alias("shown"))


@query(rf"select c_custkey, [lower(regexp_extract(a, '@([\p{{L}}\p{{N}}_.\-]+)', 1)), lower(regexp_extract(b, '@([\p{{L}}\p{{N}}_.\-]+)', 1))] as domains from ({PARTS})")
def rcv12_sender_domains(spark, sf_dir):
    return senders(spark, sf_dir).select("c_custkey", headers.sender_domains(F.col("sender"), F.col("sender"), F.col("reply")).alias("domains"))


CLAIMS = [("PayPal", "mail.paypal.com", "verify_account"), ("paypal", "paypa1.com", "verify_account"), ("Netflix", "evil.com", "informational"), ("Acme", "evil.com", "pay_or_transfer")]


@query("select c_custkey, c_custkey % 4 = 1 as mismatch from customer")
def pol09_brand_mismatch(spark, sf_dir):
    row = F.element_at(F.array(*[F.struct(F.lit(a).alias("brand"), F.lit(b).alias("domain"), F.lit(c).alias("action")) for a, b, c in CLAIMS]), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", policy.brand_mismatch(row["brand"], row["domain"], row["action"]).alias("mismatch"))


SUMMARIES = ["The sender asks for a payment to a new account.", "Suspicious email with a link", "Too short", "The message is likely a phishing attempt by a stranger.", "It mentions SPF and asks to reply soon."]


@query("select c_custkey, c_custkey % 5 = 0 as usable from customer")
def pol20_summary_check(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", policy.usable_summary(F.element_at(F.array(*map(F.lit, SUMMARIES)), (F.pmod("c_custkey", F.lit(5)) + 1).cast("int"))).alias("usable"))


LETTERS = ["Gentile Mario Rossi, la sua fattura", "Dear Mr. Smith call +39 02 1234567", "write to a@b.com or https://x.y/z", "IBAN DE89370400440532013000 and 10.0.0.1"]


@query("select c_custkey, ['Gentile [PERSON], la sua fattura', 'Dear Mr. [PERSON][PHONE]', 'write to [EMAIL ADDRESS] or [URL LINK]', 'IBAN [IBAN] and [IP ADDRESS]'][c_custkey % 4 + 1] as masked from customer")
def norm07_anonymize(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", text.anonymize(F.element_at(F.array(*map(F.lit, LETTERS)), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))).alias("masked"))
