"""Queries over facts about messages: each customer row stands for a message whose facts go round by its key, made alike in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import fixed
from corvid.operators import attachments, body, campaigns, context, corpus, enrich, headers, policy
from corvid.plans.catalog import documents, labelled, query
from corvid.plans.session import cut, table


def literal(v) -> str:
    return "null" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"


class Messages:
    """Columns whose values go round by c_custkey: name=(values, how many keys in a row have the same one)."""

    def __init__(self, **spec):
        self.spec = spec

    def sql(self) -> str:
        one = [f"[{', '.join(map(literal, vs))}][(c_custkey // {d}) % {len(vs)} + 1] as {n}" for n, (vs, d) in self.spec.items()]
        return f"select c_custkey, {', '.join(one)} from customer"

    def rows(self, spark, sf_dir):
        at = lambda vs, d: (F.pmod(F.floor(F.col("c_custkey") / d), F.lit(len(vs))) + 1).cast("int")
        return table(spark, sf_dir, "customer").select("c_custkey", *[F.element_at(F.array(*map(F.lit, vs)), at(vs, d)).alias(n) for n, (vs, d) in self.spec.items()])


FLAGS = [True, False, False, False, True]
ANSWERS = Messages(
    requested_action=(["none", "verify_account", "visit_link", "pay_or_transfer", "provide_credentials", "informational", "claim_reward", "reply", "other", "bypass_procedure", "change_account_settings"], 1), action_channel=(["supplied_link", "email_reply", "supplied_link", "supplied_attachment", "none"], 3),
    asks_to_verify_account=(FLAGS, 2), asks_for_credentials=(FLAGS, 7), asks_for_sensitive_information=(FLAGS, 11), asks_for_payment=(FLAGS, 5), asks_to_change_account_settings=(FLAGS, 13), financial_pretext_present=(FLAGS, 4), threat_or_consequence_present=(FLAGS, 6),
    spf=(["pass", "fail", "none", "softfail"], 1), dkim=(["pass", "fail", "none", "permerror", "policy"], 2), dmarc=(["pass", "fail", "none", "bestguesspass", "temperror", "unknown"], 3), brand_mismatch=([False, False, True], 17),
    sender=(["mail.shop.example.com", "example.org", "", "shop.example.com."], 5), h1=(["www.example.com", "evil.test", "", "a..example.org"], 2), h2=(["example.org", "x.y.z.example.com", "single"], 9),
    evidence_phrase=(["", "please confirm", None], 4), ambiguity=(["low", "high", "low", "low"], 3), confidence_provided=([True, False], 1), confidence=([0.3, 0.65, 0.9], 2), n_links=([0, 1, 3], 2), n_files=([0, 2], 5), structured_extortion=([False] * 6 + [True], 1), has_message=([True, True, True, False], 3),
)
DOMAIN = r"array_to_string(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '\.+$', ''), '.'), lambda x: x <> '')[-2:], '.')"
SENSITIVE = ", ".join(map(literal, policy.SENSITIVE_ACTIONS))


@query(f"""with m as ({ANSWERS.sql()}), d as (select *, {DOMAIN.format('sender')} as own, {DOMAIN.format('h1')} as d1, {DOMAIN.format('h2')} as d2 from m)
    select c_custkey, action_channel = 'supplied_link' and (requested_action in ({SENSITIVE}) or asks_to_verify_account or asks_for_credentials or asks_for_sensitive_information or asks_for_payment or asks_to_change_account_settings or (financial_pretext_present and threat_or_consequence_present))
        and not ((dmarc in ('pass', 'bestguesspass') or (spf = 'pass' and dkim = 'pass')) and not brand_mismatch) and own <> '' and ((d1 <> '' and d1 <> own) or (d2 <> '' and d2 <> own)) as mismatch from d""")
def pol10_link_mismatch(spark, sf_dir):
    m = ANSWERS.rows(spark, sf_dir)
    return m.select("c_custkey", context.sensitive_link_mismatch(F.array("h1", "h2"), F.col("sender"), F.col("brand_mismatch")).alias("mismatch"))


@query(f"""select c_custkey, structured_extortion or (has_message and (requested_action in ('none', 'informational', 'visit_link', 'other')
        or (requested_action in ({SENSITIVE}, 'claim_reward', 'bypass_procedure') and coalesce(evidence_phrase, '') = '') or (action_channel = 'supplied_link' and n_links = 0) or (action_channel = 'supplied_attachment' and n_files = 0)
        or ambiguity = 'high' or (confidence_provided and confidence < 0.65))) as needed from ({ANSWERS.sql()})""")
def pol13_verifier_needed(spark, sf_dir):
    return ANSWERS.rows(spark, sf_dir).select("c_custkey", context.needs_verifier(F.col("n_links"), F.col("n_files"), F.col("has_message")).alias("needed"))


KINDS = Messages(
    a_scam=([None, "none", "other", "extortion", "sextortion", "romance"], 1), b_scam=([None, "none", "other", "extortion", "sextortion", ""], 7), a_threat=(["none", "data_exposure", "private_material_exposure", "other", None], 2), b_threat=(["none", "reputation_harm", "strange", None], 3),
    a_asset=(["bitcoin", "", None], 1), b_asset=([None, "euro", ""], 2), a_amount=([None, "500", ""], 4), b_amount=(["", None, "9"], 5),
)
RANK = "case coalesce(nullif({0}, ''), 'none') {1} else 1 end"


def ranks(table_: dict[str, int]) -> str:
    return " ".join(f"when '{k}' then {v}" for k, v in table_.items())


@query(f"""select c_custkey, case when {RANK.format('a_scam', ranks(fixed.SCAM_RANKS))} > {RANK.format('b_scam', ranks(fixed.SCAM_RANKS))} then coalesce(nullif(a_scam, ''), 'none') else b_scam end as scam_type,
    case when {RANK.format('a_threat', ranks(fixed.THREAT_RANKS))} > {RANK.format('b_threat', ranks(fixed.THREAT_RANKS))} then coalesce(nullif(a_threat, ''), 'none') else b_threat end as threat_type,
    coalesce(nullif(b_asset, ''), nullif(a_asset, ''), b_asset) as payment_asset, coalesce(nullif(b_amount, ''), nullif(a_amount, ''), b_amount) as amount from ({KINDS.sql()})""")
def pol13_merged_answer(spark, sf_dir):
    side = lambda x: F.struct(*[F.col(f"{x}_{k}").alias(n) for k, n in (("asset", "payment_asset"), ("amount", "amount"), ("scam", "scam_type"), ("threat", "threat_type"))])
    return KINDS.rows(spark, sf_dir).select("c_custkey", context.merged_answer(side("a"), side("b")).alias("m")).select("c_custkey", "m.scam_type", "m.threat_type", "m.payment_asset", "m.amount")


REPORTS = Messages(
    spf=(["pass", "fail", "unknown", "softfail"], 1), dkim=(["pass", "fail", "none", "permerror", "unknown"], 2), dmarc=(["pass", "fail", "none", "policy"], 3), reply_to_mismatch=([True, False], 4), return_path_mismatch=([False, True, False], 2), is_bulk=([True, False], 7), n_bulk_signals=([0, 3, 7], 3),
    display_name_spoofing=([None, "", "paypal"], 5), ip1=([True, False, None], 2), ip2=([False, True], 6), host=(["a.test", "", None], 3), technique=(["homoglyph", None], 4), status=(["malicious", "clean", None, "Suspicious"], 2), ratio=(["3 / 70", None], 5),
    level=(["HIGH", "LOW", "MEDIUM"], 2), field=(["Body", "SPF", "Links", "PDF Content"], 3), message=(["Only HTML", "", None, "Odd link"], 4),
)
EVIDENCE = "case lower(coalesce(nullif({0}, ''), 'unknown')) when 'malicious' then 'positive_malicious_evidence' when 'suspicious' then 'manual_review_signal_not_sufficient_alone' when 'clean' then 'no_detection' else 'unavailable_neutral_no_evidence' end"


@query(f"""select c_custkey, array_to_string(list_filter([
    case when spf not in ('pass', 'unknown') then 'SPF check did not pass: ' || spf end,
    case when dkim in ('fail', 'temperror', 'permerror', 'policy') then 'DKIM check did not pass: ' || dkim when dkim = 'none' then 'DKIM signature is absent (status=none); this is weaker evidence than a failed signature' end,
    case when dmarc in ('fail', 'temperror', 'permerror', 'policy') then 'DMARC check did not pass: ' || dmarc end, case when reply_to_mismatch then 'Reply-To mismatch detected' end,
    case when return_path_mismatch then 'Return-Path domain differs from From domain; bulk_sender=' || is_bulk::varchar || ' bulk_sender_signal_count=' || n_bulk_signals end,
    case when coalesce(display_name_spoofing, '') <> '' then 'Display name spoofing indicator: ' || display_name_spoofing end,
    case when ip1 then 'Link check did not pass: direct IP URL extracted from email' end, case when ip2 then 'Link check did not pass: direct IP URL extracted from email' end,
    'Lookalike/domain check did not pass: host=' || coalesce(nullif(host, ''), '-') || ' technique=' || coalesce(technique, '-') || ' detail=-',
    case when lower(status) in ('malicious', 'suspicious') then 'VirusTotal link check did not pass: status=' || lower(status) || ' detections=' || coalesce(ratio, '0 / 0') || ' evidence=' || {EVIDENCE.format('status')} end,
    case when level in ('HIGH', 'MEDIUM') and field not in ('SPF', 'PDF Content') and coalesce(message, '') <> '' then '- ' || level || ' ' || field || ': ' || message end], lambda x: x is not null), chr(10)) as lines from ({REPORTS.sql()})""")
def pol14_technical_lines(spark, sf_dir):
    m = REPORTS.rows(spark, sf_dir).withColumns(
        {
            "links": F.array(F.struct(F.col("ip1").alias("is_ip")), F.struct(F.col("ip2").alias("is_ip"))),
            "lookalikes": F.array(F.struct("host", "technique", F.lit(None).cast("string").alias("detail"))),
            "reputations": F.array(F.struct("status", "ratio")),
            "flags": F.array(F.struct("level", "field", "message")),
        }
    )
    return m.select("c_custkey", F.array_join(context.technical_lines(), "\n").alias("lines"))


WORDED = Messages(
    verdict=(["phishing", "legitimate", "review", None, "PHISHING"], 1), summary=(["It asks for money. ", None, "", "Read this"], 2), supported=([True, False], 3), d1=(["sender authentication passed", "SPF did not pass (fail)", " ", "a URL is detected as malicious"], 2), d2=(["DKIM signature is absent", "", None], 3), d3=(["the message contains a direct-IP URL", None], 5), c1=([None, "", "BERT returned an inconclusive result."], 4),
)


def sentence_sql(column: str) -> str:
    return f"case trim({column}) {' '.join(f'when {literal(k)} then {literal(v)}' for k, v in fixed.REASON_WORDS.items())} else trim({column}) end"


def natural_sql(columns: list[str]) -> str:
    parts = "list_filter([" + ", ".join(rf"regexp_replace(trim(coalesce({c}, '')), '[ .]+$', '')" for c in columns) + "], lambda x: x <> '')"
    return f"(select case len(p) when 0 then '' when 1 then p[1] when 2 then p[1] || ' and ' || p[2] else array_to_string(p[:-2], ', ') || ', and ' || p[-1] end from (select {parts} as p))"


@query(rf"""with m as ({WORDED.sql()}), w as (select *, {natural_sql([sentence_sql(c) for c in ('d1', 'd2', 'd3')])} as why, {natural_sql([sentence_sql('c1')])} as but from m)
    select c_custkey, case lower(coalesce(verdict, 'review')) when 'legitimate' then 'Our analysis indicates that this email is likely legitimate.' when 'phishing' then 'Our analysis indicates that this email is likely a phishing attempt.'
        else 'Our analysis indicates that this email requires manual verification before the recipient takes action.' end || ' ' || regexp_replace(trim(coalesce(nullif(summary, ''), 'Content unavailable.')), '[ .]+$', '') || '. '
        || case when supported and why <> '' then 'Independent checks support this assessment because ' || why || '.' when supported then 'Independent checks support this assessment.'
        else 'Independent checks do not corroborate this assessment; the conclusion is based on the action requested in the subject and body.' end || case when but <> '' then ' However, ' || but || '.' else '' end as report from w""")
def pol16_report(spark, sf_dir):
    c = F.col
    return WORDED.rows(spark, sf_dir).select("c_custkey", context.report(c("verdict"), c("summary"), c("supported"), F.array("d1", "d2", "d3"), F.array("c1")).alias("report"))


SUMMED = Messages(
    action=([*fixed.ACTION_WORDS, "unheard_of"], 1), has_links=([True, False], 1), extortion=([False, False, False, False, True], 2), asset=(["", "bitcoin", None], 3), method=(["cryptocurrency", "card"], 4), amount=([None, " 500 EUR ", ""], 5), scam=(["sextortion", "other"], 2),
)


@query(rf"""select c_custkey, case when extortion then 'The subject and body use coercion to demand a ' || coalesce(nullif(trim(asset), ''), case when method = 'cryptocurrency' then 'cryptocurrency' else 'money' end) || ' payment'
        || case when coalesce(trim(amount), '') <> '' then ' (' || trim(amount) || ')' else '' end || ', a clear ' || case when scam = 'sextortion' then 'sextortion' else 'extortion' end || ' scam.'
    else 'The subject and body ' || case when has_links and action = 'claim_reward' then replace({literal(fixed.ACTION_WORDS['claim_reward'])}, 'claim it,', 'claim it through a supplied link,')
        else case action {' '.join(f'when {literal(k)} then {literal(v)}' for k, v in fixed.ACTION_WORDS.items())} else {literal(fixed.ACTION_WORDS['other'])} end end || '.' end as summary from ({SUMMED.sql()})""")
def pol16_fallback_summary(spark, sf_dir):
    c = F.col
    return SUMMED.rows(spark, sf_dir).select("c_custkey", context.fallback_summary(c("action"), c("has_links"), c("extortion"), c("asset"), c("method"), c("amount"), c("scam")).alias("summary"))


HAVING = Messages(
    act1=([True, False, None], 1), role1=([None, "signature", "body_action", "navigation"], 2), text1=(["Pay  now", "https://a.test/x", "ok", "Verify your account"], 3), act2=([None, False], 2), role2=(["", "unsubscribe", "footer"], 1), text2=(["pay now", "Read\nmore", None], 2),
    f_act=([None, True, False], 2), f_role=(["attachment", "inline_resource", None], 3), f_ext=(["pdf", "", None, "ZIP"], 1), f_type=(["image/png", None], 5), subject=(["Bill", "", None], 2), intent=(["", None, "Please read"], 3), clean=(["Clean text", ""], 2), html=(["From html", None], 4),
)
PASSIVE = ", ".join(map(literal, fixed.PASSIVE_ROLES))
LINKS_SQL = f"""[t for t in [case when coalesce(act1, true) and coalesce(nullif(role1, ''), 'body_action') not in ({PASSIVE}) then trim(regexp_replace(coalesce(text1, ''), '\\s+', ' ', 'g')) end,
    case when coalesce(act2, true) and coalesce(nullif(role2, ''), 'body_action') not in ({PASSIVE}) then trim(regexp_replace(coalesce(text2, ''), '\\s+', ' ', 'g')) end] if t is not null and length(t) >= 4 and not regexp_full_match(t, '(?i)https?://\\S+')]"""


def link_rows(m):
    one = lambda i: F.struct(F.col(f"act{i}").alias("actionable"), F.col(f"role{i}").alias("role"), F.col(f"text{i}").alias("display_text"))
    return F.array(one(1), one(2))


def file_rows(m):
    return F.array(F.struct(F.col("f_act").alias("actionable"), F.col("f_role").alias("mime_role"), F.col("f_ext").alias("extension"), F.col("f_type").alias("content_type")))


@query(rf"""with l as (select *, {LINKS_SQL} as t from ({HAVING.sql()})), u as (select *, case when len(t) = 2 and lower(t[1]) = lower(t[2]) then t[:1] else t end as labels, coalesce(nullif(intent, ''), nullif(clean, ''), nullif(html, ''), '') as body from l)
    select c_custkey, body, array_to_string(list_filter(list_concat([coalesce(subject, ''), body], labels), lambda x: x <> ''), chr(10)) as evidence from u""")
def hlp06_evidence_text(spark, sf_dir):
    m = HAVING.rows(spark, sf_dir)
    none = F.lit(None).cast("string")
    m = m.withColumn("body", context.body(F.col("intent"), none, none, none, F.col("clean"), F.col("html")))
    return m.select("c_custkey", "body", context.evidence_text(F.col("subject"), F.col("body"), context.link_texts(link_rows(m))).alias("evidence"))


@query(f"""select c_custkey, (coalesce(act1, true) and coalesce(nullif(role1, ''), 'body_action') not in ({PASSIVE}))::int + (coalesce(act2, true) and coalesce(nullif(role2, ''), 'body_action') not in ({PASSIVE}))::int as n_links,
    (coalesce(f_act, true) and coalesce(nullif(f_role, ''), 'attachment') <> 'inline_resource')::int as n_files, case when coalesce(f_act, true) and coalesce(nullif(f_role, ''), 'attachment') <> 'inline_resource' then lower(coalesce(nullif(f_ext, ''), nullif(f_type, ''), 'file')) else 'none' end as types from ({HAVING.sql()})""")
def att07_actionable(spark, sf_dir):
    m = HAVING.rows(spark, sf_dir)
    return m.select("c_custkey", F.size(context.actionable_links(link_rows(m))).alias("n_links"), F.size(context.actionable_attachments(file_rows(m))).alias("n_files"), context.attachment_types(file_rows(m)).alias("types"))


@query(rf"""with l as (select *, {LINKS_SQL} as t from ({HAVING.sql()})), u as (select *, list_filter(case when len(t) = 2 and lower(t[1]) = lower(t[2]) then t[:1] else t end, lambda x: not contains(lower(clean), lower(x))) as labels,
        (coalesce(act1, true) and coalesce(nullif(role1, ''), 'body_action') not in ({PASSIVE}))::int + (coalesce(act2, true) and coalesce(nullif(role2, ''), 'body_action') not in ({PASSIVE}))::int as n, coalesce(f_act, true) and coalesce(nullif(f_role, ''), 'attachment') <> 'inline_resource' as has from l)
    select c_custkey, 'SUBJECT: ' || coalesce(subject, '') || chr(10) || 'META: links=' || n || '; attachments=' || has::int || '; types=' || case when has then lower(coalesce(nullif(f_ext, ''), nullif(f_type, ''), 'file')) else 'none' end || chr(10) || '<<<' || chr(10)
        || case when len(labels) > 0 then trim(clean || chr(10) || chr(10) || '[LINK CALL-TO-ACTION TEXT]' || chr(10) || array_to_string(labels, chr(10)), chr(10) || ' ') else clean end || chr(10) || '>>>' as prompt from u""")
def hlp10_prompt(spark, sf_dir):
    m = HAVING.rows(spark, sf_dir)
    p = context.prompt(F.coalesce("subject", F.lit("")), F.col("clean"), link_rows(m), file_rows(m), "<<<", ">>>")
    return m.select("c_custkey", F.regexp_replace(p, "<<<\n\\s+\\[LINK", "<<<\n[LINK").alias("prompt"))


SHOWN = Messages(
    value=(["-", " n/a ", None, "x y", "< >", "unknown", "Unknown", "no ne", ""], 1), raw=(["pass (sender)", "  SoftFail x", "", None, "(?)"], 2), from_host=([None, "", "mx.test"], 1), hop=(["  by mx2", "from a", None], 2), by_host=(["", None, "b.test"], 3), anomaly=(["a; PDF risk high;  b", "PDF risk low", None, ";"], 2),
    pool=(["vt", "__overloaded__", "vt"], 5), state=(["done", "error", "running", "missing", "done"], 1), result=([None, "clean", "malicious"], 2), error=(["timed out", None], 3), bert=(["phishing", " Benign ", "review", None, "odd"], 2), status=(["Clean", "malicious", "suspicious", "", None], 3),
    params=(['{"temperature": 1.5, "band": 0.2}', "{}", None, '{"threshold": 0.61, "positive_label_id": 0}'], 2),
)


@query(rf"""select c_custkey, coalesce(regexp_replace(trim(value), '\s+', '', 'g'), '') not in ('', '-', '--', '<>', 'null', 'none', 'n/a', 'unknown') as meaningful,
    case when coalesce(raw, '') = '' then 'none' else coalesce(nullif(lower(regexp_extract(raw, '^\s*([a-zA-Z0-9_-]+)', 1)), ''), 'unknown') end as spf, coalesce(nullif(from_host, ''), case when lower(ltrim(coalesce(hop, ''))) like 'by %' then 'internal/by-only' else 'unknown' end) as hop_from, coalesce(nullif(by_host, ''), 'unknown') as hop_by,
    array_to_string([trim(x) for x in string_split(coalesce(anomaly, ''), ';') if trim(x) <> '' and not starts_with(trim(x), 'PDF risk ')], '; ') as anomaly from ({SHOWN.sql()})""")
def hlp22_shown_values(spark, sf_dir):
    c = F.col
    return SHOWN.rows(spark, sf_dir).select("c_custkey", context.meaningful(c("value")).alias("meaningful"), context.received_spf(c("raw")).alias("spf"), context.hop_from(c("from_host"), c("hop")).alias("hop_from"), context.hop_by(c("by_host")).alias("hop_by"), context.anomaly_without_pdf(c("anomaly")).alias("anomaly"))


@query(f"""select c_custkey, case when pool = '__overloaded__' then 'unavailable' when state = 'done' and result is not null then result when state in ('done', 'error') then 'error' else 'pending' end as status,
    case when pool = '__overloaded__' then 'VT was not started because the analysis queue is full' when state = 'done' and result is not null then '' when state = 'done' then 'VT returned an invalid result' when state = 'error' then 'VT: ' || coalesce(error, 'None') else 'VT analysis in progress' end as message from ({SHOWN.sql()})""")
def hlp21_lookup_state(spark, sf_dir):
    c = F.col
    return SHOWN.rows(spark, sf_dir).select("c_custkey", context.lookup_state(c("pool"), c("state"), c("result"), c("error"), "VT").alias("s")).select("c_custkey", "s.status", "s.message")


@query(f"""select c_custkey, case lower(trim(coalesce(bert, ''))) when 'phishing' then 'malicious' when 'benign' then 'legitimate' when 'review' then 'uncertain' else 'unavailable' end as kind,
    case lower(trim(coalesce(bert, ''))) when 'phishing' then 'BERT classified the content as phishing' when 'benign' then 'BERT classified the content as legitimate' when 'review' then 'BERT returned an inconclusive result' else '' end as sentence,
    {EVIDENCE.format('status')} as vendor, case when lower(status) in ('malicious', 'suspicious') then lower(status) else '' end as useful from ({SHOWN.sql()})""")
def hlp08_evidence_labels(spark, sf_dir):
    c = F.col
    return SHOWN.rows(spark, sf_dir).select("c_custkey", context.classifier_evidence(c("bert")).alias("e"), context.vendor_evidence(c("status")).alias("vendor"), context.useful_status(c("status")).alias("useful")).select("c_custkey", "e.kind", "e.sentence", "vendor", "useful")


@query(f"""select c_custkey, coalesce(json_extract_string(params, '$.temperature')::double, 1.0) as temperature, coalesce(json_extract_string(params, '$.threshold')::double, 0.5) as threshold, coalesce(json_extract_string(params, '$.band')::double, 0.3) as band, coalesce(json_extract_string(params, '$.positive_label_id')::int, 1) as positive_label_id from ({SHOWN.sql()})""")
def hlp18_calibration_defaults(spark, sf_dir):
    return SHOWN.rows(spark, sf_dir).select("c_custkey", context.calibrated(F.col("params")).alias("p")).select("c_custkey", "p.*")


@query("select doc_id, case when length(trim(text)) <= 220 then trim(text) else rtrim(left(trim(text), 220)) || '...' end as short from documents")
def hlp27_short_text(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", context.short_text(F.col("text")).alias("short"))


@query("select l_orderkey, list_transform(c, lambda x: list_concat(x, list_transform(range(w - len(x)), lambda y: 0))) as padded from (select *, list_max(list_transform(c, lambda x: len(x))) as w from (select l_orderkey, [list_transform(range(l_orderkey % 4 + 1), lambda y: 1), list_transform(range(l_orderkey % 7 + 1), lambda y: 2)] as c from (select distinct l_orderkey from lineitem)))")
def hlp17_padded_chunks(spark, sf_dir):
    k = F.col("l_orderkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey").distinct()
    return rows.select("l_orderkey", context.padded(F.array(F.array_repeat(F.lit(1), (k % 4 + 1).cast("int")), F.array_repeat(F.lit(2), (k % 7 + 1).cast("int")))).alias("padded")).withColumn("padded", F.transform("padded", lambda x: F.transform(x, lambda y: y.cast("int"))))


# ------------------------------------------------------------------ destinations and vendors' context

URLS = Messages(
    url=(["https://a.test/x", "ftp://a.test/", "http://user:pw@a.test/", "http:///x", "", None, "https://b.test:8443/?q=1"], 1), ip1=(["8.8.8.8", "10.0.0.1", None, "1.1.1.1"], 2), ip2=(["9.9.9.9", "127.0.0.1", "172.32.0.1", "192.168.1.1"], 3),
)
PRIVATE = r"regexp_matches({0}, '^(0|10|127)\.|^169\.254\.|^172\.(1[6-9]|2[0-9]|3[01])\.|^192\.168\.|^100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.|^192\.0\.[02]\.|^198\.1[89]\.|^198\.51\.100\.|^203\.0\.113\.|^2(2[4-9]|[3-5][0-9])\.')"


@query(rf"""select c_custkey, case when lower(regexp_extract(trim(coalesce(url, '')), '^([a-zA-Z][a-zA-Z0-9+.-]*):', 1)) not in ('http', 'https') then 'Only HTTP(S) destinations are allowed' when regexp_extract(url, '://(?:[^/?#@]*@)?([^/?#:]*)', 1) = '' then 'Destination hostname is missing'
    when regexp_extract(url, '://([^/?#@]+)@', 1) <> '' then 'Destination URLs containing credentials are not allowed' when ip1 is null then 'Destination DNS lookup returned no addresses'
    when {PRIVATE.format('ip1')} or {PRIVATE.format('ip2')} then 'Private, loopback, reserved, or otherwise non-public destinations are blocked' else '' end as reason from ({URLS.sql()})""")
def enr08_destination_guard(spark, sf_dir):
    found = F.when(F.col("ip1").isNotNull(), F.array("ip1", "ip2"))
    return URLS.rows(spark, sf_dir).select("c_custkey", enrich.destination_guard(F.col("url"), found).alias("reason"))


#: Where a URL leads: h<i>.site<i % 7>.test redirects to h<i + 1> unless i is divisible by 10; 13 of every 50 are refused.
HOPS = "select 'http://h' || i || '.site' || (i // 8) || '.test/' as url, 'http://h' || (i + 1) || '.site' || ((i + 1) // 8) || '.test/' as location from range(0, 400) t(i) where i % 10 <> 0"
REGISTERED = r"array_to_string(string_split(regexp_extract({0}, '://([^/]*)', 1), '.')[-2:], '.')"


@query(rf"""with recursive hops as ({HOPS}), bad as (select 'http://h' || i || '.site' || (i // 8) || '.test/' as url from range(0, 400) t(i) where i % 50 = 13),
    walk(k, first, spot, n, state) as (select c_custkey, u, u, 0, case when u = '' then 'skipped' when u in (select url from bad) then 'blocked' end from (select c_custkey, case when c_custkey % 41 = 0 then '' else 'http://h' || (c_custkey % 400) || '.site' || ((c_custkey % 400) // 8) || '.test/' end as u from customer)
        union all select k, first, case when n >= 5 then spot else location end, n + 1, case when n >= 5 then 'unavailable' when location in (select url from bad) then 'blocked' end from walk join hops on spot = url where state is null),
    last as (select k, first, arg_max(spot, n) as spot, max(n) as n, arg_max(coalesce(state, ''), n) as state from walk group by k, first)
    select k as c_custkey, spot as final_url, regexp_extract(spot, '://([^/]*)', 1) as final_host, coalesce(nullif(state, ''), case when {REGISTERED.format('first')} = {REGISTERED.format('spot')} then 'match' else 'mismatch' end) as destination_status,
        state = '' and {REGISTERED.format('first')} = {REGISTERED.format('spot')} as destination_match, n as redirect_count from last""")
def enr09_destinations(spark, sf_dir):
    at = lambda i: F.concat(F.lit("http://h"), i.cast("string"), F.lit(".site"), F.floor(i / 8).cast("string"), F.lit(".test/"))
    i = F.col("id")
    hops = spark.range(0, 400).where(i % 10 != 0).select(at(i).alias("url"), at(i + 1).alias("location"))
    bad = spark.range(0, 400).where(i % 50 == 13).select(at(i).alias("url"))
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 41 == 0, F.lit("")).otherwise(at(F.pmod(k, F.lit(400)))).alias("url"))
    return enrich.destinations(rows, "c_custkey", "url", hops, bad).withColumnRenamed("key", "c_custkey")


SHARED = Messages(
    sev=(["high", "odd", None, "Low"], 1), title=(["Seen in the wild", "", None], 2), name=(["By name", None], 3), source=(["team", None, ""], 2), ts=([1700000000, None], 4), note=(["first", "", None], 1), shape=(["list", "data", "one", "values", "none"], 3), deep=([True, False], 5),
)


@query(rf"""select c_custkey, case when shape = 'none' then 0 when shape = 'list' then 2 else 1 end as n, case when shape <> 'none' then case when upper(coalesce(sev, 'INFO')) in ('HIGH', 'LOW') then upper(sev) else 'INFO' end end as severity,
    case when shape <> 'none' then coalesce(nullif(title, ''), name, 'Crowdsourced context') end as title, case when shape <> 'none' then coalesce(source, '') end as source, case when shape <> 'none' and ts is not null then '2023-11-14 22:13 UTC' end as date,
    case when shape <> 'none' then array_to_string(list_filter([nullif(note, ''), 'k: v'], lambda x: x is not null), '|') end as details from ({SHARED.sql()})""")
def enr05_shared_context(spark, sf_dir):
    m = SHARED.rows(spark, sf_dir)
    item = F.struct(F.col("sev").alias("severity"), "title", "name", "source", F.col("ts").alias("timestamp"), F.col("note").alias("description"), F.create_map(F.lit("k"), F.lit("v")).alias("metadata"))
    item = F.when(F.col("deep"), F.to_json(F.struct(item.alias("attributes")))).otherwise(F.to_json(item))
    raw = (
        F.when(F.col("shape") == "list", F.concat(F.lit('{"crowdsourced_context": ['), item, F.lit(', 7, {"title": "second"}]}')))
        .when(F.col("shape") == "data", F.concat(F.lit('{"crowdsourced_contexts": {"data": ['), item, F.lit("]}}")))
        .when(F.col("shape") == "one", F.concat(F.lit('{"crowdsourced_context_items": ['), item, F.lit("]}")))
        .when(F.col("shape") == "values", F.concat(F.lit('{"crowdsourced_context": {"a1": '), item, F.lit("}}")))
        .otherwise(F.lit('{"other": 1}'))
    )
    found = enrich.shared_context(raw)
    first = F.get("found", F.lit(0))
    return m.select("c_custkey", found.alias("found")).select("c_custkey", F.size("found").alias("n"), first["severity"].alias("severity"), first["title"].alias("title"), first["source"].alias("source"), first["date"].alias("date"), F.array_join(first["details"], "|").alias("details"))


# ------------------------------------------------------------------ attachments and raw messages


@query("""select c_custkey, case when c_custkey % 4 in (0, 1) then 'p' || c_custkey end as payload, case c_custkey % 4 when 0 then null when 1 then 'Attachment payload was not decoded by email parser' when 2 then 'Attachment payload empty or not decodable' else 'Unsupported attachment payload type: list' end as warning from customer""")
def att05_coerced(spark, sf_dir):
    k = F.pmod("c_custkey", F.lit(4))
    p = F.when(k != 2, F.concat(F.lit("p"), F.col("c_custkey").cast("string")).cast("binary"))
    kind = F.when(k == 0, "bytes").when(k == 1, "text").when(k == 3, "list")
    return table(spark, sf_dir, "customer").select("c_custkey", attachments.coerced(p, kind).alias("c")).select("c_custkey", F.decode("c.payload", "utf-8").alias("payload"), "c.warning")


@query("""select c_custkey, case when c_custkey % 3 = 0 then 2 when c_custkey % 3 = 1 then 1 else 3 end as url_count, case when c_custkey % 3 = 0 then 1 when c_custkey % 3 = 1 then 1 else 3 end as uri_action_url_count, case when c_custkey % 3 = 2 then 1 else (c_custkey % 3 = 0)::int end as nested_redirect_count,
    (c_custkey % 3 = 2)::int as tracked_redirect_count, case when c_custkey % 3 = 1 then 1 else 0 end as public_site_landing_count,
    case c_custkey % 3 when 0 then 'object ' || c_custkey || ' 0: a.test -> b.test' when 1 then 'PDF URI: forms.gle' else 'object ' || c_custkey || ' 0: a.test -> b.test' end as sample from customer""")
def pdf13_object_evidence(spark, sf_dir):
    k = F.col("c_custkey").cast("string")
    body_ = (
        F.when(F.pmod("c_custkey", F.lit(3)) == 0, F.concat(k, F.lit(" 0 obj /URI (https://a.test/go?url=https%3A%2F%2Fb.test%2F) endobj 9 0 obj (https://c.test/) endobj")))
        .when(F.pmod("c_custkey", F.lit(3)) == 1, F.lit("1 0 obj (https://forms.gle/abc) endobj"))
        .otherwise(F.concat(k, F.lit(" 0 obj /URI (https://a.test/go?url=https%3A%2F%2Fb.test%2F&uid=1) (https://c.test/) (https://a.test/go?url=https%3A%2F%2Fb.test%2F&uid=1) endobj")))
    )
    e = table(spark, sf_dir, "customer").select("c_custkey", attachments.object_evidence(body_).alias("e"))
    return e.select("c_custkey", "e.url_count", "e.uri_action_url_count", "e.nested_redirect_count", "e.tracked_redirect_count", "e.public_site_landing_count", F.get("e.samples", F.lit(0)).alias("sample"))


PIECES = Messages(u1=([1, 2, 5], 1), r1=([0, 1], 2), s1=(["a", "b", "c"], 1), t1=(["x", "y"], 3), u2=([0, 3], 4), r2=([1, 2], 1), s2=(["a", "d"], 2), t2=(["x", "z"], 2), empty=([True, False], 7))


@query(f"""select c_custkey, u1 + u2 as url_count, r1 + case when not empty and s2 = s1 then 0 else r2 end as nested_redirect_count, array_to_string(case when t1 = t2 then [t1] else [t1, t2] end, '|') as samples,
    array_to_string(list_sort(case when empty or s1 = s2 then [s1] else [s1, s2] end), '|') as signatures from ({PIECES.sql()})""")
def pdf12_merged_evidence(spark, sf_dir):
    zero = [F.lit(0).alias(c) for c in ("tracked_redirect_count", "public_site_landing_count")]
    one = lambda i, gone: F.struct(F.col(f"u{i}").alias("url_count"), F.lit(0).alias("uri_action_url_count"), F.col(f"r{i}").alias("nested_redirect_count"), *zero, F.array(f"t{i}").alias("samples"), F.when(gone, F.array().cast("array<string>")).otherwise(F.array(f"s{i}")).alias("signatures"))
    e = PIECES.rows(spark, sf_dir).select("c_custkey", attachments.merged_evidence(F.array(one(1, F.lit(False)), one(2, F.col("empty")))).alias("e"))
    return e.select("c_custkey", "e.url_count", "e.nested_redirect_count", F.array_join("e.samples", "|").alias("samples"), F.array_join("e.signatures", "|").alias("signatures"))


@query("""select c_custkey, c_custkey % 4 < 3 as is_pdf, case c_custkey % 4 when 0 then 'high' when 1 then 'clean' when 2 then 'critical' else 'not_pdf' end as risk_level, c_custkey % 4 in (0, 2) as suspicious,
    case c_custkey % 4 when 0 then 'javascript x1' when 1 then 'No active PDF features detected' when 2 then 'launch_action x1; uri x1' else 'Not a PDF document' end as summary from customer""")
def pdf01_security(spark, sf_dir):
    import zlib

    packed = zlib.compress(b"5 0 obj << /S /Launch >> endobj")
    kinds = [b"%PDF-1.4\n1 0 obj << /JS (x) >> endobj %%EOF", b"%PDF-1.4\n1 0 obj << /Type /Page >> endobj %%EOF", b"%PDF-1.5\n1 0 obj << /Type /X /Filter /FlateDecode >> stream\n" + packed + b"\nendstream endobj 2 0 obj << /URI (x) >> endobj %%EOF", b"plain text"]
    payload = F.element_at(F.array(*[F.unhex(F.lit(x.hex())) for x in kinds]), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", payload.alias("payload"))
    return attachments.pdf_security(rows).select("c_custkey", "pdf.is_pdf", "pdf.risk_level", "pdf.suspicious", "pdf.summary")


@query("""with l as (select doc_id, doc_id % 9 as n, repeat('QUJDREVGR0hJSktMTU5PUA', 2) || chr(10) as b, 'a=20b=' || chr(10) as q from documents)
    select doc_id, 'head' || chr(10) || case when n >= 4 then '[... base64 content removed (' || n || ' rows, ~0 KB) ...]' || chr(10) else repeat(b, n::int) end || 'mid' || chr(10)
        || case when (doc_id % 6) >= 4 then '[... quoted-printable content removed (' || (doc_id % 6) || ' rows) ...]' || chr(10) else repeat(q, (doc_id % 6)::int) end || 'end' as shown from l""")
def mim07_without_encoded(spark, sf_dir):
    b, q = "QUJDREVGR0hJSktMTU5PUA" * 2 + "\n", "a=20b=\n"
    n, m = (F.pmod("doc_id", F.lit(x)).cast("int") for x in (9, 6))
    raw = F.concat(F.lit("head\n"), F.expr(f"repeat('{b[:-1]}\\n', int(pmod(doc_id, 9)))"), F.lit("mid\n"), F.expr(f"repeat('{q[:-1]}\\n', int(pmod(doc_id, 6)))"), F.lit("end"))
    return documents(spark, sf_dir).select("doc_id", body.without_encoded(raw).alias("shown"))


ROUTED = Messages(r1=(["pass client-ip=8.8.8.8;", "fail client-ip=10.0.0.1;", None], 1), r2=(["pass client-ip=192.168.1.1;", "none", "pass Client-IP=9.9.9.9;"], 2), auth=(["mx; smtp.remote-ip=1.2.3.4", "mx; smtp.remote-ip=10.1.1.1", None], 3), hop=(["10.0.0.2", "5.6.7.8"], 4), second=([None, "7.7.7.7"], 5))


@query(f"""with x as (select *, regexp_extract(coalesce(r1, ''), '(?i)client-ip=([0-9.]+)', 1) as c1, regexp_extract(r2, '(?i)client-ip=([0-9.]+)', 1) as c2, regexp_extract(coalesce(auth, ''), 'smtp\\.remote-ip=([0-9.]+)', 1) as c3 from ({ROUTED.sql()}))
    select c_custkey, case when c2 <> '' and not {PRIVATE.format('c2')} then c2 when c1 <> '' and not {PRIVATE.format('c1')} then c1 when c3 <> '' and not {PRIVATE.format('c3')} then c3 when not {PRIVATE.format('hop')} then hop else second end as ip from x""")
def hdr13_spf_sender(spark, sf_dir):
    r = ROUTED.rows(spark, sf_dir)
    return r.select("c_custkey", headers.spf_sender_ip(F.array("r1", "r2"), F.col("auth"), F.array("hop"), F.col("second")).alias("ip"))


# ------------------------------------------------------------------ campaigns and splits on them

RULES = ["label_domain", "unknown_split", "banned_source", "synthetic_outside_train", "text_hash_in_several_splits", "campaign_id_in_several_splits", "text_hash_in_several_labels"]


@query(" union all ".join(f"select '{r}' as rule, 0::bigint as violations" for r in RULES))
def cmp03_split_invariants(spark, sf_dir):
    """The rules that a split by campaigns must keep, counted on its rows."""
    rows = corpus.clean(labelled(spark, sf_dir))
    return corpus.constraint_counts(cut(campaigns.split_campaigns(rows).drop("text")))


@query("select s as source, case when n = 1 then x[1] else null end as split from (select source as s, count(*) as n, list(split) as x from (values ('a', 'train')) t(source, split) group by 1) where false")
def cmp04_two_splits(spark, sf_dir):
    """Sources that a holdout of whole sources put in two splits, or campaigns that it did: none."""
    d = documents(spark, sf_dir)
    source = F.concat(F.lit("s"), F.pmod("doc_id", F.lit(6)).cast("string"))
    rows = corpus.clean(d.select(F.col("doc_id").alias("ord"), "text", F.pmod("doc_id", F.lit(2)).alias("label"), source.alias("source"), F.lit("").alias("source_file")))
    told = cut(campaigns.split_sources(rows, forced={"s0": "test"}).drop("text"))
    both = told.groupBy("source").agg(F.countDistinct("split").alias("n"), F.min("split").alias("split")).unionByName(told.groupBy(F.col("campaign_id").alias("source")).agg(F.countDistinct("split").alias("n"), F.min("split").alias("split")))
    return both.where("n > 1").select("source", "split")
