"""The verdict policy: three risks from facts about a message, and the verdict that they make. Rules are data: (condition, reason)."""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what a message may ask for, and by which way
ACTIONS = ["none", "informational", "visit_link", "open_attachment", "reply", "provide_information", "provide_credentials", "pay_or_transfer", "change_account_settings", "verify_account", "claim_reward", "bypass_procedure", "other"]
CHANNELS = ["none", "normal_known_procedure", "supplied_link", "external_form", "supplied_attachment", "email_reply", "phone_or_other", "unclear"]
ACTION_ALIASES = {"info": "informational", "payment": "pay_or_transfer", "change_settings": "change_account_settings", "bypass": "bypass_procedure"}
CHANNEL_ALIASES = {"known_procedure": "normal_known_procedure", "link": "supplied_link", "form": "external_form", "attachment": "supplied_attachment", "reply": "email_reply", "phone": "phone_or_other"}
SUPPLIED = ["supplied_link", "external_form", "supplied_attachment"]
HARMLESS = ["none", "informational", "other"]


def enum(value: Column, allowed: list[str], default: str, aliases: dict[str, str] | None = None) -> Column:
    """A model's word as one of the allowed ones, else the default."""
    v = F.translate(F.lower(F.trim(F.coalesce(value, F.lit("")))), "- ", "__")
    for short, full in (aliases or {}).items():
        v = F.when(v == short, full).otherwise(v)
    return F.when(v.isin(allowed), v).otherwise(default)


def truth(value: Column) -> Column:
    return F.lower(F.trim(F.coalesce(value.cast("string"), F.lit("")))).isin("1", "true", "yes", "y")


def confidence(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.cast("string").try_cast("double"), F.lit(0.5))))


BOOLEANS = ["asks_to_click_link", "asks_to_open_attachment", "asks_for_credentials", "asks_for_sensitive_information", "asks_for_payment", "asks_to_change_account_settings", "asks_to_verify_account", "asks_to_claim_reward", "asks_to_bypass_procedure", "impersonation_or_deception", "structured_extortion", "urgency_present", "financial_pretext_present", "financial_incentive_present", "threat_or_consequence_present"]


def facts(answer: Column) -> list[Column]:
    """The typed facts of a model's JSON answer, whatever it holds."""
    get = lambda k: F.get_json_object(answer, f"$.{k}")
    return [enum(get("requested_action"), ACTIONS, "none", ACTION_ALIASES).alias("requested_action"), enum(get("action_channel"), CHANNELS, "unclear", CHANNEL_ALIASES).alias("action_channel"), confidence(get("confidence")).alias("confidence"), F.coalesce(get("evidence_phrase"), F.lit("")).alias("evidence_phrase"), *[truth(get(b)).alias(b) for b in BOOLEANS]]


def correlated(rows: DataFrame) -> DataFrame:
    """Facts held against what the message has (n_links, n_attachments): a way or an act that it cannot offer is taken back, and an act without a quotation is doubted."""
    no_link, no_file = F.col("n_links") == 0, F.col("n_attachments") == 0
    action, channel = F.col("requested_action"), F.col("action_channel")
    lost = ((action == "visit_link") & no_link) | ((action == "open_attachment") & no_file)
    unclear = ((channel == "supplied_link") & no_link) | ((channel == "supplied_attachment") & no_file)
    phrase = F.when(lost, "").otherwise(F.col("evidence_phrase"))
    groundless = ~action.isin(HARMLESS) & (phrase == "")
    return rows.withColumns(
        {
            "requested_action": F.when(lost, "informational").otherwise(action),
            "action_channel": F.when(lost, "none").when(unclear, "unclear").otherwise(channel),
            "evidence_phrase": phrase,
            "ambiguity": F.when(lost | unclear | groundless, "high").otherwise(F.lit("low")),
            "confidence": F.when(groundless, F.least("confidence", F.lit(0.49))).otherwise(F.col("confidence")),
            "asks_to_click_link": (F.col("asks_to_click_link") | (channel == "supplied_link")) & ~((channel == "supplied_link") & no_link) & ~((action == "visit_link") & no_link),
            "asks_to_open_attachment": (F.col("asks_to_open_attachment") | (channel == "supplied_attachment")) & ~((channel == "supplied_attachment") & no_file) & ~((action == "open_attachment") & no_file),
            "urgency_targets_risky_action": F.col("urgency_present") & ~action.isin(HARMLESS),
        }
    )


def reasons(rules: list[tuple[Column, str]]) -> Column:
    return F.filter(F.array(*[F.when(c, name) for c, name in rules]), lambda x: x.isNotNull())


def content_risk(c=F.col) -> Column:
    """(risk, reasons) of correlated facts: malicious by the first rule that holds, suspicious by any of the others, else benign."""
    channel, action = c("action_channel"), c("requested_action")
    supplied = channel.isin([*SUPPLIED, "email_reply"]) | c("asks_to_click_link") | c("asks_to_open_attachment")
    sensitive = c("asks_for_sensitive_information") | c("asks_for_payment")
    settings = c("asks_to_change_account_settings") & supplied
    worst = [
        (c("structured_extortion") & c("asks_for_payment"), "extortion"),
        (c("asks_for_credentials") & ((action == "provide_credentials") | supplied) & (channel != "normal_known_procedure"), "credentials_requested"),
        (c("asks_to_bypass_procedure"), "procedure_bypassed"),
        (c("impersonation_or_deception") & (sensitive | settings), "deceptive_sensitive_request"),
    ]
    doubtful = [
        (c("asks_for_payment"), "payment_requested"),
        (c("asks_for_sensitive_information"), "sensitive_information_requested"),
        (settings, "settings_change_by_supplied_channel"),
        (((action == "verify_account") | c("asks_to_verify_account")) & supplied, "verification_by_supplied_channel"),
        (((action == "claim_reward") | c("asks_to_claim_reward")) & supplied, "reward_by_supplied_channel"),
        (c("urgency_targets_risky_action") & (supplied | sensitive), "urgent_risky_action"),
        (c("financial_pretext_present") & c("threat_or_consequence_present") & supplied, "debt_with_threat"),
        (c("financial_incentive_present") & c("urgency_present") & supplied, "incentive_with_urgency"),
    ]
    first, more = F.slice(reasons(worst), 1, 1), reasons(doubtful)
    return F.when(F.size(first) > 0, F.struct(F.lit("malicious").alias("risk"), first.alias("reasons"))).when(F.size(more) > 0, F.struct(F.lit("suspicious").alias("risk"), more.alias("reasons"))).otherwise(F.struct(F.lit("benign").alias("risk"), F.array().cast("array<string>").alias("reasons")))


NOT_PASSED = ["fail", "temperror", "permerror", "policy", "softfail", "neutral"]


def identity_risk(c=F.col) -> Column:
    """spoofing_evidence, verified or uncertain, from (display_name_spoofing, reply_to_mismatch, brand_mismatch, spf, dkim, dmarc). A failed check alone is no evidence of spoofing."""
    passed = c("dmarc").isin("pass", "bestguesspass") | ((c("spf") == "pass") & (c("dkim") == "pass"))
    return F.when(c("display_name_spoofing") | c("reply_to_mismatch") | c("brand_mismatch"), "spoofing_evidence").when(passed, "verified").otherwise("uncertain")


def technical_risk(c=F.col) -> Column:
    """malicious, uncertain or clean, from the worst reputations (link, file, hop, domain), PDF risk, and (anomaly, ip_link, lookalike, link_mismatch)."""
    seen = [c(k) for k in ("link_status", "file_status", "hop_status", "domain_status")]
    has = lambda v: F.coalesce(seen[0] == v, F.lit(False)) | F.coalesce(seen[1] == v, F.lit(False)) | F.coalesce(seen[2] == v, F.lit(False)) | F.coalesce(seen[3] == v, F.lit(False))
    return F.when(has("malicious") | F.coalesce(c("pdf_risk").isin("high", "critical"), F.lit(False)), "malicious").when(has("suspicious") | F.coalesce(c("pdf_risk") == "medium", F.lit(False)) | c("anomaly") | c("ip_link") | c("lookalike") | c("link_mismatch"), "uncertain").otherwise("clean")


def verdict(content: Column, identity: Column, technical: Column, classifier: Column, channel: Column) -> Column:
    """phishing, review or legitimate. Weak evidence needs another axis to bear it out; failed authentication alone is never phishing."""
    supplied = channel.isin(SUPPLIED)
    says = F.coalesce(classifier.isin("phishing", "malicious"), F.lit(False)) & supplied
    return (
        F.when((technical == "malicious") | (content == "malicious"), "phishing")
        .when((content == "suspicious") & ((identity == "spoofing_evidence") | (technical == "uncertain")), "phishing")
        .when(says & identity.isin("uncertain", "spoofing_evidence"), "phishing")
        .when(says | (content == "suspicious") | (identity == "spoofing_evidence") | (technical == "uncertain"), "review")
        .otherwise("legitimate")
    )


def alike(least: float):
    """A test of (quote, text): whether a passage of text has a ratio of least to quote: as many whole words, or as many characters from anywhere.

    A passage of n characters with a ratio of r has m >= n r characters in common with the quotation, in at most
    2 (n - m) + 1 runs, so that m - runs of its neighbouring pairs are the quotation's; only passages with as many are compared.

    The test is a closure, which Spark ships by value: workers need not find this package.
    """

    def test(quote: str, text: str) -> bool:
        near = difflib.SequenceMatcher(None, quote, "", autojunk=False)

        def fits(passage):
            near.set_seq2(passage)
            return near.real_quick_ratio() >= least and near.quick_ratio() >= least and near.ratio() >= least

        n = len(quote)
        if n >= len(text):
            if fits(text):
                return True
        else:
            points = lambda x: np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            pairs = lambda x: x[:-1] << 21 | x[1:]
            same = np.concatenate([[0], np.cumsum(np.isin(pairs(points(text)), pairs(points(quote))))])
            shared = same[n - 1 :] - same[: len(same) - n + 1]
            common = math.ceil(least * n - 1e-9)
            found = np.flatnonzero(shared >= common - 2 * (n - common) - 1)
            if any(fits(text[i : i + n]) for i in found[np.argsort(-shared[found], kind="stable")].tolist()):
                return True
        words, size = text.split(), len(quote.split())
        return any(fits(" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1)))

    return test


def grounded(evidence: Column, message: Column, least: float = 0.82) -> Column:
    """Whether a quotation stands in a message, apart from case and spaces; if not, whether a passage of its length is alike enough."""

    test = alike(least)

    @F.pandas_udf("boolean")
    def run(pairs: pd.DataFrame) -> pd.Series:
        return pd.Series([bool(q) and bool(t) and test(q, t) for q, t in zip(pairs["q"], pairs["t"], strict=True)])

    # upper case first: ß is ss then, as it is in a quotation in capitals. A last sigma is one like others; besides, Spark takes lower(upper(x)) for lower(x)
    plain = lambda x: F.lower(F.replace(F.upper(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))), F.lit("Σ"), F.lit("σ")))
    q, t = plain(evidence), plain(message)
    found = (q != "") & F.contains(t, q)
    # only quotations that aren't found as they are go to Python
    return found | run(F.struct(F.when(found, "").otherwise(q).alias("q"), F.when(found, "").otherwise(t).alias("t")))


def best_candidate(rows: DataFrame, key: str) -> DataFrame:
    """Of each message's section candidates (section, score, …) the one with the greatest score, the first at a tie. One aggregation."""
    rest = [c for c in rows.columns if c not in (key, "score", "section")]
    top = F.max(F.struct("score", (-F.col("section")).alias("back"), *rest)).alias("top")
    return rows.groupBy(key).agg(top).select(key, (-F.col("top.back")).alias("section"), "top.score", *[F.col(f"top.{c}").alias(c) for c in rest])


# fixed values: brands with the domains that are theirs, acts that need them, and what a summary may not say
BRAND_DOMAINS = {"iCloud": ["apple.com", "icloud.com"], "Trust Wallet": ["trustwallet.com"], "Microsoft": ["microsoft.com"], "PayPal": ["paypal.com"], "Netflix": ["netflix.com"]}
SENSITIVE_ACTIONS = ["provide_credentials", "provide_information", "pay_or_transfer", "verify_account", "change_account_settings"]
BAD_STARTS = ["untrusted email", "suspicious email", "potential phishing", "possible phishing"]
BAD_WORDS = ["official portal", "certified portal", "if intercepted", "could be intercepted", "bert", "virustotal", "abuseipdb", "spf", "dkim", "dmarc", "technical checks", "sender is authenticated", "authentication checks"]


def brand_mismatch(brand: Column, domain: Column, action: Column) -> Column:
    """Whether a message that asks for something sensitive claims a known brand from a domain that is not the brand's."""
    out = F.lit(False)
    for name, owned in BRAND_DOMAINS.items():
        own = F.lit(False)
        for d in owned:
            own = own | (domain == d) | domain.endswith("." + d)
        out = out | ((F.lower(F.trim(brand)) == name.lower()) & ~own)
    return F.coalesce(action.isin(SENSITIVE_ACTIONS) & (domain != "") & out, F.lit(False))


def usable_summary(value: Column) -> Column:
    """Whether a model's summary says what a message asks for, in 4 to 35 words, without a verdict or technical checks."""
    s = F.lower(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " ")))
    bad = s.rlike("^(?:" + "|".join(BAD_STARTS) + ")") | s.rlike("|".join(BAD_WORDS)) | s.rlike(r"\b(?:email|message|it|this)\s+(?:is|appears|seems|looks|is likely)\s+(?:to\s+be\s+)?(?:a\s+)?(?:legitimate|phishing(?:\s+attempt)?)\b")
    return (s != "") & ~bad & F.size(F.split(s, " ")).between(4, 35)
