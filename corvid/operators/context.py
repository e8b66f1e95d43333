"""What a model is told about a message, what its answer is held against, and how a verdict is put into words. All of it is column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvid.functions import fixed, text
from corvid.operators import policy

def filled(value: Column) -> Column:
    """value, or null if it is empty."""
    return F.nullif(value, F.lit(""))


# ------------------------------------------------------------------ what a message has


def actionable_links(links: Column) -> Column:
    """Links (struct with actionable, role) that may be asked to be followed: not those marked otherwise, nor signatures', unsubscribe or navigation links."""
    return F.filter(links, lambda x: F.coalesce(x["actionable"], F.lit(True)) & ~F.coalesce(filled(x["role"]), F.lit("body_action")).isin(fixed.PASSIVE_ROLES))


def actionable_attachments(files: Column) -> Column:
    """Attachments (struct with actionable, mime_role) without those marked otherwise and inline resources."""
    return F.filter(files, lambda x: F.coalesce(x["actionable"], F.lit(True)) & (F.coalesce(filled(x["mime_role"]), F.lit("attachment")) != "inline_resource"))


def link_texts(links: Column, most: int = 8) -> Column:
    """The first different labels of actionable links, of 4 characters or more and not URLs themselves; case does not tell them apart. Compatibility forms (NFKC) stay: labels are elements of an array, which Python functions don't take."""
    shown = F.transform(actionable_links(links), lambda x: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(x["display_text"], F.lit("")), r"[\p{Cf}\x{FE00}-\x{FE0F}\x{E0100}-\x{E01EF}]", ""), r"(?U)\s+", " ")))
    good = F.filter(shown, lambda x: (F.length(x) >= 4) & ~x.rlike(r"(?i)^https?://\S+$"))
    lower = F.transform(good, lambda x: F.lower(x))
    return F.slice(F.filter(good, lambda x, i: F.array_position(lower, F.lower(x)) == i + 1), 1, most)


def body(intent: Column, ai: Column, body_ai: Column, extracted: Column, clean: Column, html: Column) -> Column:
    """The first body that isn't empty; the text of the HTML part comes last."""
    return F.coalesce(*[filled(c) for c in (intent, ai, body_ai, extracted, clean, html)], F.lit(""))


def evidence_text(subject: Column, message: Column, labels: Column) -> Column:
    """Subject, body and link labels, a line each: what a quotation must stand in."""
    return F.array_join(F.filter(F.concat(F.array(F.coalesce(subject, F.lit("")), F.coalesce(message, F.lit(""))), labels), lambda x: x != ""), "\n")


def attachment_types(files: Column, most: int = 3) -> Column:
    """The first few different types of actionable attachments in order, joined by commas; `none` without any."""
    kinds = F.transform(actionable_attachments(files), lambda x: F.lower(F.coalesce(filled(x["extension"]), filled(x["content_type"]), F.lit("file"))))
    return F.coalesce(filled(F.array_join(F.slice(F.array_sort(F.array_distinct(kinds)), 1, most), ",")), F.lit("none"))


def prompt(subject: Column, message: Column, links: Column, files: Column, begin: str, end: str, section: Column | None = None, total: Column | None = None) -> Column:
    """A model's input: subject (240 characters at most), what the message has, and the text between two marks. Labels that the body lacks follow it."""
    known = F.lower(text.collapse(message))
    more = F.array_join(F.filter(link_texts(links), lambda x: ~F.contains(known, F.lower(x))), "\n")
    whole = F.when(more != "", F.trim(F.concat(message, F.lit("\n\n[LINK CALL-TO-ACTION TEXT]\n"), more))).otherwise(message)
    n = lambda a: F.size(a).cast("string")
    part = F.when(total > 1, F.concat(F.lit("; section="), section.cast("string"), F.lit("/"), total.cast("string"))).otherwise(F.lit("")) if total is not None else F.lit("")
    meta = F.concat(F.lit("META: links="), n(actionable_links(links)), F.lit("; attachments="), n(actionable_attachments(files)), F.lit("; types="), attachment_types(files), part)
    return F.concat_ws("\n", F.concat(F.lit("SUBJECT: "), text.clip(subject, 240)), meta, F.lit(begin), whole, F.lit(end))


# ------------------------------------------------------------------ checks of an answer


def labels_domain(host: Column) -> Column:
    """The last two labels of a host that aren't empty, or the only one, or nothing."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(host, F.lit(""))), r"\.+$", ""), r"\."), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), 2), ".")


def sensitive_link_mismatch(hosts: Column, sender: Column, brand_mismatch: Column, c=F.col) -> Column:
    """Whether a sensitive request goes by a link whose registered domain isn't the sender's, and the sender isn't verified (or claims another's brand).

    hosts: of the actionable links; sender: the sender's domain; facts and spf, dkim, dmarc by c.
    """
    asks = c("requested_action").isin(policy.SENSITIVE_ACTIONS) | c("asks_to_verify_account") | c("asks_for_credentials") | c("asks_for_sensitive_information") | c("asks_for_payment") | c("asks_to_change_account_settings") | (c("financial_pretext_present") & c("threat_or_consequence_present"))
    verified = F.coalesce(c("dmarc").isin("pass", "bestguesspass"), F.lit(False)) | F.coalesce((c("spf") == "pass") & (c("dkim") == "pass"), F.lit(False))
    own = labels_domain(sender)
    other = F.exists(hosts, lambda h: (labels_domain(h) != "") & (labels_domain(h) != own))
    return F.coalesce((c("action_channel") == "supplied_link") & asks & ~(verified & ~brand_mismatch) & (own != "") & other, F.lit(False))


def needs_verifier(n_links: Column, n_files: Column, has_message: Column, c=F.col) -> Column:
    """Whether a second, narrower question is due: extortion; or of a message with text, a generic act, a sensitive one without a quotation, a way that the message hasn't, or doubt."""
    action, channel = c("requested_action"), c("action_channel")
    generic = action.isin("none", "informational", "visit_link", "other")
    bare = action.isin(*policy.SENSITIVE_ACTIONS, "claim_reward", "bypass_procedure") & (F.coalesce(c("evidence_phrase"), F.lit("")) == "")
    impossible = ((channel == "supplied_link") & (n_links == 0)) | ((channel == "supplied_attachment") & (n_files == 0))
    doubt = (c("ambiguity") == "high") | (c("confidence_provided") & (c("confidence") < 0.65))
    return F.coalesce(c("structured_extortion"), F.lit(False)) | (has_message & (generic | bare | impossible | F.coalesce(doubt, F.lit(False))))


def specific(first: Column, second: Column, ranks: dict[str, int]) -> Column:
    """The more specific of two answers by ranks (1 for others), the second at a tie."""
    rank = lambda v: F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv]), v), F.lit(1))
    a, b = (F.coalesce(filled(v), F.lit("none")) for v in (first, second))
    return F.when(rank(a) > rank(b), a).otherwise(second)


def merged_answer(primary: Column, targeted: Column) -> Column:
    """The second answer (payment_asset, amount, scam_type, threat_type), with what only the first tells, and the more specific kinds."""
    both = lambda k: F.coalesce(filled(targeted[k]), filled(primary[k]), targeted[k]).alias(k)
    return F.struct(both("payment_asset"), both("amount"), specific(primary["scam_type"], targeted["scam_type"], fixed.SCAM_RANKS).alias("scam_type"), specific(primary["threat_type"], targeted["threat_type"], fixed.THREAT_RANKS).alias("threat_type"))


def classifier_evidence(result: Column) -> Column:
    """(kind, sentence) of a classifier's result."""
    r = F.lower(F.trim(F.coalesce(result, F.lit(""))))
    said = lambda kind, sentence: F.struct(F.lit(kind).alias("kind"), F.lit(sentence).alias("sentence"))
    return F.when(r.isin("phishing", "malicious"), said("malicious", "BERT classified the content as phishing")).when(r.isin("legitimate", "benign"), said("legitimate", "BERT classified the content as legitimate")).when(r.isin("uncertain", "inconclusive", "review"), said("uncertain", "BERT returned an inconclusive result")).otherwise(said("unavailable", ""))


def vendor_evidence(status: Column) -> Column:
    s = F.lower(F.coalesce(filled(status), F.lit("unknown")))
    return F.when(s == "malicious", "positive_malicious_evidence").when(s == "suspicious", "manual_review_signal_not_sufficient_alone").when(s == "clean", "no_detection").otherwise("unavailable_neutral_no_evidence")


def useful_status(status: Column) -> Column:
    s = F.lower(F.coalesce(status, F.lit("")))
    return F.when(s.isin("malicious", "suspicious"), s).otherwise("")


def technical_lines(c=F.col) -> Column:
    """What did not pass, a line each, in order: authentication, identity, links with an IP, lookalikes (host, technique, detail), vendors' verdicts (status, ratio), and flags (level, field, message) that no line above has."""
    failed = ["fail", "temperror", "permerror", "policy"]
    auth = lambda name, s: F.concat(F.lit(f"{name} check did not pass: "), s)
    low = lambda b: b.cast("string")
    or_dash = lambda v: F.coalesce(filled(v), F.lit("-"))
    first = F.array(
        F.when(~c("spf").isin("pass", "unknown"), auth("SPF", c("spf"))),
        F.when(c("dkim").isin(failed), auth("DKIM", c("dkim"))).when(c("dkim") == "none", "DKIM signature is absent (status=none); this is weaker evidence than a failed signature"),
        F.when(c("dmarc").isin(failed), auth("DMARC", c("dmarc"))),
        F.when(c("reply_to_mismatch"), "Reply-To mismatch detected"),
        F.when(c("return_path_mismatch"), F.concat(F.lit("Return-Path domain differs from From domain; bulk_sender="), low(c("is_bulk")), F.lit(" bulk_sender_signal_count="), c("n_bulk_signals").cast("string"))),
        F.when(F.coalesce(c("display_name_spoofing"), F.lit("")) != "", F.concat(F.lit("Display name spoofing indicator: "), c("display_name_spoofing"))),
    )
    ips = F.transform(F.filter(F.slice(c("links"), 1, 8), lambda x: F.coalesce(x["is_ip"], F.lit(False))), lambda x: F.lit("Link check did not pass: direct IP URL extracted from email"))
    alike = F.transform(F.slice(c("lookalikes"), 1, 5), lambda x: F.concat(F.lit("Lookalike/domain check did not pass: host="), or_dash(x["host"]), F.lit(" technique="), or_dash(x["technique"]), F.lit(" detail="), or_dash(x["detail"])))
    seen = F.transform(
        F.filter(F.slice(c("reputations"), 1, 8), lambda x: useful_status(x["status"]) != ""),
        lambda x: F.concat(F.lit("VirusTotal link check did not pass: status="), useful_status(x["status"]), F.lit(" detections="), F.coalesce(x["ratio"], F.lit("0 / 0")), F.lit(" evidence="), vendor_evidence(x["status"])),
    )
    told = ["SPF", "DKIM", "DMARC", "Return-Path", "PDF Content", "PDF Attachment"]
    flags = F.transform(F.filter(c("flags"), lambda x: x["level"].isin("HIGH", "MEDIUM") & ~x["field"].isin(told) & (F.coalesce(x["message"], F.lit("")) != "")), lambda x: F.concat(F.lit("- "), x["level"], F.lit(" "), x["field"], F.lit(": "), text.clip(x["message"], 160)))
    return F.filter(F.concat(first, ips, alike, seen, flags), lambda x: x.isNotNull())


# ------------------------------------------------------------------ words


def natural_join(values: Column) -> Column:
    """a; a and b; a, b, and c."""
    parts = F.filter(F.transform(values, lambda x: F.regexp_replace(F.trim(F.coalesce(x, F.lit(""))), r"[ .]+$", "")), lambda x: x != "")
    n = F.size(parts)
    last = F.try_element_at(parts, F.lit(-1))
    return F.when(n <= 1, F.coalesce(last, F.lit(""))).when(n == 2, F.array_join(parts, " and ")).otherwise(F.concat(F.array_join(F.slice(parts, 1, F.greatest(n - 1, F.lit(1))), ", "), F.lit(", and "), last))


def sentences(values: Column, most: int = 3) -> Column:
    """The first few reasons as parts of a sentence."""
    table = F.create_map(*[F.lit(x) for kv in fixed.REASON_WORDS.items() for x in kv])
    return F.transform(F.slice(values, 1, most), lambda x: F.coalesce(F.try_element_at(table, F.trim(x)), F.trim(x)))


def fallback_summary(action: Column, has_links: Column, extortion: Column, asset: Column, method: Column, amount: Column, scam: Column) -> Column:
    """What a message asks for, in a sentence, where a model gave none."""
    said = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in fixed.ACTION_WORDS.items() for x in kv]), action), F.lit(fixed.ACTION_WORDS["other"]))
    said = F.when(has_links & (action == "claim_reward"), F.replace(said, F.lit("claim it,"), F.lit("claim it through a supplied link,"))).otherwise(said)
    what = F.coalesce(filled(F.trim(asset)), F.when(method == "cryptocurrency", "cryptocurrency").otherwise("money"))
    sum_ = F.when(F.coalesce(F.trim(amount), F.lit("")) != "", F.concat(F.lit(" ("), F.trim(amount), F.lit(")"))).otherwise("")
    kind = F.when(scam == "sextortion", "sextortion").otherwise("extortion")
    return F.when(extortion, F.concat(F.lit("The subject and body use coercion to demand a "), what, F.lit(" payment"), sum_, F.lit(", a clear "), kind, F.lit(" scam."))).otherwise(F.concat(F.lit("The subject and body "), said, F.lit(".")))


def report(verdict: Column, summary: Column, supported: Column, details: Column, caveats: Column) -> Column:
    """A verdict in three sentences: what it is, what the message asks for, and what bears it out."""
    v = F.lower(F.coalesce(filled(verdict), F.lit("review")))
    review = "Our analysis indicates that this email requires manual verification before the recipient takes action."
    opening = F.when(v == "legitimate", "Our analysis indicates that this email is likely legitimate.").when(v == "phishing", "Our analysis indicates that this email is likely a phishing attempt.").otherwise(review)
    said = F.concat(F.regexp_replace(F.trim(F.coalesce(filled(summary), F.lit("Content unavailable."))), r"[ .]+$", ""), F.lit("."))
    why, but = natural_join(sentences(details)), natural_join(sentences(caveats))
    checks = F.when(supported & (why != ""), F.concat(F.lit("Independent checks support this assessment because "), why, F.lit("."))).when(supported, "Independent checks support this assessment.")
    checks = checks.otherwise("Independent checks do not corroborate this assessment; the conclusion is based on the action requested in the subject and body.")
    return F.concat_ws(" ", opening, said, F.concat(checks, F.when(but != "", F.concat(F.lit(" However, "), but, F.lit("."))).otherwise("")))


def meaningful(value: Column) -> Column:
    """Whether a value to show says anything."""
    v = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), r"(?U)\s+", "")
    return (v != "") & ~v.isin("-", "--", "<>", "null", "none", "n/a", "unknown")


def hop_from(from_host: Column, raw: Column) -> Column:
    return F.coalesce(filled(from_host), F.when(F.startswith(F.lower(F.ltrim(F.coalesce(raw, F.lit("")))), F.lit("by ")), "internal/by-only").otherwise("unknown"))


def hop_by(by_host: Column) -> Column:
    return F.coalesce(filled(by_host), F.lit("unknown"))


def received_spf(raw: Column) -> Column:
    """The status that a Received-SPF header starts with; none without a header."""
    return F.when(F.coalesce(raw, F.lit("")) == "", "none").otherwise(F.coalesce(filled(F.lower(F.regexp_extract(raw, r"^\s*([a-zA-Z0-9_-]+)", 1))), F.lit("unknown")))


def short_text(value: Column, most: int = 220) -> Column:
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.length(v) <= most, v).otherwise(F.concat(F.rtrim(F.left(v, F.lit(most))), F.lit("...")))


def lookup_state(pool: Column, state: Column, result: Column, error: Column, service: str) -> Column:
    """(status, message) of a lookup that may not have ended: missing ones are pending."""
    told = lambda status, message: F.struct(F.lit(status).alias("status"), message.alias("message"))
    return (
        F.when(pool == "__overloaded__", told("unavailable", F.lit(f"{service} was not started because the analysis queue is full")))
        .when((state == "done") & result.isNotNull(), F.struct(result.alias("status"), F.lit("").alias("message")))
        .when(state == "done", told("error", F.lit(f"{service} returned an invalid result")))
        .when(state == "error", told("error", F.concat(F.lit(f"{service}: "), F.coalesce(error, F.lit("None")))))
        .otherwise(told("pending", F.lit(f"{service} analysis in progress")))
    )


def anomaly_without_pdf(anomaly: Column) -> Column:
    """An attachment's anomalies without those that only repeat its PDF risk."""
    return F.array_join(F.filter(F.transform(F.split(F.coalesce(anomaly, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: (x != "") & ~F.startswith(x, F.lit("PDF risk "))), "; ")


def calibrated(params: Column) -> Column:
    """(temperature, threshold, band, positive_label) of a JSON text, with the defaults for what it lacks (or if it is null)."""
    get = lambda k, default: F.coalesce(F.get_json_object(params, f"$.{k}").try_cast("double"), F.lit(default)).alias(k)
    return F.struct(get("temperature", 1.0), get("threshold", 0.5), get("band", 0.3), F.coalesce(F.get_json_object(params, "$.positive_label_id").try_cast("int"), F.lit(1)).alias("positive_label_id"))


def padded(chunks: Column) -> Column:
    """Arrays of numbers as arrays of the width of the longest, with zeros at the end."""
    width = F.array_max(F.transform(chunks, F.size))
    return F.transform(chunks, lambda x: F.concat(x, F.array_repeat(F.lit(0), width - F.size(x))))
