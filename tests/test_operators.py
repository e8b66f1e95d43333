"""Operators of the library on small, hard inputs."""

import gzip
import io
import random
import tarfile
import zipfile
from email.message import EmailMessage
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.functions import text, urls
from corvid.functions.html import read, visible_text
from corvid.operators import attachments, body, campaigns, corpus, headers, links, scoring
from corvid.operators.graph import connected_components
from corvid.sources import messages


def column(spark, values, f, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(f(F.col("v"))).collect()]


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(1, 2), (2, 3), (5, 4), (7, 7)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 40)], [(1, None), (None, None), (3, 2), (3, 2)]])
def test_components(spark, edges):
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = {}
    for a, b in edges:
        if a is not None and b is not None and a != b:
            group = want.get(a, {a}) | want.get(b, {b})
            for x in group:
                want[x] = group
    assert got == {k: min(g) for k, g in want.items()}


def test_random_components(spark):
    rng = random.Random(1)
    for n in (30, 200):
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(n // 2)]
        test_components.__wrapped__(spark, edges) if hasattr(test_components, "__wrapped__") else test_components(spark, edges)


def test_labels(spark):
    given_ = ["1", "0", "1.0", "2", None, "Spam", " Safe_Email ", "not-phishing", "phishing  email", "", "x", "nan"]
    assert column(spark, given_, text.parse_label) == [1, 0, 1, None, None, 1, 0, 0, 1, None, None, None]


def test_normalization(spark):
    assert column(spark, ["ﬁne\x07ＡＢＣ x", None, "  A\n\nB ", "<b>Hi</b>&amp;", "ÀÉ"], text.normalize) == ["fine abc x", "", "a b", "hi &", "àé"]


def test_placeholders(spark):
    got = column(spark, ["see https://a.b/c?d=1 and www.x.org now", "mail me@x.co", "ip 10.0.0.1", "4111 1111 1111 1111", "call +39 02 1234567", "x" * 170, "DE89370400440532013000"], text.placeholders)
    assert got == ["see [URL LINK] and [URL LINK] now", "mail [EMAIL ADDRESS]", "ip [IP ADDRESS]", "[CARD OR ACCOUNT NUMBER]", "call [PHONE NUMBER]", "[OBFUSCATED DATA]", "[IBAN]"]


def test_urls(spark):
    u = ["https://user@WWW.Example.co.uk:8080/a/b?c#d", "https://[tok]@evil.com/x", "ftp://h/", "nothing", "http://[::1]/x"]
    assert column(spark, u, urls.host) == ["www.example.co.uk", "evil.com", "h", "", "[::1]"]
    assert column(spark, ["a.b.example.com.", "x", "", None], urls.registered_domain) == ["example.com", "x", "", ""]
    assert column(spark, ["8.8.8.8", "10.1.1.1", "256.1.1.1", "172.31.0.1", "1.2.3", "::1"], urls.public_ipv4) == [True, False, False, False, False, False]
    assert column(spark, ["a%2520b+c", "%zz", "x"], urls.percent_decoded) == ["a b+c", "%zz", "x"]
    assert column(spark, ["https://a.b/c.d", "x.y"], text.defang) == ["https[://]a[.]b/c.d", "x[.]y"]
    assert column(spark, ["xn--pypal-4ve.com", "plain.org"], urls.punycode_decoded) == ["pаypal.com", "plain.org"]


def test_lookalikes(spark):
    hosts = ["paypal.com", "www.paypal.com", "paypa1.com", "pаypal.com", "xn--pypal-4ve.com", "secure-paypal.com", "rnicrosoft.com", "example.org", "10.0.0.1", ""]
    found = links.lookalikes(spark.createDataFrame([(h,) for h in hosts], "host string"), links.brand_table(spark)).collect()
    told = {(r["host"], r["brand"]): r["technique"] for r in found}
    assert told[("paypa1.com", "paypal.com")] == "edit_distance" and told[("pаypal.com", "paypal.com")] == "homoglyph" and told[("pаypal.com", "-")] == "unicode_homoglyph"
    assert told[("xn--pypal-4ve.com", "-")] == "punycode_idna" and told[("secure-paypal.com", "paypal.com")] == "typosquatting" and told[("rnicrosoft.com", "microsoft.com")] in ("edit_distance", "typosquatting")
    assert not {h for h, _ in told} & {"paypal.com", "www.paypal.com", "example.org", "10.0.0.1", ""}


def corpus_rows(spark, rows):
    return spark.createDataFrame(rows, "ord int, text string, label string, source string, source_file string")


LONG = "this is a sufficiently long text number one for all the rules"


def test_cleaning(spark):
    rows = [(0, LONG, "0", "a", "f"), (1, LONG.upper(), "legit", None, None), (2, "short", "1", "a", "f"), (3, None, "1", "a", "f"), (4, LONG + " two", "1", "b", "f"), (5, LONG + " two", "0", "b", "f"), (6, LONG + " three", "odd", "c", "f"), (7, "w" * 50, "1", "c", "f"), (8, "x " * 100_001, "1", "c", "f")]
    df = corpus_rows(spark, rows)
    assert [r["ord"] for r in corpus.clean(df).collect()] == [0]
    assert corpus.reject_counts(df).first().asDict() == {"n_rows": 9, "invalid_text": 1, "invalid_label": 1, "too_short": 1, "too_few_words": 2, "too_long": 1, "valid": 4}
    assert corpus.clean(spark.createDataFrame([(1, LONG)], "ord int, text string")).count() == 0
    assert corpus.clean(df.limit(0)).count() == 0


def test_template_dedup(spark):
    t = "your invoice {} is at https://x.y/{} write to a{}@b.com and pay it within the week"
    rows = [(i, t.format(i, i, i), "1", "a", "f") for i in range(5)] + [(9, LONG, "1", "a", "f"), (10, LONG + "!", "0", "a", "f")]
    assert [r["ord"] for r in corpus.dedupe_templates(corpus_rows(spark, rows)).collect()] == [0]


def test_append(spark):
    rows = [(1, "h", 0), (2, "h", 0), (3, "h", 1), (4, "h", 0), (5, "g", 1), (6, "g", 1)]
    assert sorted(r["ord"] for r in corpus.append_new(spark.createDataFrame(rows, "ord int, text_hash string, label int")).collect()) == [1, 3, 4, 5]


def test_ranks(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randrange(1000), i) for i in range(500)]
    got = corpus.rank_within(spark.createDataFrame(rows, "g string, x int, i int"), ["g"], ["x", "i"]).collect()
    for g in ("a", "b", None):
        mine = sorted((r["x"], r["i"], r["rank"]) for r in got if r["g"] == g)
        assert [r[2] for r in mine] == list(range(1, len(mine) + 1))
    assert len(got) == 500


def test_campaigns(spark):
    import math
    from collections import Counter

    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    texts = []
    for _ in range(14):
        w = [rng.choice(words) for _ in range(25)]
        texts.append(" ".join(w))
        for _ in range(rng.randrange(3)):
            w[rng.randrange(25)] = rng.choice(words)
            texts.append(" ".join(w))
    texts = sorted(set(texts))

    def vector(t):
        c = Counter()
        for w in t.split():
            p = f" {w} "
            for n in (4, 5):
                c.update([p] if len(p) <= n and (n == 4 or len(p) == 5) and len(p) <= 4 else [p[i : i + n] for i in range(len(p) - n + 1)])
        return c

    grams = [vector(t) for t in texts]
    df = Counter(g for c in grams for g in c)
    least_df = 1 if len(texts) < 20 else 2
    vec = []
    for c in grams:
        v = {g: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, k in c.items() if df[g] >= least_df}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        vec.append({g: x / norm for g, x in v.items()})
    want = {(texts[i], texts[j]) for i, j in combinations(range(len(texts)), 2) if sum(x * vec[j].get(g, 0) for g, x in vec[i].items()) >= 0.83}
    rows = spark.createDataFrame([(t, t) for t in texts], "text_hash string, text string")
    assert {(r["a"], r["b"]) for r in campaigns.edges(rows).collect()} == want and want


def near_texts():
    """(texts, the pairs of them that link by brute force): short near copies whose frequent words differ, and some long ones."""
    import math
    from collections import Counter

    rng = random.Random(5)
    parts = ["th", "an", "er", "on", "ti", "re", "he", "in", "ed", "nd", "ha", "en", "ou", "ea", "st", "ing", "ble", "sh"]
    word = lambda: "".join(rng.choices(parts, weights=range(len(parts), 0, -1), k=rng.choice([1, 1, 2, 2, 3, 4])))
    texts = set()
    for k in range(260):
        w = [word() for _ in range(rng.randrange(6, 12) if k else 3000)]
        texts.add(" ".join(w))
        for _ in range(3):
            near = list(w)
            for _ in range(rng.choice([1, 1, 2])):
                near.insert(rng.randrange(len(near)), word())
            texts.add(" ".join(near))
    texts = sorted(texts)
    counts = []
    for t in texts:
        c = Counter()
        for w in t.split():
            p = f" {w} "
            c.update(p[i : i + n] for n in (4, 5) for i in range(len(p) - n + 1))
        counts.append(c)
    df = Counter(g for c in counts for g in c)
    vectors, posted = [], {}
    for i, c in enumerate(counts):
        v = {g: (1 + math.log(k)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, k in c.items() if df[g] > 1}
        norm = math.sqrt(sum(x * x for x in v.values()))
        vectors.append({g: x / norm for g, x in v.items()})
        for g, x in vectors[-1].items():
            posted.setdefault(g, []).append((i, x))
    want = set()
    for i, v in enumerate(vectors):
        cosines = Counter()
        for g, x in v.items():
            for j, y in posted[g]:
                cosines[j] += x * y
        want |= {(texts[i], texts[j]) for j, x in cosines.items() if i < j and x >= 0.83}
    return texts, want


def test_campaign_links_of_short_texts(spark):
    """No link is lost; long texts and short ones are held against each other too."""
    texts, want = near_texts()
    rows = spark.createDataFrame([(t, t) for t in texts], "text_hash string, text string")
    got = {(r["a"], r["b"]) for r in campaigns.edges(rows).collect()}
    assert got == want and len(want) > 300


def test_split_keeps_linked_texts_together(spark):
    """Texts that link by brute force have one campaign and one split."""
    texts, want = near_texts()
    rows = spark.createDataFrame([(t, t, 0, "s") for t in texts], "text_hash string, text string, label int, source string")
    told = {r["text_hash"]: (r["campaign_id"], r["split"]) for r in campaigns.split_campaigns(rows).drop("text").collect()}
    assert len(told) == len(texts) and not [p for p in want if told[p[0]] != told[p[1]]]


def test_valid_texts_are_normalized_once(spark):
    """The filters of valid rows do not normalize the texts a second time."""
    df = spark.createDataFrame([(1, "some é words that are long enough to be kept here", "0", "s", "f")], "ord long, text string, label string, source string, source_file string")
    plan = corpus.valid(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and corpus.valid(df).count() == 1


def test_campaign_links_take_little(spark):
    """A large group of near copies makes no row for each pair, and what is kept on disk is of the texts' size."""
    from pathlib import Path

    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 10))) for _ in range(900)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(120)]
    for _ in range(120):
        near = texts[0].split()
        near[rng.randrange(300)] = rng.choice(words)
        texts.append(" ".join(near))
    rows = spark.createDataFrame([(f"h{i:04}", t) for i, t in enumerate(texts)] + [("h0005", texts[5])], "text_hash string, text string").localCheckpoint()
    campaigns.campaigns(rows.limit(3)).count()  # a checkpoint folder is there
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    got = {r["text_hash"]: r["campaign_id"] for r in campaigns.campaigns(rows).collect()}
    assert size() - before < 4 * sum(map(len, texts))
    assert len(got) == 240 and campaigns.campaigns(rows).count() == 240
    root = {h: h for h in got}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    pairs = campaigns.edges(rows).collect()
    for r in pairs:
        root[max(find(r["a"]), find(r["b"]))] = min(find(r["a"]), find(r["b"]))
    assert got == {h: f"campaign:{find(h)}" for h in got} and len(pairs) > 5000
    assert campaigns.links(rows).count() <= 240


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40))
def test_assignment_places_every_group(sizes):
    groups = [(f"g{i}", n) for i, n in enumerate(sizes)]
    got = campaigns.assign(groups, campaigns.SHARES, "42")
    assert set(got) == {g for g, _ in groups} and set(got.values()) <= set(campaigns.SHARES)


def test_thirty_rows_split(spark):
    rows = [(i, f"campaign:{s}{y}{i}", y, s) for s in "ab" for y in (0, 1) for i in range(30)]
    got = campaigns.split(spark.createDataFrame(rows, "i int, campaign_id string, label int, source string"), ["label", "source"])
    counts = {(r["label"], r["source"], r["split"]): r["count"] for r in got.groupBy("label", "source", "split").count().collect()}
    assert all(counts[(y, s, k)] == n for s in "ab" for y in (0, 1) for k, n in (("train", 21), ("validation", 3), ("test", 6)))


def test_windows(spark):
    n = [0, 1, 510, 511, 892, 893, 5000, 100_000]
    got = column(spark, n, lambda c: scoring.window_starts(c), "int")

    def plain(n):
        last = max(n - 510, 0)
        s = sorted({*range(0, last + 1, 382), last})
        return s if len(s) <= 8 else [s[round(i * (len(s) - 1) / 7)] for i in range(8)]

    assert got == [plain(x) for x in n]


def test_temperature(spark):
    rng = random.Random(4)
    import math

    rows = []
    for _ in range(4000):
        m = rng.gauss(0, 4)
        rows.append((m, int(rng.random() < 1 / (1 + math.exp(-m / 2.5)))))
    assert scoring.fit_temperature(spark.createDataFrame(rows, "margin double, label int")) == pytest.approx(2.5, rel=0.12)


def test_metrics_of_nothing(spark):
    empty = spark.createDataFrame([], "predicted int, label int, p double")
    assert scoring.confusion(empty).first()["f1"] == 0.0 and scoring.best_f1(empty).count() == 0 and scoring.selective_band(empty).count() == 0


def test_layers(spark):
    t = ["Hi\nthere\nBest regards\nBob", "top\nOn Mon, Bob wrote:\n> old", "Forwarded message\nFrom: a\nTo: b\n\nbody here", None, ""]
    got = spark.createDataFrame([(x,) for x in t], "t string").select(body.layer(F.col("t")).alias("l")).select("l.*").collect()
    assert [r["context"] for r in got] == ["normal", "reply", "forwarded", "normal", "normal"]
    assert got[0]["removed_tail"] == 2 and [x for x in got[1]["lines"] if x] == ["top"] and got[2]["lines"] == ["body here"]


def test_segments_are_trimmed_of_spaces_only(spark):
    t = "\n".join(["  Pad to eight "] * 3 + [f"{i}27243074{i}!!" for i in range(12)] + ["pad to EIGHT", "short"])
    assert column(spark, [t, None], body.evidence_segments) == [["pad to eight"] + [f"{i}27243074{i}!!" for i in range(12)], []]
    anchors = "".join(f"<a href={i}.example/{i}>x</a>" for i in range(12))
    assert column(spark, [anchors], links.hrefs) == [[f"{i}.example/{i}" for i in range(12)]]


def test_quotations_cut_within_words_and_capitals(spark):
    from corvid.operators import policy

    hexes = "".join(f"{i * 7919:04x}" for i in range(40))
    rows = [("SSSS SSSS SS", "ßß ßß ß", True), ("STRASSE UND GRÖSSE", "die Straße und  Größe hier", True), ("ΟΔΟΣ", "η οδοςα", True), (f"es mi docoado token = {hexes[:30]}xx", f"laasr es mi docoado token = {hexes} ende", True), (hexes[40:98] + "xx", hexes, True), (hexes[::-1][:60], hexes, False), ("", "x", False), ("abcdefgh", None, False), ("abcdefghij", "abcdefghi", True)]
    df = spark.createDataFrame([r[:2] for r in rows], "q string, t string")
    assert [r[0] for r in df.select(policy.grounded(F.col("q"), F.col("t"))).collect()] == [r[2] for r in rows]


def test_pair_filter_loses_no_alike_passage():
    import difflib

    from corvid.operators import policy

    rng, told = random.Random(5), []
    for _ in range(400):
        text = " ".join("".join(rng.choice("abcd") for _ in range(rng.randrange(1, 7))) for _ in range(12))
        quote = list(text[5:30])
        for _ in range(rng.randrange(9)):
            quote[rng.randrange(len(quote))] = rng.choice("abcd x")
        quote = "".join(quote)
        want = any(difflib.SequenceMatcher(None, quote, text[i : i + len(quote)], autojunk=False).ratio() >= 0.82 for i in range(len(text) - len(quote) + 1))
        told.append(want)
        assert not want or policy.alike(0.82)(quote, text)
    assert 40 < sum(told) < 360


@pytest.mark.parametrize("zone", ["UTC", "Asia/Kathmandu"])
def test_utc_minutes_of_all_years(spark, zone):
    from corvid.operators import enrich

    seconds = [0, 1_700_000_059, 518_394_000_000, -50_000_000_000, -62_167_219_201, -99_999_999_999, 10**17, None]
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert column(spark, seconds, enrich.utc_minute, "long") == ["1970-01-01 00:00 UTC", "2023-11-14 22:14 UTC", "18397-04-02 13:20 UTC", "0385-07-25 07:06 UTC", "-1-12-31 23:59 UTC", "-1199-02-15 14:13 UTC", None, None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_noise(spark):
    rng = random.Random(5)
    noise = "\n".join("".join(rng.choice("ABCDEFGHIJKLMNOPqrstuvwxyz0123456789+/") for _ in range(600)) for _ in range(9))
    rows = [(1, f"before\n{noise}\nafter"), (2, "plain\ntext"), (3, None), (4, "\n".join(noise.split("\n")[:7]))]
    got = {r["key"]: r for r in body.strip_noise(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()}
    assert got[1]["text"] == "before\nafter" and got[1]["removed_lines"] == 9 and got[1]["removed_chars"] == 5400
    assert got[2]["text"] == "plain\ntext" and got[3]["text"] == "" and got[4]["removed_lines"] == 0


def test_auth(spark):
    raw = ["mx; spf=pass smtp.mailfrom=a.com; dkim=fail (bad) header.d=b.com; DKIM=pass header.d=c.com; dmarc=weird", "", None]
    rows = headers.auth_results(spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "m int, raw string"), "m", "raw")
    got = {r["proto"]: (r["status"], r["n_results"]) for r in headers.worst(rows, ["m", "proto"]).collect()}
    assert got == {"SPF": ("pass", 1), "DKIM": ("fail", 2), "DMARC": ("weird", 1)}


def test_hops(spark):
    raw = "from mail.x.com (mail.x.com [203.0.113.9]) by mx.y.net with ESMTPS (version=TLSv1.3 cipher=TLS_AES_256_GCM_SHA384) for <a@b.c>; Tue, 2 Jan 2024 10:00:05 +0100 (CET)"
    h = spark.createDataFrame([(raw,), ("nonsense",)], "r string").select(headers.hop(F.col("r")).alias("h")).select("h.*").collect()
    assert (h[0]["from_host"], h[0]["by_host"], h[0]["for_address"], h[0]["tls_version"], h[0]["all_ips"]) == ("mail.x.com", "mx.y.net", "a@b.c", "TLSv1.3", ["203.0.113.9"])
    assert str(h[0]["received_at"]) == "2024-01-02 09:00:05" and h[1]["received_at"] is None


def test_attachments(spark):
    rows = [("a.pdf", "application/pdf", b"%PDF-1.4"), ("a.pdf", "application/pdf", b"MZ\x90"), ("b.docx", "application/zip", b"PK\x03\x04"), ("c.jpeg", "image/jpeg", b"\xff\xd8\xff\xe0"), (None, None, b""), ("noext", "text/html", b"<html>")]
    r = spark.createDataFrame(rows, "f string, c string, p binary").select(attachments.record(F.col("f"), F.col("c"), F.col("p")).alias("r")).select("r.*").collect()
    assert [x["magic_detected_format"] for x in r] == ["pdf", "exe", "zip", "jpg", None, "html"]
    assert [x["anomaly"] is not None for x in r] == [False, True, False, True, False, False]


def test_pdf(spark):
    rows = [(b"%PDF-1.4\n1 0 obj <</J#61vaScript 2 0 R /OpenAction 3 0 R>> endobj %%EOF",), (b"%PDF-1.4\n/URI (http://a.b/?url=http%3A%2F%2Fc.d) %%EOF",), (b"%PDF-1.4",)]
    r = spark.createDataFrame(rows, "p binary").select(attachments.pdf_scan(F.col("p")).alias("s")).select("s.*", attachments.pdf_risk(F.col("s.names")).alias("risk")).collect()
    assert [x["risk"] for x in r] == ["high", "high", "clean"] and r[0]["objects"] == 1 and r[1]["urls"] == ["http://a.b/?url=http%3A%2F%2Fc.d"]
    assert column(spark, [r[1]["urls"][0]], attachments.nested_redirects) == [["http://c.d"]]


def test_html():
    h = "<head><title>t</title></head><p>Pa<span>y</span>Pal</p><div hidden>no</div><p style='display: none'>no</p><img alt='logo'><br>x<div class='signature'><a href=u>Sig</a></div>"
    assert visible_text(h) == "PayPal\nlogo\nx\nSig" and visible_text(h, True) == "PayPal\nlogo\nx" and visible_text(None) == ""
    assert [x["role"] for x in read(h + "<a href=z rel=unsubscribe>q</a><a href=w>go</a>").links] == ["signature_or_footer", "unsubscribe", "body_action"]


def mail(subject="Hi", plain="hello there", html=None, files=()):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@b.com", "c@d.com", subject
    m.set_content(plain)
    if html:
        m.add_alternative(html, subtype="html")
    for name, data in files:
        m.add_attachment(data, maintype="application", subtype="octet-stream", filename=name)
    return m


def test_messages(spark, tmp_path):
    nested = mail("outer")
    nested.add_attachment(mail("inner"))
    (tmp_path / "a.eml").write_bytes(mail(html="<p>x</p>", files=[("f.bin", b"12")]).as_bytes())
    (tmp_path / "b.eml").write_bytes(b"Created at: odd line\n" + nested.as_bytes())
    (tmp_path / "c.eml").write_bytes(mail(files=[(f"{i}", b"1") for i in range(26)]).as_bytes())
    (tmp_path / "d.eml").write_bytes(b"\n")
    (tmp_path / "e.eml").write_bytes(b"Subject: u7\nContent-Type: text/html; charset=utf-8\n\n+ADw-html+AD4APA-body+AD4-+ADw-p+AD4-hi+ADw-/p+AD4-")
    got = {r["path"].rsplit("/", 1)[-1]: r for r in messages.parse_messages(messages.files(spark, str(tmp_path))).collect()}
    assert (got["a.eml"]["subject"], got["a.eml"]["body"].strip(), got["a.eml"]["attachments"][0]["payload"]) == ("Hi", "hello there", b"12")
    assert got["b.eml"]["subject"] == "outer" and got["b.eml"]["body"].strip() == "hello there" and got["b.eml"]["attachments"][0]["content_type"] == "message/rfc822"
    assert got["c.eml"]["status"] == "limit_exceeded" and got["d.eml"]["status"] == "ok" and got["e.eml"]["body"] == "hi"


def test_archives(spark, tmp_path):
    one, two = mail("one").as_bytes(), mail("two").as_bytes()
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("repo/email/a.eml", one)
        z.writestr("repo/readme", b"no")
    with tarfile.open(tmp_path / "t.tar.bz2", "w:bz2") as t:
        for i, data in enumerate((one, two)):
            info = tarfile.TarInfo(f"m/{i}")
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))
    box = b"From a@b Mon Jan 1\n" + one + b"\nFrom c@d Tue Jan 2\n" + two
    (tmp_path / "box").write_bytes(box)
    (tmp_path / "box.gz").write_bytes(gzip.compress(box))
    parsed = messages.parse_messages(messages.archive(spark, str(tmp_path)).where("member not like '%readme'")).groupBy("subject").count().collect()
    assert {r["subject"]: r["count"] for r in parsed} == {"one": 4, "two": 3}
    assert messages.archive(spark, str(tmp_path / "z.zip"), wanted="/email/").count() == 1


def test_entry_without_llm():
    """The library and its queries stand without the llm subpackage."""
    import subprocess
    import sys

    code = "import sys; sys.modules['corvid.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') for k in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("pathlib").Path(__file__).parents[1]))
