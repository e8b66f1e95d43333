"""Every operator on nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from corvid.llm import html_text, langid, lattice, media, packing, pieces, quality, simhash, toxicity, warc

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score string, fp string, lang_pred string, held_out string, bin string, y string, corvid_key string, n string"
LONG = "the quick brown fox jumps over the lazy dog und der hund " * 4000
ROWS = [
    (1, "Hello world, this is a plain text about nothing much at all.", "en", "a"), (2, None, "en", "a"), (3, "", None, None), (None, "no key here but some words", "en", "b"), (4, LONG, "en", "a"),
    (5, "same text twice over and over", "de", "b"), (5, "same text twice over and over", "de", "b"), (6, "same text twice over and over", "de", "b"), (7, "12345 !!! ###", "fr", "c"), (8, "日本語のテキスト", None, "c"), (None, None, None, None), (9, "   \n\t ", "en", "a"), (10, "a\0b ퟿\U0001f642", "en", "a"),
]


def frame(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None, *(["x"] * 9)) for r in rows], SCHEMA)


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int, text string, key string")


LABELS = [(1, 1, 0, "t", "k"), (4, 0, 1, None, None), (5, 1, None, "t", "k"), (5, 0, 1, "t", "k"), (None, 1, 1, "t", "k"), (99, 1, 0, "t", "k"), (8, 7, None, "t", "k"), (9, 1, 0, "t", "k"), (10, 0, 0, "t", "k")]


@pytest.mark.parametrize("empty", [False, True])
def test_language(spark, empty):
    docs = frame(spark, [] if empty else ROWS)
    got = langid.identify(docs, langid.fit(docs)).collect()
    assert len(got) == docs.count()
    by = {r["key"]: r for r in got}
    if not empty:
        assert [by[k]["lang"] for k in (2, 3, 9, 7)] == ["und"] * 4 and by[1]["lang"] in ("en", "de") and all(0 <= r["score"] <= 1 for r in got)
        assert langid.identify(docs, langid.fit(docs.where("lang is null"))).where("lang != 'und'").count() == 0
        assert langid.keep_known(docs, langid.fit(docs)).columns == docs.columns


@pytest.mark.parametrize("empty", [False, True])
def test_media(spark, empty):
    docs = frame(spark, [] if empty else ROWS)
    got = media.measure(media.store(docs)).collect()
    assert len(got) == docs.count() and all(r["payload_bytes"] % 576 == 0 and r["payload_bytes"] > 0 for r in got)
    assert media.inspect(media.store(docs)).where("type = 'audio/wav' and corrected and whole").count() == docs.count()


@pytest.mark.parametrize("empty", [False, True])
def test_packing(spark, empty):
    docs = frame(spark, [] if empty else ROWS)
    got = packing.pack(docs).collect()
    assert len({(r["key"], r["copy"], r["source"]) for r in got}) == docs.count()
    assert sum(r["length"] for r in got) == sum(len(t or "") for _, t, *_ in (docs.select("doc_id", "text").collect()))


@pytest.mark.parametrize("empty", [False, True])
def test_simhash(spark, empty):
    docs = frame(spark, [] if empty else ROWS)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    if not empty:
        by = {r["key"]: r for r in got if r["key"] is not None}
        assert by[5]["component"] == by[6]["component"] == 5 and by[2]["component"] == by[3]["component"] == by[9]["component"] == 2 and by[2]["fp"] == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect())
    assert ids == ([] if empty else [1, 2, 4, 5, 7, 8, 10])


@pytest.mark.parametrize("empty", [False, True])
def test_pieces(spark, empty):
    import public_tokenizers

    docs = frame(spark, [] if empty else ROWS)
    model = public_tokenizers.path("piece_bpe_32k.model")
    got = pieces.encode(docs, model).collect()
    v = pieces.vocabulary(model)
    assert len(got) == docs.count() and pieces.digest(docs, model).count() == len(got)
    for r, (_, text, *_) in zip(got, [] if empty else ROWS, strict=True):
        assert r["agrees"] and r["ids"] == v.library.encode(text or "", add_eos=True) and r["text"] == (text or "")


@pytest.mark.parametrize("rows", [LABELS, [], [(1, 1, 1, "t", "k")]])
@pytest.mark.parametrize("empty", [False, True])
def test_learned_scores(spark, empty, rows):
    docs = frame(spark, [] if empty else ROWS)
    for op in (quality, toxicity):
        got = op.grade(docs, op.fit(docs, labels(spark, rows))).collect()
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert quality.keep_good(docs, quality.fit(docs, labels(spark, []))).count() == docs.count()


PAGES = [(1, "http://a/", "<p>x</p>"), (2, None, None), (None, "http://b\r\nWARC/1.1", "<p>" + "y" * 2000), (3, "u", "<p>" + "y" * 2000), (4, "u", "<p>" + "y" * 2000), (4, "u", "<p>" + "y" * 2000), (5, "u", ""), (6, "u", "z" * 999), (7, "u", "z" * 999)]


@pytest.mark.parametrize("empty", [False, True])
def test_archives(spark, empty):
    pages = spark.createDataFrame([(*p, "c", "c", "c", "c") for p in ([] if empty else PAGES)], "page_id bigint, url string, html string, key string, digest string, n string, top string")
    got = sorted((tuple(r) for r in warc.visits(warc.round_trip(pages)).select("key", "payload_bytes", "record_type", "refers_to").collect()), key=repr)
    want = [] if empty else [(1, 8, "response", None), (2, 0, "response", None), (None, 2003, "revisit", 4), (3, 2003, "revisit", 4), (4, 2003, "response", None), (4, 2003, "response", None), (5, 0, "response", None), (6, 999, "response", None), (7, 999, "response", None)]
    assert got == sorted(want, key=repr)


@pytest.mark.parametrize("empty", [False, True])
def test_main_text(spark, empty):
    pages = spark.createDataFrame([(*p, "c") for p in ([] if empty else PAGES)], "page_id bigint, url string, html string, key string")
    got = html_text.extract(pages).collect()
    assert len(got) == len([] if empty else PAGES) and all(r["text"] is not None and r["n_chars"] == len(r["text"]) for r in got)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    a, b = [1.0] * 16, [1.0] * 15 + [1.1]
    rows = [(1, a, 1), (2, b, 1), (3, b, 2), (4, b, None), (5, None, 1), (6, [0.0] * 16, 1), (7, [nan] * 16, 1), (8, [inf] + a[1:], 1), (9, [None] + a[1:], 1), (10, a[:8], 1), (11, [], 1), (12, [-x for x in a], 1), (2, b, 1), (None, a, 1), (13, [3e300] * 16, 1)]
    df = spark.createDataFrame([(*r, "c", 1, 1) for r in rows], "vec_id bigint, embedding array<double>, label int, key string, cid int, m int")
    got = sorted((tuple(r) for r in lattice.near_duplicates(df).collect()), key=repr)
    near = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (None, 4, 1, False), (13, 4, 1, False)]
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted(near + alone, key=repr)
    assert lattice.near_duplicates(df.limit(0)).count() == 0
    assert lattice.near_duplicates(df.withColumn("label", F.lit(None).cast("int"))).where("n_links > 0").count() == 0
