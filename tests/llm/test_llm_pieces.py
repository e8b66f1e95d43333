"""The piece operator's bounds of memory, and its decoding against the library's."""

import random

import pytest
from pyspark.sql import functions as F

from corvid.llm import pieces


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def library(v, text):
    ids = v.library.encode(text or "") + [v.end]
    return ids, v.library.decode(ids)


def test_texts_cut_in_parts_and_a_memory_that_starts_anew(model, monkeypatch):
    monkeypatch.setattr(pieces, "TOGETHER", 50)
    monkeypatch.setattr(pieces, "REMEMBERED", 400)
    monkeypatch.setattr(pieces, "CELLS", 64)
    r = random.Random(3)
    v = pieces.vocabulary(model)
    known = pieces.Memory(v)
    texts = [None, "", " ", "▁", *("".join(r.choices("abe ▁é\0\n🙂世", k=r.randint(0, 300))) for _ in range(200)), "one two  three " * 300, "x" * 900]
    got = [s.result() for s in pieces.results(v, known, iter(texts), pieces.Whole)]
    assert [g[:2] for g in got] == [library(v, t) for t in texts]
    assert all(g[2] for g in got)
    assert known.size <= 400 + 900


def test_many_rows_of_different_words(spark, model):
    r = random.Random(4)
    rows = [(i, " ".join("".join(r.choices("abcdefghijklmnop0123", k=9)) for _ in range(20))) for i in range(10_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(1)
    got = pieces.digest(docs, model)
    assert got.where(F.col("agrees")).count() == 10_000
    v = pieces.vocabulary(model)
    some = {r["key"]: r["n_tokens"] for r in got.where("key % 501 = 0").collect()}
    assert some == {i: len(library(v, t)[0]) for i, t in rows if i % 501 == 0}


def test_bytes_that_are_no_characters(model):
    v = pieces.vocabulary(model)
    r = random.Random(5)
    for n in (1, 2, 5, 3000):
        ids = r.choices(list(v.bytes), k=n)
        assert v.decode(ids) == v.library.decode(ids)


def test_agenda_and_shared_agenda_agree(model):
    v = pieces.vocabulary(model)
    r = random.Random(6)
    units = ["▁" + "".join(r.choices("aeinorstl", k=k)) for k in range(1, 60) for _ in range(5)]
    assert v.together(units) == [v.alone(u) for u in units] == [v.library.encode(u[1:]) for u in units]
