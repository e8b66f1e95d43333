"""Toxicity's counts against plain ones."""

from collections import Counter

import numpy as np

from corvid.llm import toxicity


def test_no_two_ngrams_share_a_count(spark):
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz0123456789"))
    words = ["".join(w) for w in letters[np.random.default_rng(1).integers(0, 36, (30_000, 4))]]
    rows = [(" ".join(words[i : i + 100]), (i // 100) % 2) for i in range(0, len(words), 100)]
    want = (Counter(), Counter())
    for text, y in rows:
        for w in text.split():
            p = "\x01" * 3 + w + "\x01"
            want[y].update(p[i : i + 4] for i in range(len(p) - 3))
    got = toxicity.count(spark.createDataFrame(rows, "text string, y int")).to_pylist()
    assert {r["gram"]: (r["toxic"], r["ordinary"]) for r in got} == {g: (want[1][g], want[0][g]) for g in want[0] | want[1]} and len(got) == len(want[0] | want[1])


def test_equal_hashes_are_kept_apart(monkeypatch):
    monkeypatch.setattr(toxicity, "mixed", lambda codes: np.zeros(len(codes), np.uint64))
    codes = np.array([[1, 2], [1, 3], [4, 5]], np.uint32)
    assert toxicity.Ratios.of(codes, np.array([1.0, 2.0, 3.0])).find(np.array([[4, 5], [9, 9], [1, 2], [1, 3]], np.uint32), -1.0).tolist() == [3, -1, 1, 2]
