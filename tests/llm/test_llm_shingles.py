"""Near-duplicates by shingle similarity against brute force, and the pipeline's stage."""

from itertools import combinations

import corpus_pipeline
from corvid.llm import shingles

SF = "/root/testdata/sf0.01"


def survivors(rows):
    sets = []
    for _, text in rows:
        w = (text or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a == b or (min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) / len(a | b) >= 0.8):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i][0])
    return sorted(min((k for k in g if k is not None), default=-1) for g in groups.values())


def kept(df):
    return sorted(-1 if r["doc_id"] is None else r["doc_id"] for r in df.select("doc_id").collect())


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = survivors(rows)
    assert len(want) < len({t for _, t in rows})  # near copies that are no exact copies
    assert kept(corpus_pipeline.simhash_stage(spark, docs, SF)) == want


def test_groups_without_a_hub_and_repeated_keys(spark):
    base = [f"w{i}" for i in range(60)]

    def changed(*at, by="x"):
        return " ".join(by + w if i in at else w for i, w in enumerate(base))

    # a chain in which neighbours are similar and the ends are not; the least key at its end
    chain = [(10 + k, " ".join(f"c{i}" for i in range(4 * k, 4 * k + 60))) for k in range(8)]
    star = [(30 + k, changed(7 * k + 3, by=f"y{k}")) for k in range(8)] + [(29, changed())]
    rows = [*chain, *star, (50, "one two three"), (51, "ONE  two three"), (52, None), (53, ""), (None, "no key " * 30), (None, "no key " * 31), (None, "another text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert kept(shingles.keep_one(docs)) == survivors(rows)
    twice = spark.createDataFrame([(1, "a b c d e f"), (5, "a b c d e f"), (5, "other words of a different text"), (5, "other words of a different text")], "doc_id bigint, text string")
    assert sorted(tuple(r) for r in shingles.keep_one(twice).collect()) == [(1, "a b c d e f"), (5, "other words of a different text")]
    assert shingles.keep_one(docs.limit(0)).count() == 0
