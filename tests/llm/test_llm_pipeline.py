"""The pipeline against a plain version of its stages."""

from itertools import combinations

import corpus_pipeline
from corvid.llm import langid, packing, quality

SF = "/root/testdata/sf0.01"


def test_pipeline_against_plain_version(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = quality.fit(docs, labels)
    import numpy as np

    score = dict(zip(rows, model.score(np.array([quality.statistics(r["text"]) for r in rows.values()])), strict=True))
    rows = {k: r for k, r in rows.items() if score[k] >= 0.7}
    known = langid.fit(spark.createDataFrame(list(rows.values()), docs.schema))
    rejected = dict(zip(rows, known.predict([r["text"] for r in rows.values()])["rejected"], strict=True))
    rows = {k: r for k, r in rows.items() if not rejected[k]}
    # the rule of near-duplicate stages: five-word shingles, a Jaccard similarity of 0.8 or more
    sets = {}
    for k, r in rows.items():
        w = r["text"].lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {k: k for k in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(rows, 2):
        x, y = sets[a], sets[b]
        if x == y or min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    rows = {k: r for k, r in rows.items() if find(k) == k}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in got} == set(rows)
    assert {(r["doc_id"], r["piece"], r["start"], r["length"]) for r in got} == {(k, p, p * packing.CAPACITY, min(packing.CAPACITY, len(r["text"]) - p * packing.CAPACITY)) for k, r in rows.items() for p in range(max(1, -(-len(r["text"]) // packing.CAPACITY)))}


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(120)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= docs.count()
