"""Packing keeps near copies apart."""

from collections import defaultdict

from corvid.llm import packing, queries, simhash

SF = "/root/testdata/sf0.01"


def test_near_copies_never_share_a_bin(spark):
    words = [f"w{i}" for i in range(800)]
    rows = [(k, " ".join([*words, f"x{k}"]), f"s{k}") for k in range(6)]
    rows += [(6, rows[0][1], "s6"), (6, "some other text", None), (None, rows[0][1], None), (7, None, "a"), (8, "", "b")]
    fps = {simhash.fingerprint(t) for k, t, _ in rows if k is not None and k < 6}
    assert len(fps) > 1 or len({t for _, t, _ in rows[:6]}) == 6  # near copies, not exact ones
    got = packing.pack_near(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()
    assert len(got) == len(rows)
    near = [r for r in got if r["length"] > 1000]
    assert len(near) == 8 and len({r["cluster"] for r in near}) == 1 and len({r["bin"] for r in near}) == 8


def test_query_parts_components(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    component = {r["key"]: r["component"] for r in simhash.near_duplicates(docs).collect()}
    got = queries.op5_packing(spark, SF).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r["bin"]].append(component[r["doc_id"]])
    assert {r["doc_id"] for r in got} == set(component) and all(len(b) == len(set(b)) for b in bins.values())
