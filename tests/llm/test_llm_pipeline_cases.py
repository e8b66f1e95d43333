"""The pipeline on nulls, empty texts, repeated rows, clashing columns and an empty table."""

import corpus_pipeline

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, set string, fp string, kept_key string, score string, bin string"


def run(spark, tmp_path, name, rows):
    folder = tmp_path / name
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder))


def test_defined_cases(spark, tmp_path):
    base = [tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    more = ("k", "s", "f", "kk", "sc", "b")
    plain = {r["doc_id"] for r in run(spark, tmp_path, "plain", [(*r, *more) for r in base]).collect()}
    kept = next(r for r in base if r[0] in plain)
    odd = [(9001, None, "en", "a", 0), (9002, "", None, None, 0), (9003, "  \n ", "en", "a", 4), (None, None, None, None, None), kept, (kept[0] + 100_000, *kept[1:])]
    got = run(spark, tmp_path, "odd", [(*r, *more) for r in base + odd]).collect()
    ids = [r["doc_id"] for r in got if r["piece"] == 0]
    assert not {9001, 9002, 9003, None, kept[0] + 100_000} & set(ids) and len(ids) == len(set(ids))
    assert set(ids) == plain  # neither the odd rows nor the copies change what stays


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, "empty", []).count() == 0
