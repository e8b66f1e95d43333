"""cln07_template_dedup equals its SQL where several texts share a template, which the small test tables hardly hold."""

import duckdb

from corvid.plans.catalog import ORACLES, QUERIES


def test_the_first_of_a_template_is_by_ord(spark, tmp_path):
    text = "invoice {} of the {} order waits for you, please pay it within the week"
    rows = [(1000 - 2 * i, text.format(i, kind), "s") for kind in ("red", "green", "blue", "white") for i in (len(kind) * 10 + k for k in range(9))]
    rows += [(2001 + 2 * i, f"notice {i} for holders of the other label, of more than forty characters", "s") for i in range(9)]
    rows += [(3000 + i, f"reminder {i} under both labels, also of more than forty characters", "s") for i in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    told = sorted(c.sql(f"select ord, label, source, template_hash from ({ORACLES['cln07_template_dedup']})").fetchall())
    mine = sorted(map(tuple, QUERIES["cln07_template_dedup"](spark, str(tmp_path)).select("ord", "label", "source", "template_hash").collect()))
    assert len(told) == 5 and mine == told
