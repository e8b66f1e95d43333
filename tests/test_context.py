"""Rows that repeat keys, restarted drains, sources with faults, sinks, and checks that no SQL expresses."""

import ipaddress
import json
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from corvid.operators import attachments, body, corpus, enrich, headers
from corvid.sources import messages, tables
from corvid.streaming import jobs

GOOD = "this is a text of more than forty characters, and of more than five words, number {}"


def test_clean_with_repeated_ord(spark):
    rows = [(1, GOOD.format("one"), 0, "a"), (1, GOOD.format("two"), 0, "a"), (2, GOOD.format("two"), 1, "b"), (1, GOOD.format("three"), 1, "a"), (1, GOOD.format("three"), 1, "a"), (1, GOOD.format("three"), 1, "b"), (None, GOOD.format("four"), 0, "c")]
    df = spark.createDataFrame(rows, "ord int, text string, label int, source string")
    got = sorted((r["text"][-5:], r["source"]) for r in corpus.clean(df).collect())
    assert got == [(" four", "c"), ("r one", "a"), ("three", "a")]  # two labels: the second text is gone, for all its rows
    once = corpus.dedupe_templates(df)
    assert once.count() == 3 and once.select("text_hash").distinct().count() == 3
    assert corpus.clean(df.limit(0)).count() == 0


def test_append_keeps_what_follows_a_clash(spark):
    rows = [(1, "a", 0), (2, "a", 0), (3, "a", 1), (4, "a", 0), (5, "b", 1), (6, "b", 1)]
    got = corpus.append_new(spark.createDataFrame(rows, "ord int, text_hash string, label int"))
    assert sorted(r["ord"] for r in got.collect()) == [1, 3, 4, 5]


def test_noise_of_repeated_and_null_keys(spark):
    noise = "\n".join(("QUJDREVGR0hJSktMTU5PUFFSU1RVVldYWVphYmNkZWZnaGlqa2xtbm9wcXJzdHV2d3h5eg" * 8)[:520] for _ in range(9))
    rows = [(1, "alpha\nbeta"), (1, "gamma\ndelta"), (None, "one\ntwo"), (None, f"before\n{noise}\nafter"), (2, None)]
    got = sorted(((r["key"], r["text"], r["removed_lines"]) for r in body.strip_noise(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()), key=repr)
    assert got == sorted([(1, "alpha\nbeta", 0), (1, "gamma\ndelta", 0), (None, "one\ntwo", 0), (None, "before\nafter", 9), (2, "", 0)], key=repr)


def test_a_drain_goes_on_where_it_stopped(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    name = f"resumed-{uuid.uuid4().hex}"
    assert jobs.drain(jobs.stream(spark, f"{tmp_path}/in"), name=name).count() == 3
    spark.range(10, 12).write.mode("append").parquet(f"{tmp_path}/in")
    # a second call reads the new files only, and the first ones' rows are not there twice
    again = jobs.drain(jobs.stream(spark, f"{tmp_path}/in"), name=name)
    assert sorted(r[0] for r in again.collect()) == [0, 1, 2, 10, 11]
    assert jobs.drain(jobs.stream(spark, f"{tmp_path}/in")).count() == 5


def test_snapshots_groups_and_health(spark, tmp_path):
    spark.range(4).write.parquet(f"{tmp_path}/in")
    q = jobs.stream(spark, f"{tmp_path}/in").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert jobs.snapshot(q) == {"state": "done", "rows": 4, "error": None}
    assert jobs.snapshot(None)["state"] == "missing"
    assert jobs.in_group(spark, "g", lambda: spark.range(5).count()) == 5
    jobs.cancel(spark, "g", q)
    now, calls = [0.0], []
    h = jobs.Health(lambda: calls.append(1) or True, ttl=10, clock=lambda: now[0])
    assert h.ok() and h.ok() and len(calls) == 1
    now[0] = 10.0
    assert h.ok() and len(calls) == 2


def test_stream_pieces(spark):
    lines = ['{"message": {"content": "Hel"}}', 'data: {"choices": [{"delta": {"content": "lo"}}]}', "data: [DONE]", "", '{"done": true}', "not json"]
    got = jobs.deltas(spark.createDataFrame([(x,) for x in lines], "line string"))
    assert [r["piece"] for r in got.collect()] == ["Hel", "lo"]


def test_recipe_guard(spark, tmp_path):
    with pytest.raises(ValueError):
        jobs.guard_recipe(spark, str(tmp_path), {"epochs": 4}, resume=True)
    jobs.guard_recipe(spark, str(tmp_path), {"epochs": 4, "data": "x"}, resume=False)
    jobs.guard_recipe(spark, str(tmp_path), {"epochs": 4, "data": "x"}, resume=True)
    with pytest.raises(ValueError, match="another recipe"):
        jobs.guard_recipe(spark, str(tmp_path), {"epochs": 5, "data": "x"}, resume=True)


def test_sources_are_isolated(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Email Text,Email Type\n"hello, there",Safe Email\nbuy,Phishing Email\n')
    (tmp_path / "b.csv").write_text("Email Text\nx\n")
    (tmp_path / "m.mbox").write_bytes(b"From a\nSubject: One\n\nbody one\n\nFrom b\nSubject: Two\n\nbody two\n")
    paths = {"ubuntu_modern_ham": ["x"], "zenodo_validation_2024": [f"{tmp_path}/a.csv", f"{tmp_path}/b.csv"], "nazario": [f"{tmp_path}/m.mbox"], "unheard_of": ["y"]}
    rows, report = tables.ingest(spark, paths, all_or_nothing=False)
    assert sorted((r["text"], r["label"]) for r in rows.select("text", F.col("label").cast("string")).collect()) == [("buy", "Phishing Email"), ("hello, there", "Safe Email"), ("one body one", "1"), ("two body two", "1")]
    assert [r["status"] for r in report] == ["refused", "read", "error", "read", "error"] and "Email Type" in report[2]["error"]
    assert tables.ingest(spark, paths)[0] is None


def test_archives_are_bounded_and_files_ordered(spark, tmp_path):
    (tmp_path / "m.mbox").write_bytes(b"".join(b"From x\nSubject: %d\n\nb\n" % i for i in range(5)))
    assert messages.archive(spark, f"{tmp_path}/m.mbox", most=3).count() == 3
    for n in ("B.eml", "a.eml", "C.eml"):
        (tmp_path / n).write_bytes(b"Subject: x\n\ny")
    got = messages.listed(messages.files(spark, str(tmp_path)), most=2)
    assert [r["path"].rsplit("/", 1)[-1] for r in got.collect()] == ["a.eml", "B.eml"]


def test_checksums_and_strict_labels(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"abc")
    good = "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    assert tables.verified(spark, f"{tmp_path}/x", good.upper())
    with pytest.raises(ValueError):
        tables.verified(spark, f"{tmp_path}/x", "0" * 64)
    df = spark.createDataFrame([("spam",), ("ham",)], "label string")
    assert [r[0] for r in df.select(tables.strict_label(F.col("label"))).collect()] == [1, 0]
    with pytest.raises(Exception, match="not a label"):
        spark.createDataFrame([(None,)], "label string").select(tables.strict_label(F.col("label"))).collect()


def test_sinks_are_whole(spark, tmp_path):
    df = spark.createDataFrame([("  A  Text ", 1, [1, 2])], "text string, label int, more array<int>")
    for _ in range(2):  # the second replaces the first
        tables.save_rows(df, f"{tmp_path}/rows")
    back = tables.load_rows(spark, f"{tmp_path}/rows")
    assert back.select(tables.COLUMNS).columns == tables.COLUMNS and back.first()["text"] == "a text" and back.count() == 1
    assert tables.known_labels(back).first()["label"] == 1
    tables.save_tables({"one": df}, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("escape", '"').csv(f"{tmp_path}/csv/one").first()["more"] == "[1,2]"
    tables.save_json(spark, f"{tmp_path}/card.json", {"t": 1.5, "n": "è"})
    assert json.loads((tmp_path / "card.json").read_text()) == {"t": 1.5, "n": "è"}
    report = tables.as_json(df.withColumn("raw", F.lit(b"x")), "text", "label").first()["report"]
    assert json.loads(report) == {"text": "  A  Text ", "more": [1, 2]}
    assert tables.for_training(spark.createDataFrame([("a", 1), (None, 0)], "xt_combined string, label int")).count() == 1


def test_public_addresses(spark):
    some = ["8.8.8.8", "10.1.1.1", "::1", "2001:4860:4860::8888", "fe80::1", "[2606:4700::1111]", "fc00::1", "nonsense:", "", None, "2001:db8::1", "192.0.2.5"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in some], "ip string").select(enrich.public_ip(F.col("ip"))).collect()]

    def want(x):
        try:
            return ipaddress.ip_address((x or "").strip("[]")).is_global
        except ValueError:
            return False

    assert got == [want(x) for x in some]


def test_lookups_join_what_is_known(spark):
    rows = spark.createDataFrame([(1, "a.test"), (2, "b.test"), (3, None)], "id int, host string")
    keys = enrich.plan(rows, "id", domain="host")
    one = enrich.Lookups(domain=lambda k: k.withColumn("score", F.length("entity_key")))
    got = {r["id"]: r["domain"]["score"] if r["domain"] else None for r in one.joined(rows, keys, domain="host").collect()}
    assert got == {1: 6, 2: 6, 3: None}


def test_compressed_objects_are_scanned(spark):
    inner = zlib.compress(b"7 0 obj << /S /JavaScript /JS (x) /URI (https://a.test/?url=https%3A%2F%2Fb.test) >> endobj")
    whole = b"%PDF-1.5\n1 0 obj << /Type /ObjStm /Filter /FlateDecode >> stream\n" + inner + b"\nendstream endobj"
    broken = b"%PDF-1.5\n1 0 obj << /Filter /FlateDecode >> stream\nnot zlib\nendstream endobj"
    rows = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(broken)), (3, None), (4, bytearray(b""))], "id int, payload binary")
    got = {r["id"]: r["pdf"] for r in attachments.pdf_security(rows).collect()}
    assert got[1]["risk_level"] == "high" and "javascript" in got[1]["behaviors"] and got[1]["evidence"]["nested_redirect_count"] == 1
    assert got[2]["error"].startswith("object 1") and got[2]["risk_level"] == "clean"
    assert got[3]["risk_level"] == got[4]["risk_level"] == "not_pdf"


def test_spf_sender_without_anything(spark):
    none = F.lit(None).cast("array<string>")
    assert spark.range(1).select(headers.spf_sender_ip(none, F.lit(None).cast("string"), none, F.lit(None).cast("string"))).first()[0] is None


def made_rows(n=60):
    import random

    r = random.Random(5)
    words = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(2000)]
    out = []
    for label in (0, 1):
        for s in "abc":
            for _ in range(n // 6):
                out.append((len(out), " ".join(r.choices(words, k=40)) + f" {label}{s}", label, f"src_{s}{label}", "f"))
    near = out[0][1]
    # a campaign in two sources, and one with both labels
    out += [(1000, near + " extra", 0, "src_b0", "f"), (1001, out[-1][1] + " more", 0, "src_a0", "f")]
    out += [(1002, "synthetic text of its own, with enough words in it to stay", 1, "synthetic_x", "f")]
    return out


def test_splits_by_campaigns_and_sources(spark):
    from corvid.operators import campaigns

    df = spark.createDataFrame(made_rows(), "ord int, text string, label int, source string, source_file string")
    rows = corpus.clean(df)
    told = campaigns.split_campaigns(rows).collect()
    by = {}
    for r in told:
        by.setdefault(r["campaign_id"], []).append(r)
    assert all(len({r["split"] for r in v}) == 1 and len({r["source"] for r in v}) == 1 and len({r["label"] for r in v}) == 1 for v in by.values())
    assert [r["split"] for r in told if r["source"] == "synthetic_x"] == ["train"]
    assert len(told) < rows.count()  # the campaign with both labels is gone, and one row of that in two sources stays
    held = campaigns.split_sources(rows, forced={"src_a0": "test"}).collect()
    splits = {}
    for r in held:
        splits.setdefault(r["source"], set()).add(r["split"])
    assert splits["src_a0"] == {"test"} and all(len(v) == 1 for v in splits.values())
    with pytest.raises(ValueError, match="three sources"):
        campaigns.split_sources(rows.where("source != 'src_c1'"))


@pytest.mark.parametrize("name", ["split_campaigns", "split_sources"])
def test_splits_take_little(spark, name):
    """What a split keeps on disk is of the size of its texts, which come back whole."""
    from pathlib import Path

    from corvid.operators import campaigns

    rows = corpus.clean(spark.createDataFrame(made_rows(), "ord int, text string, label int, source string, source_file string")).localCheckpoint()
    texts = {r["text_hash"]: r["text"] for r in rows.collect()}
    folder = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    size = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = size()
    told = getattr(campaigns, name)(rows).collect()
    assert size() - before < 12 * sum(map(len, texts.values()))
    assert len(told) > 50 and all(r["text"] == texts[r["text_hash"]] for r in told)


def test_balance_and_build(spark):
    from corvid.operators import campaigns

    df = spark.createDataFrame(made_rows() + [(2000 + i, f"one more legitimate text, number {i * 7919}, with words of its own {chr(97 + i) * 9}", 0, "src_a0", "f") for i in range(6)], "ord int, text string, label int, source string, source_file string")
    table, found = campaigns.build(df, "campaign")
    n = {r["label"]: r["count"] for r in table.where("source not like 'synthetic%'").groupBy("label").count().collect()}
    assert abs(n[0] - n[1]) <= 3 and found.where("violations > 0").count() == 0
    held = campaigns.balanced(corpus.clean(df), "source_holdout")
    per = held.groupBy("split").pivot("label", [0, 1]).count().collect()
    assert all(r["0"] == r["1"] for r in per if r["split"] != "train") or all(r["0"] is not None and r["1"] is not None for r in per)
    with pytest.raises(ValueError, match="mode"):
        campaigns.balanced(corpus.clean(df), "other")
    with pytest.raises(ValueError, match="both labels"):
        campaigns.build(df.where("label = 0"))
