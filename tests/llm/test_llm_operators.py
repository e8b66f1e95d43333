"""Operators against brute force, exact round trips, and held-out labels."""

import hashlib
import random
import struct
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from corvid.llm import html_text, langid, lattice, media, packing, pieces, quality, queries, simhash, toxicity, warc

SF = "/root/testdata/sf0.01"


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def plain_fingerprint(text):
    import re

    words = re.findall(rb"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64)) if hashes else 0


def test_fingerprints_follow_their_definition():
    rng = random.Random(1)
    words = ["A", "b", "Ça", "\xa0x", "\x1cy", "d" * 50, "Ünder", " "]
    for n in (0, 1, 2, 3, 4, 50):
        for _ in range(10):
            t = rng.choice(["", " "]).join([rng.choice(" \t\n\x0b\x0c\r") + rng.choice(words) for _ in range(n)])
            assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_close_fingerprints_connect(spark):
    rng = random.Random(2)
    fps = set()
    for _ in range(60):
        fps.add(x := rng.getrandbits(64))
        for _ in range(rng.randrange(6)):
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps |= {0, 3, 5, 1 << 63, (1 << 64) - 1, (1 << 64) - 2}
    fps = sorted(x - (1 << 64) * (x >> 63) for x in fps)
    want = components(fps, [(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2])
    from corvid.operators.graph import connected_components

    pairs = simhash.close_pairs(spark.createDataFrame([(x,) for x in fps], "fp bigint"))
    got = {x: x for x in fps} | {r["node"]: r["root"] for r in connected_components(pairs).collect()}
    assert got == want


def test_simhash_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fp = {k: plain_fingerprint(t) for k, t in docs.items()}
    want = components(docs, [(a, b) for a, b in combinations(docs, 2) if (fp[a] ^ fp[b]).bit_count() <= 2])
    got = queries.op6_simhash(spark, SF).collect()
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {k: (f"{fp[k]:016x}", want[k]) for k in docs}


def naive_best_fit(items, capacity):
    bins, out = [], []
    for size, s, c in items:
        fit = [(cap, i) for i, (cap, ss, cs) in enumerate(bins) if cap >= size and not ss & s and not cs & c and cap]
        if fit:
            cap, i = min(fit)
        else:
            cap, i = capacity, len(bins)
            bins.append((capacity, 0, 0))
        out.append((i, capacity - cap))
        bins[i] = (cap - size, bins[i][1] | s, bins[i][2] | c)
    return out


def test_best_fit():
    rng = random.Random(3)
    for _ in range(40):
        items = [(rng.randrange(0, 101), 1 << rng.randrange(6), rng.choice([0, 1 << rng.randrange(30)])) for _ in range(200)]
        items.sort(key=lambda x: -x[0])
        assert packing.best_fit(items, 100)[0] == naive_best_fit(items, 100)


def test_packing_query(spark):
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op5_packing(spark, SF).collect()
    bins, texts = {}, {}
    for r in rows:
        bins.setdefault(r["bin"], []).append(r)
        texts.setdefault(r["doc_id"], []).append(r)
    for k, d in docs.items():
        parts = sorted(texts[k], key=lambda r: r["piece"])
        assert "".join(d["text"][p["start"] : p["start"] + p["length"]] for p in parts) == d["text"]
    for b in bins.values():
        at = 0
        for r in sorted(b, key=lambda r: (r["offset"], r["length"])):
            assert r["offset"] == at
            at += r["length"]
        assert at + b[0]["room"] == packing.CAPACITY
        assert len({r["source"] for r in b}) == len(b) == len({r["cluster"] for r in b})


def test_language_held_out(spark):
    got = queries.op1_langid(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), "doc_id")
    r = got.where("held_out and lang_pred != 'und'").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("right"), F.avg(F.col("rejected").cast("int")).alias("rejected")).first()
    assert r["right"] > 0.97 and r["rejected"] < 0.005


def test_gibberish_is_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs)
    assert model.predict(["xqzjk wvqzx kjqxz " * 40, "漢字 " * 60])["rejected"].all()


def test_quality_held_out(spark):
    got = queries.op8_quality(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = ([r["score"] for r in got if r["quality"] == y] for y in (1, 0))
    assert np.mean([a > b for a in good for b in bad]) > 0.85


def test_toxicity_held_out(spark):
    got = queries.op9_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r["score"] for r in got if r["toxic"] == y] for y in (1, 0))
    assert np.mean([a > b for a in bad for b in good]) > 0.75 and np.mean([s >= 0.5 for s in good]) < 0.05


def test_kneser_ney_sums_to_one():
    rng = np.random.default_rng(4)
    codes = np.unique(rng.integers(1, 5, (200, 4)).astype(np.uint32), axis=0)
    p = toxicity.shared_probabilities(codes)
    by = {}
    for row, x in zip(codes[:, 1:], p, strict=True):
        by.setdefault(tuple(row[:-1]), {})[row[-1]] = x
    assert all(0 < sum(d.values()) <= 1 + 1e-9 for d in by.values())


def test_trees_fit_and_traverse():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(2000, len(quality.NAMES)))
    y = ((x[:, 0] > 0) ^ (x[:, 3] > 0.5)).astype(float)
    model = quality.train(x, y, trees=30)
    assert ((model.score(x) > 0.5) == y).mean() > 0.97
    one = model.score(x[:5])
    for i in range(5):
        total = model.prior
        for f, c, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if x[i, f[at]] > c[at] else 1)
            total += leaf[at - len(f)]
        assert one[i] == pytest.approx(1 / (1 + np.exp(-total)))


def test_media_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op2_media(spark, "/root/testdata/sf0.001").collect():
        raw = docs[r["doc_id"]].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        media_file = media.wav(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media_file), hashlib.sha256(media_file).hexdigest())


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")
GIF = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\xff\xff\xff\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
JPEG = b"\xff\xd8" + b"\xff\xe0\x00\x10JFIF\0\1\1\0\0\1\0\1\0\0" + b"\xff\xc0\x00\x0b\x08\0\1\0\1\1\1\x11\0" + b"\xff\xda\x00\x08\1\1\0\0\x3f\0" + b"\x12\xff\x00\x34" + b"\xff\xd9"


def test_sniffing_and_carving():
    import gzip
    import io
    import zipfile

    gz, box = gzip.compress(b"x" * 99), io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.png", PNG)
    for data, kind in ((PNG, "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (gz, "application/gzip"), (box.getvalue(), "application/zip"), (media.wav(b"ab"), "audio/wav"), (b"%PDF-1.4\nstartxref\n0\n%%EOF", "application/pdf")):
        assert media.sniff(data)[:2] == (kind, len(data))
        assert media.sniff(data[:-3])[0] == media.UNKNOWN
        assert media.sniff(b"BM RIFF" + data + b"tail GIF89a")[2][0] == (7, len(data), kind)
    assert media.sniff(b"BMRIFFGIF89aPK\x03\x04ftyp") == (media.UNKNOWN, 20, [])


def test_lattice_query_and_recall(spark):
    rng = np.random.default_rng(6)
    base = rng.normal(size=(150, 64))
    rows, i = [], 0
    for b in base:
        b /= np.linalg.norm(b)
        for cos in (0.9, 0.925, 0.931, 0.94, 0.96):
            d = rng.normal(size=64)
            d -= d @ b * b
            d /= np.linalg.norm(d)
            rows.append((i, (cos * b + np.sqrt(1 - cos * cos) * d).tolist(), int(i % 10 == 0)))
            i += 1
        rows.append((i, (3 * b).tolist(), 0))
        i += 1
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows])
    true = (x @ x.T >= 0.93) & (lab[:, None] == lab[None, :]) & ~np.eye(len(x), dtype=bool)
    got = np.array([r["n_links"] for r in lattice.near_duplicates(df).orderBy("key").collect()])
    assert (got <= true.sum(axis=1)).all() and got.sum() >= 0.99 * true.sum()


def test_lattice_points():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8)) * 2
    p = lattice.decode(x)
    assert (np.abs(p % 2 - p[:, :1] % 2) == 0).all() and (p.sum(axis=1) % 4 == 0).all()
    d = ((x - p / 2) ** 2).sum(axis=1)
    near = ((x[:, None] - (p[:, None] + lattice.minimal()[None]) / 2) ** 2).sum(axis=2).min(axis=1)
    assert (d <= near + 1e-9).all() and d.max() <= 1 + 1e-9


FAKE = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-page:666:0>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"


def test_magic_in_payloads_is_rejected(spark):
    pages = spark.createDataFrame([(i, "u", f"{i}{FAKE}" * 3 + FAKE) for i in range(50)], "page_id bigint, url string, html string")
    got = warc.visits(warc.round_trip(pages))
    want = {i: (len(t := f"{i}{FAKE}" * 3 + FAKE), hashlib.sha1(t.encode()).hexdigest()) for i in range(50)}
    assert {r["key"]: (r["payload_bytes"], r["payload_digest"]) for r in got.collect()} == want and got.count() == 50


def test_pointer_jumping():
    at, after = np.array([0, 4, 10, 20, 25, 40]), np.array([10, 20, 25, 40, 50, 44])
    assert warc.reachable(at, after).tolist() == [True, False, True, False, True, False]
    assert not warc.reachable(at + 1, after + 1).any()


def test_pieces_query(spark):
    import public_tokenizers

    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in queries.op7_pieces(spark, "/root/testdata/sf0.001").collect():
        ids = v.library.encode(docs[r["doc_id"]], add_eos=True)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["agrees"]) == (len(ids), sha(" ".join(map(str, ids))), sha(v.library.decode(ids)), True)


def test_agendas_agree():
    import public_tokenizers

    v = pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(8)
    for _ in range(300):
        t = "".join(rng.choice("ab  theinger\n\té日🙂▁.,0\0") for _ in range(rng.randrange(60)))
        ids = v.encode(t)
        assert ids == v.library.encode(t, add_eos=True) and v.decode(ids) == v.library.decode(ids)
        assert all(v.alone(u) == v.segment([u])[0] for u in v.units(t))
        some = [rng.randrange(v.library.get_piece_size()) for _ in range(8)]
        assert v.decode(some) == v.library.decode(some)


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<body><nav><a href=x>Home</a></nav><div id=content><h1>Title</h1><div class=post><p>This is a long paragraph of text.</p><p>Another&nbsp;one &amp; more.</p></div></div><div class='comments'><p>First! a comment</p></div><aside>side</aside><footer>foot</footer>", "Title\n\nThis is a long paragraph of text.\n\nAnother one & more."),
        ("<p>one<p>two <b>bold</b> x<br>y<ul><li>a<li>b</ul>", "one\n\ntwo bold x y\n\na\n\nb"),
        ("plain text only", "plain text only"),
        ("", ""),
        ("<body><article><p>Good &lt;b&gt; here<script>if (a<b) x('</p>')</script> end</p><p unclosed", "Good <b> here end"),
        ("<main><header><h1>T</h1></header><section><p>aaa bbb</p></section><section><p>ccc</p></section></main><form><p>Subscribe</p></form>", "T\n\naaa bbb\n\nccc"),
        ("<div class=content-with-sidebar><p>abc def</p></div>", "abc def"),
        ("<nav><a href=x>only</a> <a href=y>links</a></nav>", ""),
        ("<body><div class='cookie-notice'>We use cookies and say so at great length here.</div><p>Body text.</p><!-- <p>no</p> --><style>p{}</style></body>", "Body text."),
    ],
)
def test_main_text(html, text):
    assert html_text.main_text(html) == text


def test_main_text_of_pages(spark):
    import re
    from html import unescape

    for r in queries.op10_html_text(spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r["html"], re.S)[1]
        parts = (" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n\n".join(x for x in parts if x)


def test_dense_groups_count_their_links(spark):
    rng = np.random.default_rng(9)
    rows = []
    for spread in (0.004, 0.012, 0.02, 0.03, 0.04, 0.05):
        base = rng.normal(size=64)
        base /= np.linalg.norm(base)
        rows += [(base + spread * rng.normal(size=64)).tolist() for _ in range(120)]
    rows += rng.normal(size=(200, 64)).tolist()
    x = np.array(rows)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = (x @ x.T >= 0.93) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame([(i, r, 1) for i, r in enumerate(rows)], "vec_id bigint, embedding array<double>, label int")
    got = lattice.near_duplicates(df).orderBy("key").collect()
    n = np.array([r["n_links"] for r in got])
    want = components(range(len(x)), np.argwhere(np.triu(true)).tolist())
    assert (n <= true.sum(axis=1)).all() and n.sum() >= 0.99 * true.sum()
    assert sum(r["component"] != want[r["key"]] for r in got) <= 2


def test_archives_of_long_pages(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "FILE_BYTES", 1 << 20)
    rows = [(i, f"http://x/{i}", f"{i} " + "é<p>WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n</p>" * (1 if i % 5 else 20_000)) for i in range(1, 400)]
    rows += [(400, None, ""), (401, "u" * 50_000, None), (402, None, rows[9][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(2)
    warc.write(pages, str(tmp_path / "w"))
    sizes = [p.stat().st_size for p in (tmp_path / "w").rglob("part-*")]
    assert len(list((tmp_path / "w").iterdir())) > 1 and sum(s > 3 << 20 for s in sizes) == 0
    got = {r["key"]: (r["payload_bytes"], r["record_type"]) for r in warc.visits(warc.read(spark, str(tmp_path / "w"))).collect()}
    want = {k: len((h or "").encode()) for k, _, h in rows}
    assert {k: n for k, (n, _) in got.items()} == want
    assert got[10][1] == "revisit" and got[402][1] == "response"


def test_payloads_of_false_records_are_not_hashed():
    inner = b"".join(b"WARC/1.0\r\nContent-Length: %d\r\n\r\n" % (200_000 - 40 * i) for i in range(2000))
    body = inner + b"x" * 400_000
    data = b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    import time

    began = time.process_time()
    found = warc.candidates("f", data)
    assert time.process_time() - began < 2
    assert [r[-1] is not None for r in found if r[1] == 0] == [True] and all(r[-1] is None for r in found if r[1] > 0)


def test_equal_rows_are_packed_apart(spark):
    rows = [(7, "same text", "s")] * 3000 + [(None, "x", None)] * 50 + [(k, f"text {k}", "s") for k in range(100, 200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = packing.pack(docs, shard_rows=64).collect()
    assert len(got) == len(rows) and sorted(r["copy"] for r in got if r["key"] == 7) == list(range(3000))
    assert sorted(r["copy"] for r in got if r["key"] is None) == list(range(50))
    shards = {}
    for r in got:
        shards.setdefault(r["bin"].split(".")[0], []).append(r["key"])
    assert max(map(len, shards.values())) < 150


def test_lattice_recall_at_other_cosines(spark):
    rng = np.random.default_rng(3)
    for least in (0.8, 0.9, 0.97):
        rows = []
        for i in range(150):
            a = rng.normal(size=64)
            a /= np.linalg.norm(a)
            b = rng.normal(size=64)
            b -= (b @ a) * a
            b /= np.linalg.norm(b)
            c = least + 0.004
            rows += [(2 * i, "l", a.tolist()), (2 * i + 1, "l", (c * a + np.sqrt(1 - c * c) * b).tolist())]
        got = lattice.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>"), least=least)
        assert got.where("n_links > 0").count() >= 0.98 * len(rows)


def test_statistics_of_all_planes():
    s = dict(zip(quality.NAMES, quality.statistics("日本語のテキスト🙂 漢字、仮名。" * 3), strict=True))
    assert s["entropy"] > 3 and s["run"] < 1 and s["letters"] > 0.5 and s["symbols"] > 0
    plain = "Plain text, with 3 digits: 123. " * 5
    wide = dict(zip(quality.NAMES, quality.statistics(plain), strict=True))
    big = quality.TABLE
    try:
        quality.TABLE = 0  # the other way of counting
        assert wide == dict(zip(quality.NAMES, quality.statistics(plain), strict=True))
    finally:
        quality.TABLE = big


def test_counts_beyond_the_table_of_logs():
    rows = np.array([[0, 1, 70_000, 1 << 20]])
    assert np.allclose(langid.logs(rows), np.log1p(rows), rtol=1e-6) and langid.logs(rows)[0, 3] > langid.logs(rows)[0, 2]


def test_repeated_magics_cost_what_the_file_is_long():
    import time

    for magic in (b"PK\3\4PK\5\6", b"PK\3\4" + b"PK\5\6" + bytes(18), b"%PDF-1", b"%%EOF%PDF-1", b"OggS\0\2" + bytes(20) + b"\1\0", b"GIF89a1234567!a", b"\0\0\0\x08ftyp", b"\x1f\x8b\x08", b"\x89PNG\r\n\x1a\n", b"RIFF\x10\0\0\0WAVE"):
        data = magic * ((1 << 20) // len(magic))
        began = time.process_time()
        media.sniff(data)
        assert time.process_time() - began < 4, magic


def test_a_file_after_a_flac_is_carved():
    import zlib

    chunk = lambda k, d: len(d).to_bytes(4, "big") + k + d + zlib.crc32(k + d).to_bytes(4, "big")
    image = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13)) + chunk(b"IEND", b"")
    flac = b"fLaC\x80\0\0\x22" + bytes(34) + b"\xff\xf8" + bytes(50)
    assert media.sniff(b"junk" + flac + image)[2] == [(4, len(flac), "audio/flac"), (4 + len(flac), len(image), "image/png")]


def test_links_stand_within_manhattan_distance_two(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    near = base[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    fps = [int(x) for x in np.unique(np.concatenate([base, near]).view(np.int64))]
    df = spark.createDataFrame([(x,) for x in fps], "fp bigint")
    few, full = simhash.meetings(df)
    cells = {r["fp"]: r["home"] for r in few.select("fp", "home").distinct().collect()}
    pairs = {(r["a"], r["b"]) for r in simhash.close_pairs(df).collect()}
    want = {(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2}
    assert pairs == want and full.count() == 0  # no cell is full: every link is a pair of the grid
    digits = lambda c: [(c >> 3 * i) & 7 for i in range(21)]
    assert all(sum(abs(x - y) for x, y in zip(digits(cells[a]), digits(cells[b]), strict=True)) <= 2 for a, b in pairs)
