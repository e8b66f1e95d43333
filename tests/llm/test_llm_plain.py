"""The queries of models against plain versions: one text, one word and one n-gram at a time, without arrays."""

import math
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest

from corvid.llm import langid, quality, queries, toxicity

SF = "/root/testdata/sf0.001"
U32 = (1 << 32) - 1


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def remainder(key, m):
    return zlib.crc32(str(key).encode()) % m


def buckets(text):
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if unicodedata.category(c)[0] == "L":
            word += c
        elif word:
            words.append(word)
            word = ""
    line = [ord(c) for c in " " + " ".join(words) + " "]
    shift = 32 - 14
    two = [(a * 0x9E3779B1 + b * 0x85EBCA77) & U32 for a, b in zip(line, line[1:], strict=False)]
    out = Counter((((t ^ t >> 13) * 0x165667B1) & U32) >> shift for t in two)
    three = [(((t ^ t >> 15) * 0xC2B2AE3D) + c * 0x27D4EB2F) & U32 for t, c in zip(two, line[2:], strict=False)]
    out.update((((t ^ t >> 16) * 0x9E3779B1) & U32) >> shift for t in three)
    return out if words else None


def test_language_query(spark, docs):
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in queries.op1_langid(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        g, c = got[r["doc_id"]], buckets(r["text"])
        assert g["held_out"] == (remainder(r["doc_id"], 3) == 1)
        if c is None:
            assert (g["lang_pred"], g["score"]) == ("und", 0)
            continue
        v = {b: math.log1p(n) * float(model.idf[b]) for b, n in c.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        near = [sum(x * float(centroid[b]) for b, x in v.items()) / size for centroid in model.centroids]
        best = max(near)
        assert g["score"] == pytest.approx(best, abs=1e-4)
        # another language only where the two are as good as equal
        assert best - max(n for n, k in zip(near, model.owner, strict=True) if model.langs[k] == g["lang_pred"]) < 1e-4


def kneser_ney(texts):
    """(ratio of each n-gram seen, ratio of each context) from (words, label) rows."""
    counts = (Counter(), Counter())
    for words, y in texts:
        for w in words:
            p = "\x01" * 3 + w + "\x01"
            counts[y].update(p[i : i + 4] for i in range(len(p) - 3))
    every = set(counts[0]) | set(counts[1])

    def discount(values):
        one, two = values.count(1), values.count(2)
        return one / (one + 2 * two) if one else 0.5

    def shared(longer):
        """Of each different tail, its probability by how many different longer ones end so."""
        n = Counter(g[1:] for g in longer)
        d = discount(list(n.values()))
        if len(next(iter(n))) == 1:
            total = sum(n.values())
            return {t: (max(k - d, 0) + d * len(n) / (len(n) + 1)) / total for t, k in n.items()}
        lower, total, kinds = shared(set(n)), Counter(), Counter()
        for t, k in n.items():
            total[t[:-1]] += k
            kinds[t[:-1]] += 1
        return {t: (max(k - d, 0) + d * kinds[t[:-1]] * lower[t[1:]]) / total[t[:-1]] for t, k in n.items()}

    back = shared(every)
    logs, left = [], []
    for c in (counts[1], counts[0]):
        d = discount([c[g] for g in every])
        total, kinds = Counter(), Counter()
        for g in every:
            total[g[:-1]] += c[g]
            kinds[g[:-1]] += c[g] > 0
        rest = {h: d * kinds[h] / total[h] if total[h] else 1.0 for h in {g[:-1] for g in every}}
        logs.append({g: math.log((max(c[g] - d, 0) / total[g[:-1]] if total[g[:-1]] else 0) + rest[g[:-1]] * back[g[1:]]) for g in every})
        left.append({h: math.log(x) for h, x in rest.items()})
    return {g: logs[0][g] - logs[1][g] for g in every}, {h: left[0][h] - left[1][h] for h in left[0]}


def test_toxicity_query(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit(docs, labels)
    told = defaultdict(list)
    for r in labels.collect():
        if r["toxic"] in (0, 1) and remainder(r["doc_id"], 5):
            told[r["doc_id"]].append(r["toxic"])
    rows = docs.collect()
    seen, unseen = kneser_ney([(toxicity.words_of(r["text"]), y) for r in rows for y in told[r["doc_id"]]])
    got = {r["doc_id"]: r for r in queries.op9_toxicity(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        best = None
        for w in set(toxicity.words_of(r["text"])):
            p = "\x01" * 3 + w + "\x01"
            ratios = [seen.get(p[i : i + 4], unseen.get(p[i : i + 3], 0.0)) for i in range(len(p) - 3)]
            best = max(sum(ratios) / len(ratios), -math.inf if best is None else best)
        z = (best or 0.0) * model.weights[0] + model.weights[1]
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3) and g["predicted"] == (g["score"] >= 0.5) and g["held_out"] == (remainder(r["doc_id"], 5) == 0)


def statistics(text):
    text = text or ""
    kinds, run, longest, last = Counter(), 0, 0, None
    for c in text:
        cat = unicodedata.category(c)
        kinds["space" if c.isspace() else "mark" if c in ".,;:!?'\"()-–—¿¡«»‘’“”" else "upper" if cat == "Lu" else "lower" if cat[0] in "LM" else "digit" if cat[0] == "N" else "symbol" if cat[0] in "PS" else "other"] += 1
        run = run + 1 if c == last else 1
        longest, last = max(longest, run), c
    n = max(1, len(text))
    words = text.split()
    w, sizes = max(1, len(words)), [len(x) for x in words] or [0]
    mean = sum(sizes) / len(sizes)
    lines = [x for x in text.split("\n") if x.strip()]
    k, weight, tally, copies = max(1, len(lines)), sum(map(len, lines)) or 1, Counter(words), Counter(lines)
    share = lambda test: sum(map(test, words)) / w
    stops = sum(x[-1] in ".!?" for x in words)
    return {
        "chars": math.log1p(len(text)), "words": math.log1p(len(words)), "word_mean": mean, "word_sd": math.sqrt(sum((x - mean) ** 2 for x in sizes) / len(sizes)), "word_max": math.log1p(max(sizes)), "upper": kinds["upper"] / n, "digits": kinds["digit"] / n, "marks": kinds["mark"] / n, "symbols": kinds["symbol"] / n, "spaces": kinds["space"] / n,
        "letters": (kinds["upper"] + kinds["lower"]) / n, "other": kinds["other"] / n, "distinct": len(tally) / w, "top_word": max(tally.values(), default=0) / w, "pairs": len(set(zip(words, words[1:], strict=False))) / max(1, w - 1), "lines": math.log1p(len(lines)), "line_mean": math.log1p(weight / k), "line_copies": 1 - len(copies) / k,
        "line_top": max((v * len(x) for x, v in copies.items() if v > 1), default=0) / weight, "line_ends": sum(x.rstrip()[-1] in ".!?:;\"'”»" for x in lines) / k, "line_bullets": sum(x.lstrip()[0] in "-*•>|#" for x in lines) / k, "entropy": -sum(v / n * math.log2(v / n) for v in Counter(text).values()), "run": math.log1p(longest),
        "wordless": share(lambda x: not any(map(str.isalpha, x))), "shouted": share(lambda x: x.isupper() and len(x) > 1), "exclaimed": share(lambda x: x[-1] == "!"), "decorated": share(lambda x: x[-1] in "#$%&*+=@^~_"), "piped": share(lambda x: x == "|"), "sentence": math.log1p(w / max(1, stops)), "short": sum(x <= 2 for x in sizes) / len(sizes),
    }


def test_quality_query(spark, docs):
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    got = {r["doc_id"]: r for r in queries.op8_quality(spark, SF).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in [*rows, {"doc_id": None, "text": "日本語 テキスト 🙂🙂 ÀÉ!\n\n- x"}, {"doc_id": None, "text": None}]:
        plain, own = statistics(r["text"]), dict(zip(quality.NAMES, quality.statistics(r["text"]), strict=True))
        assert own == pytest.approx({k: plain[k] for k in own}, abs=1e-9)
        if r["doc_id"] is None:
            continue
        total = model.prior
        for feature, cut, leaf in zip(model.feature, model.cut, model.leaf, strict=True):
            at = 0
            while at < len(feature):
                at = 2 * at + (2 if own[quality.NAMES[feature[at]]] > cut[at] else 1)
            total += leaf[at - len(feature)]
        g = got[r["doc_id"]]
        assert g["score"] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-9) and g["predicted"] == (g["score"] >= 0.7) and g["held_out"] == (remainder(r["doc_id"], 4) == 2)
