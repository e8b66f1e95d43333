"""Document quality by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.plans.session import hash_below, ship

#: The most labelled rows that a model is fitted on (about; twice that at most).
FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, RIDGE, LEAST = 60, 4, 64, 0.15, 1.0, 2.0
THRESHOLD = 0.7
NAMES = (
    "chars words word_mean word_sd word_max upper digits marks symbols spaces letters other distinct top_word pairs lines line_mean line_copies line_top line_ends line_bullets "
    "entropy run wordless shouted exclaimed decorated piped sentence short"
).split()
MARKS = frozenset(".,;:!?'\"()-–—¿¡«»‘’“”")
PLANES = 0x110000
#: Texts whose code points are all below this are counted in a table, others by sorting: the numbers are the same.
TABLE = 0x3000


@cache
def classes() -> np.ndarray:
    """Of each code point: 0 lower or caseless letter or mark, 1 upper, 2 digit, 3 space, 4 punctuation, 5 symbol, 6 other."""
    out = np.zeros(PLANES, np.uint8)
    for cp in range(PLANES):
        kind = unicodedata.category(c := chr(cp))
        out[cp] = 3 if c.isspace() else 4 if c in MARKS else 1 if kind == "Lu" else 0 if kind[0] in "LM" else 2 if kind[0] == "N" else 5 if kind[0] in "PS" else 6
    return out


def statistics(text: str | None) -> list[float]:
    """The values of NAMES for a whole text; all of them are finite, and defined for null and empty texts."""
    text = text or ""
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    n = max(1, len(cp))
    if cp.max(initial=0) < TABLE:
        seen = np.bincount(cp, minlength=TABLE)
        which = np.flatnonzero(seen)
        seen = seen[which]
    else:
        which, seen = np.unique(cp, return_counts=True)
    kind = np.bincount(classes()[which], seen, 7) / n
    p = seen / n
    run = np.diff(np.flatnonzero(np.diff(cp, prepend=-1, append=-1))).max() if len(cp) else 0
    words = text.split()
    w = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    tally = Counter(words)
    wordless = shouted = exclaimed = decorated = stops = 0
    for x, k in tally.items():
        last = x[-1]
        if not last.isalnum():
            exclaimed += k * (last == "!")
            stops += k * (last in ".!?")
            decorated += k * (last in "#$%&*+=@^~_")
        if x.isupper():
            shouted += k * (len(x) > 1)
        elif not x.isalpha() and not any(map(str.isalpha, x)):
            wordless += k
    lines = [x for x in text.split("\n") if x.strip()]
    k = max(1, len(lines))
    told = Counter(lines)
    weight = sum(map(len, lines)) or 1
    ends = sum(x.rstrip()[-1] in ".!?:;\"'”»" for x in lines)
    return [
        np.log1p(len(cp)), np.log1p(len(words)), sizes.mean(), sizes.std(), np.log1p(sizes.max()), kind[1], kind[2], kind[4], kind[5], kind[3], kind[0] + kind[1], kind[6],
        len(tally) / w, max(tally.values(), default=0) / w, len(set(zip(words, words[1:], strict=False))) / max(1, w - 1), np.log1p(len(lines)), np.log1p(weight / k), 1 - len(told) / k, max((v * len(x) for x, v in told.items() if v > 1), default=0) / weight, ends / k, sum(x.lstrip()[0] in "-*•>|#" for x in lines) / k,
        float(-(p * np.log2(p)).sum()), np.log1p(run), wordless / w, shouted / w, exclaimed / w, decorated / w, tally["|"] / w, np.log1p(w / max(1, stops)), float((sizes <= 2).mean()),
    ]


@dataclass
class Model:
    """Complete trees as arrays: node i's children are 2 i + 1 and 2 i + 2; leaves come last."""

    prior: float
    feature: np.ndarray  # trees x (2 ** depth - 1)
    cut: np.ndarray  # the same shape; a value above it goes to the second child
    leaf: np.ndarray  # trees x 2 ** depth
    trained: bool = True

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1. All rows go down a tree together, a level at a time."""
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(int(np.log2(len(leaf)))):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            total += leaf[at - len(feature)]
        return 1 / (1 + np.exp(-total))


def train(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Model:
    """Boosted trees for 0/1 labels, logistic loss; splits are sought among the bins of each statistic's histogram.

    Without rows of both labels it is a model with no tree: a score of (ones + 1) / (rows + 2).
    """
    order = np.lexsort([*x.T, y]) if len(y) else np.zeros(0, int)
    x, y = x[order], y[order].astype(float)
    n, width = len(y), x.shape[1] if x.ndim == 2 else len(NAMES)
    prior = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    if not 0 < y.sum() < n:
        return Model(prior, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)), trained=False)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    total = np.full(n, prior)
    inner = 2**depth - 1
    features, edges, leaves = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    for t in range(trees):
        p = 1 / (1 + np.exp(-total))
        grad, hess = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best = np.zeros(nodes)
            best_f, best_b = np.zeros(nodes, int), np.full(nodes, BINS)
            for f in range(width):
                g = np.bincount(local * BINS + bins[:, f], grad, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                h = np.bincount(local * BINS + bins[:, f], hess, nodes * BINS).reshape(nodes, BINS).cumsum(axis=1)
                gs, hs = g[:, -1:], h[:, -1:]
                gain = g**2 / (h + RIDGE) + (gs - g) ** 2 / (hs - h + RIDGE) - gs**2 / (hs + RIDGE)
                gain = np.where((h >= LEAST) & (hs - h >= LEAST), gain, 0)[:, : len(cuts[f])]
                if gain.shape[1]:
                    b = gain.argmax(axis=1)
                    better = (top := gain[np.arange(nodes), b]) > best + 1e-12
                    best, best_f, best_b = np.where(better, top, best), np.where(better, f, best_f), np.where(better, b, best_b)
            features[t, first : first + nodes] = best_f
            edges[t, first : first + nodes] = [cuts[f][b] if b < BINS else np.inf for f, b in zip(best_f, best_b, strict=True)]
            at = 2 * at + 1 + (bins[np.arange(n), best_f[local]] > best_b[local])
        local = at - inner
        g, h = np.bincount(local, grad, inner + 1), np.bincount(local, hess, inner + 1)
        leaves[t] = RATE * g / (h + RIDGE)
        total += leaves[t][local]
    return Model(prior, features, edges, leaves)


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> Model:
    """A model of about fit_rows labelled rows that are not held out, chosen by a hash of key.

    Rows with a null key or a label other than 0 and 1 are ignored; a key with several labels counts with each.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and key is not null")
    known = known.where(~held_out("key"))
    chosen = known.where(hash_below("key", fit_rows / max(1, known.count()))).limit(2 * fit_rows)
    # at most 2 * fit_rows rows of 12 bytes are broadcast
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key").select("y", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [np.array(statistics(t)).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary())], ["y", "x"])

    got = rows.mapInArrow(run, "y int, x binary").limit(4 * fit_rows).collect()
    x = np.stack([np.frombuffer(r["x"]) for r in got]) if got else np.zeros((0, len(NAMES)))
    return train(x, np.array([r["y"] for r in got], float))


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> score."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(shared.value.score(np.array([statistics(t) for t in texts], float).reshape(-1, len(NAMES))))

    return run


def grade(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, held_out, score, predicted) for the rows of docs: score is the probability of label 1 from the whole text.

    Null texts score as empty ones. Repeated rows give repeated rows; other columns are not read.
    """
    r = scorer(docs.sparkSession, model)(F.col(text)).alias("score")
    return docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), r).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score threshold or more, with docs' columns; all of them if the model had no labels of both kinds to learn from."""
    return docs.where(scorer(docs.sparkSession, model)(docs[text]) >= threshold) if model.trained else docs
