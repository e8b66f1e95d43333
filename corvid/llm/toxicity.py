"""Toxicity by class-conditional Kneser-Ney models over the letters of words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.plans.session import hash_below, ship, small_enough

ORDER = 4
#: One in so many learning rows is set aside from the counts; of those, about so many fit the scale of the scores.
ASIDE, FIT_ROWS = 6, 6000
#: Bounds of memory only: words that are looked up at once, and words that a worker remembers.
TOGETHER, REMEMBERED = 1 << 17, 1 << 17
WORD = re.compile(r"\w+")
EDGE = 1  # the code that stands before a word's first letter and after its last
THRESHOLD = 0.5
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def each_word(text: str | None) -> Iterator[str]:
    """words_of, without a list of all words where the text is long."""
    return iter(words_of(text)) if len(text or "") < TOGETHER else (m[0] for m in WORD.finditer(text.lower()))


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of each word as rows of ORDER codes, and the place of its word."""
    if not words:
        return np.zeros((0, ORDER), np.uint32), np.zeros(0, np.int64)
    pad = chr(EDGE) * (ORDER - 1)
    cp = np.frombuffer("".join([pad + w + chr(EDGE) for w in words]).encode("utf-32-le", "replace"), "<u4")
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1  # n-grams of each word
    own = np.repeat(np.arange(len(words)), sizes)
    starts = np.arange(sizes.sum()) + own * (ORDER - 1)
    return cp[starts[:, None] + np.arange(ORDER)], own


def mixed(codes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of codes."""
    h = np.zeros(len(codes), np.uint64)
    for i in range(codes.shape[1]):
        h = (h ^ (codes[:, i].astype(np.uint64) * MULTIPLIERS[i])) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
    return h


def named(codes: np.ndarray) -> np.ndarray:
    """Each row of codes as one value that no other row has; codes need 21 bits."""
    out = np.zeros(len(codes), [("a", np.uint64), ("b", np.uint64)])
    for i in range(codes.shape[1]):
        field, shift = ("a", 21 * i) if i < 3 else ("b", 21 * (i - 3))
        out[field] |= codes[:, i].astype(np.uint64) << np.uint64(shift)
    return out


@dataclass
class Ratios:
    """The ratio of each row of codes that was seen, and no other's: the table has a row for each, however many there are."""

    hashes: np.ndarray  # sorted
    codes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, codes: np.ndarray, values: np.ndarray) -> Ratios:
        """codes: without repeats."""
        order = np.lexsort([*codes.T, mixed(codes)])
        return cls(mixed(codes)[order], codes[order], values[order].astype(np.float32))

    def find(self, codes: np.ndarray, missing: float) -> np.ndarray:
        out = np.full(len(codes), missing, np.float32)
        if len(self.hashes):
            h = mixed(codes)
            at, left = np.searchsorted(self.hashes, h), np.arange(len(codes))
            while len(left):  # goes on only where other codes have the same 64 bits
                left = left[at[left] < len(self.hashes)]
                left = left[self.hashes[at[left]] == h[left]]
                same = (self.codes[at[left]] == codes[left]).all(axis=1)
                out[left[same]] = self.values[at[left[same]]]
                left = left[~same]
                at[left] += 1
        return out


@dataclass
class Model:
    """Log-likelihood ratios (toxic to ordinary) of seen n-grams, and of unseen ones by their context; and the score's scale and offset."""

    seen: Ratios  # of n-grams
    unseen: Ratios  # of contexts
    weights: np.ndarray = None

    def word_ratios(self, words: list[str]) -> np.ndarray:
        """For each word, the ratio of its two likelihoods' logarithms for each of its n-grams."""
        codes, own = grams(words)
        r = self.seen.find(codes, np.nan)
        none = np.isnan(r)
        if none.any():
            r[none] = self.unseen.find(codes[none, :-1], 0.0)
        return np.bincount(own, r, len(words)) / np.bincount(own, minlength=len(words))

    def ratios(self, texts, known: dict[str, float] | None = None) -> np.ndarray:
        """Of each text, the greatest of its words' length-normalised log-likelihood ratios; of texts without words, the ratio of equal likelihoods, 0.

        known: ratios of words that were met before. About TOGETHER words are looked up at once, of however few or many texts.
        """
        known = {} if known is None else known
        out = np.full(len(texts), -np.inf)
        words: list[str] = []
        texts_of: list[tuple[int, int]] = []

        def flush():
            if not words:
                return
            fresh = {w for w in words if w not in known}
            if len(known) + len(fresh) > REMEMBERED:
                known.clear()
                fresh = set(words)
            if fresh := sorted(fresh):
                known.update(zip(fresh, self.word_ratios(fresh).tolist(), strict=True))
            r = np.fromiter(map(known.__getitem__, words), np.float64, len(words))
            ends = np.cumsum([n for _, n in texts_of])
            most = np.maximum.reduceat(r, ends - [n for _, n in texts_of])
            np.maximum.at(out, [i for i, _ in texts_of], most)
            words.clear()
            texts_of.clear()

        for i, text in enumerate(texts):
            cut = each_word(text)
            while some := list(islice(cut, TOGETHER - len(words))):
                texts_of.append((i, len(some)))
                words += some
                if len(words) >= TOGETHER:
                    flush()
        flush()
        return np.where(np.isinf(out), 0.0, out)

    def score(self, texts, known: dict[str, float] | None = None) -> np.ndarray:
        z = self.ratios(texts, known) * self.weights[0] + self.weights[1]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def discount(counts: np.ndarray) -> float:
    one, two = (counts == 1).sum(), (counts == 2).sum()
    return float(one / (one + 2 * two)) if one else 0.5


def grouped(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows without repeats: (one row of each kind, each row's kind, rows of each kind)."""
    _, first, kind, n = np.unique(named(codes), return_index=True, return_inverse=True, return_counts=True)
    return codes[first], kind, n


def shared_probabilities(codes: np.ndarray) -> np.ndarray:
    """Kneser-Ney probability of each row's last code after the others, by how many different codes rows' tails follow.

    codes: n-grams without repeats. Both classes back off to these.
    """
    tails, kind, n = grouped(codes)
    if tails.shape[1] == 1:
        d = discount(n)
        p = (np.maximum(n - d, 0) + d * len(n) / (len(n) + 1)) / n.sum()
        return p[kind]
    lower = shared_probabilities(tails[:, 1:]) if tails.shape[1] > 1 else None
    _, context, _ = grouped(tails[:, :-1])
    total, types = np.bincount(context, n), np.bincount(context)
    d = discount(n)
    p = (np.maximum(n - d, 0) + d * types[context] * lower) / total[context]
    return p[kind]


def train(codes: np.ndarray, toxic: np.ndarray, ordinary: np.ndarray) -> Model:
    """The two models' ratios from n-grams (without repeats) and their counts in either class.

    P(x | h) = (max(c(hx) - D, 0) + D N(h) S(x | h')) / c(h): c and N are counts and kinds in the class, S is
    shared by the classes. What neither class has seen has the ratio of what the two leave for such.
    """
    seen = unseen = Ratios.of(codes[:0], np.zeros(0))
    if len(codes) and toxic.sum() and ordinary.sum():
        shared = shared_probabilities(codes[:, 1:][np.argsort(mixed(codes))])[np.argsort(np.argsort(mixed(codes)))]
        heads, context, _ = grouped(codes[:, :-1])
        logs = []
        for c in (toxic, ordinary):
            d = discount(c)
            total, types = np.bincount(context, c, len(heads)), np.bincount(context, c > 0, len(heads))
            left = np.where(total > 0, d * types / np.maximum(total, 1), 1.0)
            held = np.where(total[context] > 0, np.maximum(c - d, 0) / np.maximum(total[context], 1), 0)
            logs.append((np.log(held + left[context] * shared), np.log(left)))
        seen = Ratios.of(codes, logs[0][0] - logs[1][0])
        unseen = Ratios.of(heads, logs[0][1] - logs[1][1])
    return Model(seen, unseen)


def scale(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of a logistic regression; a constant score of 0 without both classes."""
    if not 0 < y.sum() < len(y):
        return np.array([0.0] * x.shape[1] + [-1000.0])
    a = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    ridge = np.diag([1e-3 * len(y) * s for s in [*(x.var(axis=0) + 1e-12), 0]]) + 1e-9 * np.eye(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge, a.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


#: Words that a counting task gathers before it passes their n-grams on: a bound of memory only.
GATHERED = 1 << 18


def count(rows: DataFrame) -> pa.Table:
    """The n-grams of rows (text, y, aside) with their counts in either class, and in either class of the rows set aside: (gram, ordinary, toxic, ordinary_aside, toxic_aside), by gram.

    Each task counts words, then the n-grams of different words, so that what is shuffled is a row for each n-gram and task.
    """
    names = ("ordinary", "toxic", "ordinary_aside", "toxic_aside")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = [Counter() for _ in names]

        def told():
            words = sorted(set().union(*tally))
            codes, own = grams(words)
            _, first, inverse = np.unique(named(codes), return_index=True, return_inverse=True)
            text = codes[first].astype("<u4").tobytes().decode("utf-32-le")
            kinds = [text[i : i + ORDER] for i in range(0, len(text), ORDER)]
            sums = [np.bincount(inverse, np.fromiter((t[w] for w in words), np.float64, len(words))[own], len(first)).astype(np.int64) for t in tally]
            for t in tally:
                t.clear()
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), *map(pa.array, sums)], ["gram", *names])

        for b in batches:
            for text, y, aside in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = each_word(text.as_py())
                while some := list(islice(words, GATHERED)):
                    tally[y + 2 * aside].update(some)
                    if sum(map(len, tally)) > GATHERED:
                        yield told()
        if any(tally):
            yield told()

    rows = rows if "aside" in rows.columns else rows.withColumn("aside", F.lit(0))
    parts = rows.select("text", "y", "aside").mapInArrow(run, f"gram string, {', '.join(f'{n} bigint' for n in names)}")
    # a row for each different n-gram comes to the driver: they grow with the input
    return parts.groupBy("gram").agg(*[F.sum(n).alias(n) for n in names]).toArrow().sort_by("gram")


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model of all labelled rows that are not held out.

    The scale and offset of its scores are fitted on about fit_rows of the rows set aside, by a model that has
    not counted them; then those are counted too. Rows with a null key or a label other than 0 and 1 are ignored; a key
    with several labels counts with each. Without rows of both labels every score is 0.
    """
    ship(docs.sparkSession)
    known = labels.select(F.col(key).alias("key"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and key is not null").where(~held_out("key"))
    known = known.withColumn("aside", (F.pmod(F.xxhash64("key", F.lit(7)), F.lit(ASIDE)) == 0).cast("int"))
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def of(rows: DataFrame) -> DataFrame:
        # beyond that size both sides are shuffled by key
        return texts.join(F.broadcast(rows) if small_enough(rows, 16) else rows, "key")

    table = count(of(known))
    codes = np.frombuffer("".join(table["gram"].to_pylist()).encode("utf-32-le"), "<u4").reshape(-1, ORDER)
    ordinary, toxic, ordinary_aside, toxic_aside = (table[n].to_numpy().astype(float) for n in table.column_names[1:])
    del table
    early = ordinary + toxic > 0
    model = train(codes[early], toxic[early], ordinary[early])

    def scaled(sample: DataFrame) -> np.ndarray | None:
        """The scale and offset for the ratios of a sample of rows; None if it has not both labels."""
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b.column(1), pa.array(shared.value.ratios(b.column(0).to_pylist()))], ["y", "x"])

        chosen = sample.where(hash_below("key", fit_rows / max(1, sample.count()))).limit(2 * fit_rows)
        got = np.array(sorted((r["x"], r["y"]) for r in of(chosen).select("text", "y").mapInArrow(run, "y int, x double").limit(4 * fit_rows).collect()))
        shared.destroy()
        return scale(got[:, :1], got[:, 1]) if len(got) and 0 < got[:, 1].sum() < len(got) else None

    weights = scaled(known.where("aside = 1"))
    model = train(codes, toxic + toxic_aside, ordinary + ordinary_aside)
    if weights is None:
        weights = scaled(known)
    model.weights = scale(np.zeros((0, 1)), np.zeros(0)) if weights is None else weights
    return model


def scorer(spark: SparkSession, model: Model):
    """A column function: text -> score."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known: dict[str, float] = {}
        for texts in batches:
            yield pd.Series(shared.value.score(texts, known))

    return run


def grade(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (key, held_out, score, predicted) for the rows of docs: score grows with the length-normalised log-likelihood of the text's most toxic word under the toxic model, less that under the ordinary one.

    The whole text is compared, word by word: a long text's few toxic words are not outweighed by the rest. A word's n-grams do not
    cross its edges, so what ordinary words say together is not seen.

    Null texts, and texts without words, score as texts whose likelihoods are the same. Repeated rows give repeated rows; other
    columns are not read.
    """
    r = scorer(docs.sparkSession, model)(F.col(text)).alias("score")
    return docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), r).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
