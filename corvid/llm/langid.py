"""Language identification by nearest centroid over hashed character n-grams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.plans.session import ship

UNKNOWN = "und"
BUCKETS = 1 << 14
CENTROIDS = 4
#: The most documents of a language, and of all languages, that a model is fitted on (about; twice that at most).
FIT_ROWS, FIT_ALL = 600, 6000
#: A text is rejected if its closeness to its centroid is below this share of the least one among its language's texts.
SLACK = 0.5
#: N-grams up to which a text's cosine is expected to grow, with the square root of their number.
ENOUGH = 1500
BLOCK = 128
RESULT = "lang string, score double, distance double, rejected boolean"


@cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x110000)])


def counts(text: str | None) -> np.ndarray | None:
    """Bucket counts of the character bigrams and trigrams of a text's lower-cased words; None without a letter."""
    cp = np.frombuffer((" " + (text or "").lower() + " ").encode("utf-32-le", "replace"), "<u4")
    word = letters()[np.minimum(cp, 0x10FFFF)]
    if not word.any():
        return None
    stay = word.copy()
    stay[1:] |= word[:-1]
    stay[:-1] |= word[1:] & (np.cumsum(word)[:-1] == 0)
    cp = np.where(word, cp, np.uint32(32))[stay]
    two = cp[:-1] * np.uint32(0x9E3779B1) + cp[1:] * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(15))) * np.uint32(0xC2B2AE3D) + cp[2:] * np.uint32(0x27D4EB2F)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    both = np.concatenate([((two ^ (two >> np.uint32(13))) * np.uint32(0x165667B1)) >> shift, ((three ^ (three >> np.uint32(16))) * np.uint32(0x9E3779B1)) >> shift])
    return np.bincount(both, minlength=BUCKETS)


LOGS = np.log1p(np.arange(1 << 16)).astype(np.float32)


def logs(rows: np.ndarray) -> np.ndarray:
    """log(1 + n) of counts; those that the table does not hold are computed."""
    top = len(LOGS) - 1
    if rows.max(initial=0) <= top:
        return LOGS[rows]
    return np.where(rows <= top, LOGS[np.minimum(rows, top)], np.log1p(rows)).astype(np.float32)


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    langs: list[str]  # sorted; of each centroid, owner has the place of its language here
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    least: np.ndarray  # the closeness below which a centroid rejects

    def vectors(self, rows: np.ndarray) -> np.ndarray:
        return unit(logs(rows) * self.idf)

    def predict(self, texts) -> pd.DataFrame:
        out = pd.DataFrame({"lang": [UNKNOWN] * len(texts), "score": 0.0, "distance": 1.0, "rejected": True})
        lang, score, rejected = out["lang"].to_numpy(object), np.zeros(len(texts)), np.ones(len(texts), bool)
        kept, at = [], []
        for i, text in enumerate(texts):
            if (c := counts(text)) is not None:
                kept.append(c)
                at.append(i)
            if kept and (len(kept) == BLOCK or i == len(texts) - 1):
                if not self.langs:
                    rejected[at] = False
                else:
                    near = self.vectors(np.stack(kept)) @ self.centroids.T
                    best = near.argmax(axis=1)
                    cos = near[np.arange(len(at)), best]
                    lang[at] = [self.langs[k] for k in self.owner[best]]
                    score[at] = np.clip(cos, 0, 1)
                    rejected[at] = closeness(cos, np.array([c.sum() for c in kept])) < self.least[best]
                kept, at = [], []
        return pd.DataFrame({"lang": lang, "score": score, "distance": 1 - score, "rejected": rejected})


def closeness(cos: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Cosines made comparable between texts of few and of many n-grams."""
    return cos / np.sqrt(np.clip(grams / ENOUGH, 1e-9, 1))


def clusters(x: np.ndarray, k: int, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from rows at equal steps of likeness to the mean; (centroids, each row's centroid)."""
    order = np.argsort(x @ x.mean(axis=0), kind="stable")
    c = x[order[np.linspace(0, len(x) - 1, 2 * k + 1).astype(int)[1::2]]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([unit(x[own == j].mean(axis=0, keepdims=True))[0] if (own == j).any() else c[j] for j in range(k)])
    return c, (x @ c.T).argmax(axis=1)


def train(rows: list[tuple[str, bytes, bytes]]) -> Model:
    """A model of (language, buckets, their counts) rows, as packed() gives them; their order does not matter."""
    rows = sorted(rows)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model([], np.ones(BUCKETS, np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0))
    seen = sum(np.bincount(np.frombuffer(r[1], "<u2"), minlength=BUCKETS) for r in rows)
    model = Model(langs, (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32), np.zeros((0, BUCKETS), np.float32), np.zeros(0, int), np.zeros(0))
    all_c, owner, least = [], [], []
    for i, lang in enumerate(langs):
        own_rows = np.zeros((sum(r[0] == lang for r in rows), BUCKETS), np.int32)
        for row, (_, at, n) in zip(own_rows, (r for r in rows if r[0] == lang), strict=True):
            row[np.frombuffer(at, "<u2")] = np.frombuffer(n, "<u4")
        x = model.vectors(own_rows)
        c, own = clusters(x, min(CENTROIDS, len(x)))
        radius = SLACK * closeness((x * c[own]).sum(axis=1), own_rows.sum(axis=1)).min()
        all_c.append(c)
        owner += [i] * len(c)
        least += [radius] * len(c)
    model.centroids, model.owner, model.least = np.concatenate(all_c).astype(np.float32), np.array(owner), np.array(least)
    return model


def packed(c: np.ndarray) -> tuple[bytes, bytes]:
    """The buckets that counts has, and their counts."""
    at = np.flatnonzero(c)
    return at.astype("<u2").tobytes(), c[at].astype("<u4").tobytes()


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", fit_rows: int = FIT_ROWS, fit_all: int = FIT_ALL) -> Model:
    """A model of about fit_rows texts of each language (and fit_all in all), chosen by a hash of key.

    Only rows that are not held out and have a lang and a letter count. Without any, the model knows no
    language, and predicts `und` without rejecting texts that have letters.
    """
    ship(docs.sparkSession)
    rows = docs.where(~held_out(key) & F.col(lang).isNotNull())
    sizes = {r["lang"]: r["n"] for r in rows.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(fit_all).collect()}
    each = min(fit_rows, max(1, fit_all // max(1, len(sizes))))
    share = F.lit(0.0)
    for k, n in sizes.items():
        share = F.when(F.col(lang) == k, F.lit(min(1.0, each / n))).otherwise(share)
    chosen = rows.where(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < share * float(1 << 30)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(k, *packed(c)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (c := counts(t)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.binary(), pa.binary()))], ["lang", "at", "n"])

    return train([(r["lang"], bytes(r["at"]), bytes(r["n"])) for r in chosen.mapInArrow(run, "lang string, at binary, n binary").limit(2 * fit_all).collect()])


def predictor(spark: SparkSession, model: Model):
    """A column function: text -> struct of RESULT."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield shared.value.predict(texts.tolist())

    return run


def identify(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, held_out, lang, score, distance, rejected) for the rows of docs.

    The language is that of the centroid with the greatest cosine (the first in order of
    languages at a tie), score the cosine and distance 1 - score. Texts farther from it than the centroid's
    radius allows are rejected. Null texts and texts without a letter are `und`, at score 0, rejected.
    Texts are read whole; repeated rows give repeated rows; other columns are not read.
    """
    r = predictor(docs.sparkSession, model)(F.col(text)).alias("r")
    return docs.select(F.col(key).alias("key"), held_out(key).alias("held_out"), r).select("key", "held_out", "r.*")


def keep_known(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with docs' columns."""
    return docs.where(~predictor(docs.sparkSession, model)(docs[text])["rejected"])
