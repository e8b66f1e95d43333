"""A content classifier that stands in for a hosted model: hashed words and logistic regression, giving two logits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: frequent function words by language
FUNCTION_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "with", "was", "this", "are", "be", "it", "by"],
    "fr": ["le", "la", "les", "des", "et", "est", "une", "dans", "que", "pour", "qui", "sur", "pas", "avec", "du"],
    "de": ["der", "die", "das", "und", "ist", "nicht", "ein", "eine", "von", "mit", "den", "auf", "zu", "für", "sich"],
    "es": ["el", "los", "las", "que", "una", "por", "con", "para", "del", "su", "se", "al", "como", "no", "y"],
}


def language_guess(text: Column, least_chars: int = 20) -> Column:
    """The language with the most function words, the first at a tie; unknown for short texts and texts with none."""
    from corvid.functions.text import words

    ws = words(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+", " "))
    counts = F.array(*[F.struct(F.size(matching(ws, v)).alias("n"), F.lit(-i).alias("order"), F.lit(k).alias("lang")) for i, (k, v) in enumerate(FUNCTION_WORDS.items())])
    best = F.array_max(counts)
    return F.when((F.length(text) < least_chars) | (best["n"] == 0), "unknown").otherwise(F.coalesce(best["lang"], F.lit("unknown")))


def matching(ws: Column, known: list[str]) -> Column:
    return F.filter(ws, lambda w: w.isin(known))


def fit(rows: DataFrame, text: str = "text", label: str = "label", features: int = 1 << 16):
    """A fitted pipeline for rows (text, label)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    steps = [RegexTokenizer(inputCol=text, outputCol="tokens", pattern=r"[^\p{L}\p{N}]+"), HashingTF(inputCol="tokens", outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="tfidf"), LogisticRegression(featuresCol="tfidf", labelCol=label, maxIter=20, regParam=0.01)]
    return Pipeline(stages=steps).fit(rows.select(text, F.col(label).cast("double").alias(label)).dropna())


def logits(model, rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Rows (key, logit_neg, logit_pos)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(rows.select(key, F.coalesce(text, F.lit("")).alias(text)))
    raw = vector_to_array("rawPrediction")
    return out.select(key, raw[0].alias("logit_neg"), raw[1].alias("logit_pos"))
