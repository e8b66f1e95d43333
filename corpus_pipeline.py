"""The corpus pipeline: quality, language, near-duplicates, packing. Each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvid.llm import langid, packing, quality, shingles
from corvid.llm.warc import remove
from corvid.plans.session import cut, shared_folder, table

#: The packing's search and the classifiers cannot be written in SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores 0.7 or more; it learns from `labels` rows that are not held out."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within a centroid's radius; those without a letter go."""
    return langid.keep_known(docs, langid.fit(docs))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (similarity of 5-word shingles 0.8 or more), the document with the least doc_id.

    Fingerprints of whole texts (by the popcount grid) and of parts of their shingles bring texts together; shingles decide.
    """
    return shingles.keep_one(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: the rows of packing.pack_near."""
    return packing.pack_near(docs).withColumnRenamed("key", "doc_id")


STAGES = [("quality classifier", quality_stage), ("language ID", language_stage), ("SimHash near-dedup", simhash_stage), ("best-fit packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packing of `documents` in sf_dir. Every stage but the last is written as Parquet to the shared folder and read again; the folder is removed at the end.

    Defined cases: null and empty texts are scored as empty ones, and language ID rejects them as texts without a letter; of rows that repeat
    a doc_id and a text one stays; other columns go through the stages but are not in the result; an empty table gives an empty table.
    """
    import uuid

    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    try:
        for i, (_, stage) in enumerate(STAGES[:-1]):
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}")
            docs = spark.read.parquet(f"{base}/{i}")
        return cut(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        remove(spark, base)
