"""Tables in and out: named sources with their policy, checksums, and sinks that are in place at once."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.functions.text import normalize, parse_label, text_hash
from corvid.operators import corpus
from corvid.sources import messages
from corvid.streaming.jobs import write_text

COLUMNS = ["text", "label", "source", "source_file", "text_hash"]


def required(rows: DataFrame, *columns: str) -> DataFrame:
    """rows, if it has all columns; a ValueError that names those it lacks."""
    if lacking := [c for c in columns if c not in rows.columns]:
        raise ValueError(f"columns are missing: {', '.join(lacking)}")
    return rows


def strict_label(value):
    """parse_label, but a value that is neither label ends the job."""
    label = parse_label(value)
    return F.when(label.isNull(), F.raise_error(F.concat(F.lit("not a label: "), F.coalesce(value.cast("string"), F.lit("null")))).cast("int")).otherwise(label)


def labelled(spark: SparkSession, path: str, text: str, label: str, source: str) -> DataFrame:
    """A CSV of texts with labels as corpus rows."""
    rows = required(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path), text, label)
    return rows.select(F.col(text).alias("text"), F.col(label).alias("label"), F.lit(source).alias("source"), F.col("_metadata.file_name").alias("source_file"))


def mail(spark: SparkSession, path: str, label: int, source: str, wanted: str = "", most: int | None = None) -> DataFrame:
    """The messages of archives as corpus rows; messages that can't be parsed are left out, and `most` bounds how many members of each archive are read."""
    raw = messages.archive(spark, path, wanted, most)
    return messages.training_text(messages.parse_messages(raw)).select("text", F.lit(str(label)).alias("label"), F.lit(source).alias("source"), "source_file")


#: How each named source is read from a local path: (spark, path) -> corpus rows.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "spamassassin": lambda spark, path: mail(spark, path, 0, "spamassassin"),
    "nazario": lambda spark, path: mail(spark, path, 1, "nazario"),
    "enron": lambda spark, path: mail(spark, path, 0, "enron", most=10_000),
    "phishing_pot": lambda spark, path: mail(spark, path, 1, "phishing_pot", wanted="/email/"),
    "zenodo_validation_2024": lambda spark, path: labelled(spark, path, "Email Text", "Email Type", "zenodo_validation_2024"),
    "kaggle_phishing_email": lambda spark, path: labelled(spark, path, "text_combined", "label", "kaggle_phishing_email"),
}


def ingest(spark: SparkSession, paths: dict[str, list[str]], readers: dict | None = None, all_or_nothing: bool = True) -> tuple[DataFrame | None, list[dict]]:
    """(rows, report): the corpus rows of named sources in their order, each source once, and for each path its status.

    Refused sources are reported and not read. A path that can't be read is an error of its own: with all_or_nothing no
    rows come back then, else those of the other paths.
    """
    readers = readers or READERS
    told, refused = corpus.source_policy(list(paths))
    report = [{"source": s, "path": None, "status": "refused", "error": None} for s in refused]
    parts = []
    for name in told:
        for path in paths[name]:
            try:
                if name not in readers:
                    raise KeyError(f"unknown source: {name}")
                rows = readers[name](spark, path)
                rows.limit(1).count()
                parts.append(rows)
                report.append({"source": name, "path": path, "status": "read", "error": None})
            except Exception as bad:  # one source's fault is told, not raised
                report.append({"source": name, "path": path, "status": "error", "error": str(bad).splitlines()[0][:300]})
    if not parts or all_or_nothing and any(r["status"] == "error" for r in report):
        return None, report
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ord", F.monotonically_increasing_id()), report


def verified(spark: SparkSession, path: str, sha256: str) -> str:
    """path, if the file's SHA-256 is the one expected; a ValueError otherwise."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]
    if found != sha256.lower():
        raise ValueError(f"{path}: SHA-256 is {found}, not {sha256}")
    return path


def load_rows(spark: SparkSession, path: str) -> DataFrame:
    """A staged table, normalized anew, with hashes."""
    rows = required(spark.read.parquet(path), "text", "label")
    n = rows.withColumn("text", normalize(F.col("text"))).withColumn("label", parse_label(F.col("label")))
    return n.withColumn("text_hash", text_hash(F.col("text")))


def known_labels(rows: DataFrame) -> DataFrame:
    """(text_hash, label): the label that each staged text has, the last one by label where it has several."""
    return rows.groupBy("text_hash").agg(F.max("label").alias("label"))


def for_training(rows: DataFrame, text: str = "xt_combined") -> DataFrame:
    """(text, label) of a custom table, without rows that have no text."""
    return required(rows, text, "label").select(F.col(text).alias("text"), "label").dropna(subset=["text"])


# ------------------------------------------------------------------ sinks


def replace_folder(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes to a folder beside path and renames it: readers see the old table or the new one, whole."""
    jvm = spark._jvm
    part = f"{path.rstrip('/')}.{uuid.uuid4().hex}.part"
    write(part)
    where, made = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(part)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(where, True)
    if not fs.rename(made, where):
        raise OSError(f"could not rename to {path}")


def save_rows(rows: DataFrame, path: str) -> None:
    """A staging table: normalized anew, columns in a fixed order."""
    n = required(rows, "text", "label").withColumn("text", normalize(F.col("text")))
    for c in ("source", "source_file"):
        n = n if c in n.columns else n.withColumn(c, F.lit(""))
    n = n.withColumn("text_hash", text_hash(F.col("text"))).select(COLUMNS)
    replace_folder(rows.sparkSession, path, lambda p: n.write.parquet(p))


def save_csv(rows: DataFrame, path: str) -> None:
    """A table as CSV with a header; nested columns are written as JSON."""
    flat = [F.to_json(c).alias(c) if kind.startswith(("struct", "array", "map")) else F.col(c) for c, kind in rows.dtypes]
    replace_folder(rows.sparkSession, path, lambda p: rows.select(flat).write.option("header", True).option("escape", '"').csv(p))


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Each table as a CSV folder of its name."""
    for name, rows in tables.items():
        save_csv(rows, f"{folder.rstrip('/')}/{name}")


def as_json(rows: DataFrame, key: str, *left_out: str) -> DataFrame:
    """(key, report): each row as one JSON text, without binary columns and those left out."""
    kept = [c for c, kind in rows.dtypes if kind != "binary" and c not in left_out]
    return rows.select(F.col(key), F.to_json(F.struct(*kept)).alias("report"))


def save_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small document, as a model's card or calibration."""
    write_text(spark, path, json.dumps(value, indent=2, ensure_ascii=False))
