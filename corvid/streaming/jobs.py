"""Incremental jobs: windows with late data, duplicates within a time, sessions, resumed ingestion."""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.plans.session import shared_folder


def stream(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet table as a stream, `files` files to a batch; its schema is read from the files."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if where.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(where).isFile():
        # a stream's source is a folder: the file is picked from its own
        rows = reader.option("pathGlobFilter", where.getName()).parquet(where.getParent().toString())
    else:
        rows = reader.parquet(path)
    # event time has a zone: times without one are in the session's
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, kind in rows.dtypes if kind == "timestamp_ntz"})


def tumbling(events: DataFrame, width: str = "1 day", late: str = "1 hour", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Counts and sums of each window and key; rows later than `late` are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), key).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), key, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour", ts: str = "ts", key: str = "user_id") -> DataFrame:
    """Sessions of each key: rows no more than `gap` apart."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), key).agg(F.count("*").alias("n")).select(key, F.col("s.start").alias("start"), "n")


def first_within(events: DataFrame, keys: list[str], ttl: str = "30 minutes", ts: str = "ts") -> DataFrame:
    """One row of each key within ttl: state is dropped as the watermark passes."""
    return events.withWatermark(ts, ttl).dropDuplicatesWithinWatermark(keys)


def drain(out: DataFrame, mode: str = "append", name: str | None = None) -> DataFrame:
    """All that a streaming table gives for the data there is now, as a table.

    Offsets, state and results are in a folder of the shared one, called by name: a call with the same name, by this
    driver or a restarted one, goes on where the last one stopped, and reads each file once. Without a name each call is a job of its own.
    """
    spark = out.sparkSession
    base = f"{shared_folder(spark)}/stream-{name or uuid.uuid4().hex}"
    if mode == "append":
        query = out.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    else:
        # each batch replaces the table: the last one is complete
        query = out.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def snapshot(query) -> dict:
    """What is known of a streaming query, without waiting: state (running, done, error or missing), rows read so far, and the error's text."""
    if query is None:
        return {"state": "missing", "rows": 0, "error": None}
    bad = query.exception()
    state = "running" if query.isActive else "error" if bad else "done"
    return {"state": state, "rows": sum(p["numInputRows"] for p in query.recentProgress), "error": str(bad) if bad else None}


def in_group(spark: SparkSession, group: str, work, *args):
    """work(*args), its Spark jobs in a group that cancel() ends."""
    spark.sparkContext.setJobGroup(group, group, interruptOnCancel=True)
    try:
        return work(*args)
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def cancel(spark: SparkSession, group: str, *queries) -> None:
    """Ends a group's jobs, and streaming queries."""
    spark.sparkContext.cancelJobGroup(group)
    for q in queries:
        q.stop()


class Health:
    """A check's answer, kept for ttl seconds by a clock that never goes back."""

    def __init__(self, check, ttl: float = 30.0, clock=time.monotonic):
        self.check, self.ttl, self.clock, self.told = check, ttl, clock, None

    def ok(self) -> bool:
        if self.told is None or self.clock() - self.told[0] >= self.ttl:
            self.told = self.clock(), bool(self.check())
        return self.told[1]


def deltas(lines: DataFrame, line: str = "line") -> DataFrame:
    """The pieces of text that a model's stream brings, line by line: NDJSON (message.content) or server-sent events (data: choices[0].delta.content); other lines, and [DONE], bring none."""
    body = F.trim(F.regexp_replace(F.trim(line), r"^data:", ""))
    piece = F.coalesce(F.get_json_object(body, "$.message.content"), F.get_json_object(body, "$.choices[0].delta.content"))
    return lines.withColumn("piece", F.when(F.startswith(body, F.lit("{")), piece)).where(F.coalesce(F.length("piece"), F.lit(0)) > 0)


def guard_recipe(spark: SparkSession, folder: str, recipe: dict, resume: bool) -> None:
    """Writes a training run's recipe beside its state, or, to resume, holds it against the one that is there: another recipe must not go on from that state."""
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/recipe.json")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if resume:
        if not fs.exists(where):
            raise ValueError(f"no recipe in {folder}: its state must not be resumed")
        told = json.loads("\n".join(r[0] for r in spark.read.text(where.toString()).collect()))
        if other := {k: (told.get(k), v) for k, v in recipe.items() if told.get(k) != v}:
            raise ValueError(f"the state was made by another recipe: {json.dumps(other, sort_keys=True)}")
    write_text(spark, where.toString(), json.dumps(recipe, indent=2))


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as one file, in place at once: it is written under another name and then renamed."""
    jvm = spark._jvm
    where, part = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(part, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.delete(where, False)
    if not fs.rename(part, where):
        raise OSError(f"could not rename to {path}")
