"""What every job needs of the session: the checkpoint folder, the package on the workers, checked table reads."""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Python workers find this package, whatever folder the driver was started in."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{ROOT}:{env['PYTHONPATH']}" if env.get("PYTHONPATH") else ROOT


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(named)
        return named.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(made := tempfile.mkdtemp(prefix="corvid-"))
    return made


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs a read and not the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_enough(df: DataFrame, row_bytes: int, most_bytes: int = 32 << 20) -> bool:
    """Whether df, of rows of row_bytes, may be broadcast. Counts df: give it something cheap or checkpointed."""
    return df.limit(most_bytes // row_bytes + 1).count() * row_bytes <= most_bytes


def hash_below(column, share: float):
    """A condition that holds for about `share` of a column's values, always the same ones."""
    return F.lit(True) if share >= 1 else F.pmod(F.xxhash64(column), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files make fewer partitions than there are: a small table whose rows cost much to work on. A table of many files is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() * 2 <= cores else df
