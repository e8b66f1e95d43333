"""Conflict-constrained best-fit packing of documents into fixed-size sequences."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm import simhash
from corvid.operators.corpus import rank_within
from corvid.plans.session import cut, ship, small_enough

CAPACITY = 8192
#: Documents of a shard. Shards are packed apart: this bounds a task's memory and, at worst, its quadratic search.
SHARD_ROWS = 4096
FIELDS = "key {key}, copy int, source string, cluster bigint, piece int, start bigint, length bigint, bin string, offset bigint, room bigint"


def best_fit(items: list[tuple[int, int, int]], capacity: int) -> tuple[list[tuple[int, int]], list[int]]:
    """Places items (size, source bit, cluster bit), largest first as given: [(bin, offset)] and each bin's residual.

    Open bins stand in an order of (residual, number), each with a bitmap of its sources and one of its
    clusters. The search starts at the least residual that holds the item and goes on to the
    next successor until neither bitmap has the item's bit: that is the tightest compatible bin. With
    none, a bin is opened.
    """
    order: list[tuple[int, int]] = []
    sources: list[int] = []
    clusters: list[int] = []
    residual: list[int] = []
    placed = []
    for size, source, cluster in items:
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & source or clusters[order[at][1]] & cluster):
            at += 1
        if at < len(order):
            left, b = order.pop(at)
        else:
            left, b = capacity, len(residual)
            residual.append(capacity)
            sources.append(0)
            clusters.append(0)
        placed.append((b, capacity - left))
        residual[b] = left - size
        sources[b] |= source
        clusters[b] |= cluster
        if residual[b]:
            insort(order, (residual[b], b))
    return placed, residual


def pack_shard(rows: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """A shard's documents as pieces in bins; the order of rows does not matter."""
    rows = rows.sort_values(["key", "copy", "source", "cluster", "size"], na_position="first").reset_index(drop=True)
    shard = int(rows["shard"].iloc[0]) if len(rows) else 0
    source_bit: dict = {}
    cluster_bit: dict = {}
    out, rest, n_full = [], [], 0
    for i, (key, source, cluster, size) in enumerate(zip(rows["key"], rows["source"], rows["cluster"], rows["size"], strict=True)):
        full, tail = divmod(int(size), capacity)
        for k in range(full):
            out.append((i, k, k * capacity, capacity, f"{shard}.full{n_full}", 0, 0))
            n_full += 1
        if tail or not full:
            # a null source conflicts with no source
            s = 0 if source is None or source != source else 1 << source_bit.setdefault(source, len(source_bit))
            c = 0 if cluster is None or cluster != cluster else 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
            rest.append((tail, s, c, i, full, full * capacity))
    rest.sort(key=lambda x: (-x[0], x[3]))
    placed, residual = best_fit([x[:3] for x in rest], capacity)
    out += [(i, piece, start, size, f"{shard}.{b}", offset, residual[b]) for (size, _, _, i, piece, start), (b, offset) in zip(rest, placed, strict=True)]
    at = pd.DataFrame(out, columns=["i", "piece", "start", "length", "bin", "offset", "room"])
    took = rows.loc[at["i"], ["key", "copy", "source", "cluster"]].reset_index(drop=True)
    return pd.concat([took, at.drop(columns="i")], axis=1)


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", cluster=None, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Rows (key, copy, source, cluster, piece, start, length, bin, offset, room): where each piece of each text goes.

    Sizes are code points. A text fills whole bins with its first pieces; its last piece shares a bin
    with pieces of other sources and of other duplicate clusters only (cluster: a long column,
    by default the hash of the whole text, so that exact copies part). The pieces of a text, laid end to
    end, are the text. room is what its bin has left.

    Defined cases: null and empty texts are one piece of length 0; a null source, and a null cluster, conflict with
    nothing; rows that repeat a key are told apart by copy (0, 1, ...). Other columns are not read. An
    empty table gives an empty table. Only ids, hashes and lengths are shuffled, never texts; shards are
    dealt by a hash of key and copy, so a hot source or cluster, and equal rows, spread over all shards.
    """
    ship(docs.sparkSession)
    t = F.col(text)
    rows = docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), (F.xxhash64(F.coalesce(t, F.lit(""))) if cluster is None else cluster.cast("long")).alias("cluster"), F.coalesce(F.length(t), F.lit(0)).cast("long").alias("size"))
    return dealt(rows, capacity, shard_rows)


def pack_near(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """As pack(), with clusters of near copies: a cluster is a component of simhash.near_duplicates, so neither exact nor near copies share a bin."""
    kind = docs.schema[key].dataType.simpleString()
    t = F.col(text)
    # each row takes its own source and size along, so that repeated keys need no join back
    each = docs.select(F.struct(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.coalesce(F.length(t), F.lit(0)).cast("long").alias("size")).alias("row"), t.alias("text"))
    found = cut(simhash.near_duplicates(each, "row", "text"))
    rows = found.select(F.col("key.key").cast(kind).alias("key"), "key.source", F.xxhash64("component").alias("cluster"), "key.size")
    return dealt(rows, capacity, shard_rows)


def dealt(rows: DataFrame, capacity: int, shard_rows: int) -> DataFrame:
    """Packs rows (key, source, cluster, size) in shards.

    A row's shard is a hash of its key and, where rows repeat a key, of the copy's number, so that neither a hot source or
    cluster nor any number of equal rows comes to one shard.
    """
    kind = rows.schema["key"].dataType.simpleString()
    rows = cut(rows.withColumn("number", F.monotonically_increasing_id()))
    shards = max(1, -(-rows.count() // shard_rows))
    again = cut(rows.groupBy(F.col("key").alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"))
    if again.isEmpty():
        told = rows.withColumn("copy", F.lit(0))
    else:
        again = F.broadcast(again) if small_enough(again, 16) else again
        repeated = rows["key"].eqNullSafe(again["again"])
        copies = rank_within(rows.join(again, repeated, "left_semi"), ["key"], ["number"]).withColumn("copy", (F.col("rank") - 1).cast("int")).drop("rank")
        told = rows.join(again, repeated, "left_anti").withColumn("copy", F.lit(0)).unionByName(copies)
    shard = F.pmod(F.xxhash64("key", "copy"), F.lit(shards)).cast("int")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pack_shard(pdf, capacity)

    return told.drop("number").withColumn("shard", shard).groupBy("shard").applyInPandas(run, FIELDS.format(key=kind))
