"""Connected components over an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.plans.session import cut


def connected_components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """Rows (node, root): every node that an edge names, and the least node of its component.

    Each round hangs neighbours on the least node seen, first the larger ones (large star), then the
    smaller ones (small star); the edge set shrinks to one star for each component in about log(n)
    rounds, whatever the diameter. No group is ever gathered: a round is a `min` with partial
    aggregation and a join back, whose hot keys AQE splits. Every round is checkpointed, so no
    lineage grows. Edges with a null end and loops are ignored (a node with only a loop is not listed);
    repeated edges count once; an empty table gives an empty table.
    """
    kind = edges.schema[src].dataType
    e = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = cut(e)
    before = None
    while True:
        seen = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if seen["n"] == 0 or (now := (seen["n"], seen["h"])) == before:
            break
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        large = large.where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.union(low.select("u", F.col("m").alias("v"))).distinct())
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root"))).select(F.col("node").cast(kind), F.col("root").cast(kind))
