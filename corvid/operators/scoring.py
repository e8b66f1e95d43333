"""Chunks, scores, calibration and metrics."""

from __future__ import annotations

from math import exp, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_starts(n: Column, payload: int = 510, overlap: int = 128, most: int = 8, truncate: bool = False) -> Column:
    """Where the windows over n tokens start: every payload - overlap, the last at n - payload; of more than `most`, that many at equal steps (rounded half to even, or truncated)."""
    step = payload - overlap
    last = F.greatest(n - payload, F.lit(0))
    regular = F.when(last == 0, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(step)))
    all_starts = F.array_distinct(F.concat(regular, F.array(last.cast("int"))))
    size = F.size(all_starts)
    at = lambda i: i.cast("double") * (size - 1) / F.lit(float(most - 1))
    pick = (lambda i: F.floor(at(i))) if truncate else (lambda i: F.bround(at(i)))
    chosen = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.element_at(all_starts, (pick(i) + 1).cast("int")))
    return F.when(size > most, F.array_distinct(chosen)).otherwise(all_starts)


def chunks(docs: DataFrame, key: str, tokens: str, cls: str = "[CLS]", sep: str = "[SEP]", payload: int = 510, overlap: int = 128, most: int = 8) -> DataFrame:
    """Rows (key, chunk, start, tokens): each text's windows between the two marks."""
    starts = window_starts(F.size(tokens), payload, overlap, most)
    out = docs.select(F.col(key), F.col(tokens).alias("t"), F.posexplode(starts).alias("chunk", "start"))
    return out.select(key, "chunk", "start", F.concat(F.array(F.lit(cls)), F.slice("t", F.col("start") + 1, payload), F.array(F.lit(sep))).alias("tokens"))


def best_chunk(rows: DataFrame, key: str = "owner", order: str = "chunk") -> DataFrame:
    """Of each key the chunk with the greatest logit margin, the first at a tie. One aggregation, no sort."""
    margin = F.col("logit_pos") - F.col("logit_neg")
    top = F.max(F.struct(margin.alias("margin"), (-F.col(order)).alias("back"), "logit_neg", "logit_pos")).alias("top")
    return rows.groupBy(key).agg(top).select(key, (-F.col("top.back")).alias(order), "top.logit_neg", "top.logit_pos", "top.margin")


def probability(margin: Column, temperature: float = 1.0) -> Column:
    """Softmax of two logits at a temperature: the sigmoid of their margin."""
    return 1 / (1 + F.exp(-margin / F.lit(max(temperature, 1e-6))))


def decision(p: Column, threshold: float = 0.5, band: float = 0.3) -> Column:
    return F.when(p >= threshold + band / 2, "phishing").when(p <= threshold - band / 2, "legitimate").otherwise("uncertain")


def weighted_loss(rows: DataFrame) -> DataFrame:
    """Cross entropy of (p, label, weight), by weight."""
    ce = -F.when(F.col("label") == 1, F.log("p")).otherwise(F.log(1 - F.col("p")))
    return rows.agg((F.sum(F.col("weight") * ce) / F.greatest(F.sum("weight"), F.lit(1e-12))).alias("loss"))


def fit_temperature(rows: DataFrame, rounds: int = 40) -> float:
    """The temperature with the least cross entropy of (margin, label). Convex in 1/T: Newton steps, each one aggregation over rows."""
    b = 1.0
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-F.col("margin") * F.lit(b)))
        g = rows.agg(F.avg((p - F.col("label")) * F.col("margin")).alias("g"), F.avg(p * (1 - p) * F.col("margin") * F.col("margin")).alias("h")).first()
        if g["g"] is None or not g["h"]:
            break
        step = max(-1.0, min(1.0, g["g"] / (g["h"] * b)))  # in log b
        b *= exp(-step)
        if abs(step) < 1e-9:
            break
    return exp(-log(max(b, 1e-6)))


def running(rows: DataFrame, order: str, ascending: bool, *sums: str) -> DataFrame:
    """Running sums over a column's different values, of rows pre-aggregated by that column.

    Values are range-partitioned; each task sums its own, and the totals of the tasks before it are added, so no task sees all values.
    """
    from corvid.plans.session import cut

    by = F.col(order).asc() if ascending else F.col(order).desc()
    spread = cut(rows.repartitionByRange(by).sortWithinPartitions(by).withColumn("part", F.spark_partition_id()))
    totals = spread.groupBy("part").agg(*[F.sum(s).alias(f"all_{s}") for s in sums])
    before = totals.alias("x").join(totals.alias("y"), F.col("y.part") < F.col("x.part"), "left").groupBy(F.col("x.part").alias("part")).agg(*[F.coalesce(F.sum(f"y.all_{s}"), F.lit(0)).alias(f"before_{s}") for s in sums])
    own = Window.partitionBy("part").orderBy(by)
    out = spread
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.sum(s).over(own))
    out = out.join(F.broadcast(before), "part")
    for s in sums:
        out = out.withColumn(f"cum_{s}", F.col(f"cum_{s}") + F.col(f"before_{s}"))
    return out.drop("part", *[f"before_{s}" for s in sums])


def best_f1(rows: DataFrame) -> DataFrame:
    """(threshold, f1): the score that as a threshold gives (p, label) the best F1, the least one at a tie."""
    by = rows.groupBy("p").agg(F.count("*").alias("n"), F.sum("label").alias("pos"))
    positives = F.lit(rows.agg(F.sum("label")).first()[0] or 0)
    c = running(by, "p", False, "n", "pos")
    f1 = F.when(F.col("cum_n") + positives > 0, 2.0 * F.col("cum_pos") / (F.col("cum_n") + positives)).otherwise(0.0)
    return c.select(F.col("p").alias("threshold"), f1.alias("f1")).orderBy(F.desc("f1"), "threshold").limit(1)


def selective_band(rows: DataFrame, threshold: float = 0.5, coverage: float = 0.80, accuracy: float = 0.95) -> DataFrame:
    """(half_width, coverage, accuracy): the narrowest band about the threshold outside which (p, label) is accurate enough and covers enough; else the most accurate that covers enough, the narrowest at a tie."""
    distance = F.abs(F.col("p") - threshold)
    right = ((F.col("p") >= threshold).cast("int") == F.col("label")).cast("long")
    by = rows.select(distance.alias("d"), right.alias("right")).groupBy("d").agg(F.count("*").alias("n"), F.sum("right").alias("right"))
    total = F.lit(rows.count())
    c = running(by, "d", False, "n", "right").select(F.col("d").alias("half_width"), (F.col("cum_n") / total).alias("coverage"), (F.col("cum_right") / F.col("cum_n")).alias("accuracy")).where(F.col("coverage") >= coverage)
    good = F.col("accuracy") >= accuracy
    return c.orderBy(good.desc(), F.when(~good, -F.col("accuracy")), "half_width").limit(1)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def confusion(rows: DataFrame, *by: str) -> DataFrame:
    """Confusion counts and ratios of (predicted, label), by any columns; a ratio over nothing is 0."""
    p, y = F.col("predicted") == 1, F.col("label") == 1
    g = (rows.groupBy(*by) if by else rows).agg(F.count_if(p & y).alias("tp"), F.count_if(p & ~y).alias("fp"), F.count_if(~p & y).alias("fn"), F.count_if(~p & ~y).alias("tn"))
    g = g.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))
    return g.withColumn("accuracy", ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn"))).withColumn("f1", ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def prevalence(rows: DataFrame, key: str, shares: tuple[float, ...] = (0.5, 0.1, 0.05, 0.02), seed: str = "42") -> DataFrame:
    """Confusion of (key, predicted, label) at other shares of positives: all negatives, and round(n_neg · p / (1 - p)) positives, those whose hash with the seed is least.

    One ranking serves all scenarios.
    """
    from corvid.operators.corpus import rank_within

    counts = rows.agg(F.count_if(F.col("label") == 0).alias("neg")).first()
    draw = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    pos = rank_within(rows.where("label = 1").withColumn("draw", draw).withColumn("one", F.lit(1)), ["one"], ["draw", key]).drop("draw", "one")
    both = pos.unionByName(rows.where("label = 0").withColumn("rank", F.lit(0).cast("long")))
    steps = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(int(round(counts["neg"] * s / (1 - s)))).alias("most")) for s in shares])
    return confusion(both.select("*", F.inline(steps)).where(F.col("rank") <= F.col("most")), "scenario")


def histogram(value: Column, width: float, bins: int) -> Column:
    """The bin's lower edge; the last bin is closed."""
    return F.least(F.floor(value / width), F.lit(bins - 1)) * width
