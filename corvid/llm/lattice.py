"""Embedding near-duplicates by lattice hashing: random projections decoded to E8 points."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvid.operators.graph import connected_components
from corvid.plans.session import cut, ship, small_enough

COSINE = 0.93
#: Tables; E8 points to a table; cells that are probed in a table; the lattice's unit in projected distance for a cosine of COSINE (unit_for has it for others).
TABLES, PARTS, PROBES, UNIT = 6, 2, 32, 0.23
#: Nearest neighbours of a point that are considered in each part.
NEAR = 12
SEED = 20_240_501
#: Angles nearer than this to a bound are not trusted: such pairs are verified by their cosines.
MARGIN = 1e-6
#: Tasks that a large ball's members are dealt to.
SALT = 32
#: Followers of a leader beyond which its vector is copied for that many tasks.
CROWD = 64


@cache
def minimal() -> np.ndarray:
    """The 240 shortest vectors of E8, doubled."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    return np.array(out + [v for v in product((1, -1), repeat=8) if np.prod(v) == 1])


def decode(x: np.ndarray) -> np.ndarray:
    """The E8 point nearest to each row, doubled: the nearer of those in D8 and in D8 plus a half."""

    def d8(y):
        near = np.rint(y)
        off = y - near
        odd = np.flatnonzero(near.sum(axis=1) % 2)
        worst = np.abs(off[odd]).argmax(axis=1)
        near[odd, worst] += np.where(off[odd, worst] >= 0, 1, -1)
        return near

    whole, half = d8(x), d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(axis=1) <= ((x - half) ** 2).sum(axis=1)
    return np.rint(2 * np.where(closer[:, None], whole, half)).astype(np.int64)


@cache
def projections(dims: int, tables: int = TABLES) -> np.ndarray:
    """For each table, orthonormal rows (as far as dims goes), scaled as for 64 dimensions."""
    rng = np.random.default_rng([SEED, dims])
    out = []
    for _ in range(tables):
        rows = 8 * PARTS
        q = np.linalg.qr(rng.normal(size=(dims, dims)))[0] if dims >= rows else rng.normal(size=(rows, dims)) / np.sqrt(rows)
        out.append(q[:rows] * np.sqrt(dims / 64) if dims >= rows else q * np.sqrt(rows / 64))
    return np.stack(out)


def mixed(parts: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each row of whole numbers."""
    h = np.full(parts.shape[:-1], 0x9E3779B97F4A7C15, np.uint64)
    for i in range(parts.shape[-1]):
        h = (h ^ parts[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def cells(x: np.ndarray, tables: int = TABLES, probes: int = PROBES, unit: float = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """Of unit vectors of the same dimension: each one's own cell in every table (n, tables), and the cells that it probes (n, tables, probes + 1)."""
    own, probed = [], []
    shifts = minimal()
    for t, r in enumerate(projections(x.shape[1], tables)):
        sides, homes = [], []
        for part in range(PARTS):
            y = x @ r[8 * part : 8 * part + 8].T / unit
            at = decode(y)
            far = 2 - (y - at / 2) @ shifts.T  # how much farther each neighbouring point is, squared
            near = np.argpartition(far, NEAR, axis=1)[:, :NEAR]
            homes.append(mixed(at)[:, None])
            sides.append((np.hstack([np.zeros((len(x), 1)), np.take_along_axis(far, near, axis=1)]), np.hstack([homes[-1], mixed(at[:, None, :] + shifts[near])])))
        (d0, h0), (d1, h1) = sides
        both = (d0[:, :, None] + d1[:, None, :]).reshape(len(x), -1)
        best = np.argpartition(both, probes, axis=1)[:, : probes + 1]
        tag = np.uint64(t + 1)
        pair = lambda a, b: ((a * np.uint64(0xFF51AFD7ED558CCD)) ^ (b + tag)) * np.uint64(0xC4CEB9FE1A85EC53)  # noqa: B023, E731
        width = d1.shape[1]
        probed.append(pair(np.take_along_axis(h0, best // width, axis=1), np.take_along_axis(h1, best % width, axis=1)))
        own.append(pair(homes[0], homes[1])[:, 0])
    return np.stack(own, axis=1), np.stack(probed, axis=1)


def unit_for(least: float) -> float:
    """The lattice's unit for a least cosine: it grows with the chord of the linking angle, so that the chance to meet stays the same."""
    return max(1e-4, UNIT * math.sqrt((1 - least) / (1 - COSINE)))


def with_units(made: DataFrame) -> DataFrame:
    """made with a column unit: v, whose rows are not empty and finite, scaled to length 1. Scaling by the largest component first keeps squares from overflowing."""
    schema = T.StructType([*made.schema.fields, T.StructField("unit", T.ArrayType(T.DoubleType()))])
    at = made.columns.index("v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, sizes = b.column(at).flatten().to_numpy(zero_copy_only=False), np.diff(b.column(at).offsets.to_numpy())
                ends = np.cumsum(sizes)
                x = x / np.repeat(np.maximum.reduceat(np.abs(x), ends - sizes), sizes)
                x = x / np.repeat(np.sqrt(np.add.reduceat(x * x, ends - sizes)), sizes)
                units = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(x))
                yield pa.RecordBatch.from_arrays([*b.columns, units], [*b.schema.names, "unit"])

    return made.mapInArrow(run, schema)


def entries(classes: DataFrame, unit: float, own_only: bool = False) -> DataFrame:
    """Rows (cell, id, home) of classes (id, group, unit): a row for each table's own cell (home) and, unless own_only, for each cell probed."""
    ship(classes.sparkSession)
    block = 512

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, group = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, sizes = b.column(2).flatten().to_numpy(zero_copy_only=False), np.diff(b.column(2).offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            for dims in np.unique(sizes):
                rows = np.flatnonzero(sizes == dims)
                for at in range(0, len(rows), block):
                    some = rows[at : at + block]
                    own, probed = cells(flat[starts[some][:, None] + np.arange(dims)], unit=unit)
                    salt = mixed(np.stack([group[some], np.full(len(some), dims)], axis=1))
                    for found, home in ((own[:, :, None], True), (probed, False))[: 1 if own_only else 2]:
                        key = (found ^ salt[:, None, None]).reshape(-1).view(np.int64)
                        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(ids[some], found.shape[1] * found.shape[2])), pa.array(np.full(len(key), home))], ["cell", "id", "home"])

    return classes.select("id", "group", "unit").mapInArrow(run, "cell bigint, id bigint, home boolean")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(a: str, b: str) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def balls(classes: DataFrame, least: float) -> DataFrame:
    """Rows (id, ball) of classes (id, group, label, unit): balls so small that all their members link.

    In each table the least id of a cell leads; a class follows the least leader that is within half the
    linking angle. A ball's centre is its members' mean, its radius the farthest member's angle; if twice
    the radius is more than the linking angle, its members stay alone. Balls of several have odd numbers, those of one class even ones.
    """
    limit = math.acos(least)
    own = cut(entries(classes, unit_for(least), own_only=True).select("cell", "id"))
    led = own.join(own.groupBy("cell").agg(F.min("id").alias("leader")), "cell").where("leader < id").select("id", "leader").distinct()
    side = lambda n: classes.select(F.col("id").alias(n), F.col("label").alias(f"l_{n}"), F.col("unit").alias(f"u_{n}"))
    crowd = cut(led.groupBy("leader").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("leader", F.lit(True).alias("crowded")))
    crowd = F.broadcast(crowd) if small_enough(crowd, 16) else crowd
    marked = lambda df: df.join(crowd, "leader", "left").withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    near = salted_join(marked(led.join(side("id"), "id")), marked(side("leader")), "leader", F.col("crowded")).where((F.col("l_id") == F.col("l_leader")) & (F.size("u_id") == F.size("u_leader"))).where(dot("u_id", "u_leader") >= math.cos(limit / 2 - MARGIN))
    joined = classes.select("id", "unit").join(near.groupBy("id").agg(F.min("leader").alias("leader")), "id", "left").select("id", "unit", F.coalesce("leader", "id").alias("lead"))
    big = joined.groupBy("lead").agg(F.count("*").alias("n")).where("n > 1").select("lead")
    members = cut(salted_join(joined, big, "lead"))
    middle = centres(members, "lead")
    tight = salted_join(members, middle, "lead").groupBy("lead").agg(F.max(angle("unit", "centre")).alias("r")).where(2 * F.col("r") <= limit - MARGIN).select("lead")
    kept = salted_join(members, tight, "lead").select("id", (2 * F.col("lead") + 1).alias("ball"))
    return classes.select("id").join(kept, "id", "left").select("id", F.coalesce("ball", 2 * F.col("id")).alias("ball"))


def centres(members: DataFrame, by: str) -> DataFrame:
    """Rows (by, centre): the direction of each group's mean. Sums are partial; a group's list has one entry for each dimension."""
    mean = members.select(by, F.posexplode("unit").alias("pos", "x")).groupBy(by, "pos").agg(F.sum("x").alias("x"))
    whole = mean.groupBy(by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).withColumn("v", F.transform("v", lambda e: e["x"]))
    norm = F.sqrt(dot("v", "v"))
    return whole.withColumn("norm", norm).select(by, F.expr("transform(v, e -> e / norm)").alias("centre"))


def salted_join(members: DataFrame, groups: DataFrame, by: str, several: Column | None = None) -> DataFrame:
    """members (id, by, …) with the columns of their group; the members of groups of several are dealt to SALT tasks (several: a condition on by; all groups by default)."""
    several = F.lit(True) if several is None else several
    copies = groups.withColumn("salt", F.explode(F.when(several, F.sequence(F.lit(0), F.lit(SALT - 1))).otherwise(F.array(F.lit(0))))).drop("crowded")
    return members.withColumn("salt", F.when(several, F.pmod(F.xxhash64("id"), F.lit(SALT)).cast("int")).otherwise(0)).join(copies, [by, "salt"]).drop("salt")


def meeting(classes: DataFrame, unit: float) -> DataFrame:
    """Pairs (a, b), a < b, of balls with members of which one probes the other's own cell. A ball is entered once in a cell, however many members it has."""
    rows = entries(classes.select(F.col("ball").alias("id"), "group", "unit"), unit)
    rows = rows.where("id % 2 = 0").unionByName(rows.where("id % 2 = 1").distinct())
    rows = cut(rows)
    homes = rows.where("home").select("cell", F.col("id").alias("h"))
    found = rows.where("not home").select("cell", F.col("id").alias("p")).join(homes.hint("shuffle_hash"), "cell").where("h != p")
    return found.select(F.least("h", "p").alias("a"), F.greatest("h", "p").alias("b")).distinct()


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", least: float = COSINE) -> DataFrame:
    """Rows (key, n_links, component, kept): for each row of vectors the number of other rows that it links with, and the least key reachable.

    Rows link if their labels are equal and not null and their vectors' cosine, in double precision, is
    `least` or more. Equal vectors are one class. Classes are projected in each table and decoded to E8 points;
    a class meets those whose own cell it probes, among the cells nearest to it. Classes so close together
    that all of them link make a ball, which is entered once in a cell and counted by size. Balls that meet are
    verified: by their centres and radii where these prove that all or none of their members link, else
    member by member. So neither copies nor dense groups of near copies make pairs.

    Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, rows with a null label, and vectors of
    different dimension link with nothing (0 links, their own component). Repeated rows are rows of their
    own, and link. kept: key equals component (both may be null). Other columns are not read.
    """
    x = F.col("v")
    rows = vectors.select(F.col(key).alias("key"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    good = F.coalesce(F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0) & finite & F.exists(x, lambda e: e != 0), F.lit(False))
    rows = rows.withColumn("good", good)
    made = rows.where("good").groupBy("label", "v").agg(F.min("key").alias("low"), F.count("*").alias("m"))
    ship(vectors.sparkSession)
    classes = cut(with_units(made.withColumn("id", F.monotonically_increasing_id()).withColumn("group", F.xxhash64("label"))))
    classes = cut(classes.join(balls(classes, least), "id"))

    sizes = classes.groupBy("ball").agg(F.sum("m").alias("total"), F.min("low").alias("low"))
    several = classes.where("ball % 2 = 1")
    middle = centres(several, "ball")
    radii = salted_join(several, middle, "ball").groupBy("ball").agg(F.max(angle("unit", "centre")).alias("r"), F.first("centre").alias("centre"), F.first("label").alias("label"))
    points = classes.where("ball % 2 = 0").select("ball", F.lit(0.0).alias("r"), F.col("unit").alias("centre"), "label").unionByName(radii)
    points = cut(points.join(sizes.select("ball", "total"), "ball"))
    side = lambda n: points.select(F.col("ball").alias(n), F.col("r").alias(f"r_{n}"), F.col("centre").alias(f"c_{n}"), F.col("label").alias(f"l_{n}"), F.col("total").alias(f"t_{n}"))
    limit = math.acos(least)
    apart = F.when(F.col("r_a") + F.col("r_b") > 0, angle("c_a", "c_b"))
    both = meeting(classes, unit_for(least)).join(side("a"), "a").join(side("b"), "b").where((F.col("l_a") == F.col("l_b")) & (F.size("c_a") == F.size("c_b"))).withColumn("apart", apart)
    reach = F.col("r_a") + F.col("r_b")
    single = (reach == 0) & (dot("c_a", "c_b") >= least)
    all_of = (reach > 0) & (F.col("apart") + reach <= limit - MARGIN)
    some_of = (reach > 0) & ~all_of & (F.col("apart") - reach <= limit + MARGIN)
    judged = cut(both.withColumn("kind", F.when(single | all_of, "all").when(some_of, "some")).where("kind is not null").select("a", "b", "t_a", "t_b", "kind"))

    whole = judged.where("kind = 'all'")
    member = lambda n: classes.select(F.col("ball").alias(n), F.col("id").alias(f"i_{n}"), F.col("m").alias(f"m_{n}"), F.col("unit").alias(f"u_{n}"))
    part = cut(judged.where("kind = 'some'").select("a", "b").join(member("a"), "a").join(member("b"), "b").where(dot("u_a", "u_b") >= least).select("a", "b", "i_a", "i_b", "m_a", "m_b"))
    by_ball = whole.select(F.col("a").alias("ball"), F.col("t_b").alias("t")).union(whole.select("b", "t_a")).groupBy("ball").agg(F.sum("t").alias("more"))
    by_class = part.select(F.col("i_a").alias("id"), F.col("m_b").alias("t")).union(part.select("i_b", "m_a")).groupBy("id").agg(F.sum("t").alias("others"))
    parts = connected_components(whole.select("a", "b").union(part.select("a", "b"))).withColumnRenamed("node", "ball")
    named = sizes.join(parts, "ball", "left").join(by_ball, "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    lows = named.groupBy("root").agg(F.min("low").alias("component"))
    named = named.join(lows, "root").select("ball", "component", (F.col("total") - 1 + F.coalesce("more", F.lit(0))).alias("linked"))
    told = salted_join(classes.select("id", "ball", "label", "v"), named, "ball", F.col("ball") % 2 == 1).join(by_class, "id", "left").select("label", "v", (F.col("linked") + F.coalesce("others", F.lit(0))).alias("n_links"), "component")
    out = rows.where("good").join(told, ["label", "v"]).select("key", "n_links", "component")
    return out.unionByName(rows.where("not good").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component"))).withColumn("kept", F.col("key").eqNullSafe(F.col("component")))
