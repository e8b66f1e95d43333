"""SimHash near-duplicates by shingle similarity: fingerprints of whole texts and of parts of their shingles, segment counts as a lower bound, exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.llm.simhash import LOWER, SEED, close_pairs, free_name, majority
from corvid.operators.graph import connected_components
from corvid.plans.session import cut, ship, small_enough

WORDS = 5
#: Similarity of 0.8 as a fraction, so that every comparison is one of whole numbers.
NUMERATOR, DENOMINATOR = 4, 5
#: Parts of a text's shingles that are fingerprinted (a power of two), and the least mean number of shingles in one, as a fraction.
PARTS, MEAN = 32, (5, 2)
ODD = np.random.default_rng(20_240_501).integers(1 << 62, size=PARTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Sets that share a part's fingerprint: up to so many are all compared with each other, more at first with one of them only.
FEW = 16
#: Sets of one task's share of a fingerprint that are passed on together; a larger share is compared by itself.
LOCAL = 64
#: Sets of a large group that are compared with as many others at once.
BLOCK = 1024
#: Tasks that a large component's sets are dealt to.
SALT = 32
#: One in so many large groups is compared at first; those that are still in several components then, all of them.
SOME = 4
ENTRY = np.dtype([("sig", "<u8"), ("set", "<i8"), ("n", "<u4")])
BUCKET_ROWS = 250_000


def shingles(text: str | None, words: int = WORDS) -> tuple[np.ndarray, int]:
    """The different 64-bit hashes of a text's word shingles, sorted, and the text's SimHash; a text of fewer words is one shingle, a wordless one has none."""
    parts = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not parts:
        return np.zeros(0, np.uint64), 0
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(parts[i : i + words]), SEED) for i in range(max(1, len(parts) - words + 1))), np.uint64)
    return np.unique(hashes), majority(hashes)


def set_id(grams: np.ndarray) -> int:
    """A signed long that names a set of shingles."""
    return xxhash.xxh64_intdigest(grams.astype("<u8").tobytes(), SEED) - (1 << 63)


def level(n: int) -> int:
    """Shingles are dealt to 2 ** level parts: MEAN to twice MEAN in each."""
    return max(0, (n * MEAN[1] // MEAN[0]).bit_length() - 1)


def signatures(grams: np.ndarray) -> np.ndarray:
    """The fingerprints of parts of a set, each mixed with its part's name.

    Shingles are dealt to parts by their hashes; a part's fingerprint is the SimHash of its shingles. A set of many parts uses
    PARTS of them, one of few deals its shingles anew several times. Sets of similar sizes have a level in common.
    """
    n, out = len(grams), []
    for j in sorted({level(n), level(n * DENOMINATOR // NUMERATOR)}) if n else ():
        tables = max(1, PARTS >> j)
        place = (grams[None, :] * ODD[:tables, None]) >> np.uint64(64 - j) if j else np.zeros((tables, n), np.uint64)
        place = (place + (np.arange(tables, dtype=np.uint64) << np.uint64(j))[:, None]).reshape(-1)
        used = np.flatnonzero(place < np.uint64(PARTS))
        used = used[np.argsort(place[used], kind="stable")]
        if not len(used):
            continue
        place, dealt = place[used], grams[used % n]
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        sizes = np.diff(np.append(starts, len(place)))
        bits = np.unpackbits(dealt.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        fps = np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").reshape(-1).view("<u8")
        key = (fps ^ ((place[starts] + np.uint64(j << 8)) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        out.append(key ^ (key >> np.uint64(32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def counts(grams: np.ndarray) -> bytes:
    """A set's numbers of shingles in equal segments of the hashes: 256 of a byte, or 1024 of four for sets that these don't suit."""
    if len(grams) < 1 << 12 and (few := np.bincount((grams >> np.uint64(56)).astype(np.int64), minlength=256)).max() < 256:
        return few.astype("u1").tobytes()
    return np.bincount((grams >> np.uint64(54)).astype(np.int64), minlength=1024).astype("<u4").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "u1" if len(b) == 256 else "<u4").astype(np.int32)


def bound(a: np.ndarray, b: np.ndarray) -> int:
    """The Manhattan distance of two sets' segment counts: no more than the number of shingles that only one of them has."""
    k = min(len(a), len(b))
    return int(np.abs(a.reshape(k, -1).sum(axis=1) - b.reshape(k, -1).sum(axis=1)).sum())


def longs(grams: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(g) for g in grams])]).astype(np.int32)
    flat = np.concatenate([*grams, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


#: Rows of a batch that are worked on together: a bound of memory only.
ROWS = 1024


def sketches(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, set, n, fp, counts, sigs): the name and size of a text's set of shingles, its SimHash, its segment counts and its parts' fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                found = []
                for t in b.column(1):
                    g, fp = shingles(t.as_py())
                    found.append((set_id(g), len(g), fp - (1 << 64) * (fp >> 63), counts(g), signatures(g)))
                ids, n, fps, segments, sigs = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (ids, n, fps)), pa.array(segments, pa.binary()), longs(list(sigs))], ["key", "set", "n", "fp", "counts", "sigs"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, set bigint, n bigint, fp bigint, counts binary, sigs array<bigint>")


def sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (set, grams) for the sets of wanted (set, low); low is the key of a row with that set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                sets = [shingles(t.as_py())[0] for t in whole.column(0).slice(at, ROWS)]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(g) for g in sets], pa.int64()), longs(sets)], ["set", "grams"])

    ids = wanted.select("set")
    keys = wanted.select(F.col("low").alias("wanted_key")).distinct()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    near = rows.join(F.broadcast(keys) if small_enough(keys, 16) else keys, F.col("key").eqNullSafe(F.col("wanted_key")), "left_semi")
    # a key that several rows have brings other sets along
    return near.select("text").mapInArrow(run, "set bigint, grams array<bigint>").join(F.broadcast(ids) if small_enough(ids, 16) else ids, "set", "left_semi").dropDuplicates(["set"])


def similar_sizes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return NUMERATOR * np.maximum(a, b) <= DENOMINATOR * np.minimum(a, b)


def meetings(each: DataFrame) -> DataFrame:
    """Rows (a, b, blocks) of sets that share a part's fingerprint: pairs of them (blocks 0), and for large groups a row (fingerprint, set, number of blocks) for each set.

    Fingerprints are shuffled as packed bytes; a task passes on at most LOCAL sets of one, so what meets in a task grows with the
    number of tasks and not with a group.
    """
    total = each.agg(F.sum(F.size("sigs"))).first()[0] or 0
    buckets = max(int(each.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_ROWS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = np.uint64(0)
        for b in batches:
            ids, first = np.unique(b.column(0).to_numpy(), return_index=True)
            lists = b.column(2).take(pa.array(first))
            sizes = np.diff(lists.offsets.to_numpy())
            at = np.empty(sizes.sum(), ENTRY)
            at["sig"], at["set"], at["n"] = lists.flatten().to_numpy().view(np.uint64), np.repeat(ids, sizes), np.repeat(b.column(1).to_numpy()[first], sizes)
            at = at[np.lexsort([at["set"], at["sig"]])]
            new = np.concatenate([[True], at["sig"][1:] != at["sig"][:-1]])[: len(at)]
            group = np.cumsum(new) - 1
            crowd = np.bincount(group)[group] > LOCAL if len(at) else new
            bucket = (at["sig"] % np.uint64(buckets)).astype(np.int64)
            serial += np.uint64(1)
            own = buckets + ((at["sig"] + serial + at["set"][:1].view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            # a crowded fingerprint's least set goes on; the whole share meets in a place of its own
            at, bucket = np.concatenate([at[~crowd | new], at[crowd]]), np.concatenate([bucket[~crowd | new], own[crowd]])
            order = np.argsort(bucket, kind="stable")
            at, bucket = at[order], bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array([x.tobytes() for x in np.split(at, starts[1:])] if len(at) else [], pa.binary())], ["bucket", "entries"])

    def meet(rows: pa.Table) -> pa.Table:
        at = np.frombuffer(b"".join(rows["entries"].to_pylist()), ENTRY)
        at = at[np.lexsort([at["set"], at["sig"]])]
        at = at[np.concatenate([[True], (at["sig"][1:] != at["sig"][:-1]) | (at["set"][1:] != at["set"][:-1])])]
        new = np.concatenate([[True], at["sig"][1:] != at["sig"][:-1]])
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(at)))
        size, lead = np.repeat(sizes, sizes), np.repeat(starts, sizes)
        ends = []
        for d in range(1, FEW):
            i = np.flatnonzero((at["sig"][d:] == at["sig"][:-d]) & (size[d:] <= FEW)) if len(at) > d else np.zeros(0, int)
            ends.append((i, i + d))
        i = np.flatnonzero((size > FEW) & ~new)
        ends.append((lead[i], i))
        a, b = (np.concatenate(x) for x in zip(*ends, strict=True))
        near = similar_sizes(at["n"][a].astype(np.int64), at["n"][b].astype(np.int64))
        pairs = np.unique(np.stack([at["set"][a[near]], at["set"][b[near]]], axis=1), axis=0)
        hot = size > FEW
        blocks = -(-size[hot] // BLOCK)
        out = (np.concatenate([pairs[:, 0], at["sig"][hot].view(np.int64)]), np.concatenate([pairs[:, 1], at["set"][hot]]), np.concatenate([np.zeros(len(pairs), np.int64), blocks]))
        return pa.table(dict(zip(("a", "b", "blocks"), map(pa.array, out), strict=True)))

    dealt = each.where("n > 0").select("set", "n", "sigs").mapInArrow(deal, "bucket bigint, entries binary")
    return dealt.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint, blocks bigint")


def within_bound(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and segment counts allow a similarity of 0.8, with their sizes."""
    side = lambda x: groups.select(F.col("set").alias(x), F.col("n").alias(f"n{x}"), F.col("counts").alias(f"c{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{NUMERATOR} * greatest(na, nb) <= {DENOMINATOR} * least(na, nb)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2).to_numpy(), b.column(4).to_numpy()
            ca, cb = b.column(3).to_pylist(), b.column(5).to_pylist()
            good = [(NUMERATOR + DENOMINATOR) * bound(unpacked(x), unpacked(y)) <= (DENOMINATOR - NUMERATOR) * (n + m) for x, n, y, m in zip(ca, na, cb, nb, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(i).filter(pa.array(good, pa.bool_())) for i in (0, 1, 2, 4)], ["a", "b", "na", "nb"])

    return both.select("a", "b", "na", "ca", "nb", "cb").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def alike(pairs: DataFrame, docs: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """Those of pairs (a, b, na, nb) whose sets have a Jaccard similarity of 0.8 or more, by the sets themselves."""
    ids = pairs.select(F.col("a").alias("set")).union(pairs.select("b")).distinct()
    sets = sets_of(docs, cut(groups.join(ids, "set", "left_semi").select("set", "low")), key, text)
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("grams").alias("ga")), "a").join(sets.select(F.col("set").alias("b"), F.col("grams").alias("gb")), "b")
    overlap = F.size(F.array_intersect("ga", "gb"))
    return cut(both.where((NUMERATOR + DENOMINATOR) * overlap >= NUMERATOR * (F.col("na") + F.col("nb"))).select("a", "b"))


def by_fingerprint(groups: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets whose whole texts' fingerprints are equal or within 2 bits, by the popcount grid; they connect all such sets."""
    first = cut(groups.groupBy("fp").agg(F.min("set").alias("lead")))
    same = groups.join(first, "fp").where("set != lead").select(F.col("lead").alias("a"), F.col("set").alias("b"))
    near = close_pairs(first.select("fp")).join(first.select(F.col("fp").alias("a"), F.col("lead").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("lead").alias("y")), "b")
    return same.union(near.select("x", "y"))


def apart(hot: DataFrame, groups: DataFrame, parts: DataFrame, closest: bool) -> DataFrame:
    """Pairs (a, b, na, nb) of sets of large groups that are in different components and within the bound: blocks of a group are compared with blocks of it, and only what is within makes a row.

    closest: of each set and each other component only the pair with the least bound.
    """
    rooted = cut(hot.select(F.col("a").alias("sig"), F.col("b").alias("set"), "blocks").join(parts.withColumnRenamed("node", "set"), "set", "left").withColumn("root", F.coalesce("root", "set")))
    mixed = cut(rooted.groupBy("sig").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least != most").select("sig"))
    # a broadcast leaves the rows of a large group where they are
    mixed = F.broadcast(mixed) if small_enough(mixed, 16) else mixed
    rows = rooted.join(mixed, "sig", "left_semi").join(groups.select("set", "n", "counts"), "set")
    block = F.pmod(F.xxhash64("set"), F.col("blocks"))
    rows = rows.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("sig", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "set", "root", "n", "counts")

    def compare(t: pa.Table) -> pa.Table:
        n, root, ids, block = (t[c].to_numpy() for c in ("n", "root", "set", "block"))
        held = [unpacked(c) for c in t["counts"].to_pylist()]
        k = min(map(len, held))
        c = np.stack([h.reshape(k, -1).sum(axis=1) for h in held])
        left, right = (np.flatnonzero(block == t[x][0].as_py()) for x in ("x", "y"))
        names, kind = np.unique(root, return_inverse=True)
        few = kind != np.bincount(kind).argmax()  # pairs of two components have one at least that isn't in the largest
        a, b = [], []
        for i, others in [*((i, right) for i in left[few[left]]), *((i, left[~few[left]]) for i in right[few[right]] if t["x"][0] != t["y"][0])]:
            j = others[(root[others] != root[i]) & similar_sizes(n[i], n[others])]
            far = np.abs(c[j] - c[i]).sum(axis=1)
            near = (NUMERATOR + DENOMINATOR) * far <= (DENOMINATOR - NUMERATOR) * (n[j] + n[i])
            j, far = j[near], far[near]
            if closest and len(j):
                j = j[np.lexsort([far, kind[j]])]
                j = j[np.concatenate([[True], kind[j][1:] != kind[j][:-1]])]
            a.append(np.full(len(j), i))
            b.append(j)
        a, b = np.concatenate([*a, np.zeros(0, int)]).astype(int), np.concatenate([*b, np.zeros(0, int)]).astype(int)
        swap = ids[a] > ids[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b]), "na": pa.array(n[a]), "nb": pa.array(n[b])})

    # few bytes, much work: as many tasks as there are partitions, however small they are
    rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "sig", "x", "y")
    return rows.groupBy("sig", "x", "y").applyInArrow(compare, "a bigint, b bigint, na bigint, nb bigint").distinct()


def widened(parts: DataFrame, more: DataFrame) -> DataFrame:
    """Components (node, root) with further links (a, b): only what they join is worked out anew."""
    ends = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    nodes = cut(parts.unionByName(ends.join(parts, "node", "left_anti").withColumn("root", F.col("node"))))
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
    joined = connected_components(more.join(side("a"), "a").join(side("b"), "b").select("ra", "rb"), "ra", "rb")
    return cut(nodes.join(joined.select(F.col("node").alias("root"), F.col("root").alias("least")), "root", "left").select("node", F.coalesce("least", "root").alias("root")))


def components(docs: DataFrame, each: DataFrame, groups: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (node, root): the sets that link with others by a similarity of 0.8 or more, and the least set that links lead to.

    Sets meet if their whole texts' fingerprints are within 2 bits, or if a part's fingerprints are equal; what is within the
    bound of the segment counts is verified. A group of more than FEW sets of one part is compared with its least set first,
    and then by blocks as far as it is still in several components.
    """
    met = cut(meetings(each))
    first = by_fingerprint(groups).union(met.where("blocks = 0").select("a", "b"))
    first = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    parts = connected_components(alike(cut(within_bound(first, groups)), docs, groups, key, text))
    hot = met.where("blocks > 0")
    if hot.isEmpty():
        return parts
    for closest in (True, False):  # the closest pairs of some groups join most components, so that little is left for the second time, which sees all
        rest = cut(apart(hot.where(F.pmod("a", F.lit(SOME)) == 0) if closest else hot, groups, parts, closest))
        if rest.isEmpty():
            continue
        found = alike(rest, docs, groups, key, text)
        if not found.isEmpty():
            parts = widened(parts, found)
    return parts


def winners(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(each, best): the rows (key, set) of docs, and for each set the row (key, set) of its component that stays: that with the least key, then the least set."""
    ship(docs.sparkSession)
    each = cut(sketches(docs, key, text))
    groups = cut(each.groupBy("set").agg(F.min("key").alias("low"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("counts").alias("counts")))
    parts = components(docs, each, groups, key, text)
    linked = cut(groups.select("set", "low").join(parts.withColumnRenamed("node", "set"), "set"))
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("low").isNull(), "low", "set")).alias("best"))
    # a large component's sets are dealt to SALT tasks
    copies = best.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    won = linked.withColumn("salt", F.pmod(F.xxhash64("set"), F.lit(SALT)).cast("int")).join(copies, ["root", "salt"]).select("set", F.col("best.low").alias("best_key"), F.col("best.set").alias("best_set"))
    alone = groups.join(parts.select(F.col("node").alias("set")), "set", "left_anti").select("set", F.col("low").alias("best_key"), F.col("set").alias("best_set"))
    return each.select("key", "set"), cut(won.unionByName(alone))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: one with the least key.

    Texts link if the Jaccard similarity of their sets of 5-word shingles (ASCII letters in lower case) is 0.8
    or more; groups are what links connect. No pair below 0.8 links. A pair of exactly 0.8 fails to meet with a chance of about
    3 in a million in the worst case of PARTS and MEAN, more similar pairs with less. Null and wordless texts
    link with each other. Texts are shuffled only for keys that are null or repeated, and to drop more keys than can be broadcast.
    """
    each, best = winners(docs, key, text)
    own, mark = free_name(docs, "kept_key"), free_name(docs, "kept_set")
    repeated = each.groupBy(F.col("key").alias("again")).agg(F.count("*").alias("rows")).where("rows > 1 or again is null").select("again")
    named = each.join(best, "set")
    gone = cut(named.where(~F.col("key").eqNullSafe(F.col("best_key"))).select(F.col("key").alias(own)).union(repeated).where(F.col(own).isNotNull()).distinct())
    rest_of = best.select("best_key", "best_set").distinct().join(repeated, F.col("best_key").eqNullSafe(F.col("again")), "left_semi")
    many = cut(rest_of.select(F.col("best_key").alias(own), F.col("best_set").alias(f"{mark}_")))
    out = docs.where(docs[key].isNotNull()).join(F.broadcast(gone) if small_enough(gone, 16) else gone, docs[key] == gone[own], "left_anti")
    if many.isEmpty():
        return out

    @F.pandas_udf("bigint")
    def sets(texts):
        import pandas as pd

        return pd.Series([set_id(shingles(t)[0]) for t in texts], dtype="int64")

    rest = docs.join(many, docs[key].eqNullSafe(many[own]), "left_semi")
    rest = rest.withColumn(mark, sets(rest[text]))
    rest = rest.join(many, rest[key].eqNullSafe(many[own]) & (rest[mark] == many[f"{mark}_"]), "left_semi")
    return out.unionByName(rest.dropDuplicates([key, mark]).drop(mark))
