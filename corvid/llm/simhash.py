"""SimHash near-duplicates by a segment-popcount embedding."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvid.operators.graph import connected_components
from corvid.plans.session import cut, ship

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
SEED = 42
#: Bits of each segment: 21 popcounts from 0 to 4, kept in one long with three bits each.
SEGMENTS = (3,) * 20 + (4,)
DIGIT = 3
#: Fingerprints of a cell beyond which it makes no pairs: its fingerprints are linked through shared words instead.
FULL = 16
SLICE = 1 << 16


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64-bit SimHash of a text's word shingles, unsigned; null and wordless texts have 0."""
    parts = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not parts:
        return 0
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    if len(parts) > words:
        spans = zip(starts[: len(parts) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)
    else:
        spans = iter([(0, len(line))])
    n = max(1, len(parts) - words + 1)
    digest = xxhash.xxh64_intdigest
    return majority(np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of some 64-bit hashes, as a number."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, SLICE):
        bits = np.unpackbits(hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3) -> DataFrame:
    """Rows (key, fp): fp is the fingerprint as a signed long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["key", "fp"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, fp bigint")


def popcounts(fp):
    """A fingerprint's grid cell: the popcount of each segment, plus 1, in three bits."""
    cell, at = F.lit(0).cast("long"), 0
    for i, width in enumerate(SEGMENTS):
        one = F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1))) + F.lit(1)
        cell = cell.bitwiseOR(F.shiftleft(one.cast("long"), DIGIT * i))
        at += width
    return cell


def manhattan(a: str, b: str):
    """The distance of two cells: a lower bound on the differing bits of their fingerprints."""
    mask = (1 << DIGIT) - 1
    digit = lambda c, i: F.shiftrightunsigned(c, DIGIT * i).bitwiseAND(F.lit(mask))
    return sum((F.abs(digit(a, i) - digit(b, i)) for i in range(1, len(SEGMENTS))), F.abs(digit(a, 0) - digit(b, 0)))


def meetings(distinct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Grid range-join of fingerprints at Manhattan distance 2: (rows (cell, fp, home) of cells that few fingerprints share, rows (fp) of those in full ones).

    Two cells at distance 2 or less share a cell at distance 1 or less from both, so each fingerprint is
    entered in the 43 cells about its own.
    """
    steps = [F.lit(1 << DIGIT * i).cast("long") for i in range(len(SEGMENTS))]
    about = F.array("home", *[F.col("home") + s for s in steps], *[F.col("home") - s for s in steps])
    cells = distinct.select("fp", popcounts(F.col("fp")).alias("home")).select("fp", "home", F.explode(about).alias("cell"))
    shared = cut(cells.withColumn("n", F.count("*").over(Window.partitionBy("cell"))).where("n > 1"))
    return shared.where(F.col("n") <= FULL).select("cell", "fp", "home"), shared.where(F.col("n") > FULL).select("fp").distinct()


def close_pairs(distinct: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs (a, b) of different fingerprints that connect all those at `bits` (2) or fewer differing bits.

    The popcount vectors of two fingerprints differ by at most their Hamming distance in Manhattan
    distance, so those that link meet in a cell of the grid (meetings). Those that meet are pairs if
    their cells' Manhattan distance is 2 or less, and are then verified by their bits. A cell of more than
    FULL fingerprints makes no pairs: fingerprints at 2 bits or less share a word at 1 bit or less from
    both, and all that share one are at 2 or less from each other; a word is shared by at most 65, so
    chaining its neighbours in order links them all, however dense a group is.
    """
    if bits != 2:
        raise ValueError("the grid and the full cells' check are for 2 bits")
    few, full = meetings(distinct)
    side = lambda n: few.select("cell", F.col("fp").alias(n), F.col("home").alias(f"home_{n}"))
    near = side("a").join(side("b"), "cell").where(F.col("a") < F.col("b")).where(manhattan("home_a", "home_b") <= bits).select("a", "b")
    flips = [F.lit((1 << i) - (1 << 64) * (i == 63)).cast("long") for i in range(64)]
    words = full.select("fp", F.explode(F.array("fp", *[F.col("fp").bitwiseXOR(x) for x in flips])).alias("mid"))
    chained = words.select(F.lag("fp").over(Window.partitionBy("mid").orderBy("fp")).alias("a"), F.col("fp").alias("b")).where("a is not null")
    return near.union(chained).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 3, bits: int = 2) -> DataFrame:
    """Rows (key, fp, component): a row for each row of docs, its fingerprint and the least key reachable over links.

    Texts link if their fingerprints differ in `bits` bits or fewer; equal fingerprints always link.
    Null and wordless texts have fingerprint 0 and link like any other. Null keys are kept as rows and
    never name a component unless all its keys are null. Repeated rows give repeated rows. Other columns
    of docs are not read, so their names cannot clash. An empty table gives an empty table.
    """
    each = cut(fingerprints(docs, key, text, words))
    groups = cut(each.groupBy("fp").agg(F.min("key").alias("low")))
    parts = connected_components(close_pairs(groups.select("fp"), bits))
    rooted = groups.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = rooted.join(lows, "root").select("fp", "component")
    return each.join(named, "fp").select("key", "fp", "component")


def hex_digits(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group: the one with the least key.

    Of repeated rows with that key, one of each different fingerprint stays; where no row of a
    group has a key, likewise. Only the texts of such repeated rows are shuffled to choose.
    """
    found = cut(near_duplicates(docs, key, text))
    own, mark = free_name(docs, "kept_key"), free_name(docs, "kept_fp")
    kept = cut(found.where(F.col("key").eqNullSafe(F.col("component"))).groupBy("key").agg(F.count("*").alias("rows_of_key")).select(F.col("key").alias(own), "rows_of_key"))
    single = kept.where(F.col("rows_of_key") == 1).select(own)
    out = docs.join(single, docs[key] == single[own], "left_semi")
    many = kept.where((F.col("rows_of_key") > 1) | F.col(own).isNull()).select(own)
    if many.isEmpty():
        return out
    rest = docs.join(many, docs[key].eqNullSafe(many[own]), "left_semi")
    return out.unionByName(rest.withColumn(mark, fingerprint_udf()(rest[text])).dropDuplicates([key, mark]).drop(mark))


def free_name(df: DataFrame, name: str) -> str:
    """name, lengthened until df has no such column."""
    while name.lower() in (c.lower() for c in df.columns):
        name += "_"
    return name


def fingerprint_udf():
    @F.pandas_udf("bigint")
    def run(texts):
        import pandas as pd

        return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).astype(np.int64))

    return run
