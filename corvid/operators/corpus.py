"""Corpus building: cleaning, duplicates, appends, balance, profiles, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvid.functions import fixed
from corvid.functions.text import normalize, parse_label, template_hash, text_hash, words
from corvid.plans.session import cut, spread


def checked(rows: DataFrame, compose: bool = True) -> DataFrame:
    """rows (ord, text, label, source, source_file; missing ones take defaults) with normalized text, parsed label, hash and a flag for each reason to reject. Reasons overlap."""
    for name, value in (("text", F.lit("")), ("label", F.lit(None).cast("string")), ("source", F.lit("unknown")), ("source_file", F.lit(""))):
        if name not in rows.columns:
            rows = rows.withColumn(name, value)
    # exploded, so that no filter is moved below and each text is normalized once
    rows = spread(rows).select("ord", F.explode(F.array(normalize(F.col("text"), compose))).alias("text"), parse_label(F.col("label")).alias("label"), F.coalesce("source", F.lit("unknown")).cast("string").alias("source"), F.coalesce("source_file", F.lit("")).cast("string").alias("source_file"))
    invalid = F.col("text").isin(fixed.PLACEHOLDER_TEXTS)
    return rows.select(
        "*",
        text_hash(F.col("text")).alias("text_hash"),
        invalid.alias("invalid_text"),
        F.col("label").isNull().alias("invalid_label"),
        (~invalid & (F.length("text") < fixed.MIN_CHARS)).alias("too_short"),
        (~invalid & (F.size(words(F.col("text"))) < fixed.MIN_WORDS)).alias("too_few_words"),
        (F.length("text") > fixed.MAX_CHARS).alias("too_long"),
    )


REASONS = ("invalid_text", "invalid_label", "too_short", "too_few_words", "too_long")
KEPT = ("ord", "text", "label", "source", "source_file", "text_hash")


def reject_counts(rows: DataFrame, compose: bool = True) -> DataFrame:
    """One row: how many rows each reason rejects, and how many none does."""
    c = checked(rows, compose)
    ok = ~(F.col("invalid_text") | F.col("invalid_label") | F.col("too_short") | F.col("too_few_words") | F.col("too_long"))
    return c.agg(F.count("*").alias("n_rows"), *[F.count_if(F.col(r)).alias(r) for r in REASONS], F.count_if(ok).alias("valid"))


def valid(rows: DataFrame, compose: bool = True) -> DataFrame:
    c = checked(rows, compose)
    for r in REASONS:
        c = c.where(~F.col(r))
    return c.select(*KEPT)


def first_wins(rows: DataFrame, *keys: str) -> DataFrame:
    """The row with the least ord of each key: a `min` with partial aggregation, and a join on ord, so that no key gathers its texts."""
    first = rows.groupBy(*keys).agg(F.min("ord").alias("ord")).select("ord")
    return rows.join(first, "ord", "left_semi")


def without_conflicts(rows: DataFrame, key: str, label: str = "label") -> DataFrame:
    """Rows whose key has a single label."""
    clash = rows.groupBy(key).agg(F.min(label).alias("l"), F.max(label).alias("h")).where("l != h").select(key)
    return rows.join(clash, key, "left_anti")


def take(v: DataFrame, best: DataFrame) -> DataFrame:
    """One row of v for each row of best (SLIM's columns, m: how many rows of v have all of them, and others, which are added).

    Rows are taken by all of SLIM, so that a repeated ord brings no other text along; only texts of rows that are
    equal in all of it are shuffled, to leave one of each.
    """
    # a null ord is an ord of its own
    same = lambda x: [v[c].eqNullSafe(x[c]) for c in SLIM]
    added = [c for c in best.columns if c not in (*SLIM, "m")]
    once, several = (best.where(cond) for cond in ("m = 1", "m > 1"))
    out = v.join(once, same(once)).select(*[v[c] for c in KEPT], *[once[c] for c in added])
    if several.isEmpty():
        return out
    more = v.join(several, same(several)).select(*[v[c] for c in KEPT], *[several[c] for c in added])
    return out.unionByName(more.dropDuplicates(list(SLIM)))


SLIM = ("ord", "source", "source_file", "label", "text_hash")


def first_of(slim: DataFrame, *keys: str) -> DataFrame:
    """The row of slim that comes first of each key: by ord, then by what else it has; a `min` with partial aggregation."""
    # SLIM leads with ord; a join on a key moves that key to the front of slim's own columns
    cols = [*SLIM, *(c for c in slim.columns if c not in (*SLIM, "m"))]
    counted = slim if "m" in slim.columns else slim.groupBy(*cols).agg(F.count("*").alias("m"))
    return counted.groupBy(*keys).agg(F.min(F.struct(*cols, "m")).alias("w")).select("w.*")


def clean(rows: DataFrame, compose: bool = True) -> DataFrame:
    """Valid rows, without texts that have both labels, the first of each text.

    Choices are made on a checkpointed table of ids, labels and hashes; texts are read again to
    take the chosen ones, and never shuffled before. ord need not be unique: rows with the same ord are ordered by their source and file.
    """
    v = valid(rows, compose)
    slim = cut(v.select(*SLIM))
    return take(v, cut(first_of(without_conflicts(slim, "text_hash"), "text_hash")))


def dedupe_templates(rows: DataFrame, compose: bool = True) -> DataFrame:
    """clean, then the same by template fingerprint; the first of each label and fingerprint stays."""
    v = valid(rows, compose)
    slim = cut(v.select(*SLIM, template_hash(F.col("text")).alias("template_hash")))
    once = cut(first_of(without_conflicts(slim, "text_hash"), "text_hash"))
    return take(v, cut(first_of(without_conflicts(once, "template_hash"), "label", "template_hash"))).select(*KEPT, "template_hash")


def append_new(rows: DataFrame) -> DataFrame:
    """Of rows (ord, text_hash, label) in order, those that an append keeps.

    The first of a hash is kept; later ones with its label are skipped until another label comes, which is kept, and
    from then on every row of that hash is.
    """
    first = rows.groupBy("text_hash").agg(F.min(F.struct("ord", "label")).alias("first"))
    told = rows.join(first, "text_hash")
    other = told.where(F.col("label") != F.col("first.label")).groupBy("text_hash").agg(F.min("ord").alias("clash"))
    # minima by hash, so that no task orders the rows of one
    return told.join(other, "text_hash", "left").where((F.col("ord") == F.col("first.ord")) | (F.col("ord") >= F.col("clash"))).select(*rows.columns)


def upsert_status(new: DataFrame, existing: DataFrame, overwrite: bool = False, min_chars: int = 10) -> DataFrame:
    """new (text, text_hash, …) with a status against existing (text_hash): added, replaced, duplicate or error."""
    known = existing.select("text_hash").distinct().withColumn("known", F.lit(True))
    return new.join(known, "text_hash", "left").withColumn("status", F.when(F.length("text") < min_chars, "error").when(F.col("known") & F.lit(not overwrite), "duplicate").when(F.col("known"), "replaced").otherwise("added")).drop("known")


def is_synthetic(source: Column) -> Column:
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.startswith(s, F.lit(fixed.SYNTHETIC_PREFIX)) | s.isin(fixed.SYNTHETIC_SOURCES)


def undersample(rows: DataFrame, by: str = "label", key: str = "text_hash", seed: str = "42") -> DataFrame:
    """As many rows of each class as the least has: those whose hash with the seed is least.

    Ranks come from a global count below each hash: rows are range-partitioned by (class, hash), so a hot
    class spreads over all tasks.
    """
    n = rows.groupBy(by).agg(F.count("*").alias("n")).agg(F.min("n").alias("n")).first()["n"] or 0
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    ranked = rank_within(rows.withColumn("draw", order), [by], ["draw", key])
    return ranked.where(F.col("rank") <= n).drop("draw", "rank")


def rank_within(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """row_number within each group, without gathering a group in one task.

    Rows are range-partitioned and sorted by (groups, order); a task numbers its own rows, and the sizes of what
    stands before it (a row for each task and group) are added.
    """
    spread = cut(rows.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("part", F.spark_partition_id()))
    own = Window.partitionBy("part", *groups).orderBy(*order)
    sizes = spread.groupBy("part", *groups).agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy(*groups).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    same = [spread[g].eqNullSafe(before[g]) for g in groups]
    cond = spread["part"] == before["part"]
    for s in same:
        cond = cond & s
    numbered = spread.withColumn("own", F.row_number().over(own))
    cond = numbered["part"] == before["part"]
    for g in groups:
        cond = cond & numbered[g].eqNullSafe(before[g])
    return numbered.join(F.broadcast(before), cond).select(*[numbered[c] for c in rows.columns], (F.col("own") + F.col("before")).alias("rank"))


def profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by each key on its own and in all: one pass of grouping sets."""
    sets = [[F.col(k)] for k in keys]
    counts = rows.groupingSets([*sets, []], *keys).agg(F.count("*").alias("n_rows"), F.count_if(F.col("label") == 1).alias("n_positive"))
    return counts.select(*[F.coalesce(k, F.lit("*")).alias(k) for k in keys], "n_rows", "n_positive")


def constraint_counts(rows: DataFrame) -> DataFrame:
    """(rule, violations) of a training table (text_hash, label, source, split, campaign_id)."""

    def spans(key: str, what: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(what).alias("n")).agg(F.count_if(F.col("n") > 1).alias("violations")).select(F.lit(f"{key}_in_several_{what}s").alias("rule"), "violations")

    one = rows.agg(
        F.count_if(~F.coalesce(F.col("label").isin(0, 1), F.lit(False))).alias("label_domain"),
        F.count_if(~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False))).alias("unknown_split"),
        F.count_if(F.startswith(F.lower("source"), F.lit("ubuntu_"))).alias("banned_source"),
        F.count_if(is_synthetic(F.col("source")) & (F.col("split") != "train")).alias("synthetic_outside_train"),
    )
    names = one.columns
    flat = one.select(F.expr(f"stack({len(names)}, {', '.join(f'{chr(39)}{n}{chr(39)}, {n}' for n in names)}) as (rule, violations)"))
    return flat.unionByName(spans("text_hash", "split")).unionByName(spans("campaign_id", "split")).unionByName(spans("text_hash", "label"))


def class_weights(rows: DataFrame) -> DataFrame:
    """(label, n, weight): rows / (classes × rows of the class)."""
    n = rows.groupBy("label").agg(F.count("*").alias("n"))
    return n.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("n")))


def hash_split(rows: DataFrame, key: str, shares: dict[str, float] | None = None) -> Column:
    """A split name by a hash of key, the same for equal keys."""
    draw = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, low = F.lit(None).cast("string"), 0.0
    for name, share in (shares or {"train": 0.7, "validation": 0.1, "test": 0.2}).items():
        out = F.when((draw >= low) & (draw < low + share), name).otherwise(out)
        low += share
    return F.coalesce(out, F.lit("test"))


def hard_negatives(spark, categories: DataFrame, entities: list[str], events: list[str]) -> DataFrame:
    """Rows (category, language, batch, text) from templates: categories (category, language, templates, signatures) × entities × events.

    The product is of fixed lists; a row's template and signature go round by its number.
    """
    one = lambda name, values: spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{name}_ord int, {name} string")
    rows = categories.crossJoin(F.broadcast(one("entity", entities))).crossJoin(F.broadcast(one("event", events)))
    n = F.row_number().over(Window.partitionBy("category", "language").orderBy("entity_ord", "event_ord"))
    rows = rows.withColumn("counter", n).withColumn("batch", (F.col("event_ord") % 2) + 1)
    pick = lambda a, i: F.element_at(a, F.pmod(i, F.size(a)) + 1)
    body = F.replace(F.replace(pick(F.col("templates"), F.col("counter") - 1), F.lit("{entity}"), F.col("entity")), F.lit("{event}"), F.col("event"))
    return rows.select("category", "language", "batch", "counter", F.concat_ws("\n", body, pick(F.col("signatures"), F.col("counter") + F.col("batch"))).alias("text"))


def generator_checks(rows: DataFrame, forbidden: list[str], min_chars: int = 40, min_words: int = 5) -> DataFrame:
    """(rows, distinct_texts, too_short, too_few_words, forbidden) of generated rows."""
    banned = F.lit(False)
    for phrase in forbidden:
        banned = banned | F.contains(F.lower("text"), F.lit(phrase))
    return rows.agg(F.count("*").alias("rows"), F.countDistinct("text").alias("distinct_texts"), F.count_if(F.length("text") < min_chars).alias("too_short"), F.count_if(F.size(words(F.col("text"))) < min_words).alias("too_few_words"), F.count_if(banned).alias("forbidden"))


def manifest(spark, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256) of the files below path."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def compose(public: DataFrame, synthetic: DataFrame, share: float = fixed.MAX_SYNTHETIC_SHARE, seed: str = "42") -> DataFrame:
    """public (text_hash, label, source, split) and, in its training split, as many synthetic rows (text_hash, label, source) as make up at most `share` of it.

    The number is even, half of it of each label; those with the least hash of the seed are taken, and none whose text is public already.
    """
    n = public.where("split = 'train'").count()
    half = int(share * n / (1 - share)) // 2
    fresh = synthetic.join(public.select("text_hash"), "text_hash", "left_anti")
    fresh = first_wins(fresh.withColumn("ord", F.sha2(F.concat_ws(":", F.lit(seed), "text_hash"), 256)), "text_hash")
    counts = {r["label"]: r["n"] for r in fresh.groupBy("label").agg(F.count("*").alias("n")).collect()}
    half = min(half, counts.get(0, 0), counts.get(1, 0))
    ranked = rank_within(fresh, ["label"], ["ord"]).where(F.col("rank") <= half)
    return public.select("text_hash", "label", "source", "split").unionByName(ranked.select("text_hash", "label", "source", F.lit("train").alias("split")))


def source_policy(names: list[str]) -> tuple[list[str], list[str]]:
    """(sources to build from, in order and once; sources that are refused)."""
    told = list(dict.fromkeys(names))
    refused = [x for x in told if x in fixed.DISALLOWED_SOURCES or x in fixed.LEGACY_SOURCES]
    return [x for x in told if x not in refused], refused
