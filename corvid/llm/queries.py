"""The queries of this subpackage: the digests that the contracts fix, derived from the operators' results."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.llm import html_text, langid, lattice, media, packing, pieces, quality, simhash, toxicity, warc
from corvid.plans.session import table


def op1_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs))
    return found.select(F.col("key").alias("doc_id"), "held_out", F.col("lang").alias("lang_pred"), "score", "distance", "rejected")


def op2_media(spark, sf_dir):
    return media.round_trip(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op3_lattice(spark, sf_dir):
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings")).select(F.col("key").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op4_warc(spark, sf_dir):
    return warc.visits(warc.round_trip(table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op5_packing(spark, sf_dir):
    return packing.pack_near(table(spark, sf_dir, "documents")).withColumnRenamed("key", "doc_id")


def op6_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("key").alias("doc_id"), simhash.hex_digits("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def op7_pieces(spark, sf_dir):
    import public_tokenizers

    return pieces.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")).withColumnRenamed("key", "doc_id")


def op8_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.fit(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("key", "doc_id")


def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.grade(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"))).withColumnRenamed("key", "doc_id")


def op10_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).withColumnRenamed("key", "page_id")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_langid, op2_media, op3_lattice, op4_warc, op5_packing, op6_simhash, op7_pieces, op8_quality, op9_toxicity, op10_html_text, pipeline)}
ORACLES: dict[str, str] = {
    "op3_lattice": """
        with recursive v as (
            select vec_id, label, embedding::double[] as e from embeddings
            where label is not null and embedding is not null and len(embedding) > 0
              and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and len([x for x in embedding if x <> 0]) > 0),
        link as (
            select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
            where list_cosine_similarity(a.e, b.e) >= 0.93),
        reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join link l on r.b = l.a)
        select r.a as vec_id, coalesce(any_value(n.n), 0) as n_links, min(r.b) as component_id, r.a = min(r.b) as kept
        from reach r left join (select a, count(*) as n from link group by a) n on r.a = n.a group by r.a""",
    "op4_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as body from pages),
        d as (select page_id, octet_length(body) as payload_bytes, sha1(body) as payload_digest from p),
        t as (select *, max(page_id) over (partition by payload_digest) as top from d)
        select page_id, payload_bytes, payload_digest,
               case when payload_bytes >= 1000 and page_id <> top then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 1000 and page_id <> top then top end as refers_to
        from t""",
}
