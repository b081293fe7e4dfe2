"""Registered queries of this package, one for each operator, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, compression_quality, exact_topk, licenses, minhash, packing, pii, sentencepiece_codec, sharding, toxicity, vector_codes, warc
from .frames import table


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether decoding gives its text back."""
    return sentencepiece_codec.encode(_docs(spark, sf_dir), vocabulary("piece_bpe_32k.model"))


def op2_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression_quality.assess(_docs(spark, sf_dir))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return exact_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.annotate(_docs(spark, sf_dir))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_docs(spark, sf_dir), vocabulary("word_bpe_49k.json"), 1, 4096)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conversations and one whose texts are control strings, formatted and read back."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    text = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_windows(rows.unionByName(more), vocabulary("byte_bpe_50k.json")))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return toxicity.scores(docs, toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic")))


def op8_hash_tree_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_docs(spark, sf_dir), sharding.tree(16), sharding.tree(16, extra=1))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.duplicates(_docs(spark, sf_dir), minhash.Likeness(words=3, share=85))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_docs(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.encode(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def license_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scan of operator 10 over known texts as files hold them, as `documents` has no whole licence."""
    return licenses.scan(spark.createDataFrame(licenses.variants(), "doc_id long, text string"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_sentencepiece, op2_compression_quality, op3_exact_topk, op4_pii, op5_packing, op6_chat, op7_toxicity, op8_hash_tree_sharding, op9_minhash, op10_license_scan, op11_warc, op12_centroids, op13_vector_codes, license_variants)
}

ORACLE: dict[str, str] = {
    "op3_exact_topk": """with v as (select vec_id::bigint as vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.w, c.w), lambda p: p[1] * p[2]))::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0)
select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 5""",
    "op11_warc": warc.round_trip_sql(),
    "op12_centroids": centroids.cluster_sql(),
    "op13_vector_codes": vector_codes.encode_sql(),
    "op10_license_scan": licenses.scan_sql(),
    "license_variants": licenses.variants_sql(),
}
