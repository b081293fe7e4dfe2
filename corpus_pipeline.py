"""A training-data pipeline over `documents`: five stages, each one operator of the llm package.

Edge cases: each stage judges a row by its own text, whole, however long; a null or empty text fails the quality rules and
goes; rows that repeat a text, with one doc_id or several, count once; rows without doc_id pass the near-dedup stage;
an empty table gives an empty result; columns of any names besides doc_id and text reach the last stage as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gritstone.llm import compression_quality, minhash, packing, pii, toxicity
from gritstone.llm.frames import cut, discard, scratch, table
from gritstone.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels", "doc_id", "toxic"))
    return toxicity.keep_clean(docs, model)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return compression_quality.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicate texts, the one with the smallest doc_id; rows without doc_id stay."""
    return minhash.drop_copies(docs)


def mask_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents, packed into sequences of 4096."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), 1, 4096)


STAGES = [("toxicity", drop_toxic), ("quality", drop_poor), ("near_dedup", drop_copies), ("pii", mask_private), ("packing", pack)]

#: No stage but the base part of the rules can be said in SQL: the tests hold run() against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are written to the shared folder and read again.

    When a stage is written, what it and the stage before it had written goes, also if a stage fails.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        try:
            with scratch(spark) as own:
                out = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
                own.keep(out)
        finally:
            discard(docs)
        docs = out
    return docs
