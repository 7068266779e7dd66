"""Corpus pipeline: documents in, packed token sequences out.

Each stage takes all rows its predecessor kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabwarden.llm import identifiers, language, near_text, packing, quality
from tabwarden.sources.storage import scratch_path

#: A text whose two nearest languages are this close has none.
LEAST_MARGIN = 0.02


def _carried(docs: DataFrame) -> DataFrame:
    """The texts, each with its whole row in one column, so that no name of a row meets one of an operator."""
    return docs.select(docs["text"].alias("text"), F.struct(*(docs[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(docs.columns))).alias("document"))


def _released(rows: DataFrame, docs: DataFrame) -> DataFrame:
    return rows.select(*(F.col("document").getField(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognizable language go: no letter (or null), or two profiles as near as each other."""
    marked = language.identify(_carried(docs), language.learn_profiles(docs), keep=["document"])
    return _released(marked.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_MARGIN)), docs)


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the rules score under 0.5 go."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return _released(quality.score(_carried(docs), quality.train(docs, labels), keep=["document"]).where("predicted = 1"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id."""
    return near_text.drop_near_duplicates(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers are written as the name of their kind; n_chars follows."""
    return identifiers.redact(docs, "text", "n_chars")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece of a document in a sequence."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language_id", language_id), ("quality", quality_filter), ("near_dedup", near_dedup), ("pii", pii), ("packing", packed)]
#: The classifiers and the packing have no SQL; tests/llm holds the result against its parts and a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
