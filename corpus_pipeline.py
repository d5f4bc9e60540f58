"""Corpus pipeline: quality, toxicity, exact duplicates, near duplicates, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that its predecessor kept. All but the
last return rows of ``docs`` with all columns; the last returns one row per piece of a document.
A null text counts as empty in every stage; an empty table passes through all of them.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitemill.llm import exact_dedup, importance, jaccard_join, packing, toxicity
from sitemill.session import materialise

#: Near duplicates: five words a shingle, similarity of 0.8 or more.
WORDS, PERCENT = 5, 80


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that importance resampling draws."""
    return importance.Draw(docs, _labels(spark, sf_dir)).filter(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose toxicity is below the threshold."""
    return toxicity.without_toxic(docs, _labels(spark, sf_dir))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first of equal documents."""
    return exact_dedup.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies."""
    return jaccard_join.without_near_copies(docs, WORDS, PERCENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents into sequences of 2048 tokens."""
    import public_tokenizers

    return packing.packed_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("exact dedup", exact_copies),
    ("n-gram Jaccard join", near_copies),
    ("best-fit packing", pack),
]
#: SQL can express neither the fitted stages nor the tokenizer: tests hold run() against a brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
