"""Cleaning of a document table as a chain of stages, each written and read again.

Quality rules drop documents, line dedup shortens texts (and drops documents of
which nothing is left), near-duplicate groups keep their first document,
contaminated documents go, and the texts that remain are encoded.

Cases: rows with a null ``doc_id`` pass the stages that compare documents; further
columns of the table are carried to the last stage; an empty table gives an empty
result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flamelake.llm import bpe, decontaminate, line_dedup, near_dup, quality_rules, transducer
from flamelake.llm.common import stage, table

_HAS_WORD = r"[^\x20\x09-\x0D]"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = line_dedup.dedup(docs)
    emptied = (F.col("line_dedup.n_removed") > 0) & ~F.coalesce(F.col("text").rlike(_HAS_WORD), F.lit(False))
    left = left.where(~emptied).drop("line_dedup")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return left


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.first_of_groups(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, text``: token ids and the text decoded from them."""
    ids = bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return transducer.encode(docs, ids, public_tokenizers.PATTERN, keep=False, decoded=True)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminated),
    ("bpe", encoded),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
