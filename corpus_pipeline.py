"""Corpus pipeline: quality rules, line dedup, near-duplicates, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. Between
stages the documents are written as Parquet in the shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeloom.llm import bpe_chunks, fertility, line_join, odd_minhash, queries, winnow
from changeloom.sources.shared import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the quality rules."""
    return fertility.keep_good(docs, queries.PIECE_MODEL, language_column="lang")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines of any length that repeat an earlier one; ``n_chars`` follows the text."""
    left = line_join.drop_lines(docs, line_join.similar_lines(docs, least_words=1))
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id."""
    found = odd_minhash.near_duplicates(docs, n=5, percent=80, bands=32, rows=5)
    gone = found.where("not kept").select(F.col("doc_id").alias("_doc")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_doc"], "left_anti")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return winnow.drop_contaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text of every document left."""
    return bpe_chunks.encode_documents(docs, queries.BYTE_RANKS, queries.public_tokenizers.PATTERN, queries.BYTE_VOCABULARY)


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("bpe", bpe),
]
# Tokens, MinHash bands and words' hashes are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = queries.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
