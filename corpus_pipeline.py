"""Corpus cleaning pipeline: language ID, exact dedup, near dedup, benchmark decontamination, packing.

Each stage works on all rows that the stage before it kept, and its result is written to the shared folder and read
back, so a lost executor costs part of one stage. Stages but the last return the columns of ``documents``, extra ones
included. Null, empty and blank texts and texts without letters go in the first stage (no language); very long texts
are read whole; repeated rows, and of rows with equal texts all but one, go in the second. Rows without doc_id represent
no near-duplicate group and stay. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from framequarry.llm import decontaminate, exact_dedup, language_id, ngram_join, packing
from framequarry.llm.queries import byte_bpe, table
from framequarry.llm.shared import discard, materialize, scratch


def recognised_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the nearest-centroid classifier rejects: no letters, or unlike every learned language."""
    return language_id.keep_recognised(docs, language_id.fit(docs))


def without_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, keeps the longest original, then the smallest doc_id."""
    return exact_dedup.drop_exact_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of every component of documents with a 5-word shingle Jaccard of 0.75 or more."""
    return ngram_join.drop_near_duplicates(docs, n=5, percent=75)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of whose words a twentieth or more lie in 13-word windows of benchmark items."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), remove="documents")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens, with every source in its share of each window."""
    return packing.pack(docs, byte_bpe(), end_id=1, length=2048)


STAGES = [
    ("language_id", recognised_language),
    ("exact_dedup", without_exact_copies),
    ("near_dedup", without_near_copies),
    ("decontamination", without_benchmark),
    ("packing", packed),
]
#: Language identification, packing and tokenising have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark):  # what a stage writes on the way goes when its result is written
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}", keep=True)
        if before is not None:
            discard(before)
        before = docs
    return docs
