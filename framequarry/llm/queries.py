"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, decontaminate, exact_dedup, filter_audit, html_extract, language_id, ngram_join, packing, quality, substring_dedup, token_alignment, token_files, toxicity
from .shared import materialize, scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_tokens(*token_files.write_tokens(table(spark, sf_dir, "documents"), byte_bpe(), end_id=2))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.read_back(*chat_format.format_chats(chat_format.with_planted(table(spark, sf_dir, "conversations"))))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.classify(docs, language_id.fit(docs))
    return found.select("doc_id", F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), byte_bpe(), end_id=1, length=2048)


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.scan(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.removals(table(spark, sf_dir, "documents"), n=13)


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), n=5, percent=75)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_alignment.align(table(spark, sf_dir, "documents"), byte_bpe(), public_tokenizers.path("piece_bpe_32k.model"))


def _tidy(query: Callable) -> Callable:
    """The query with its result written, so that the tables that it made on the way can go."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with scratch(spark):
            return materialize(query(spark, sf_dir), query.__name__, keep=True, compression="zstd")

    return run


def queries() -> dict:
    """All queries. The result of packing is as long as its token store, so writing it twice is not worth the store."""
    return {k: f if f is op4_packing else _tidy(f) for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_chat_format": chat_format.SQL, "op6_decontamination": decontaminate.SQL, "op7_substring_dedup": substring_dedup.SQL, "op8_ngram_join": ngram_join.SQL, "op9_exact_dedup": exact_dedup.SQL, "op12_filter_audit": filter_audit.SQL}
