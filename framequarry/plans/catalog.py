"""Every registered query of the frame-quality jobs, with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import queries_pixels, queries_results, queries_tiles


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_pixels.star_full_analysis(spark, sf_dir)


def queries() -> dict:
    return queries_pixels.Q | queries_results.Q | queries_tiles.Q


def oracle_sql() -> dict[str, str]:
    return queries_pixels.SQL | queries_results.SQL | queries_tiles.SQL
