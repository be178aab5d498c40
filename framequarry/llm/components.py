"""Connected components of a link table by alternating large-star and small-star steps (DataFrame operations)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import few, materialize


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, component) for all nodes of ``links`` (a, b); the component is its smallest node.

    Every round is written to the shared folder, so lineage stays short and lost executors cost one round. Minima are
    combined before the shuffle and joined back, so a node with very many links is no hot group.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(64), "cc-edges")
    n = edges.count()
    before = None
    if not n:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        least = few(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")), n)
        large = few(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), n)
        least = few(large.groupBy("u").agg(F.min("v").alias("m")), n)
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        edges = materialize(few(small.where("u <> v").distinct(), n), "cc-edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before, n = now, now[0]
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    return edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component").union(edges.select("v", "v").distinct())


def gathered(links: DataFrame, rows: int, hops: int = 2) -> DataFrame:
    """(node, component) where the component is the smallest node within ``hops`` links: a part of the true component.

    Stars are gathered whole, in two aggregations and a join; longer chains stay in several parts.
    """
    both = links.union(links.select("b", "a")).toDF("node", "other")
    label = few(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("component")), rows)
    for _ in range(hops - 1):
        far = few(both.join(label.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("component")), rows)
        label = far
    return label
