"""Order within folders over ranges: places and neighbours without a folder in one task.

Files are dealt by ranges of (folder, natural key, name) and written once, so the ranges stay as they are; what follows
works inside a range, and a row per (folder, range) carries what goes on in the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions.store import materialize
from framequarry.operators.results import natural_key


def ranged(files: DataFrame, folder: str, name: str, ranges: int | None = None) -> DataFrame:
    """(folder, name, sort_key, part) of ``files`` in natural order: all of one ``part`` comes before all of the next. A
    written table; ``release`` deletes it."""
    keyed = files.select(F.col(folder).alias("folder"), F.col(name).alias("name"), natural_key(F.col(name)).alias("sort_key"))
    dealt = keyed.repartitionByRange(*([ranges] if ranges else []), "folder", "sort_key", "name")
    return materialize(dealt.withColumn("part", F.spark_partition_id()), "file-ranges")


def _inside(rows: DataFrame) -> tuple:
    own = Window.partitionBy("folder", "part")
    return own, own.orderBy("sort_key", "name")


def _edges(rows: DataFrame) -> DataFrame:
    """(folder, part, n, first, last): a row for each part that a folder has files in."""
    place = F.struct("sort_key", "name")
    return rows.groupBy("folder", "part").agg(F.count("*").alias("n"), F.min(place)["name"].alias("first"), F.max(place)["name"].alias("last"))


def neighbours(files: DataFrame, folder: str = "dir", name: str = "name", ranges: int | None = None) -> DataFrame:
    """(folder, name, prev_name, next_name): the files before and after each in its folder, wrapping round.

    A file that is alone is its own neighbour; files without folder are one folder; equal names are neighbours of each other.
    """
    rows = ranged(files, folder, name, ranges)
    _, order = _inside(rows)
    parts = Window.partitionBy("folder").orderBy("part")  # a row for each part
    whole = parts.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = _edges(rows).select("folder", "part", F.coalesce(F.lag("last").over(parts), F.last("last").over(whole)).alias("before"), F.coalesce(F.lead("first").over(parts), F.first("first").over(whole)).alias("after"))
    near = rows.select("folder", "part", "name", F.lag("name").over(order).alias("prev_name"), F.lead("name").over(order).alias("next_name"), (F.row_number().over(order) == 1).alias("opens")).withColumnRenamed("folder", "own").withColumnRenamed("part", "at")
    joined = near.join(edges, F.col("own").eqNullSafe(F.col("folder")) & (F.col("at") == F.col("part")))
    return joined.select(F.col("own").alias(folder), F.col("name").alias(name), F.coalesce("prev_name", "before").alias("prev_name"), F.coalesce("next_name", "after").alias("next_name"))


def places(files: DataFrame, name: str = "name", ranges: int | None = None) -> DataFrame:
    """(name, place): the number of each file, from 1, in the natural order of all of them."""
    rows = ranged(files.select(name, F.lit("").alias("all_files")), "all_files", name, ranges)
    _, order = _inside(rows)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part
    base = _edges(rows).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    at = rows.select("part", "name", F.row_number().over(order).alias("at"))
    return at.join(F.broadcast(base), "part").select(F.col("name").alias(name), (F.col("base") + F.col("at")).alias("place"))
