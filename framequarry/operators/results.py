"""The versioned, content-keyed result table and the triage of a folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequarry.functions.text import general

SCHEMA_VERSION = 3
HEAD_BYTES = 65536


def content_key(files: DataFrame) -> DataFrame:
    """Identity of a file: hash of its first 64 KB and its size, whatever its path."""
    head = F.expr(f"substring(content, 1, {HEAD_BYTES})")
    return files.withColumn("cache_key", F.sha2(F.concat(head, F.encode(F.col("length").cast("string"), "UTF-8")), 256))


def key_duplicates(keyed: DataFrame) -> DataFrame:
    """Keys of more than one file: how many, and the first name."""
    return keyed.groupBy("cache_key").agg(F.count("*").alias("copies"), F.min("name").alias("first_name")).where("copies > 1")


def current(store: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """Rows of the current schema version; older ones do not count."""
    return store.where(F.col("schema_version") == version)


def lookup(keys: DataFrame, store: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    return keys.join(current(store, version), "cache_key")


def misses(keys: DataFrame, store: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    return keys.join(current(store, version).select("cache_key"), "cache_key", "left_anti")


def upsert(store: DataFrame, new: DataFrame) -> DataFrame:
    """Union in which the newest row of a key stays; of equally new ones the highest version, then the new one.

    ``store`` has one row per key, ``new`` may repeat keys. Only ``new`` is sorted; the store meets the keys of ``new``
    in a join, so a small batch is broadcast and the store is not shuffled.
    """
    w = Window.partitionBy("cache_key").orderBy(F.col("computed_at").desc(), F.col("schema_version").desc())
    newest = new.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")
    age = F.struct("computed_at", "schema_version")
    there = store.join(newest.select("cache_key", age.alias("__new")), "cache_key", "left").where(F.col("__new").isNull() | (age > F.col("__new")))
    met = store.select("cache_key", age.alias("__old")).join(newest.select("cache_key"), "cache_key", "left_semi")
    fresh = newest.join(met, "cache_key", "left").where(F.col("__old").isNull() | (age >= F.col("__old")))
    return there.select(*store.columns).unionByName(fresh.select(*new.columns))


def save(results: DataFrame, path: str) -> None:
    """Persist a result table, partitioned by version so old versions can be dropped as folders."""
    results.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("schema_version").parquet(path)


def append(results: DataFrame, path: str) -> None:
    """Add rows to a result table on disk; what is there stays untouched, so the cost is that of the new rows."""
    results.write.mode("append").partitionBy("schema_version").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The result table on disk, or None before its first rows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def top_per_folder(rows: DataFrame, k: int, by: str = "hfr_median", folder: str = "dir", tie: str = "frame_id", descending: bool = False) -> DataFrame:
    """The k best rows of each folder; nulls last."""
    order = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(folder).orderBy(order, tie))).where(F.col("rank") <= k)


def natural_key(name: Column) -> Column:
    """Case-insensitive sort key in which runs of digits, however long, order as numbers: by their length, then as text."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), 1)
    number = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
    return F.concat_ws("", F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.concat(F.lpad(F.length(number(p)).cast("string"), 10, "0"), number(p))).otherwise(p)))


def natural_sort(files: DataFrame, name: str = "name") -> DataFrame:
    return files.withColumn("sort_key", natural_key(F.col(name))).orderBy("sort_key", name)


def neighbours(files: DataFrame, folder: str = "dir", name: str = "name") -> DataFrame:
    """Previous and next file of a folder in natural order, wrapping round."""
    w = Window.partitionBy(folder).orderBy(natural_key(F.col(name)), name)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return files.select(folder, name, F.coalesce(F.lag(name).over(w), F.last(name).over(whole)).alias("prev_name"), F.coalesce(F.lead(name).over(w), F.first(name).over(whole)).alias("next_name"))


def quality_columns(catalog: DataFrame, analysis: DataFrame, version: int = SCHEMA_VERSION) -> DataFrame:
    """Catalog rows with their quality columns: pixel statistics on success, star columns only with stars."""
    a = current(analysis, version)
    ok, stars = F.col("success"), F.col("success") & (F.col("star_count") > 0)
    shown = lambda v, n: F.concat(general(v), F.lit(" ("), n.cast("string"), F.lit("x)"))
    cols = [F.when(stars, F.col("star_count")).cast("long").alias("star_count")]
    cols += [F.when(stars, F.round(src, 2)).alias(name) for src, name in (("hfr_median", "hfr"), ("hfr_stddev", "hfr_sd"), ("fwhm_median", "fwhm"), ("ecc_median", "ecc"))]
    cols += [F.when(ok, F.round(src, 0)).alias(name) for src, name in (("pix_mean", "stat_mean"), ("pix_stddev", "stat_sd"), ("pix_median", "stat_median"), ("pix_mad", "stat_mad"))]
    cols += [F.when(ok, shown(F.col(f"pix_{e}"), F.col(f"pix_{e}_count"))).alias(f"stat_{e}") for e in ("min", "max")]
    return catalog.join(a, "cache_key", "left").select(*[catalog[c] for c in catalog.columns], *cols)


def check_line(frames: DataFrame) -> DataFrame:
    """One summary text per frame: size, headers, extremes, stars, hfr."""
    text = F.format_string("OK %dx%d headers=%d min=%.3f max=%.3f stars=%d hfr=%.2f", *[F.col(c) for c in ("width", "height", "headers", "src_min", "src_max", "star_count", "hfr_median")])
    return frames.select("frame_id", text.alias("line"))
