"""The analysis row of a frame: pixel statistics and star summary, from pixels or straight from files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions.store import materialize, release
from framequarry.operators import pixels, stars, tiletable, tilework
from framequarry.operators.results import SCHEMA_VERSION, content_key
from framequarry.sources import blocks, frames

#: Files whose keys and paths are broadcast (about 150 bytes each).
FEW_FILES = 200_000
#: Files that one task decodes, if their bytes are few.
FILES_A_TASK = 500
#: Pixels of the raster sample that median and deviation are taken from, as in ``tilework.analyse``.
SAMPLE = 200_000
METRICS = ["star_count", "hfr_median", "hfr_stddev", "fwhm_median", "ecc_median", "pix_mean", "pix_stddev", "pix_median", "pix_mad", "pix_min", "pix_min_count", "pix_max", "pix_max_count"]


def analyse(px: DataFrame, **detection) -> tuple[DataFrame, DataFrame]:
    """(a row of ``METRICS`` per frame, the stars of all frames) of ``px`` (frame_id, y, x, r, for colour also g and b).

    The stars have their position, flux, hfr, fwhm, eccentricity and axis; both come from one detection.
    """
    px = pixels.luma(px).select("frame_id", "y", "x", "luma")
    found = stars.detect(px, **detection)
    rows = pixels.stats(px).join(pixels.median_mad(px, target=SAMPLE), "frame_id")
    return rows.join(stars.summary(rows, found), "frame_id").select("frame_id", *METRICS), found


def analyse_files(files: DataFrame, version: int = SCHEMA_VERSION, tile: int = 256, computed_at: int | None = None, detection: dict | None = None) -> DataFrame:
    """Rows of the result table for ``files`` (path, content, length): cache_key, schema_version, computed_at, success,
    the ``METRICS``, and error.

    Files with the same content key are read once, the first path of each. A file that cannot be decoded gives a row with
    success false, its error and no metrics. Pixels are decoded once, written as tiles, and analysed as tiles; file
    contents are not shuffled while the paths of ``files`` can be broadcast (``once``).
    """
    keyed = once(content_key(files))
    return _result_rows(frames.tiles(keyed.select(F.col("cache_key").alias("path"), "content"), tile), version, tile, computed_at, detection, keyed.buckets)


def analyse_headers(headers: DataFrame, version: int = SCHEMA_VERSION, tile: int = 256, computed_at: int | None = None, detection: dict | None = None) -> DataFrame:
    """As ``analyse_files`` for ``blocks.read_headers`` with cache_key: pixels are read by row ranges, and nothing but
    narrow rows is shuffled on the way to the tiles, whatever the number and the size of the files."""
    first = headers.groupBy("cache_key").agg(F.min("path").alias("path"))
    return _result_rows(blocks.tiles(headers.join(first, ["path", "cache_key"], "left_semi"), tile), version, tile, computed_at, detection)


def once(keyed: DataFrame) -> DataFrame:
    """The row with the first path of each cache_key of ``keyed`` (path, which names one row, cache_key, content ...). The
    choice is made on narrow rows and broadcast if it has at most ``FEW_FILES``; beyond that contents are dealt by path.

    Contents are read by tasks of about ``blocks.RANGE_BYTES`` or ``FILES_A_TASK`` files each, without a shuffle: the tasks
    that decode them each write a file a bucket, and should not be as many as the parts that the files come in. ``buckets``
    of the result is the number of buckets that their tiles fill."""
    first = materialize(keyed.groupBy("cache_key").agg(F.min("path").alias("path"), F.max("length").alias("length")), "first-paths")
    n, size = first.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    first = first.drop("length")
    chosen = keyed.join(F.broadcast(first) if n <= FEW_FILES else first, ["path", "cache_key"], "left_semi")
    buckets = max(-(-size // blocks.RANGE_BYTES), keyed.sparkSession.sparkContext.defaultParallelism)
    chosen = chosen.coalesce(max(buckets, -(-n // FILES_A_TASK)))
    chosen.buckets = min(buckets, int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chosen


def _result_rows(tiles: DataFrame, version: int, tile: int, computed_at: int | None, detection: dict | None, buckets: int | None = None) -> DataFrame:
    """Rows of the result table for ``tiles``, named by their cache_key: the tiles are written and dropped again."""
    table = tiletable.write(tiles, tile, buckets)
    rows, found = tilework.analyse(table, **(detection or {}))
    release(found)
    ok = rows.withColumnRenamed("frame_id", "cache_key").withColumns({"success": F.lit(True), "error": F.lit(None).cast("string")})
    failed = materialize(table.tiles.where("error IS NOT NULL").groupBy(F.col("path").alias("cache_key")).agg(F.min("error").alias("error")).withColumn("success", F.lit(False)), "failed-files")
    table.drop()
    when = F.unix_timestamp(F.current_timestamp()) if computed_at is None else F.lit(computed_at).cast("long")
    both = ok.unionByName(failed, allowMissingColumns=True)
    return both.select("cache_key", F.lit(version).alias("schema_version"), when.alias("computed_at"), "success", *METRICS, "error")
