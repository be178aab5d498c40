"""Tiles at rest: a table bucketed by frame and band, so that what is joined to tiles comes to them.

A band is a run of ``BAND`` pixel rows of a frame, whole tiles and background cells. Small tables (a mesh, say) are cut by
band as well and joined on (path, band): they are shuffled into the tiles' buckets, the tiles stay where they are, and a
frame of any size is spread over the buckets of its bands.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions.store import delete, shared_dir

#: Pixel rows of a band, about: as many whole tiles as fit.
BAND = 1024


def band_of(side: int) -> int:
    """Pixel rows of a band of tiles with ``side`` rows."""
    return max(side, BAND // side * side)


def banded(tiles: DataFrame, band: int = BAND) -> DataFrame:
    return tiles if "band" in tiles.columns else tiles.withColumn("band", F.floor(F.col("y0") / band).cast("int"))


@dataclass
class TileTable:
    """A written table of tiles; ``drop`` deletes it."""

    spark: SparkSession
    name: str
    path: str
    band: int
    buckets: int

    @property
    def tiles(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete(self.spark, self.path)


def write(tiles: DataFrame, side: int = 256, buckets: int | None = None) -> TileTable:
    """Write ``tiles`` (``frames.TILES`` of ``side`` rows) into buckets by (path, band), without a shuffle. Rows with an
    error are kept. A task writes a file for each bucket that it meets, so both should follow the bytes: ``buckets`` is the
    number of ``tasks`` that ``blocks.tiles`` dealt the ranges to, or else the number of shuffle partitions, unless given.
    """
    spark = tiles.sparkSession
    name, path = f"tiles_{uuid.uuid4().hex}", shared_dir(spark, "tiles")
    n, band = buckets or getattr(tiles, "tasks", None) or int(spark.conf.get("spark.sql.shuffle.partitions")), band_of(side)
    banded(tiles, band).write.bucketBy(n, "path", "band").format("parquet").option("path", path).saveAsTable(name)
    return TileTable(spark, name, path, band, n)


def with_bands(mesh: DataFrame, cell: int, band: int) -> DataFrame:
    """``mesh`` (frame_id, cy, cx, ...) in a row per band: its cells, and those next to it that reach into it, packed in
    order as ``m``, with the first row ``cy0`` and the number of columns ``gw``."""
    rows = band // cell
    edge = F.pmod("cy", F.lit(rows))
    own = F.floor(F.col("cy") / rows).cast("int")
    bands = F.array_compact(F.array(own, F.when((edge == 0) & (own > 0), own - 1), F.when(edge == rows - 1, own + 1)))
    packed = mesh.withColumn("band", F.explode(bands)).groupBy(F.col("frame_id").alias("path"), "band")
    return packed.agg(F.min("cy").alias("cy0"), (F.max("cx") + 1).alias("gw"), F.array_sort(F.collect_list(F.struct("cy", "cx", "bg", "noise"))).alias("m")).select("path", "band", "cy0", "gw", F.col("m.bg").alias("mb"), F.col("m.noise").alias("mn"))
