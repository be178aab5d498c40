"""Quality report of frame files: statistics, stars, sensor tilt, sky background and point spread, decoded once.

All parts read one tile table: stars come from the tile analysis and are dealt to tilt cells, background cells and zones
of the point-spread plate are cut from the tiles. Nothing of a frame's pixels is shuffled but slices of zones and of
background cells that straddle tiles.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions.store import materialize, release
from framequarry.operators import background, psf, tilereduce, tiletable, tilework, tilt
from framequarry.operators.analysis import METRICS, once
from framequarry.operators.results import content_key
from framequarry.sources import blocks, frames

TILT = ["tilt_known", "hfr_min", "hfr_max", "best_corner", "worst_corner", "tilt_pct", "curvature_pct"]
SKY = ["bg_median", "radial_drop", "azim_aniso", "radial_r2", "amplitude", "direction", "plane_r2", "corner_excess", "corner_asymmetry"]
PLATE = ["psf_stars", "psf_zones", "psf_elong", "psf_radial", "psf_tangential"]


@dataclass
class Report:
    """Written tables, frames named by cache_key as frame_id. ``release`` deletes them.

    ``rows``: ``METRICS`` per frame. ``stars``: all stars. ``cells``: tilt grid. ``surface``: background cells with their
    floor and fitted surface, for frames that are large enough. ``zone_stars``, ``zones``: point-spread plate. ``failed``:
    frame_id and error of files that could not be decoded.
    """

    rows: DataFrame
    stars: DataFrame
    cells: DataFrame
    surface: DataFrame
    zone_stars: DataFrame
    zones: DataFrame
    failed: DataFrame
    grid: int
    sky_rows: int
    sky_cols: int

    def summary(self) -> DataFrame:
        """A row per file: cache_key, success, ``METRICS``, ``TILT``, ``SKY``, ``PLATE``, error. A frame too small for a
        background map has nulls there; a failed file has nulls everywhere but in its key and error."""
        lean = tilt.summary(self.cells, self.grid).withColumnRenamed("success", "tilt_known")
        sky = background.diagnostics(self.surface, self.sky_rows, self.sky_cols)
        some = F.col("n") > 0
        plate = self.zones.groupBy("frame_id").agg(
            F.sum("n").alias("psf_stars"), F.count_if(some).alias("psf_zones"), F.max(F.when(some, F.col("elong"))).alias("psf_elong"),
            F.count_if(F.col("axis") == "radial").alias("psf_radial"), F.count_if(F.col("axis") == "tangential").alias("psf_tangential"),
        )
        ok = self.rows.join(lean, "frame_id", "left").join(sky, "frame_id", "left").join(plate, "frame_id", "left").withColumns({"success": F.lit(True), "error": F.lit(None).cast("string")})
        both = ok.unionByName(self.failed.withColumn("success", F.lit(False)), allowMissingColumns=True)
        return both.select(F.col("frame_id").alias("cache_key"), "success", *METRICS, *TILT, *SKY, *PLATE, "error")

    def heatmap(self) -> DataFrame:
        """``background.heatmap`` of the frames that have a background map."""
        return background.heatmap(self.surface)

    def nodes(self) -> DataFrame:
        """``tilt.nodes`` of all frames."""
        return tilt.nodes(self.cells, self.grid)

    def release(self) -> None:
        release(self.rows, self.stars, self.cells, self.surface, self.zone_stars, self.zones, self.failed)


def report_files(files: DataFrame, tile: int = 256, grid: int = 3, nstar: int = 4, sky: dict | None = None, detection: dict | None = None) -> Report:
    """The report of ``files`` (path, content, length). Files with the same content are read once, whatever their paths.

    ``grid`` is the side of the tilt grid and of the point-spread plate, ``nstar`` the stars of a zone; ``sky`` has rows,
    cols and min_side of the background map and rounds and reject of its fit, ``detection`` what ``tilework.analyse`` takes.
    """
    keyed = once(content_key(files))
    return report_tiles(frames.tiles(keyed.select(F.col("cache_key").alias("path"), "content"), tile), tile, grid, nstar, sky, detection, keyed.buckets)


def report_headers(headers: DataFrame, tile: int = 256, grid: int = 3, nstar: int = 4, sky: dict | None = None, detection: dict | None = None) -> Report:
    """As ``report_files`` for ``blocks.read_headers`` with cache_key: a large frame is read by many tasks."""
    first = headers.groupBy("cache_key").agg(F.min("path").alias("path"))
    return report_tiles(blocks.tiles(headers.join(first, ["path", "cache_key"], "left_semi"), tile), tile, grid, nstar, sky, detection)


def report_tiles(tiles: DataFrame, tile: int = 256, grid: int = 3, nstar: int = 4, sky: dict | None = None, detection: dict | None = None, buckets: int | None = None) -> Report:
    """The report of ``frames.tiles``, frames named by their paths. An empty table gives empty tables."""
    sky = {"rows": background.ROWS, "cols": background.COLS, "min_side": 800} | (sky or {})
    fit = {k: sky.pop(k) for k in ("rounds", "reject") if k in sky}
    table = tiletable.write(tiles, tile, buckets)
    rows, found = tilework.analyse(table, **(detection or {}))
    ok = table.tiles.where("error IS NULL")
    size = ok.groupBy(F.col("path").alias("frame_id")).agg(F.first("width").alias("width"), F.first("height").alias("height"))
    placed = found.select("frame_id", F.col("cy").alias("y"), F.col("cx").alias("x"), "hfr", "ecc")
    cells = materialize(tilt.cells(placed, grid=grid, frames=size), "tilt-cells")
    surface = materialize(background.surface_fit(tilereduce.cell_floor(ok, **sky), sky["rows"], sky["cols"], **fit), "background-surface")
    zone_stars, zones = psf.plate_of_tiles(table.tiles, grid, nstar)
    failed = materialize(table.tiles.where("error IS NOT NULL").groupBy(F.col("path").alias("frame_id")).agg(F.min("error").alias("error")), "failed-files")
    table.drop()
    return Report(rows, found, cells, surface, zone_stars, zones, failed, grid, sky["rows"], sky["cols"])
