"""Sensor tilt from star sizes over a grid of cells, and rotation of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions.order_stats import clamp, upper_median
from framequarry.functions.store import dealt


def cells(stars: DataFrame, width: int | None = None, height: int | None = None, grid: int = 3, frames: DataFrame | None = None) -> DataFrame:
    """Count, median hfr and mean eccentricity of each grid cell of each frame; all cells are present.

    ``frames`` (frame_id, width, height) gives each frame its own size, and cells to frames without stars; else all have
    ``width`` and ``height``, and only frames with stars are known.
    """
    if frames is None:
        frames = stars.select("frame_id").distinct().withColumns({"width": F.lit(width), "height": F.lit(height)})
    at = lambda c, size: clamp(F.floor(F.col(c) * grid / F.col(size)), 0, grid - 1).cast("long")
    placed = stars.join(dealt(frames.select("frame_id", "width", "height")), "frame_id")
    found = placed.groupBy("frame_id", at("y", "height").alias("gy"), at("x", "width").alias("gx")).agg(F.count("*").alias("n"), upper_median("hfr").alias("hfr"), F.avg("ecc").alias("ecc"))
    side = F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))
    full = frames.select("frame_id").withColumn("gy", F.explode(side)).withColumn("gx", F.explode(side))
    return full.join(dealt(found), ["frame_id", "gy", "gx"], "left").select("frame_id", "gy", "gx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("hfr", F.lit(0.0)).alias("hfr"), F.coalesce("ecc", F.lit(0.0)).alias("ecc"))


def _corner(grid: int) -> Column:
    last = grid - 1
    spots = {(0, 0): 0, (0, last): 1, (last, 0): 2, (last, last): 3}
    out = F.lit(None).cast("long")
    for (y, x), k in spots.items():
        out = F.when((F.col("gy") == y) & (F.col("gx") == x), F.lit(k).cast("long")).otherwise(out)
    return out


def summary(tilt_cells: DataFrame, grid: int = 3) -> DataFrame:
    """Extremes, best and worst corner (TL, TR, BL, BR; the first of equals), tilt and curvature in percent."""
    c = tilt_cells.withColumn("corner", _corner(grid)).withColumn("full", F.col("n") > 0)
    corner = F.col("full") & F.col("corner").isNotNull()
    centre = F.col("full") & (F.col("gy") == grid // 2) & (F.col("gx") == grid // 2)
    k = F.col("corner")
    s = c.groupBy("frame_id").agg(
        F.min(F.when(F.col("full"), F.col("hfr"))).alias("hfr_min"), F.max(F.when(F.col("full"), F.col("hfr"))).alias("hfr_max"),
        F.min(F.when(corner, F.struct("hfr", k.alias("k")))).alias("b"), F.min(F.when(corner, F.struct((-F.col("hfr")).alias("h"), k.alias("k")))).alias("w"),
        F.count(F.when(corner, 1)).alias("corners"), F.avg(F.when(corner, F.col("hfr"))).alias("mean"), F.max(F.when(centre, F.col("hfr"))).alias("centre"),
    )
    low, high = F.col("b.hfr"), -F.col("w.h")
    two = F.col("corners") >= 2
    return s.select(
        "frame_id", F.col("hfr_min").isNotNull().alias("success"), F.coalesce("hfr_min", F.lit(0.0)).alias("hfr_min"), F.coalesce("hfr_max", F.lit(0.0)).alias("hfr_max"),
        F.when(two, F.col("b.k")).otherwise(-1).cast("long").alias("best_corner"), F.when(two, F.col("w.k")).otherwise(-1).cast("long").alias("worst_corner"),
        F.when(two & (low > 0), (high - low) / low * 100).otherwise(0.0).alias("tilt_pct"),
        F.when((F.col("corners") > 0) & (F.col("centre") > 0), (F.col("mean") - F.col("centre")) / F.col("centre") * 100).otherwise(0.0).alias("curvature_pct"),
    )


def nodes(tilt_cells: DataFrame, grid: int = 3) -> DataFrame:
    """The four corners and the centre with a displacement factor and a quality, for reports."""
    mid = (F.col("gy") == grid // 2) & (F.col("gx") == grid // 2)
    spot = F.coalesce(_corner(grid), F.when(mid, F.lit(4).cast("long")))
    n = tilt_cells.withColumn("node", spot).where("node IS NOT NULL AND n > 0")
    w = Window.partitionBy("frame_id")
    mean, low = F.avg("hfr").over(w), F.min("hfr").over(w)
    return n.select("frame_id", "node", "hfr", clamp(1 + 3 * (F.col("hfr") - mean) / mean, 0.60, 1.55).alias("factor"), ((F.col("hfr") - low) / (0.2 * low)).alias("quality"))


def rotate(cells_df: DataFrame, rows: int, cols: int, degrees: int, y: str = "gy", x: str = "gx") -> DataFrame:
    """Cells of a rows x cols grid turned clockwise by a multiple of 90 degrees."""
    turn = degrees // 90 % 4
    cy, cx = F.col(y), F.col(x)
    ny, nx = [(cy, cx), (cx, rows - 1 - cy), (rows - 1 - cy, cols - 1 - cx), (cols - 1 - cx, cy)][turn]
    return cells_df.select(*[c for c in cells_df.columns if c not in (y, x)], ny.cast("long").alias(y), nx.cast("long").alias(x))
