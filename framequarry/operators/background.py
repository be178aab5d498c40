"""Sky-background map: cell floors, robust order-2 surface and its diagnostics.

Pixels are reduced to rows x cols cells per frame first; everything after works on that small table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions.order_stats import MAD_SIGMA, clamp, lower_quartile, sorted_quantile, upper_median
from framequarry.functions.store import dealt, materialize, release

ROWS, COLS = 48, 72


def cell_floor(px: DataFrame, rows: int = ROWS, cols: int = COLS, min_side: int = 800) -> DataFrame:
    """25th percentile of each cell; trailing pixels are left out, and frames with a short side below ``min_side``."""
    size = px.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    size = size.where((F.least("w", "h") >= min_side) & (F.col("h") >= rows) & (F.col("w") >= cols))
    size = size.select("frame_id", F.floor(F.col("h") / rows).alias("bh"), F.floor(F.col("w") / cols).alias("bw"))
    p = px.join(size, "frame_id").withColumn("i", F.floor(F.col("y") / F.col("bh")).cast("long")).withColumn("j", F.floor(F.col("x") / F.col("bw")).cast("long"))
    return p.where((F.col("i") < rows) & (F.col("j") < cols)).groupBy("frame_id", "i", "j").agg(lower_quartile("luma").alias("b0"))


def coordinates(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """Cells with xn, yn in [-1, 1] and the radius r, 1 at the corners."""
    c = cells.withColumn("yn", (F.col("i") - (rows - 1) / 2) / ((rows - 1) / 2)).withColumn("xn", (F.col("j") - (cols - 1) / 2) / ((cols - 1) / 2))
    return c.withColumn("r", F.sqrt(F.col("xn") * F.col("xn") + F.col("yn") * F.col("yn")) / F.sqrt(F.lit(2.0)))


def _mad_sigma(v: np.ndarray) -> float:
    mid = lambda a: np.sort(a)[len(a) // 2]
    s = MAD_SIGMA * mid(np.abs(v - mid(v))) if len(v) else 0.0
    return float(s) if s > 0 else 1e-9


def _surface(rows: int, cols: int, rounds: int, reject: float):
    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["i", "j"])
        y, x = (pdf["i"].to_numpy() - (rows - 1) / 2) / ((rows - 1) / 2), (pdf["j"].to_numpy() - (cols - 1) / 2) / ((cols - 1) / 2)
        basis = np.stack([np.ones_like(x), y, y * y, x, x * y, x * x], axis=1)
        b0 = pdf["b0"].to_numpy(float)
        keep, pred = np.ones(len(b0), bool), np.zeros(len(b0))
        for _ in range(rounds):
            kept = basis[keep]
            normal = kept.T @ kept
            coef = np.linalg.solve(normal, kept.T @ b0[keep]) if abs(np.linalg.det(normal)) > 1e-12 else np.zeros(6)
            pred = basis @ coef
            new = b0 - pred < reject * _mad_sigma(b0[keep] - pred[keep])
            if new.sum() < 12 or (new == keep).all():
                break
            keep = new
        return pdf.assign(surface=pred)[["frame_id", "i", "j", "b0", "surface"]]

    return fit


def surface_fit(cells: DataFrame, rows: int = ROWS, cols: int = COLS, rounds: int = 5, reject: float = 2.5) -> DataFrame:
    """Order-2 surface, from which cells well above it are left out round by round. A frame has rows x cols cells."""
    return cells.select("frame_id", "i", "j", "b0").groupBy("frame_id").applyInPandas(_surface(rows, cols, rounds, reject), f"frame_id {cells.schema['frame_id'].dataType.simpleString()}, i long, j long, b0 double, surface double")


def level(surface: DataFrame) -> DataFrame:
    m = surface.groupBy("frame_id").agg(upper_median("surface").alias("bg_median"))
    return m.withColumn("bg_median", F.when(F.col("bg_median") == 0, 1e-6).otherwise(F.col("bg_median")))


def radial_profile(surface: DataFrame, rows: int = ROWS, cols: int = COLS, rings: int = 12) -> DataFrame:
    """Fall of the surface from the innermost to the outermost ring, and its spread within rings."""
    s = coordinates(surface, rows, cols)
    ring = clamp(F.floor(F.round(F.col("r") * rings, 9)), 0, rings - 1)
    by = s.groupBy("frame_id", ring.alias("ring")).agg(F.count("*").alias("n"), upper_median("surface").alias("med"), F.stddev_pop("surface").alias("sd")).where("n >= 3")
    p = by.groupBy("frame_id").agg(F.min_by("med", "ring").alias("inner"), F.max_by("med", "ring").alias("outer"), F.avg("sd").alias("sd"))
    out = level(surface).join(p, "frame_id", "left")
    a, b = F.coalesce("inner", "bg_median"), F.coalesce("outer", "bg_median")
    return out.select("frame_id", "bg_median", F.when(a != 0, (a - b) / a).otherwise(0.0).alias("radial_drop"), (F.coalesce("sd", F.lit(0.0)) / (F.abs("bg_median") + 1e-9)).alias("azim_aniso"))


def _r2(pred: Column, mean: str) -> Column:
    ssr, sst = F.sum((F.col("surface") - pred) * (F.col("surface") - pred)), F.sum((F.col("surface") - F.col(mean)) * (F.col("surface") - F.col(mean)))
    return 1 - ssr / F.when(sst > 0, sst).otherwise(1e-12)


def radial_fit(surface: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """R2 of c0 + c1 r^2 + c2 r^4, with the spread about the median."""
    s = coordinates(surface, rows, cols).withColumn("u", F.col("r") * F.col("r"))
    u, v = F.col("u"), F.col("surface")
    m = s.groupBy("frame_id").agg(F.count("*").alias("n"), *[F.sum(F.pow(u, F.lit(k))).alias(f"s{k}") for k in (1, 2, 3, 4)], *[F.sum(F.pow(u, F.lit(k)) * v).alias(f"t{k}") for k in (0, 1, 2)])
    det = lambda a, b, c, d, e, f, g, h, i: a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    n, s1, s2, s3, s4, t0, t1, t2 = (F.col(c) for c in ("n", "s1", "s2", "s3", "s4", "t0", "t1", "t2"))
    base = det(n, s1, s2, s1, s2, s3, s2, s3, s4)
    m = m.select("frame_id", (det(t0, s1, s2, t1, s2, s3, t2, s3, s4) / base).alias("c0"), (det(n, t0, s2, s1, t1, s3, s2, t2, s4) / base).alias("c1"), (det(n, s1, t0, s1, s2, t1, s2, s3, t2) / base).alias("c2"))
    j = s.join(dealt(m), "frame_id").join(dealt(level(surface)), "frame_id")
    return j.groupBy("frame_id").agg(_r2(F.col("c0") + F.col("c1") * u + F.col("c2") * u * u, "bg_median").alias("radial_r2"))


def plane_fit(surface: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """Gradient: amplitude over the corners relative to the background, direction in degrees from 0 to less than 360, R2. The grid is symmetric."""
    s = coordinates(surface, rows, cols)
    m = s.groupBy("frame_id").agg((F.sum(F.col("xn") * F.col("surface")) / F.sum(F.col("xn") * F.col("xn"))).alias("a"), (F.sum(F.col("yn") * F.col("surface")) / F.sum(F.col("yn") * F.col("yn"))).alias("b"), F.avg("surface").alias("c"))
    j = s.join(dealt(m), "frame_id").join(dealt(level(surface)), "frame_id")
    fit = j.groupBy("frame_id").agg(F.first("a").alias("a"), F.first("b").alias("b"), F.first("bg_median").alias("bg"), _r2(F.col("a") * F.col("xn") + F.col("b") * F.col("yn") + F.col("c"), "bg_median").alias("plane_r2"))
    deg = F.degrees(F.atan2("b", "a"))
    return fit.select("frame_id", (2 * (F.abs("a") + F.abs("b")) / F.col("bg")).alias("amplitude"), F.when(deg < -1e-9, deg + 360).otherwise(F.greatest(deg, F.lit(0.0))).alias("direction"), "plane_r2")  # rounding below 0 is no full turn


def corners(surface: DataFrame, rows: int = ROWS, cols: int = COLS, share: float = 0.16) -> DataFrame:
    """Largest corner excess over the surface in units of its noise, and how unlike the corner levels are."""
    hy, hx = max(1, int(rows * share / 2)), max(1, int(cols * share / 2))
    top, left = F.col("i") <= hy, F.col("j") <= hx
    low, right = F.col("i") >= rows - 1 - hy, F.col("j") >= cols - 1 - hx
    s = surface.withColumn("resid", F.col("b0") - F.col("surface"))
    med = s.groupBy("frame_id").agg(upper_median("resid").alias("m"))
    mad = s.join(dealt(med), "frame_id").withColumn("dev", F.abs(F.col("resid") - F.col("m"))).groupBy("frame_id").agg((MAD_SIGMA * upper_median("dev")).alias("sg"))
    spots = F.filter(F.array(F.when(top & left, 0), F.when(top & right, 1), F.when(low & left, 2), F.when(low & right, 3)), lambda k: k.isNotNull())
    by = s.withColumn("corner", F.explode(spots)).groupBy("frame_id", "corner").agg(upper_median("resid").alias("resid"), upper_median("surface").alias("level"))
    g = by.join(dealt(mad), "frame_id").groupBy("frame_id").agg(F.max(F.col("resid") / F.when(F.col("sg") > 0, F.col("sg")).otherwise(1e-9)).alias("corner_excess"), F.stddev_pop("level").alias("sd"), F.avg("level").alias("mean"))
    return g.select("frame_id", "corner_excess", (F.col("sd") / (F.abs("mean") + 1e-9)).alias("corner_asymmetry"))


def heatmap(surface: DataFrame) -> DataFrame:
    """Surface between its 2nd and 98th percentile, as 0 to 1."""
    q = surface.groupBy("frame_id").agg(F.collect_list("surface").alias("v")).select("frame_id", sorted_quantile(F.col("v"), 0.02).alias("lo"), sorted_quantile(F.col("v"), 0.98).alias("hi"))
    span = F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo")).otherwise(1.0)
    return surface.join(dealt(q), "frame_id").select("frame_id", "i", "j", clamp((F.col("surface") - F.col("lo")) / span, 0.0, 1.0).alias("heat"))


def diagnostics(surface: DataFrame, rows: int = ROWS, cols: int = COLS) -> DataFrame:
    """All diagnostics of ``surface_fit`` (a written table), one row per frame."""
    return radial_profile(surface, rows, cols).join(radial_fit(surface, rows, cols), "frame_id").join(plane_fit(surface, rows, cols), "frame_id").join(corners(surface, rows, cols), "frame_id")


def report(px: DataFrame, rows: int = ROWS, cols: int = COLS, min_side: int = 800) -> DataFrame:
    """All diagnostics of the frames of ``px`` (with luma), one row per frame; a written table."""
    surface = materialize(surface_fit(cell_floor(px, rows, cols, min_side), rows, cols), "background-surface")
    out = materialize(diagnostics(surface, rows, cols), "background-report")
    release(surface)
    return out
