"""Star detection and measurement on ``pixels`` (frame_id, y, x, luma).

Dense pixels are reduced to mesh cells and to the few pixels above threshold; everything after that works on a sparse
table. Thresholds are parameters with the usual defaults.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions.order_stats import MAD_SIGMA, array_median, upper_median
from framequarry.functions.store import dealt, materialize, release

FWHM_SIGMA = 2.3548200450309493


def bg_mesh(px: DataFrame, tile: int = 64, rounds: int = 3, least: int = 8) -> DataFrame:
    """Background and noise of each cell: median and scaled MAD, with up to ``rounds`` cuts at median + 3 sigma.

    A cut that would leave fewer than ``least`` values, or a sigma of 0, ends the rounds before it is applied. A cell
    is at most tile x tile values, so its array is bounded.
    """
    cell = px.groupBy("frame_id", F.floor(F.col("y") / tile).cast("long").alias("cy"), F.floor(F.col("x") / tile).cast("long").alias("cx")).agg(F.array_sort(F.collect_list("luma")).alias("v"))

    def measured(df: DataFrame) -> DataFrame:
        df = df.withColumn("med", array_median(F.col("v")))
        return df.withColumn("sigma", MAD_SIGMA * array_median(F.transform("v", lambda x: F.abs(x - F.col("med")))))

    cell = measured(cell).withColumn("open", F.lit(True))
    for _ in range(rounds):
        cell = cell.withColumn("cut", F.filter("v", lambda x: x < F.col("med") + 3 * F.col("sigma")))
        cell = cell.withColumn("open", F.col("open") & (F.col("sigma") > 0) & (F.size("cut") >= least))
        new = array_median(F.col("cut"))
        cell = cell.withColumn("v", F.when(F.col("open"), F.col("cut")).otherwise(F.col("v"))).withColumn("med", F.when(F.col("open"), new).otherwise(F.col("med")))
        cell = cell.withColumn("sigma", F.when(F.col("open"), MAD_SIGMA * array_median(F.transform("v", lambda x: F.abs(x - F.col("med"))))).otherwise(F.col("sigma")))
    return cell.select("frame_id", "cy", "cx", F.col("med").alias("bg"), F.greatest("sigma", F.lit(1e-6)).alias("noise"))


def mesh_smooth(mesh: DataFrame) -> DataFrame:
    """3x3 medians of background and noise; beyond the edge the edge cell counts again."""
    last = mesh.groupBy("frame_id").agg(F.max("cy").alias("my"), F.max("cx").alias("mx"))
    d = [F.lit(i) for i in (-1, 0, 1)]
    around = mesh.select("frame_id", "cy", "cx").join(dealt(last), "frame_id").withColumn("dy", F.explode(F.array(*d))).withColumn("dx", F.explode(F.array(*d)))
    clampc = lambda v, top: F.greatest(F.lit(0), F.least(v, F.col(top)))
    around = around.select("frame_id", "cy", "cx", clampc(F.col("cy") + F.col("dy"), "my").alias("ny"), clampc(F.col("cx") + F.col("dx"), "mx").alias("nx"))
    values = mesh.select("frame_id", F.col("cy").alias("ny"), F.col("cx").alias("nx"), "bg", "noise")
    return around.join(dealt(values), ["frame_id", "ny", "nx"]).groupBy("frame_id", "cy", "cx").agg(upper_median("bg").alias("bg"), upper_median("noise").alias("noise"))


def with_mesh(points: DataFrame, mesh: DataFrame, tile: int, y: str = "y", x: str = "x") -> DataFrame:
    """``points`` with the bilinear mesh value at (y, x) as bg and noise. One row per frame is joined: its packed mesh."""
    packed = mesh.groupBy("frame_id").agg((F.max("cx") + 1).alias("gw"), (F.max("cy") + 1).alias("gh"), F.array_sort(F.collect_list(F.struct("cy", "cx", "bg", "noise"))).alias("m"))
    packed = packed.select("frame_id", "gw", "gh", F.col("m.bg").alias("mb"), F.col("m.noise").alias("mn"))
    p = points.join(packed, "frame_id")
    for axis, c, n in (("y", y, "gh"), ("x", x, "gw")):
        p = p.withColumn(f"f{axis}", F.greatest(F.lit(0.0), F.least(F.col(c) / tile - 0.5, (F.col(n) - 1).cast("double"))))
        p = p.withColumn(f"i{axis}", F.floor(f"f{axis}")).withColumn(f"t{axis}", F.col(f"f{axis}") - F.col(f"i{axis}")).withColumn(f"j{axis}", F.least(F.col(f"i{axis}") + 1, F.col(n) - 1))

    def at(m: str) -> Column:
        v = lambda a, b: F.element_at(m, (F.col(a) * F.col("gw") + F.col(b) + 1).cast("int"))
        top = v("iy", "ix") * (1 - F.col("tx")) + v("iy", "jx") * F.col("tx")
        low = v("jy", "ix") * (1 - F.col("tx")) + v("jy", "jx") * F.col("tx")
        return top * (1 - F.col("ty")) + low * F.col("ty")

    return p.withColumn("bg", at("mb")).withColumn("noise", at("mn")).select(*points.columns, "bg", "noise")


def threshold(px: DataFrame, mesh: DataFrame, tile: int = 64, k: float = 4.0) -> DataFrame:
    """Pixels above background + k noise, with their residual."""
    p = with_mesh(px.select("frame_id", "y", "x", "luma"), mesh, tile)
    return p.where(F.col("luma") > F.col("bg") + k * F.col("noise")).select("frame_id", "y", "x", "luma", (F.col("luma") - F.col("bg")).alias("residual"), "noise")


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` nodes the least node that the links a - b reach from it."""
    label = np.arange(n)
    while True:  # minima spread along links, with pointer jumping
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def touching(key: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of pixels that touch, in sorted raster places ``key`` of rows of ``width``, one more than any x and gap."""
    pairs = []
    for step in (1, width - 1, width, width + 1):  # right, and the three below
        at = np.searchsorted(key, key + step)
        ok = (at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step)
        pairs.append((np.flatnonzero(ok), at[ok]))
    a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
    return a, b


def raster_labels(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Labels of 8-connected pixels in raster order: the smallest raster index of the component."""
    width = int(x.max()) + 2
    key = y * width + x
    label = least_linked(len(key), *touching(key, width))
    return key[label] // width * 1_000_000 + key[label] % width


def _label(pdf: pd.DataFrame) -> pd.DataFrame:
    """``raster_labels`` of the pixels of a frame, which are put in order."""
    out = pdf.sort_values(["y", "x"], kind="stable")
    out["label"] = raster_labels(out["y"].to_numpy(), out["x"].to_numpy())
    return out


def _across_borders(pdf: pd.DataFrame) -> pd.DataFrame:
    """(frame_id, label, whole): labels of tiles that go on in other tiles, from the pixels along the tiles' borders."""
    width = int(pdf["x"].max()) + 2
    key = pdf["y"].to_numpy() * width + pdf["x"].to_numpy()
    order = np.argsort(key, kind="stable")
    labels, node = np.unique(pdf["label"].to_numpy()[order], return_inverse=True)
    a, b = touching(key[order], width)
    root = least_linked(len(labels), node[a], node[b])
    moved = root != np.arange(len(labels))
    return pd.DataFrame({"frame_id": pdf["frame_id"].iloc[0], "label": labels[moved], "whole": labels[root[moved]]})


def joined_labels(labelled: DataFrame) -> DataFrame:
    """Components of frames from those of their tiles: (frame_id, y, x, label, edge, ...) with ``edge`` for pixels that
    touch another tile. Only these meet in one task per frame; labels are those of ``components``."""
    border = labelled.where("edge").select("frame_id", "y", "x", "label")
    kind = labelled.schema["frame_id"].dataType.simpleString()
    moved = border.groupBy("frame_id").applyInPandas(_across_borders, f"frame_id {kind}, label long, whole long")
    names = [c for c in labelled.columns if c not in ("label", "edge")]
    return labelled.join(dealt(moved), ["frame_id", "label"], "left").select(*names, F.coalesce("whole", "label").alias("label"))


def _label_runs(pdf: pd.DataFrame) -> pd.DataFrame:
    """As ``_label``, of runs of pixels (y, first, last) of a frame: the label is the first pixel of the component."""
    pdf = pdf.sort_values(["y", "first"])
    y, first, last = (pdf[c].to_numpy() for c in ("y", "first", "last"))
    width = int(last.max()) + 3
    lo = np.searchsorted(y * width + last, (y + 1) * width + first - 1)
    hi = np.searchsorted(y * width + first, (y + 1) * width + last + 1, "right")
    n = np.maximum(hi - lo, 0)
    a = np.repeat(np.arange(len(y)), n)
    b = np.repeat(lo, n) + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
    label = least_linked(len(y), a, b)
    return pdf.assign(label=y[label] * 1_000_000 + first[label])[["frame_id", "y", "island", "label"]]


def components(sparse: DataFrame, most: int = 2_000_000) -> DataFrame:
    """8-connected components of the sparse pixels; label = y * 1000000 + x of the first pixel in raster order.

    Frames of more than ``most`` pixels (a bright sky, a nebula) are labelled by their runs along rows, of which there
    are few, so no task holds all pixels of such a frame. The labels are the same.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in sparse.schema) + ", label long"
    crowded = sparse.groupBy("frame_id").count().where(F.col("count") > most).select("frame_id")
    if crowded.isEmpty():
        return sparse.groupBy("frame_id").applyInPandas(_label, schema)
    few = sparse.join(crowded, "frame_id", "left_anti").groupBy("frame_id").applyInPandas(_label, schema)
    island = F.col("x") - F.row_number().over(Window.partitionBy("frame_id", "y").orderBy("x"))
    many = sparse.join(crowded, "frame_id", "left_semi").withColumn("island", island)
    runs = many.groupBy("frame_id", "y", "island").agg(F.min("x").alias("first"), F.max("x").alias("last"))
    kind = sparse.schema["frame_id"].dataType.simpleString()
    labels = runs.groupBy("frame_id").applyInPandas(_label_runs, f"frame_id {kind}, y long, island long, label long")
    return few.union(many.join(dealt(labels), ["frame_id", "y", "island"]).select(*sparse.columns, "label"))


def area_filter(labelled: DataFrame, least: int = 5, most: int = 2000) -> DataFrame:
    keep = labelled.groupBy("frame_id", "label").count().where(F.col("count").between(least, most)).select("frame_id", "label")
    return labelled.join(dealt(keep), ["frame_id", "label"], "left_semi")


def moments(labelled: DataFrame) -> DataFrame:
    """Flux, peak, centroid, FWHM, eccentricity and axis angle of each component."""
    w = F.col("residual")
    first = labelled.groupBy("frame_id", "label").agg(F.sum(w).alias("flux"), F.max(w).alias("peak"), F.count("*").alias("area"), (F.sum(w * F.col("x")) / F.sum(w)).alias("cx"), (F.sum(w * F.col("y")) / F.sum(w)).alias("cy")).where("flux > 0")
    j = labelled.join(dealt(first), ["frame_id", "label"])
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    second = j.groupBy("frame_id", "label").agg((F.sum(w * dx * dx) / F.sum(w)).alias("mxx"), (F.sum(w * dy * dy) / F.sum(w)).alias("myy"), (F.sum(w * dx * dy) / F.sum(w)).alias("mxy"))
    m = first.join(dealt(second), ["frame_id", "label"])
    half, det = (F.col("mxx") + F.col("myy")) / 2, F.sqrt(F.greatest(F.lit(0.0), (F.col("mxx") - F.col("myy")) * (F.col("mxx") - F.col("myy")) / 4 + F.col("mxy") * F.col("mxy")))
    m = m.withColumn("l1", half + det).withColumn("l2", F.greatest(F.lit(0.0), half - det)).where("l1 > 0")
    return m.select(
        "frame_id", "label", "flux", "peak", "area", "cx", "cy", (FWHM_SIGMA * F.sqrt((F.col("l1") + F.col("l2")) / 2)).alias("fwhm"),
        F.sqrt(F.greatest(F.lit(0.0), 1 - F.col("l2") / F.col("l1"))).alias("ecc"), (0.5 * F.atan2(2 * F.col("mxy"), F.col("mxx") - F.col("myy"))).alias("theta"),
    )


def quality_cuts(found: DataFrame, mesh: DataFrame, tile: int = 64, snr: float = 3.0, bright: float = 30.0, ecc: float = 0.80, fwhm: tuple[float, float] = (1.2, 9.0), sharp: float = 0.95) -> DataFrame:
    """Signal to noise for all; shape limits except for components with a bright peak."""
    m = with_mesh(dealt(found), mesh, tile, "cy", "cx")
    good = F.col("flux") / (F.col("noise") * F.sqrt("area")) >= snr
    shape = (F.col("ecc") <= ecc) & F.col("fwhm").between(*fwhm) & (F.col("peak") / F.col("flux") <= sharp)
    return m.where(good & ((F.col("peak") / F.col("noise") >= bright) | shape)).drop("bg", "noise")


def half_flux_radius(labelled: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with hfr: the radius of half the flux, interpolated between the two pixels that straddle it."""
    j = labelled.select("frame_id", "label", "y", "x", "residual").join(dealt(found.select("frame_id", "label", "cx", "cy", "flux")), ["frame_id", "label"])
    j = j.withColumn("rad", F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))))
    # Radii that agree in exact arithmetic are one radius for the order; ties go by row, then column.
    w = Window.partitionBy("frame_id", "label").orderBy(F.round("rad", 9), "y", "x")
    j = j.withColumn("cum", F.sum("residual").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("prev", F.lag("rad").over(w)).withColumn("n", F.row_number().over(w))
    half = F.col("flux") / 2
    hit = j.where(F.col("cum") >= half).groupBy("frame_id", "label").agg(F.min_by(F.struct("rad", "prev", "cum", "residual", "flux"), "n").alias("h"))
    h = lambda c: F.col(f"h.{c}")
    hfr = F.when(h("prev").isNull(), h("rad")).otherwise(h("prev") + (h("flux") / 2 - (h("cum") - h("residual"))) / h("residual") * (h("rad") - h("prev")))
    return found.join(dealt(hit.select("frame_id", "label", hfr.alias("hfr"))), ["frame_id", "label"]).where("hfr > 0")


def summary(frames: DataFrame, stars: DataFrame) -> DataFrame:
    """Per frame of ``frames``: star count, medians, population deviation of hfr; zeros without stars."""
    s = stars.groupBy("frame_id").agg(F.count("*").alias("star_count"), upper_median("hfr").alias("hfr_median"), F.stddev_pop("hfr").alias("hfr_stddev"), upper_median("fwhm").alias("fwhm_median"), upper_median("ecc").alias("ecc_median"))
    out = frames.select("frame_id").join(s, "frame_id", "left")
    return out.select("frame_id", F.coalesce("star_count", F.lit(0)).alias("star_count"), *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("hfr_median", "hfr_stddev", "fwhm_median", "ecc_median")])


def sparse(px: DataFrame, tile: int = 64, k: float = 4.0, least_area: int = 5, most_area: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(labelled pixels of components of a fitting area, smoothed mesh), each written once: all that the measurements read.

    Dense pixels are read here, once for the mesh and once against it, and nowhere after.
    """
    mesh = materialize(mesh_smooth(bg_mesh(px, tile)), "star-mesh")
    bright = materialize(threshold(px, mesh, tile, k), "star-bright")
    labelled = materialize(area_filter(components(bright), least_area, most_area), "star-pixels")
    release(bright)
    return labelled, mesh


def detect(px: DataFrame, tile: int = 64, k: float = 4.0, least_area: int = 5, most_area: int = 2000, **cuts) -> DataFrame:
    """Stars of all frames of ``px`` (with luma): the whole chain, over tables that are written once."""
    labelled, mesh = sparse(px, tile, k, least_area, most_area)
    found = materialize(half_flux_radius(labelled, quality_cuts(moments(labelled), mesh, tile, **cuts)), "stars")
    release(labelled, mesh)
    return found
