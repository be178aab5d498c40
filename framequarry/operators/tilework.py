"""Frame analysis on tiles: pixels stay in arrays, and only reduced rows are shuffled.

The definitions are those of ``pixels`` and ``stars``. Of a tile the first pass gives its sums, extremes, background
cells and a sample in raster steps; the second gives its pixels above the smoothed background. A task holds one batch of
tiles; a frame, however large, is never in one place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.functions.order_stats import MAD_SIGMA
from framequarry.functions.store import dealt, materialize, release
from framequarry.operators import stars
from framequarry.operators.tiletable import BAND, TileTable, band_of, banded, with_bands

REDUCED = "frame_id string, h int, n long, total double, spread double, lo double, n_lo long, hi double, n_hi long, cells array<struct<cy:long,cx:long,bg:double,noise:double>>, sample array<double>"
#: Bright pixels that a task gathers before it hands them on, about.
HELD = 1 << 19
SPARSE = "frame_id string, y long, x long, luma double, residual double, noise double, label long, edge boolean"


def luma_of(row) -> np.ndarray:
    """Brightness of a tile, as (h, w) doubles."""
    r = np.asarray(row.r, np.float64)
    if row.g is not None and row.b is not None:
        r = 0.299 * r + 0.587 * np.asarray(row.g, np.float64) + 0.114 * np.asarray(row.b, np.float64)
    return r.reshape(row.h, row.w)


SLICE = "frame_id string, gy long, gx long, y0 long, x0 long, rh long, rw long, zy long, zx long, w long, part array<double>"
Box = tuple[int, int, int, int, int, int]


def sliced(tiles: DataFrame, boxes_of: Callable[[int, int], list[Box]], values: Callable = luma_of) -> DataFrame:
    """What tiles have of the boxes (gy, gx, y0, x0, rows, columns) of their frame, which follow from its size: a row of
    ``SLICE`` for each tile and box that meet, cut by slices of the tile."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples():
                v = values(t)
                for gy, gx, y0, x0, rh, rw in boxes_of(t.width, t.height):
                    part = v[max(0, y0 - t.y0) : max(0, y0 + rh - t.y0), max(0, x0 - t.x0) : max(0, x0 + rw - t.x0)]
                    if part.size:
                        out.append((t.path, gy, gx, y0, x0, rh, rw, max(0, t.y0 - y0), max(0, t.x0 - x0), part.shape[1], part.ravel()))
            if out:
                yield pd.DataFrame(out, columns=[c.split()[0] for c in SLICE.split(", ")])

    return tiles.where("error IS NULL").mapInPandas(run, SLICE)


def assembled(slices: pd.DataFrame) -> np.ndarray:
    """A box from all its slices."""
    first = slices.iloc[0]
    z = np.zeros((first.rh, first.rw))
    for r in slices.itertuples():
        part = np.asarray(r.part, np.float64).reshape(-1, r.w)
        z[r.zy : r.zy + part.shape[0], r.zx : r.zx + r.w] = part
    return z


def _upper(sorted_values: np.ndarray) -> float:
    return float(sorted_values[len(sorted_values) // 2])


def cell_background(values: np.ndarray, rounds: int = 3, least: int = 8) -> tuple[float, float]:
    """Background and noise of a cell by cuts at median + 3 sigma, as ``stars.bg_mesh`` has them."""
    v = np.sort(values, axis=None)
    med = _upper(v)
    sigma = MAD_SIGMA * _upper(np.sort(np.abs(v - med)))
    for _ in range(rounds):
        cut = v[: int(np.searchsorted(v, med + 3 * sigma))]
        if not sigma > 0 or len(cut) < least:
            break
        v, med = cut, _upper(cut)
        sigma = MAD_SIGMA * _upper(np.sort(np.abs(v - med)))
    return med, max(sigma, 1e-6)


def reduced(tiles: DataFrame, cell: int, target: int) -> DataFrame:
    """A row per tile: sums, extremes, cells of ``cell`` pixels, and the pixels of the frame's raster sample."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t in pdf.itertuples():
                v = luma_of(t)
                lo, hi = v.min(), v.max()
                cells = [(int(t.y0 + y) // cell, int(t.x0 + x) // cell, *cell_background(v[y : y + cell, x : x + cell])) for y in range(0, t.h, cell) for x in range(0, t.w, cell)]
                step = max(1, t.width * t.height // target)
                at = (t.y0 + np.arange(t.h))[:, None] * t.width + t.x0 + np.arange(t.w)
                mean = float(v.mean())
                rows.append((t.path, t.h, v.size, float(v.sum()), float(((v - mean) ** 2).sum()), float(lo), int((v == lo).sum()), float(hi), int((v == hi).sum()), cells, v[at % step == 0]))
            if rows:
                yield pd.DataFrame(rows, columns=[x.split()[0] for x in REDUCED.split(", ")])

    return tiles.where("error IS NULL").mapInPandas(run, REDUCED)


def statistics(parts: DataFrame) -> DataFrame:
    """Per frame: mean, sample deviation, extremes with their counts, and median and MAD of the sample, which is an array of
    less than twice the target: a join of its values to their medians could be planned as a broadcast of all of them."""
    means = parts.withColumn("m", F.col("total") / F.col("n"))
    sums = means.groupBy("frame_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    spread = means.join(dealt(sums.select("frame_id", (F.col("total") / F.col("n")).alias("mean"))), "frame_id").groupBy("frame_id").agg(F.sum(F.col("spread") + F.col("n") * (F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("m2"))
    base = sums.join(spread, "frame_id").select("frame_id", (F.col("total") / F.col("n")).alias("pix_mean"), F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0).alias("pix_stddev"))
    end = lambda v, c, pick: parts.groupBy("frame_id", v).agg(F.sum(c).alias("c")).groupBy("frame_id").agg(getattr(F, pick)(v).alias(f"pix_{pick}"), getattr(F, f"{pick}_by")("c", v).alias(f"pix_{pick}_count"))
    middle = lambda v: F.element_at(v, (F.floor(F.size(v) / 2) + 1).cast("int"))  # noqa: E731  as upper_median
    sample = parts.groupBy("frame_id").agg(F.sort_array(F.flatten(F.collect_list("sample"))).alias("v")).withColumn("pix_median", middle("v"))
    dev = sample.withColumn("dev", F.sort_array(F.transform("v", lambda x: F.abs(x - F.col("pix_median"))))).select("frame_id", "pix_median", middle("dev").alias("pix_mad"))
    return base.join(end("lo", "n_lo", "min"), "frame_id").join(end("hi", "n_hi", "max"), "frame_id").join(dev, "frame_id")


def above(tiles: DataFrame, mesh: DataFrame, cell: int, k: float, band: int = BAND, stay: bool = False, buckets: int | None = None) -> DataFrame:
    """Pixels above background + k noise, the smoothed mesh interpolated between the centres of its cells, with the label
    of their component within the tile, and whether they touch another tile.

    The mesh is cut into bands and joined on (path, band). With ``stay`` it is dealt to the tiles' buckets
    (``tiletable``), and the tiles are not moved; with ``buckets``, their number, not even if it is below that of the
    shuffle partitions.
    """
    packed = with_bands(mesh, cell, band)
    packed = packed.repartition(buckets, "path", "band") if stay and buckets else packed
    names = [c.split()[0] for c in SPARSE.split(", ")]

    def axis(start: int, n: int, cells: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        f = np.clip((start + np.arange(n)) / cell - 0.5, 0.0, cells - 1.0)
        i = np.floor(f).astype(int)
        return i, np.minimum(i + 1, cells - 1), f - i

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        joined = lambda: pd.DataFrame({"frame_id": np.repeat(np.array([r[0] for r in rows], object), [len(r[1]) for r in rows])} | {c: np.concatenate([r[i] for r in rows]) for i, c in enumerate(names[1:], 1)})
        for pdf in batches:
            for t in pdf.itertuples():
                v, gw = luma_of(t), int(t.gw)
                grids = [np.asarray(g, np.float64).reshape(-1, gw) for g in (t.mb, t.mn)]
                (i, j, ty), (a, b, tx) = axis(t.y0, t.h, -(-t.height // cell)), axis(t.x0, t.w, gw)
                across = [[g[r - t.cy0][:, a] * (1 - tx) + g[r - t.cy0][:, b] * tx for r in (i, j)] for g in grids]
                bg, noise = (top * (1 - ty)[:, None] + low * ty[:, None] for top, low in across)
                y, x = np.nonzero(v > bg + k * noise)
                if len(y):
                    edge = (y == 0) & (t.y0 > 0) | (y == t.h - 1) & (t.y0 + t.h < t.height) | (x == 0) & (t.x0 > 0) | (x == t.w - 1) & (t.x0 + t.w < t.width)
                    rows.append((t.path, y + t.y0, x + t.x0, v[y, x], v[y, x] - bg[y, x], noise[y, x], stars.raster_labels(y + t.y0, x + t.x0), edge))
                    held += len(y)
                    if held >= HELD:
                        yield joined()
                        rows, held = [], 0
        if rows:
            yield joined()

    ok = banded(tiles.where("error IS NULL"), band)
    return ok.join(packed.hint("shuffle_hash") if stay else packed, ["path", "band"]).mapInPandas(run, SPARSE)


def analyse(tiles: DataFrame | TileTable, tile: int = 64, k: float = 4.0, least_area: int = 5, most_area: int = 2000, target: int = 200_000, **cuts) -> tuple[DataFrame, DataFrame]:
    """(statistics and star summary per frame, stars) of ``frames.tiles``, whose side must be a multiple of the cell ``tile``.

    The frame is named by the tiles' path. Tiles are read twice; what is shuffled are rows per tile, cell, sample and
    pixel above threshold. Tiles of a ``TileTable`` stay in their buckets; others may be dealt by (path, band).
    """
    stay = isinstance(tiles, TileTable)
    table, tiles = (tiles, tiles.tiles) if stay else (None, tiles)
    parts = materialize(reduced(tiles, tile, target), "tile-parts")
    band = table.band if stay else band_of(parts.agg(F.max("h")).first()[0] or tile)
    if band % tile:
        raise ValueError(f"tiles, and bands of tiles, must be made of whole cells of {tile} rows")
    mesh = materialize(stars.mesh_smooth(parts.select("frame_id", F.inline("cells"))), "tile-mesh")
    bright = materialize(above(tiles, mesh, tile, k, band, stay, table.buckets if stay else None), "tile-bright")
    labelled = materialize(stars.area_filter(stars.joined_labels(bright), least_area, most_area), "tile-stars")
    found = materialize(stars.half_flux_radius(labelled, stars.quality_cuts(stars.moments(labelled), mesh, tile, **cuts)), "stars")
    stats = materialize(statistics(parts), "tile-statistics")
    rows = materialize(stats.join(stars.summary(stats, found), "frame_id"), "frame-rows")
    release(parts, mesh, bright, labelled, stats)
    return rows, found
