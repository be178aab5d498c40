"""Exact results of whole frames from tiles: value counts, histogram, background floors, thumbnails.

Of a tile only what cannot be reduced in it is shuffled: its distinct values with their counts, the sorted values of cells
that it holds in part, the sums of the thumbnail boxes that it touches. The definitions are those of ``pixels`` and
``background``. Tiles that have an error are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions.order_stats import clamp
from framequarry.functions.store import dealt
from framequarry.operators import pixels
from framequarry.operators.background import COLS, ROWS
from framequarry.operators.tilework import assembled, luma_of, sliced

COUNTS = "frame_id string, key int, v double, n long"
#: Distinct values that a task gathers before it hands them on.
HELD = 1 << 20


def order_key(v: np.ndarray) -> np.ndarray:
    """32-bit integers in the order of the values as single precision."""
    bits = (v.astype(np.float32) + np.float32(0)).view(np.int32)
    return bits ^ ((bits >> np.int32(31)) & np.int32(0x7FFFFFFF))


def _counted(frame: str, key: np.ndarray, v: np.ndarray, n: np.ndarray) -> pd.DataFrame:
    keys, first, place = np.unique(key, return_index=True, return_inverse=True)
    return pd.DataFrame({"frame_id": frame, "key": keys, "v": v[first], "n": np.bincount(place, n, len(keys)).astype(np.int64)})


def value_counts(tiles: DataFrame, channel: str = "luma") -> DataFrame:
    """(frame_id, key, v, n): how often each value of luma, or of the channel r, g or b, is in a frame. ``key`` orders values.

    Values are single precision. Tiles of one frame are merged in their task before the shuffle, so what is shuffled are
    the distinct values of a task's tiles: at most 65 536 for a frame of 16 bits.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame, held, size = None, [], 0

        def merged() -> pd.DataFrame:
            return _counted(frame, *[np.concatenate([h[i] for h in held]) for i in range(3)])

        for pdf in batches:
            for t in pdf.itertuples():
                v = luma_of(t) if channel == "luma" else getattr(t, channel)
                if v is None:
                    continue
                if held and (t.path != frame or size > HELD):
                    out = merged()
                    if t.path != frame or len(out) > HELD // 2:
                        yield out
                        held, size = [], 0
                    else:
                        held, size = [tuple(out[c].to_numpy() for c in ("key", "v", "n"))], len(out)
                frame = t.path
                values, n = np.unique(np.asarray(v, np.float32).ravel() + np.float32(0), return_counts=True)
                held.append((order_key(values), values.astype(np.float64), n))
                size += len(n)
        if held:
            yield merged()

    return _summed(tiles.where("error IS NULL").mapInPandas(run, COUNTS))


def _summed(counts: DataFrame) -> DataFrame:
    return counts.groupBy("frame_id", "key").agg(F.first("v").alias("v"), F.sum("n").alias("n"))


def at_rank(counts: DataFrame, ranks: DataFrame) -> DataFrame:
    """(frame_id, v): the value at place ``rank`` (from 0) of ``ranks`` (frame_id, rank) among a frame's sorted values.

    By the upper half of the key first, then by the lower within it: no window has more than 65 536 rows, whatever the frame.
    """
    coarse = counts.groupBy("frame_id", F.shiftright("key", 16).alias("upper")).agg(F.sum("n").alias("n"))
    before = lambda key: F.sum("n").over(Window.partitionBy("frame_id").orderBy(key)) - F.col("n")
    pick = coarse.withColumn("before", before("upper")).join(ranks, "frame_id").where("before <= rank AND rank < before + n").select("frame_id", "upper", (F.col("rank") - F.col("before")).alias("rank"))
    fine = counts.withColumn("upper", F.shiftright("key", 16)).join(dealt(pick), ["frame_id", "upper"])
    return fine.withColumn("before", before("key")).where("before <= rank AND rank < before + n").select("frame_id", "v")


def deviations(counts: DataFrame, centre: DataFrame) -> DataFrame:
    """Value counts of the distances from ``centre`` (frame_id, centre)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            dev = np.abs(pdf["v"].to_numpy() - pdf["centre"].to_numpy()).astype(np.float32)
            yield pd.DataFrame({"frame_id": pdf["frame_id"], "key": order_key(dev), "v": dev.astype(np.float64), "n": pdf["n"]})

    return _summed(counts.join(dealt(centre), "frame_id").mapInPandas(run, COUNTS))


def statistics(counts: DataFrame) -> DataFrame:
    """Per frame, from its value counts (a written table): mean, sample deviation, extremes with their counts, exact median
    and median absolute deviation of all pixels."""
    sums = counts.groupBy("frame_id").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("total"), F.min(F.struct("key", "v", "n")).alias("lo"), F.max(F.struct("key", "v", "n")).alias("hi"))
    sums = sums.withColumn("mean", F.col("total") / F.col("n"))
    apart = F.col("v") - F.col("mean")
    spread = counts.join(dealt(sums.select("frame_id", "mean")), "frame_id").groupBy("frame_id").agg(F.sum(apart * apart * F.col("n")).alias("m2"))
    rank = sums.select("frame_id", F.floor(F.col("n") / 2).alias("rank"))  # the upper middle
    med = at_rank(counts, rank).withColumnRenamed("v", "pix_median")
    mad = at_rank(deviations(counts, med.withColumnRenamed("pix_median", "centre")), rank).withColumnRenamed("v", "pix_mad")
    base = sums.join(spread, "frame_id").join(med, "frame_id").join(mad, "frame_id")
    return base.select(
        "frame_id", F.col("mean").alias("pix_mean"), F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1))).otherwise(0.0).alias("pix_stddev"), "pix_median", "pix_mad",
        F.col("lo.v").alias("pix_min"), F.col("lo.n").alias("pix_min_count"), F.col("hi.v").alias("pix_max"), F.col("hi.n").alias("pix_max_count"),
    )


def source_range(tiles: DataFrame) -> DataFrame:
    """Least and greatest value over all channels; (0, 1) where they are equal."""
    ends = [(F.array_min(c), F.array_max(c)) for c in ("r", "g", "b")]
    r = tiles.where("error IS NULL").groupBy(F.col("path").alias("frame_id")).agg(F.min(F.least(*[a for a, _ in ends])).cast("double").alias("lo"), F.max(F.greatest(*[z for _, z in ends])).cast("double").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    return r.select("frame_id", F.when(flat, 0.0).otherwise(F.col("lo")).alias("src_min"), F.when(flat, 1.0).otherwise(F.col("hi")).alias("src_max"))


def histogram(counts: DataFrame, ranges: DataFrame, bins: int = 256) -> DataFrame:
    """``pixels.histogram`` from the value counts of the channel r and ``source_range``."""
    at = F.floor((F.col("v") - F.col("src_min")) / (F.col("src_max") - F.col("src_min")) * bins)
    counted = counts.join(dealt(ranges), "frame_id").groupBy("frame_id", clamp(at, 0, bins - 1).cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    grid = ranges.select("frame_id", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    full = grid.join(counted, ["frame_id", "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    tall = F.max("n").over(Window.partitionBy("frame_id"))
    return full.select("frame_id", F.col("bin").cast("long").alias("bin"), "n", F.log1p("n").alias("log_n"), (F.log1p("n") / F.log1p(tall)).alias("rel"))


def cell_floor(tiles: DataFrame, rows: int = ROWS, cols: int = COLS, min_side: int = 800) -> DataFrame:
    """``background.cell_floor`` from tiles. Cells inside one tile are finished there; of the others the tiles' sorted values
    are shuffled and merged by rank, one cell at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t in pdf.itertuples():
                bh, bw = t.height // rows, t.width // cols
                v = luma_of(t)
                for i in range(t.y0 // bh, min(rows, (t.y0 + t.h - 1) // bh + 1)):
                    for j in range(t.x0 // bw, min(cols, (t.x0 + t.w - 1) // bw + 1)):
                        part = v[max(0, i * bh - t.y0) : (i + 1) * bh - t.y0, max(0, j * bw - t.x0) : (j + 1) * bw - t.x0]
                        run_ = np.sort(part, axis=None)
                        whole = run_.size == bh * bw
                        out.append((t.path, i, j, run_[(run_.size - 1) // 4] if whole else None, None if whole else run_))
            if out:
                yield pd.DataFrame(out, columns=["frame_id", "i", "j", "b0", "run"])

    ok = tiles.where("error IS NULL").where((F.least("width", "height") >= min_side) & (F.col("height") >= rows) & (F.col("width") >= cols))
    parts = ok.mapInPandas(run, "frame_id string, i long, j long, b0 double, run array<double>")
    runs = F.array_sort(F.flatten(F.collect_list("run")))  # one cell's values
    return parts.groupBy("frame_id", "i", "j").agg(F.max("b0").alias("b0"), runs.alias("v")).select("frame_id", "i", "j", F.coalesce("b0", F.element_at("v", (F.floor((F.size("v") - 1) / 4) + 1).cast("int"))).alias("b0"))


def _boxes(full: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end line of each of ``n`` boxes over ``full`` lines."""
    i = np.arange(n, dtype=np.float64)
    low = np.minimum(full - 1, np.floor(i * (full / n))).astype(int)
    return low, np.minimum(full, np.maximum(low + 1, np.floor((i + 1) * (full / n)).astype(int)))


def _cover(start: int, size: int, full: int, n: int) -> tuple[int, np.ndarray]:
    """(first box, matrix of boxes by lines) of the boxes that the lines from ``start`` on touch."""
    low, high = _boxes(full, n)
    hit = np.flatnonzero((low < start + size) & (high > start))
    at = start + np.arange(size)
    return int(hit[0]), ((at >= low[hit, None]) & (at < high[hit, None])).astype(np.float64)


def thumbnail(tiles: DataFrame, max_w: int, max_h: int) -> DataFrame:
    """``pixels.thumbnail`` from tiles: (frame_id, oy, ox, v, and g and b, null for frames of one channel)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf.itertuples():
                scale = min(1.0, max_w / t.width, max_h / t.height)
                ow, oh = (max(1, int(np.floor(x * scale + 0.5))) for x in (t.width, t.height))
                (oy, down), (ox, across) = _cover(t.y0, t.h, t.height, oh), _cover(t.x0, t.w, t.width, ow)
                y, x = np.meshgrid(oy + np.arange(len(down)), ox + np.arange(len(across)), indexing="ij")
                sums = {c: (down @ np.asarray(p, np.float64).reshape(t.h, t.w) @ across.T).ravel() if p is not None else np.full(y.size, np.nan) for c, p in (("v", t.r), ("g", t.g), ("b", t.b))}
                yield pd.DataFrame({"frame_id": t.path, "oy": y.ravel(), "ox": x.ravel(), "n": (down.sum(1)[:, None] * across.sum(1)).ravel().astype(np.int64)} | sums)

    parts = tiles.where("error IS NULL").mapInPandas(run, "frame_id string, oy long, ox long, n long, v double, g double, b double")
    mean = lambda c: F.sum(F.nanvl(c, F.lit(None))) / F.sum("n")
    return parts.groupBy("frame_id", "oy", "ox").agg(*[mean(c).alias(c) for c in "vgb"])


def rendered_thumbnail(tiles: DataFrame, params: DataFrame, max_w: int, max_h: int) -> DataFrame:
    """8-bit thumbnails as ``pixels.rendered_thumbnail`` gives them: v8, and g8 and b8, null for frames of one channel."""
    t = thumbnail(tiles, max_w, max_h).join(source_range(tiles), "frame_id").join(params, "frame_id")
    return t.select("frame_id", "oy", "ox", "v", *[pixels.eight_bit(F.col(c)).alias(f"{c}8") for c in "vgb"])


def crop_boxes(width: int, height: int, grid: int = 3, side: int = 16) -> list[tuple[int, int, int, int, int, int]]:
    """(gy, gx, y0, x0, rows, columns) of grid x grid evenly spaced squares, as ``pixels.cutouts`` has them."""
    c = min(side, width // grid, height // grid)
    starts = lambda full: [full // 2 - c // 2 if grid <= 1 else k * (full - c) // (grid - 1) for k in range(grid)]
    return [(gy, gx, y0, x0, c, c) for gy, y0 in enumerate(starts(height)) for gx, x0 in enumerate(starts(width))] if c else []


def cutouts(tiles: DataFrame, grid: int = 3, side: int = 16, channel: str = "r") -> DataFrame:
    """``pixels.cutouts`` from tiles: the squares follow from a frame's size, and only what lies in them is shuffled."""

    def plane(t) -> np.ndarray:
        return np.asarray(getattr(t, channel), np.float64).reshape(t.h, t.w)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        z = assembled(pdf)
        return pd.DataFrame({"frame_id": pdf["frame_id"].iloc[:1], "gy": pdf["gy"].iloc[:1], "gx": pdf["gx"].iloc[:1], "n": z.size, "values": [z.ravel()]})

    slices = sliced(tiles.where(F.col(channel).isNotNull()), lambda width, height: crop_boxes(width, height, grid, side), plane)
    return slices.groupBy("frame_id", "gy", "gx").applyInPandas(whole, "frame_id string, gy long, gx long, n long, values array<double>")
