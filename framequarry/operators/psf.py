"""Point-spread plate: stars per zone of the frame, their shape by adaptive moments, and the optical axis pattern.

Boxes are joined to pixels by row, high-pass and maxima run as aggregates and windows within a zone; from the few
candidates on, batches of stamps are measured with numpy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.functions.order_stats import MAD_SIGMA, upper_median
from framequarry.functions.store import dealt, materialize, release
from framequarry.operators.tilework import assembled, luma_of, sliced

CUT, WIN = 29, 9


def zones(px: DataFrame, grid: int = 3, cut: int = CUT) -> DataFrame:
    """Search box of each zone and frame: frame_id, gy, gx, cy, cx, y0, x0, rh, rw, width, height."""
    return zone_boxes(px.groupBy("frame_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"), F.max("luma").alias("top")), grid, cut)


def zone_boxes(size: DataFrame, grid: int = 3, cut: int = CUT) -> DataFrame:
    """``zones`` from frame_id, width, height and top of each frame."""
    short = F.least("width", "height")
    b = size.withColumn("sr", F.greatest(F.lit(2 * cut), F.floor(0.20 * short)).cast("long")).withColumn("margin", F.floor(0.03 * short).cast("long"))
    side = F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))
    b = b.withColumn("gy", F.explode(side)).withColumn("gx", F.explode(side))
    half = F.floor(F.col("sr") / 2)
    for g, c, o, length in (("gy", "cy", "y0", "height"), ("gx", "cx", "x0", "width")):
        first, last = F.col("margin") + half, F.col(length) - F.col("margin") - half
        spread = first + F.floor(F.col(g) * (last - first) / max(grid - 1, 1))
        b = b.withColumn(c, (F.when((F.lit(grid) <= 1) | (last <= first), F.floor(F.col(length) / 2)).otherwise(spread)).cast("long"))
        b = b.withColumn(o, F.greatest(F.lit(0), F.least(F.col(c) - half, F.col(length) - F.col("sr"))).cast("long"))
    return b.withColumn("rw", F.least("sr", "width")).withColumn("rh", F.least("sr", "height")).drop("sr", "margin")


def zone_pixels(px: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels of each zone with their place in it (zy, zx). Boxes may overlap."""
    rows = boxes.withColumn("y", F.explode(F.expr("sequence(y0, y0 + rh - 1)")))
    hit = px.select("frame_id", "y", "x", "luma").join(rows, ["frame_id", "y"]).where("x >= x0 AND x < x0 + rw")
    return hit.select("frame_id", "gy", "gx", (F.col("y") - F.col("y0")).alias("zy"), (F.col("x") - F.col("x0")).alias("zx"), "luma", "rh", "rw", "top")


def highpass(zp: DataFrame, blocks: int = 12) -> DataFrame:
    """Pixels minus the mean of their block, not below 0; what is left over joins the last block."""

    def block(z: str, n: str):
        size = F.greatest(F.floor(F.col(n) / blocks), F.lit(1))
        return F.least(F.floor(F.col(z) / size), F.greatest(F.floor(F.col(n) / size) - 1, F.lit(0))).cast("long")

    b = zp.withColumn("by", block("zy", "rh")).withColumn("bx", block("zx", "rw"))
    mean = b.groupBy("frame_id", "gy", "gx", "by", "bx").agg(F.avg("luma").alias("mean"))
    return b.join(mean, ["frame_id", "gy", "gx", "by", "bx"]).withColumn("hp", F.greatest(F.lit(0.0), F.col("luma") - F.col("mean"))).drop("by", "bx", "mean")


def candidates(hp: DataFrame, sigma: float = 10.0, k: int = 7, border: int = CUT, sat: float = 0.92) -> DataFrame:
    """Local maxima (ties stay) above median + sigma noise, below saturation, away from the zone's border."""
    zone = ["frame_id", "gy", "gx"]
    med = hp.groupBy(*zone).agg(upper_median("hp").alias("med"))
    mad = hp.join(med, zone).withColumn("dev", F.abs(F.col("hp") - F.col("med"))).groupBy(*zone).agg(F.first("med").alias("med"), (MAD_SIGMA * upper_median("dev")).alias("sig"))
    h = k // 2
    across = F.max("hp").over(Window.partitionBy(*zone, "zy").orderBy("zx").rowsBetween(-h, h))
    around = F.max("across").over(Window.partitionBy(*zone, "zx").orderBy("zy").rowsBetween(-h, h))
    c = hp.withColumn("across", across).withColumn("around", around).join(mad, zone)
    above = F.col("hp") > F.col("med") + sigma * F.when(F.col("sig") > 0, F.col("sig")).otherwise(1e-6)
    inner = (F.col("zy") >= border) & (F.col("zx") >= border) & (F.col("zy") <= F.col("rh") - border) & (F.col("zx") <= F.col("rw") - border)
    return c.where(above & (F.col("luma") < sat * F.col("top")) & inner & (F.col("hp") >= F.col("around"))).select(*zone, "zy", "zx", "luma", "hp")


def stamps(px: DataFrame, spots: DataFrame, half: int, y: str = "y", x: str = "x") -> DataFrame:
    """``spots`` with ``stamp``: the (2 half + 1)^2 pixels around (y, x), row-major. Stamps that the frame cuts are left out."""
    side = 2 * half + 1
    rows = spots.withColumn("__y", F.explode(F.sequence(F.col(y) - half, F.col(y) + half)))
    p = px.select("frame_id", F.col("y").alias("__y"), F.col("x").alias("__x"), F.col("luma").alias("__v"))
    hit = rows.join(p, ["frame_id", "__y"]).where((F.col("__x") >= F.col(x) - half) & (F.col("__x") <= F.col(x) + half))
    g = hit.groupBy(*spots.columns).agg(F.array_sort(F.collect_list(F.struct("__y", "__x", "__v"))).alias("p"))
    return g.where(F.size("p") == side * side).select(*spots.columns, F.col("p.__v").alias("stamp"))


def adaptive(sub: np.ndarray, rounds: int = 12) -> dict[str, np.ndarray]:
    """Gaussian-weighted second moments of stamps (n, side, side), iterated until they agree with their weight."""
    n, side, _ = sub.shape
    gy, gx = np.mgrid[:side, :side].astype(float)
    total = sub.sum((1, 2))
    ok = total > 0
    safe = np.where(ok, total, 1.0)
    x0, y0 = (sub * gx).sum((1, 2)) / safe, (sub * gy).sum((1, 2)) / safe
    q = np.tile(np.array([2.0, 2.0, 0.0]), (n, 1))  # xx, yy, xy
    open_ = ok.copy()
    for _ in range(rounds):
        det = q[:, 0] * q[:, 1] - q[:, 2] ** 2
        ok &= ~(open_ & (det <= 1e-6))
        open_ &= ok
        if not open_.any():
            break
        i = np.flatnonzero(open_)
        dx, dy = gx - x0[i, None, None], gy - y0[i, None, None]
        a, b, c = (q[i, k][:, None, None] / (2 * det[i])[:, None, None] for k in (1, 2, 0))
        w = np.exp(-0.5 * (a * dx * dx - 2 * b * dx * dy + c * dy * dy)) * sub[i]
        s = w.sum((1, 2))
        good = s > 0
        ok[i[~good]] = open_[i[~good]] = False
        i, w, s = i[good], w[good], s[good]
        nx, ny = (w * gx).sum((1, 2)) / s, (w * gy).sum((1, 2)) / s
        dx, dy = gx - nx[:, None, None], gy - ny[:, None, None]
        new = np.stack([(w * dx * dx).sum((1, 2)) / s, (w * dy * dy).sum((1, 2)) / s, (w * dx * dy).sum((1, 2)) / s], axis=1)
        moved = np.abs(new - q[i]).sum(1)
        q[i], x0[i], y0[i] = new, nx, ny
        open_[i[moved < 1e-3]] = False
    half, det = (q[:, 0] + q[:, 1]) / 2, np.sqrt(np.maximum(((q[:, 0] - q[:, 1]) / 2) ** 2 + q[:, 2] ** 2, 0))
    l1, l2 = half + det, np.maximum(half - det, 1e-6)
    ok &= l1 > 0
    ratio = np.sqrt(l2 / np.where(l1 > 0, l1, 1.0))
    return {"ok": ok, "ecc": np.sqrt(np.maximum(1 - ratio**2, 0)), "elong": 1 / ratio, "pa": 0.5 * np.arctan2(2 * q[:, 2], q[:, 0] - q[:, 1]), "fwhm": 2.3548 * np.sqrt((l1 + l2) / 2), "x0": x0, "y0": y0, "siga": np.sqrt(np.maximum(l1, 0)), "sigb": np.sqrt(l2)}


def _upper(a: np.ndarray) -> np.ndarray:
    return np.sort(a, axis=1)[:, a.shape[1] // 2]


def gate(stamps_19: np.ndarray, snr: float = 15.0, core: float = 0.12, neighbours: float = 0.35, fwhm: tuple[float, float] = (1.4, 12.0)) -> np.ndarray:
    """Score (peak over noise) of each 19 x 19 stamp that is a star, NaN for the others."""
    n = len(stamps_19)
    r = np.hypot(*(np.mgrid[-WIN : WIN + 1, -WIN : WIN + 1]))
    ring = stamps_19[:, (r >= 6.0) & (r <= 8.5)]
    bg = _upper(ring)
    noise = MAD_SIGMA * _upper(np.abs(ring - bg[:, None]))
    noise = np.where(noise > 0, noise, 1e-6)
    v = stamps_19 - bg[:, None, None]
    peak = v[:, WIN, WIN]
    beside = (v[:, WIN - 1, WIN] + v[:, WIN + 1, WIN] + v[:, WIN, WIN - 1] + v[:, WIN, WIN + 1]) / 4
    sub = np.maximum(v, 0)
    total = sub.sum((1, 2))
    ok = (peak > 0) & (peak / noise >= snr) & (beside >= neighbours * peak) & (total > 0)
    ok &= sub[:, WIN - 1 : WIN + 2, WIN - 1 : WIN + 2].sum((1, 2)) >= core * np.where(total > 0, total, 1)
    m = adaptive(sub)
    ok &= m["ok"] & (m["fwhm"] >= fwhm[0]) & (m["fwhm"] <= fwhm[1])
    return np.where(ok, peak / noise, np.nan) if n else np.zeros(0)


def _batches(side: int, work):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = work(pdf.drop(columns="stamp"), np.stack(pdf["stamp"].to_numpy()).astype(float).reshape(-1, side, side))
                if len(out):
                    yield out

    return run


def star_gate(px: DataFrame, spots: DataFrame, **limits) -> DataFrame:
    """Candidates (frame_id, gy, gx, y, x) that are stars, with their score."""

    def work(pdf: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        pdf = pdf.assign(score=gate(s, **limits))
        return pdf[pdf["score"].notna()]

    st = stamps(px, spots.select("frame_id", "gy", "gx", "y", "x"), WIN)
    return st.mapInPandas(_batches(2 * WIN + 1, work), "frame_id long, gy long, gx long, y long, x long, score double")


def _spaced(nstar: int, least: float):
    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen: list[int] = []
        pdf = pdf.sort_values(["score", "y", "x"], ascending=[False, True, True])
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        for k in range(len(pdf)):
            if len(chosen) == nstar:
                break
            if all((y[k] - y[c]) ** 2 + (x[k] - x[c]) ** 2 >= least**2 for c in chosen):
                chosen.append(k)
        return pdf.iloc[chosen]

    return pick


def topk_spaced(found: DataFrame, nstar: int = 4, least: float = 1.3 * CUT) -> DataFrame:
    """Best stars of each zone, greedily, no two closer than ``least``; of measured stars, so that a star whose moments
    fail takes no place from a later one."""
    return found.groupBy("frame_id", "gy", "gx").applyInPandas(_spaced(nstar, least), found.schema)


def measure(px: DataFrame, found: DataFrame, cut: int = CUT) -> DataFrame:
    """Shape of each star on its stamp, moved inside the frame, minus the stamp's median."""
    half = cut // 2
    size = px.groupBy("frame_id").agg(F.max("x").alias("mx"), F.max("y").alias("my"))
    inside = lambda c, top: F.greatest(F.lit(half), F.least(F.col(c), F.col(top) - half)).cast("long")
    spots = found.join(size, "frame_id").select("frame_id", "gy", "gx", "y", "x", "score", inside("y", "my").alias("sy"), inside("x", "mx").alias("sx"))

    def work(pdf: pd.DataFrame, s: np.ndarray) -> pd.DataFrame:
        m = adaptive(np.maximum(s - _upper(s.reshape(len(s), -1))[:, None, None], 0))
        out = pdf.drop(columns=["sy", "sx"]).assign(**{k: m[k] for k in ("ecc", "elong", "pa", "fwhm", "x0", "y0", "siga", "sigb")})
        return out[m["ok"]]

    schema = "frame_id long, gy long, gx long, y long, x long, score double, ecc double, elong double, pa double, fwhm double, x0 double, y0 double, siga double, sigb double"
    return stamps(px, spots, half, "sy", "sx").mapInPandas(_batches(cut, work), schema)


def zone_summary(stars: DataFrame, boxes: DataFrame, grid: int = 3) -> DataFrame:
    """Median shape of each zone, its axis, and the axis' relation to the direction from the frame's centre."""
    p = 2 * F.col("pa")
    s = stars.groupBy("frame_id", "gy", "gx").agg(F.count("*").alias("n"), upper_median("elong").alias("elong"), upper_median("ecc").alias("ecc"), (0.5 * F.atan2(F.avg(F.sin(p)), F.avg(F.cos(p)))).alias("pa"))
    z = boxes.select("frame_id", "gy", "gx", "cy", "cx", "width", "height").join(dealt(s), ["frame_id", "gy", "gx"], "left")
    radial = F.atan2(F.col("cy") - F.col("height") / 2, F.col("cx") - F.col("width") / 2)
    d = F.abs(F.abs(F.col("pa") - radial + F.lit(np.pi / 2)) % F.lit(np.pi) - F.lit(np.pi / 2))
    axis = F.when(F.col("n").isNull(), "none").when((F.col("gy") == grid // 2) & (F.col("gx") == grid // 2), "ref").when(d < np.radians(25), "radial").when(d > np.radians(65), "tangential").otherwise("oblique")
    return z.select("frame_id", "gy", "gx", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("elong", F.lit(0.0)).alias("elong"), F.coalesce("ecc", F.lit(0.0)).alias("ecc"), F.coalesce("pa", F.lit(0.0)).alias("pa"), axis.alias("axis"))


def plate(px: DataFrame, grid: int = 3, nstar: int = 4) -> tuple[DataFrame, DataFrame]:
    """(stars, zones) of the frames of ``px`` (frame_id, y, x, luma)."""
    boxes = materialize(zones(px, grid), "psf-zones")
    spots = candidates(highpass(zone_pixels(px, boxes)))
    spots = spots.join(boxes.select("frame_id", "gy", "gx", "y0", "x0"), ["frame_id", "gy", "gx"]).select("frame_id", "gy", "gx", (F.col("zy") + F.col("y0")).alias("y"), (F.col("zx") + F.col("x0")).alias("x"))
    found = materialize(topk_spaced(measure(px, star_gate(px, spots)), nstar), "psf-stars")
    return found, zone_summary(found, boxes, grid)


def boxes_of(width: int, height: int, grid: int = 3, cut: int = CUT) -> list[tuple[int, int, int, int, int, int]]:
    """(gy, gx, y0, x0, rows, columns) of the search boxes of a frame, as ``zones`` has them: they follow from its size."""
    short = min(width, height)
    side, margin = max(2 * cut, int(0.20 * short)), int(0.03 * short)

    def starts(length: int) -> list[int]:
        first, last = margin + side // 2, length - margin - side // 2
        centres = [length // 2 if grid <= 1 or last <= first else first + k * (last - first) // max(grid - 1, 1) for k in range(grid)]
        return [max(0, min(c - side // 2, length - side)) for c in centres]

    return [(gy, gx, y0, x0, min(side, height), min(side, width)) for gy, y0 in enumerate(starts(height)) for gx, x0 in enumerate(starts(width))]


def zone_highpass(z: np.ndarray, blocks: int = 12) -> np.ndarray:
    """``highpass`` of a zone held as an array."""
    edges = []
    for n in z.shape:
        size = max(n // blocks, 1)
        edges.append(np.arange(max(n // size, 1)) * size)
    sums = np.add.reduceat(np.add.reduceat(z, edges[0], 0), edges[1], 1)
    counts = [np.diff(np.append(e, n)) for e, n in zip(edges, z.shape, strict=True)]
    mean = sums / np.outer(*counts)
    return np.maximum(0.0, z - np.repeat(np.repeat(mean, counts[0], 0), counts[1], 1))


def zone_candidates(z: np.ndarray, sigma: float = 10.0, k: int = 7, border: int = CUT) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``candidates`` of a zone, but for the limit of saturation, which is the frame's."""
    hp = zone_highpass(z)
    med = float(_upper(hp.reshape(1, -1))[0])
    noise = MAD_SIGMA * float(_upper(np.abs(hp - med).reshape(1, -1))[0])
    peaks = hp
    for axis in (0, 1):
        pad = [(k // 2, k // 2) if a == axis else (0, 0) for a in (0, 1)]
        peaks = np.lib.stride_tricks.sliding_window_view(np.pad(peaks, pad, constant_values=-np.inf), k, axis).max(-1)
    keep = (hp > med + sigma * (noise if noise > 0 else 1e-6)) & (hp >= peaks)
    y, x = np.nonzero(keep)
    inner = (y >= border) & (x >= border) & (y <= z.shape[0] - border) & (x <= z.shape[1] - border)
    return y[inner], x[inner]


FOUND = "y long, x long, luma double, score double, ecc double, elong double, pa double, fwhm double, x0 double, y0 double, siga double, sigb double"


def measured_zone(z: np.ndarray, y0: int, x0: int, cut: int = CUT) -> pd.DataFrame:
    """Stars of a zone whose first pixel is (y0, x0): candidates that pass the gate, with score and shape. What is read
    around a star lies inside the zone, since candidates keep off its border."""
    names = [c.split()[0] for c in FOUND.split(", ")]
    y, x = zone_candidates(z)
    inside = lambda half: np.stack([z[a - half : a + half + 1, b - half : b + half + 1] for a, b in zip(y, x, strict=True)]) if len(y) else np.zeros((0, 2 * half + 1, 2 * half + 1))
    score = gate(inside(WIN))
    y, x, score = (v[~np.isnan(score)] for v in (y, x, score))
    s = inside(cut // 2)
    m = adaptive(np.maximum(s - _upper(s.reshape(len(s), -1))[:, None, None], 0)) if len(s) else {c: np.zeros(0) for c in (*names, "ok")}
    found = pd.DataFrame({"y": y + y0, "x": x + x0, "luma": z[y, x], "score": score} | {c: m[c] for c in names[4:]})
    return found[np.asarray(m["ok"], bool)]


def plate_of_tiles(tiles: DataFrame, grid: int = 3, nstar: int = 4, sat: float = 0.92) -> tuple[DataFrame, DataFrame]:
    """``plate`` of ``frames.tiles``: (stars, zones), two written tables, frames named by their paths.

    Boxes follow from a frame's size, so nothing is joined to pixels: tiles are cut by slices, the slices of a zone meet in
    one task as arrays (a fifth of the frame's short side each way), and only stars leave it.
    """
    def measure_zone(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        return measured_zone(assembled(pdf), int(first.y0), int(first.x0)).assign(frame_id=first.frame_id, gy=first.gy, gx=first.gx)[["frame_id", "gy", "gx", *[c.split()[0] for c in FOUND.split(", ")]]]

    def brightest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame([(t.path, t.width, t.height, luma_of(t).max()) for t in pdf.itertuples()], columns=["frame_id", "width", "height", "top"])

    ok = tiles.where("error IS NULL")
    top = ok.mapInPandas(brightest, "frame_id string, width long, height long, top double").groupBy("frame_id", "width", "height").agg(F.max("top").alias("top"))
    boxes = materialize(zone_boxes(top, grid), "psf-zones")
    slices = sliced(tiles, lambda width, height: boxes_of(width, height, grid))
    found = slices.groupBy("frame_id", "gy", "gx").applyInPandas(measure_zone, f"frame_id string, gy long, gx long, {FOUND}")
    tops = boxes.select("frame_id", "gy", "gx", "top")
    lit = found.join(dealt(tops), ["frame_id", "gy", "gx"]).where(F.col("luma") < sat * F.col("top")).drop("luma", "top")
    chosen = materialize(topk_spaced(lit, nstar), "psf-stars")
    summed = materialize(zone_summary(chosen, boxes, grid), "psf-plate")
    release(boxes)
    return chosen, summed
