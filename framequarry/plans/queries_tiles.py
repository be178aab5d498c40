"""Registered queries on tiles: the twins are those of pixel rows, over the pixels that the frame files hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions.store import materialize
from framequarry.operators import reports, tilereduce
from framequarry.operators.results import content_key
from framequarry.sources import frames

from . import bindings as b
from .queries_pixels import BC, BR, RGBL, SQL as PIXEL_SQL, TCELL, TILE, K, rounded
from .queries_results import ANALYSED, STORED, _pixel_files, _with_broken

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        Q[name], SQL[name] = f, sql
        return f

    return add


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of 16 x 16 pixels of the frame files, whose 50 x 50 pixels end in tiles cut short."""
    return materialize(frames.tiles(_pixel_files(spark, sf, "fits"), 16), "tiles")


PATH = "'frame-' || frame_id || '.fits' AS frame_id"


@query("px_stats_tiles", f"{ANALYSED} SELECT {PATH}, round(pix_mean, 6) AS pix_mean, round(pix_stddev, 6) AS pix_stddev, pix_median, pix_mad, pix_min, pix_min_count, pix_max, pix_max_count FROM an")
def px_stats_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Exact statistics, median and deviation from value counts."""
    return rounded(tilereduce.statistics(materialize(tilereduce.value_counts(_tiles(spark, sf)), "value-counts")))


RANGE = f"WITH {STORED}, rg AS (SELECT frame_id, CASE WHEN min(r) < max(r) THEN min(r) ELSE 0 END AS lo, CASE WHEN min(r) < max(r) THEN max(r) ELSE 1 END AS hi FROM pixels GROUP BY 1)"


@query("px_histogram_tiles", f"""{RANGE}, c AS (SELECT p.frame_id, CAST(greatest(0, least(255, floor((r - lo) / (hi - lo) * 256))) AS BIGINT) AS bin, count(*) AS n FROM pixels p JOIN rg USING (frame_id) GROUP BY 1, 2),
g AS (SELECT frame_id, unnest(range(256)) AS bin FROM rg), f AS (SELECT g.frame_id, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.frame_id = g.frame_id AND c.bin = g.bin)
SELECT {PATH}, bin, n, round(ln(1 + n), 6) AS log_n, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY frame_id)), 6) AS rel FROM f""")
def px_histogram_tiles(spark: SparkSession, sf: str) -> DataFrame:
    tiles = _tiles(spark, sf)
    return rounded(tilereduce.histogram(tilereduce.value_counts(tiles, "r"), tilereduce.source_range(tiles)))


@query("px_thumbnail_tiles", f"""WITH {STORED}, z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1), s AS (SELECT *, least(1.0::DOUBLE, 16.0::DOUBLE / w, 12.0::DOUBLE / h) AS k FROM z),
o AS (SELECT *, CAST(greatest(1, floor(w * k + 0.5)) AS BIGINT) AS ow, CAST(greatest(1, floor(h * k + 0.5)) AS BIGINT) AS oh FROM s),
by_ AS (SELECT frame_id, oy, least(h - 1, floor(oy * (h / oh))) AS y0, least(h, greatest(least(h - 1, floor(oy * (h / oh))) + 1, floor((oy + 1) * (h / oh)))) AS y1 FROM (SELECT *, unnest(range(oh)) AS oy FROM o)),
bx_ AS (SELECT frame_id, ox, least(w - 1, floor(ox * (w / ow))) AS x0, least(w, greatest(least(w - 1, floor(ox * (w / ow))) + 1, floor((ox + 1) * (w / ow)))) AS x1 FROM (SELECT *, unnest(range(ow)) AS ox FROM o)),
bo AS (SELECT p.frame_id, oy, ox, round(avg(r), 6) AS v FROM pixels p JOIN by_ ON by_.frame_id = p.frame_id AND p.y >= y0 AND p.y < y1 JOIN bx_ ON bx_.frame_id = p.frame_id AND p.x >= x0 AND p.x < x1 GROUP BY 1, 2, 3) SELECT {PATH}, oy, ox, v FROM bo""")
def px_thumbnail_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tilereduce.thumbnail(_tiles(spark, sf), 16, 12).select("frame_id", "oy", "ox", "v"))


@query("bg_cell_floor_tiles", f"""WITH {STORED}, z AS (SELECT frame_id, (max(y) + 1) // 6 AS bh, (max(x) + 1) // 8 AS bw FROM pixels GROUP BY 1 HAVING least(max(y), max(x)) >= 29)
SELECT {PATH.replace('frame_id ||', 'p.frame_id ||')}, y // bh AS i, x // bw AS j, list_sort(list(r))[CAST(floor((count(*) - 1) * 0.25) AS BIGINT) + 1] AS b0 FROM pixels p JOIN z USING (frame_id) WHERE y // bh < 6 AND x // bw < 8 GROUP BY p.frame_id, i, j""")
def bg_cell_floor_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return tilereduce.cell_floor(_tiles(spark, sf), 6, 8, min_side=30)


@query("px_cutouts_tiles", f"""WITH {STORED}, z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1), c AS (SELECT *, least(16, w // 3, h // 3) AS c FROM z),
g AS (SELECT *, unnest(range(3)) AS gy FROM c), k AS (SELECT *, unnest(range(3)) AS gx FROM g), o AS (SELECT frame_id, gy, gx, c, gy * (h - c) // 2 AS y0, gx * (w - c) // 2 AS x0 FROM k)
SELECT {PATH.replace('frame_id ||', 'o.frame_id ||')}, gy, gx, count(*) AS n, sum(r) AS total, list(r ORDER BY y, x)[1] AS first_value FROM o JOIN pixels p ON p.frame_id = o.frame_id AND y >= y0 AND y < y0 + c AND x >= x0 AND x < x0 + c GROUP BY o.frame_id, gy, gx""")
def px_cutouts_tiles(spark: SparkSession, sf: str) -> DataFrame:
    c = tilereduce.cutouts(_tiles(spark, sf))
    return c.select("frame_id", "gy", "gx", "n", F.aggregate("values", F.lit(0.0), lambda s, v: s + v).alias("total"), F.element_at("values", 1).alias("first_value"))


LARGE = "WITH px AS (SELECT frame_id, y, x, r AS luma FROM pixels WHERE frame_id IN (SELECT frame_id FROM pixels GROUP BY 1 HAVING least(max(y), max(x)) >= 29)),"
#: Background diagnostics and tilt of the stored pixels, from the twins of the operators on pixel rows.
_sky = lambda name: PIXEL_SQL[name].replace(f"{RGBL},", LARGE)
FOUND = "stars AS (SELECT sr.frame_id, cx AS x, cy AS y, hfr, ecc, w, h FROM sr JOIN st ON st.frame_id = sr.frame_id)"
LEAN = PIXEL_SQL["tilt_summary"].replace(b.STARS, FOUND).replace("y * 3 / 800", "y * 3 / h").replace("x * 3 / 1000", "x * 3 / w").replace("SELECT DISTINCT frame_id FROM stars", "SELECT frame_id FROM st")


@query("report_files", f"""{ANALYSED}, lean AS ({LEAN}), b1 AS ({_sky("bg_radial_profile")}), b2 AS ({_sky("bg_radial_fit")}), b3 AS ({_sky("bg_plane_fit")}), b4 AS ({_sky("bg_corners")})
SELECT 'frame-' || an.frame_id || '.fits' AS path, true AS success, star_count, round(hfr_median, 6) AS hfr_median, round(pix_mean, 6) AS pix_mean, lean.success AS tilt_known, hfr_min, hfr_max, best_corner, worst_corner, tilt_pct, curvature_pct,
 bg_median, radial_drop, azim_aniso, radial_r2, amplitude, direction, plane_r2, corner_excess, corner_asymmetry, NULL::VARCHAR AS error
FROM an JOIN su USING (frame_id) JOIN lean USING (frame_id) LEFT JOIN b1 USING (frame_id) LEFT JOIN b2 USING (frame_id) LEFT JOIN b3 USING (frame_id) LEFT JOIN b4 USING (frame_id)
UNION ALL SELECT 'cut-frame-' || frame_id || '.fits', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'truncated pixels' FROM st""")
def report_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files, some of them broken, to their report: stars, tilt and background (the surface of the first round, which SQL has)."""
    files = materialize(_with_broken(_pixel_files(spark, sf, "fits")), "report-input")
    found = reports.report_files(files, tile=16, sky={"rows": BR, "cols": BC, "min_side": 30, "rounds": 1}, detection={"tile": TILE, "k": K})
    named = found.summary().join(content_key(files).select("path", "cache_key"), "cache_key")
    return rounded(named.select(  # what has fewer digits is rounded from the measured value, not from one of six digits
        "path", "success", "star_count", "hfr_median", "pix_mean", "tilt_known", "hfr_min", "hfr_max", "best_corner", "worst_corner", "tilt_pct", "curvature_pct", "bg_median", "radial_drop", "azim_aniso",
        F.round("radial_r2", 5).alias("radial_r2"), "amplitude", F.round("direction", 5).alias("direction"), "plane_r2", "corner_excess", "corner_asymmetry", "error",
    ))
