"""Registered pixel, star, tilt, background and point-spread queries, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.operators import analysis, background, pixels, psf, stars, tilt

from . import bindings as b

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


LUMA = "px AS (SELECT *, 0.299 * r + 0.587 * g + 0.114 * b AS luma FROM pixels)"
RGBL = f"WITH {b.RGB}, {LUMA}"


def upper(v: str) -> str:
    return f"list_sort(list({v}))[len(list({v})) // 2 + 1]"


@query("px_luma", f"{RGBL} SELECT frame_id, y, x, round(luma, 6) AS luma FROM px")
def px_luma(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.luma(b.rgb_pixels(spark, sf)).select("frame_id", "y", "x", "luma"))


@query("px_sanitize_flip", f"WITH {b.MONO}, d AS (SELECT frame_id, y, x, CASE WHEN event_bad = 0 THEN CAST('nan' AS DOUBLE) WHEN event_bad = 1 THEN CAST('inf' AS DOUBLE) ELSE r END AS r FROM (SELECT *, (y * 50 + x) % 97 AS event_bad FROM pixels)), s AS (SELECT frame_id, max(y) AS top FROM d GROUP BY 1) SELECT frame_id, top - y AS y, x, CASE WHEN isnan(r) OR isinf(r) THEN 0 ELSE r END AS r FROM d JOIN s USING (frame_id)")
def px_sanitize_flip(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("y") * 50 + F.col("x")) % 97
    bad = F.when(k == 0, float("nan")).when(k == 1, float("inf")).otherwise(F.col("r"))
    return pixels.sanitize_flip(b.star_pixels(spark, sf).select("frame_id", "y", "x", bad.alias("r"))).select("frame_id", "y", "x", "r")


RANGE = "rg AS (SELECT frame_id, CASE WHEN lo < hi THEN lo ELSE 0 END AS src_min, CASE WHEN lo < hi THEN hi ELSE 1 END AS src_max FROM (SELECT frame_id, {lo} AS lo, {hi} AS hi FROM pixels GROUP BY frame_id))"
RANGE_RGB, RANGE_MONO = RANGE.format(lo="min(least(r, g, b))", hi="max(greatest(r, g, b))"), RANGE.format(lo="min(r)", hi="max(r)")


@query("px_source_range", f"WITH {b.RGB}, {RANGE_RGB} SELECT frame_id, round(src_min, 6) AS src_min, round(src_max, 6) AS src_max FROM rg")
def px_source_range(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.source_range(b.rgb_pixels(spark, sf)))


@query("px_stats", f"""WITH {b.MONO}, s AS (SELECT frame_id, avg(r) AS m, coalesce(stddev_samp(r), 0) AS sd, min(r) AS lo, max(r) AS hi FROM pixels GROUP BY 1)
SELECT p.frame_id, round(any_value(m), 6) AS pix_mean, round(any_value(sd), 6) AS pix_stddev, any_value(lo) AS pix_min, count(*) FILTER (r = lo) AS pix_min_count, any_value(hi) AS pix_max, count(*) FILTER (r = hi) AS pix_max_count FROM pixels p JOIN s USING (frame_id) GROUP BY 1""")
def px_stats(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.stats(b.star_pixels(spark, sf), "r"))


@query("px_median_mad", f"""{RGBL}, m AS (SELECT frame_id, {upper('luma')} AS med FROM px GROUP BY 1)
SELECT p.frame_id, round(any_value(med), 6) AS pix_median, round({upper('abs(luma - med)')}, 6) AS pix_mad FROM px p JOIN m USING (frame_id) GROUP BY 1""")
def px_median_mad(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.median_mad(pixels.luma(b.rgb_pixels(spark, sf))))


@query("px_histogram", f"""WITH {b.MONO}, {RANGE_MONO}, c AS (SELECT p.frame_id, CAST(greatest(0, least(255, floor((r - src_min) / (src_max - src_min) * 256))) AS BIGINT) AS bin, count(*) AS n FROM pixels p JOIN rg USING (frame_id) GROUP BY 1, 2),
g AS (SELECT frame_id, unnest(range(256)) AS bin FROM rg), f AS (SELECT g.frame_id, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN c ON c.frame_id = g.frame_id AND c.bin = g.bin)
SELECT frame_id, bin, n, round(ln(1 + n), 6) AS log_n, round(ln(1 + n) / ln(1 + max(n) OVER (PARTITION BY frame_id)), 6) AS rel FROM f""")
def px_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.histogram(b.star_pixels(spark, sf)))


STRETCH = f"""{RANGE_MONO}, v AS (SELECT p.*, (r - src_min) / (src_max - src_min) AS v, src_min, src_max FROM pixels p JOIN rg USING (frame_id)), md AS (SELECT frame_id, {upper('v')} AS med FROM v GROUP BY 1),
ad AS (SELECT v.frame_id, any_value(med) AS med, {upper('abs(v.v - med)')} AS mad FROM v JOIN md USING (frame_id) GROUP BY 1),
sh AS (SELECT frame_id, med, greatest(0, least(1, med - 2.8 * 1.4826::DOUBLE * mad)) AS shadows FROM ad),
xn AS (SELECT frame_id, shadows, CASE WHEN shadows < 1 THEN greatest(0, least(1, (med - shadows) / (1 - shadows))) ELSE 0 END AS xn FROM sh),
st AS (SELECT frame_id, shadows, 1.0::DOUBLE AS highlights, CASE WHEN xn * 0.75 > 0 AND xn + 0.25 - 0.5 * xn > 0 THEN greatest(0.001, least(0.999, xn * 0.75 / (xn + 0.25 - 0.5 * xn))) ELSE 0.5 END AS midtone FROM xn)"""


@query("px_auto_stretch", f"WITH {b.MONO}, {STRETCH} SELECT frame_id, round(shadows, 6) AS shadows, highlights, round(midtone, 6) AS midtone FROM st")
def px_auto_stretch(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.auto_stretch(b.star_pixels(spark, sf)))


@query("px_apply_stretch", f"""WITH {b.MONO}, {STRETCH}, i AS (SELECT v.frame_id, y, x, greatest(0, least(1, ((greatest(0, least(4095, floor((r - src_min) * 4096 / (src_max - src_min)))) + 0.5) / 4096 - shadows) / greatest(highlights - shadows, 1e-9))) AS n, midtone AS m FROM v JOIN st USING (frame_id))
SELECT frame_id, y, x, CAST(floor(CASE WHEN n <= 0 THEN 0 WHEN n >= 1 THEN 1 WHEN m = 0.5 THEN n ELSE (m - 1) * n / ((2 * m - 1) * n - m) END * 255 + 0.5) AS BIGINT) AS v8 FROM i""")
def px_apply_stretch(spark: SparkSession, sf: str) -> DataFrame:
    px = b.star_pixels(spark, sf)
    return pixels.apply_stretch(px.drop("dir"), pixels.auto_stretch(px))


@query("px_thumbnail", f"""WITH {b.MONO}, {STRETCH}, z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1), s AS (SELECT *, least(1.0::DOUBLE, 16.0::DOUBLE / w, 12.0::DOUBLE / h) AS k FROM z),
o AS (SELECT *, CAST(greatest(1, floor(w * k + 0.5)) AS BIGINT) AS ow, CAST(greatest(1, floor(h * k + 0.5)) AS BIGINT) AS oh FROM s),
by_ AS (SELECT frame_id, oy, least(h - 1, floor(oy * (h / oh))) AS y0, least(h, greatest(least(h - 1, floor(oy * (h / oh))) + 1, floor((oy + 1) * (h / oh)))) AS y1 FROM (SELECT *, unnest(range(oh)) AS oy FROM o)),
bx_ AS (SELECT frame_id, ox, least(w - 1, floor(ox * (w / ow))) AS x0, least(w, greatest(least(w - 1, floor(ox * (w / ow))) + 1, floor((ox + 1) * (w / ow)))) AS x1 FROM (SELECT *, unnest(range(ow)) AS ox FROM o)),
bo AS (SELECT p.frame_id, oy, ox, avg(r) AS v FROM pixels p JOIN by_ ON by_.frame_id = p.frame_id AND p.y >= y0 AND p.y < y1 JOIN bx_ ON bx_.frame_id = p.frame_id AND p.x >= x0 AND p.x < x1 GROUP BY 1, 2, 3),
i AS (SELECT bo.*, greatest(0, least(1, ((greatest(0, least(4095, floor((v - src_min) * 4096 / (src_max - src_min)))) + 0.5) / 4096 - shadows) / greatest(highlights - shadows, 1e-9))) AS n, midtone AS m FROM bo JOIN rg USING (frame_id) JOIN st USING (frame_id))
SELECT frame_id, oy, ox, round(v, 6) AS v, CAST(floor(CASE WHEN n <= 0 THEN 0 WHEN n >= 1 THEN 1 WHEN m = 0.5 THEN n ELSE (m - 1) * n / ((2 * m - 1) * n - m) END * 255 + 0.5) AS BIGINT) AS v8 FROM i""")
def px_thumbnail(spark: SparkSession, sf: str) -> DataFrame:
    px = b.star_pixels(spark, sf)
    return rounded(pixels.rendered_thumbnail(px, pixels.auto_stretch(px), 16, 12))


#: A pattern and offsets for each frame, and frames one pixel wide besides (their numbers are negative).
CFA = f"""{b.MONO.replace("pixels AS", "given AS")}, pixels AS (SELECT frame_id, y, x, r FROM given UNION ALL SELECT -1 - frame_id, y, 0, r FROM given WHERE x = 0),
c AS (SELECT frame_id, y, x, r, substr(['RGGB', 'BGGR', 'GRBG', 'GBRG'][abs(frame_id) % 4 + 1], CAST((y + abs(frame_id) % 2) % 2 * 2 + (x + abs(frame_id) // 2 % 2) % 2 + 1 AS BIGINT), 1) AS s FROM pixels)"""


@query("px_debayer", f"""WITH {CFA},
n AS (SELECT a.frame_id, a.y, a.x, any_value(a.s) AS s, any_value(a.r) AS own, avg(d.r) FILTER (d.s = 'R') AS r, avg(d.r) FILTER (d.s = 'G') AS g, avg(d.r) FILTER (d.s = 'B') AS b
 FROM c a JOIN c d ON a.frame_id = d.frame_id AND d.y BETWEEN a.y - 1 AND a.y + 1 AND d.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY 1, 2, 3)
SELECT frame_id, y, x, round(CASE WHEN s = 'R' THEN own ELSE coalesce(r, own) END, 6) AS r, round(CASE WHEN s = 'G' THEN own ELSE coalesce(g, own) END, 6) AS g, round(CASE WHEN s = 'B' THEN own ELSE coalesce(b, own) END, 6) AS b FROM n""")
def px_debayer(spark: SparkSession, sf: str) -> DataFrame:
    px = b.star_pixels(spark, sf).select("frame_id", "y", "x", "r")
    px = px.union(px.where("x = 0").select(-1 - F.col("frame_id"), "y", "x", "r"))
    k = F.abs("frame_id")
    pattern = F.element_at(F.array(*map(F.lit, ("RGGB", "BGGR", "GRBG", "GBRG"))), (k % 4 + 1).cast("int"))
    patterns = px.select("frame_id").distinct().select("frame_id", pattern.alias("pattern"), (F.floor(k / 2) % 2).alias("dx"), (k % 2).alias("dy"))
    return rounded(pixels.debayer(px, patterns=patterns, tile=16))


@query("px_bayer_pattern", """WITH c AS (SELECT o_orderkey AS frame_id, ' ''' || lower(['RGGB', 'bggr', 'GRBG', 'XXXX'][o_orderkey % 4 + 1]) || ' '' ' AS pat, (o_custkey % 5 - 2)::INTEGER AS xo, (o_custkey % 3)::INTEGER AS yo FROM orders)
SELECT frame_id, CASE WHEN frame_id % 4 < 3 THEN upper(regexp_replace(pat, '[''\\s]', '', 'g')) END AS pattern, CAST(CASE WHEN frame_id % 2 = 0 THEN ((xo % 2) + 2) % 2 ELSE 0 END AS BIGINT) AS dx, CAST(yo % 2 AS BIGINT) AS dy FROM c""")
def px_bayer_pattern(spark: SparkSession, sf: str) -> DataFrame:
    o, k = b.table(spark, sf, "orders"), F.col("o_orderkey")
    pat = F.concat(F.lit(" '"), F.lower(F.element_at(F.array(*map(F.lit, ("RGGB", "bggr", "GRBG", "XXXX"))), (k % 4 + 1).cast("int"))), F.lit(" ' "))
    card = lambda key, v: F.struct(key.alias("key"), v.alias("value"))
    listed = F.array(card(F.lit("BayerPat"), pat), card(F.when(k % 2 == 0, "XBAYROFF").otherwise("OTHER"), (F.col("o_custkey") % 5 - 2).cast("string")), card(F.lit("BAYOFFY"), (F.col("o_custkey") % 3).cast("string")))
    return pixels.bayer_pattern(o.select(k.alias("frame_id"), F.posexplode(listed).alias("card_idx", "c")).select("frame_id", "card_idx", "c.key", "c.value"))


@query("px_gray_world", f"""WITH {b.RGB}, m AS (SELECT frame_id, {upper('r')} AS mr, {upper('g')} AS mg, {upper('b')} AS mb FROM pixels GROUP BY 1),
k AS (SELECT frame_id, least(mr, mg, mb) > 0 AS ok, (mr + mg + mb) / 3 AS mean, mr, mg, mb FROM m), n AS (SELECT frame_id, CASE WHEN ok THEN greatest(0.2, least(5, mean / mr)) ELSE 1 END AS kr, CASE WHEN ok THEN greatest(0.2, least(5, mean / mg)) ELSE 1 END AS kg, CASE WHEN ok THEN greatest(0.2, least(5, mean / mb)) ELSE 1 END AS kb FROM k)
SELECT frame_id, y, x, round(r * kr, 6) AS r, round(g * kg, 6) AS g, round(b * kb, 6) AS b, round(kr, 6) AS gain_r, round(kg, 6) AS gain_g, round(kb, 6) AS gain_b FROM pixels JOIN n USING (frame_id)""")
def px_gray_world(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(pixels.gray_world(b.rgb_pixels(spark, sf)))


@query("px_cutouts", f"""WITH {b.MONO}, z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h FROM pixels GROUP BY 1), c AS (SELECT *, least(16, w // 3, h // 3) AS c FROM z),
g AS (SELECT *, unnest(range(3)) AS gy FROM c), k AS (SELECT *, unnest(range(3)) AS gx FROM g), o AS (SELECT frame_id, gy, gx, c, gy * (h - c) // 2 AS y0, gx * (w - c) // 2 AS x0 FROM k)
SELECT o.frame_id, gy, gx, count(*) AS n, round(sum(r), 6) AS total, list(r ORDER BY y, x)[1] AS first_value FROM o JOIN pixels p ON p.frame_id = o.frame_id AND y >= y0 AND y < y0 + c AND x >= x0 AND x < x0 + c GROUP BY 1, 2, 3""")
def px_cutouts(spark: SparkSession, sf: str) -> DataFrame:
    c = pixels.cutouts(b.star_pixels(spark, sf))
    return c.select("frame_id", "gy", "gx", "n", F.round(F.aggregate("values", F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.element_at("values", 1).alias("first_value"))


@query("px_star_stamps", f"""WITH {b.MONO}, z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h, arg_max(y * 50 + x, r) AS k FROM (SELECT * FROM pixels ORDER BY y, x) GROUP BY 1),
o AS (SELECT frame_id, greatest(0, least(k // 50 - 14, greatest(0, h - 29))) AS y0, greatest(0, least(k % 50 - 14, greatest(0, w - 29))) AS x0 FROM z),
v AS (SELECT o.frame_id, y0, x0, y, x, r FROM o JOIN pixels p ON p.frame_id = o.frame_id AND y >= y0 AND y < y0 + 29 AND x >= x0 AND x < x0 + 29), m AS (SELECT frame_id, {upper('r')} AS med FROM v GROUP BY 1),
d AS (SELECT v.*, greatest(0, r - med) AS d FROM v JOIN m USING (frame_id)), q AS (SELECT frame_id, greatest(1e-6, list_sort(list(d))[CAST(floor(0.995::DOUBLE * (count(*) - 1)) AS BIGINT) + 1]) AS p FROM d GROUP BY 1)
SELECT frame_id, any_value(y0) AS y0, any_value(x0) AS x0, count(*) AS n, round(sum(greatest(0, least(1, asinh(d / (p * 0.15)) / asinh(1 / 0.15)))), 5) AS total FROM d JOIN q USING (frame_id) GROUP BY 1""")
def px_star_stamps(spark: SparkSession, sf: str) -> DataFrame:
    """The asinh view of a 29 x 29 stamp around the brightest pixel of each frame."""
    px = b.star_pixels(spark, sf)
    top = px.groupBy("frame_id").agg(F.max_by(F.struct("y", "x"), F.struct("r", -(F.col("y") * 50 + F.col("x")))).alias("c")).select("frame_id", F.lit(0).alias("star"), "c.y", "c.x")
    v = pixels.normalise_stamps(pixels.stamps(px, top))
    return v.select("frame_id", "y0", "x0", F.size("values").cast("long").alias("n"), F.round(F.aggregate("values", F.lit(0.0), lambda a, c: a + c), 5).alias("total"))


# Stars, on 50 x 50 frames: cells of 8 pixels, a lower threshold.
TILE, K = 8, 1.5


def _mono(spark: SparkSession, sf: str) -> DataFrame:
    return b.star_pixels(spark, sf).withColumnRenamed("r", "luma")


def _lists(depth: int = 3) -> str:
    """Rounds of the sigma clip as nested lists."""
    med = lambda v: f"list_sort({v})[len({v}) // 2 + 1]"
    mad = lambda v, m: med(f"list_transform({v}, lambda q: abs(q - {m}))")
    sql = "m0 AS (SELECT frame_id, y // 8 AS cy, x // 8 AS cx, list_sort(list(r)) AS v FROM pixels GROUP BY 1, 2, 3), q0 AS (SELECT *, v[len(v) // 2 + 1] AS med, true AS op FROM m0), c0 AS (SELECT *, 1.4826::DOUBLE * " + mad("v", "med") + " AS sig FROM q0)"
    for k in range(depth):
        sql += f""", t{k} AS (SELECT *, list_filter(v, lambda q: q < med + 3 * sig) AS cut FROM c{k}), u{k} AS (SELECT frame_id, cy, cx, v, med, sig, cut, op AND sig > 0 AND len(cut) >= 8 AS op FROM t{k}),
q{k + 1} AS (SELECT frame_id, cy, cx, sig AS old, CASE WHEN op THEN cut ELSE v END AS v, CASE WHEN op THEN {med('cut')} ELSE med END AS med, op FROM u{k}), c{k + 1} AS (SELECT frame_id, cy, cx, v, med, op, CASE WHEN op THEN 1.4826::DOUBLE * {mad('v', 'med')} ELSE old END AS sig FROM q{k + 1})"""
    return sql + f", mesh AS (SELECT frame_id, cy, cx, med AS bg, greatest(sig, 1e-6) AS noise FROM c{depth})"


MESH = f"WITH RECURSIVE {b.MONO}, {_lists()}"
SMOOTH = f"""{MESH}, lim AS (SELECT frame_id, max(cy) AS my, max(cx) AS mx FROM mesh GROUP BY 1), near AS (SELECT frame_id, cy, cx, greatest(0, least(cy + dy, my)) AS ny, greatest(0, least(cx + dx, mx)) AS nx
  FROM mesh JOIN lim USING (frame_id), (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) e(dx)),
sm AS (SELECT n.frame_id, n.cy, n.cx, {upper('m.bg')} AS bg, {upper('m.noise')} AS noise FROM near n JOIN mesh m ON m.frame_id = n.frame_id AND m.cy = n.ny AND m.cx = n.nx GROUP BY 1, 2, 3)"""


def _bilinear(src: str, y: str, x: str, keep: str) -> str:
    axis = lambda v, n: f"greatest(0.0::DOUBLE, least({v} / 8 - 0.5, {n}::DOUBLE))"
    return f"""(SELECT p.*, (a.bg * (1 - tx) + c.bg * tx) * (1 - ty) + (d.bg * (1 - tx) + e.bg * tx) * ty AS bg, (a.noise * (1 - tx) + c.noise * tx) * (1 - ty) + (d.noise * (1 - tx) + e.noise * tx) * ty AS noise FROM
 (SELECT s.*, CAST(floor({axis(y, 'my')}) AS BIGINT) AS iy, CAST(floor({axis(x, 'mx')}) AS BIGINT) AS ix, {axis(y, 'my')} - floor({axis(y, 'my')}) AS ty, {axis(x, 'mx')} - floor({axis(x, 'mx')}) AS tx,
   least(CAST(floor({axis(y, 'my')}) AS BIGINT) + 1, my) AS jy, least(CAST(floor({axis(x, 'mx')}) AS BIGINT) + 1, mx) AS jx FROM (SELECT {keep} FROM {src}) s JOIN lim USING (frame_id)) p
 JOIN sm a ON a.frame_id = p.frame_id AND a.cy = iy AND a.cx = ix JOIN sm c ON c.frame_id = p.frame_id AND c.cy = iy AND c.cx = jx JOIN sm d ON d.frame_id = p.frame_id AND d.cy = jy AND d.cx = ix JOIN sm e ON e.frame_id = p.frame_id AND e.cy = jy AND e.cx = jx)"""


SPARSE = f"{SMOOTH}, sp AS (SELECT frame_id, y, x, r AS luma, r - bg AS residual, noise FROM {_bilinear('pixels', 'y', 'x', 'frame_id, y, x, r')} WHERE r > bg + 1.5 * noise)"
LABELS = f"""{SPARSE}, ed AS (SELECT a.frame_id, a.y * 1000000 + a.x AS u, c.y * 1000000 + c.x AS v FROM sp a JOIN sp c ON a.frame_id = c.frame_id AND c.y BETWEEN a.y - 1 AND a.y + 1 AND c.x BETWEEN a.x - 1 AND a.x + 1),
rc(frame_id, u, l) AS (SELECT frame_id, u, u FROM ed UNION SELECT ed.frame_id, ed.v, rc.l FROM rc JOIN ed ON ed.frame_id = rc.frame_id AND ed.u = rc.u WHERE rc.l < ed.v),
lb AS (SELECT sp.*, l AS label FROM sp JOIN (SELECT frame_id, u, min(l) AS l FROM rc GROUP BY 1, 2) m ON m.frame_id = sp.frame_id AND m.u = sp.y * 1000000 + sp.x)"""
AREA = f"{LABELS}, ar AS (SELECT * FROM lb WHERE (frame_id, label) IN (SELECT (frame_id, label) FROM lb GROUP BY frame_id, label HAVING count(*) BETWEEN 5 AND 2000))"
MOMENTS = f"""{AREA}, ct AS (SELECT frame_id, label, sum(residual) AS flux, max(residual) AS peak, count(*) AS area, sum(residual * x) / sum(residual) AS cx, sum(residual * y) / sum(residual) AS cy FROM ar GROUP BY 1, 2 HAVING sum(residual) > 0),
mm AS (SELECT ar.frame_id, ar.label, sum(residual * (x - cx) * (x - cx)) / sum(residual) AS mxx, sum(residual * (y - cy) * (y - cy)) / sum(residual) AS myy, sum(residual * (x - cx) * (y - cy)) / sum(residual) AS mxy FROM ar JOIN ct ON ct.frame_id = ar.frame_id AND ct.label = ar.label GROUP BY 1, 2),
ll AS (SELECT ct.*, mxx, myy, mxy, (mxx + myy) / 2 + sqrt(greatest(0, (mxx - myy) * (mxx - myy) / 4 + mxy * mxy)) AS l1, greatest(0, (mxx + myy) / 2 - sqrt(greatest(0, (mxx - myy) * (mxx - myy) / 4 + mxy * mxy))) AS l2 FROM ct JOIN mm ON ct.frame_id = mm.frame_id AND ct.label = mm.label),
mo AS (SELECT frame_id, label, flux, peak, area, cx, cy, 2.3548200450309493::DOUBLE * sqrt((l1 + l2) / 2) AS fwhm, sqrt(greatest(0, 1 - l2 / l1)) AS ecc, 0.5 * atan2(2 * mxy, mxx - myy) AS theta FROM ll WHERE l1 > 0)"""
CUTS = f"{MOMENTS}, qc AS (SELECT * EXCLUDE (bg, noise, iy, ix, jy, jx, ty, tx) FROM {_bilinear('mo', 'cy', 'cx', '*')} WHERE flux / (noise * sqrt(area)) >= 3 AND (peak / noise >= 30 OR (ecc <= 0.8 AND fwhm BETWEEN 1.2 AND 9 AND peak / flux <= 0.95)))".replace("EXCLUDE (bg, noise, iy, ix, jy, jx, ty, tx)", "")
CUTS = CUTS.replace("qc AS (SELECT * ", "qc AS (SELECT frame_id, label, flux, peak, area, cx, cy, fwhm, ecc, theta ")
HFR = f"""{CUTS}, rd AS (SELECT a.frame_id, a.label, a.y, a.x, residual, flux, sqrt((a.x - cx) * (a.x - cx) + (a.y - cy) * (a.y - cy)) AS rad FROM ar a JOIN qc ON qc.frame_id = a.frame_id AND qc.label = a.label),
cu AS (SELECT *, sum(residual) OVER w AS cum, lag(rad) OVER w AS prev, row_number() OVER w AS n FROM rd WINDOW w AS (PARTITION BY frame_id, label ORDER BY round(rad, 9), y, x ROWS UNBOUNDED PRECEDING)),
ht AS (SELECT * FROM cu WHERE cum >= flux / 2 QUALIFY row_number() OVER (PARTITION BY frame_id, label ORDER BY n) = 1),
hf AS (SELECT qc.*, CASE WHEN prev IS NULL THEN rad ELSE prev + (ht.flux / 2 - (cum - residual)) / residual * (rad - prev) END AS hfr FROM qc JOIN ht ON qc.frame_id = ht.frame_id AND qc.label = ht.label), sr AS (SELECT * FROM hf WHERE hfr > 0)"""
SUMMARY = f"""{HFR}, sx AS (SELECT frame_id, count(*) AS star_count, {upper('hfr')} AS hfr_median, stddev_pop(hfr) AS hfr_stddev, {upper('fwhm')} AS fwhm_median, {upper('ecc')} AS ecc_median FROM sr GROUP BY 1),
su AS (SELECT f.frame_id, f.dir, coalesce(star_count, 0) AS star_count, coalesce(hfr_median, 0) AS hfr_median, coalesce(hfr_stddev, 0) AS hfr_stddev, coalesce(fwhm_median, 0) AS fwhm_median, coalesce(ecc_median, 0) AS ecc_median FROM (SELECT DISTINCT frame_id, dir FROM pixels) f LEFT JOIN sx ON sx.frame_id = f.frame_id)"""
R6 = lambda *c: ", ".join(f"round({x}, 6) AS {x}" for x in c)


@query("star_bg_mesh", f"{MESH} SELECT frame_id, cy, cx, {R6('bg', 'noise')} FROM mesh")
def star_bg_mesh(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stars.bg_mesh(_mono(spark, sf), TILE))


def _mesh(px: DataFrame) -> DataFrame:
    return stars.mesh_smooth(stars.bg_mesh(px, TILE))


@query("star_mesh_smooth", f"{SMOOTH} SELECT frame_id, cy, cx, {R6('bg', 'noise')} FROM sm")
def star_mesh_smooth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_mesh(_mono(spark, sf)))


def _sparse(px: DataFrame) -> DataFrame:
    return stars.threshold(px, _mesh(px), TILE, K)


@query("star_threshold", f"{SPARSE} SELECT frame_id, y, x, {R6('luma', 'residual', 'noise')} FROM sp")
def star_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_sparse(_mono(spark, sf)))


@query("star_components", f"{LABELS} SELECT frame_id, y, x, label FROM lb")
def star_components(spark: SparkSession, sf: str) -> DataFrame:
    return stars.components(_sparse(_mono(spark, sf))).select("frame_id", "y", "x", "label")


@query("star_area_filter", f"{AREA} SELECT frame_id, y, x, label FROM ar")
def star_area_filter(spark: SparkSession, sf: str) -> DataFrame:
    return stars.area_filter(stars.components(_sparse(_mono(spark, sf)))).select("frame_id", "y", "x", "label")


@query("star_moments", f"{MOMENTS} SELECT frame_id, label, area, {R6('flux', 'peak', 'cx', 'cy', 'fwhm', 'ecc')}, round(abs(theta), 4) AS turned FROM mo")
def star_moments(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stars.moments(stars.sparse(_mono(spark, sf), TILE, K)[0]).withColumn("turned", F.round(F.abs("theta"), 4)).drop("theta"))


def _cut(px: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labelled pixels, stars that pass the cuts), over tables that are written once."""
    labelled, mesh = stars.sparse(px, TILE, K)
    return labelled, stars.quality_cuts(stars.moments(labelled), mesh, TILE)


@query("star_quality_cuts", f"{CUTS} SELECT frame_id, label, area, {R6('flux', 'peak', 'cx', 'cy', 'fwhm', 'ecc')}, round(abs(theta), 4) AS turned FROM qc")
def star_quality_cuts(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_cut(_mono(spark, sf))[1].withColumn("turned", F.round(F.abs("theta"), 4)).drop("theta"))


@query("star_hfr", f"{HFR} SELECT frame_id, label, {R6('hfr', 'fwhm', 'flux')} FROM sr")
def star_hfr(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stars.half_flux_radius(*_cut(_mono(spark, sf))).select("frame_id", "label", "hfr", "fwhm", "flux"))


@query("star_summary", f"{SUMMARY} SELECT frame_id, star_count, {R6('hfr_median', 'hfr_stddev', 'fwhm_median', 'ecc_median')} FROM su")
def star_summary(spark: SparkSession, sf: str) -> DataFrame:
    px = _mono(spark, sf)
    return rounded(stars.summary(px.select("frame_id").distinct(), stars.detect(px, TILE, K)))


@query("star_detailed", f"{HFR} SELECT frame_id, {R6('cx', 'cy', 'flux', 'hfr', 'fwhm', 'ecc')}, round(abs(theta), 4) AS turned, area FROM sr")
def star_detailed(spark: SparkSession, sf: str) -> DataFrame:
    """All stars of all frames with their measurements, as the summary counts them."""
    found = stars.detect(_mono(spark, sf), TILE, K)
    return rounded(found.select("frame_id", "cx", "cy", "flux", "hfr", "fwhm", "ecc", F.round(F.abs("theta"), 4).alias("turned"), "area"))


@query("star_full_analysis", f"""{SUMMARY}, ps AS (SELECT frame_id, avg(r) AS pix_mean, coalesce(stddev_samp(r), 0) AS pix_stddev, {upper('r')} AS pix_median, min(r) AS pix_min, max(r) AS pix_max FROM pixels GROUP BY 1),
pm AS (SELECT ps.*, {upper('abs(r - pix_median)')} AS pix_mad, count(*) FILTER (r = pix_min) AS pix_min_count, count(*) FILTER (r = pix_max) AS pix_max_count FROM pixels JOIN ps USING (frame_id) GROUP BY ALL)
SELECT su.frame_id, su.dir, star_count, {R6('hfr_median', 'hfr_stddev', 'fwhm_median', 'ecc_median', 'pix_mean', 'pix_stddev', 'pix_median', 'pix_mad')}, pix_min, pix_min_count, pix_max, pix_max_count, row_number() OVER (PARTITION BY su.dir ORDER BY hfr_median, su.frame_id) AS rank FROM su JOIN pm USING (frame_id)""")
def star_full_analysis(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels to ranked frames: the whole analysis row, and the sharpest frames of each folder first."""
    from framequarry.operators.results import top_per_folder

    px = b.star_pixels(spark, sf)
    rows, _ = analysis.analyse(px.select("frame_id", "y", "x", "r"), tile=TILE, k=K)
    return rounded(top_per_folder(rows.join(px.select("frame_id", "dir").distinct(), "frame_id"), 2**31 - 1))


TCELL = f"""WITH {b.STARS}, tc AS (SELECT frame_id, CAST(greatest(0, least(2, floor(y * 3 / 800))) AS BIGINT) AS gy, CAST(greatest(0, least(2, floor(x * 3 / 1000))) AS BIGINT) AS gx, count(*) AS n, {upper('hfr')} AS hfr, avg(ecc) AS ecc FROM stars GROUP BY 1, 2, 3),
tg AS (SELECT f.frame_id, gy, gx FROM (SELECT DISTINCT frame_id FROM stars) f, (SELECT unnest(range(3)) AS gy) a, (SELECT unnest(range(3)) AS gx) e),
cl AS (SELECT tg.frame_id, tg.gy, tg.gx, coalesce(n, 0) AS n, coalesce(hfr, 0) AS hfr, coalesce(ecc, 0) AS ecc, CASE WHEN (tg.gy, tg.gx) = (0, 0) THEN 0 WHEN (tg.gy, tg.gx) = (0, 2) THEN 1 WHEN (tg.gy, tg.gx) = (2, 0) THEN 2 WHEN (tg.gy, tg.gx) = (2, 2) THEN 3 END AS k FROM tg LEFT JOIN tc ON tc.frame_id = tg.frame_id AND tc.gy = tg.gy AND tc.gx = tg.gx)"""


@query("tilt_cells", f"{TCELL} SELECT frame_id, gy, gx, n, {R6('hfr', 'ecc')} FROM cl")
def tilt_cells(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tilt.cells(b.stars(spark, sf), 1000, 800))


@query("tilt_summary", f"""{TCELL}, a AS (SELECT frame_id, min(hfr) FILTER (n > 0) AS lo, max(hfr) FILTER (n > 0) AS hi, min(hfr) FILTER (n > 0 AND k IS NOT NULL) AS cb, max(hfr) FILTER (n > 0 AND k IS NOT NULL) AS cw, count(*) FILTER (n > 0 AND k IS NOT NULL) AS nc, avg(hfr) FILTER (n > 0 AND k IS NOT NULL) AS mean, max(hfr) FILTER (n > 0 AND gy = 1 AND gx = 1) AS ce FROM cl GROUP BY 1)
SELECT a.frame_id, lo IS NOT NULL AS success, round(coalesce(lo, 0), 6) AS hfr_min, round(coalesce(hi, 0), 6) AS hfr_max, CAST(CASE WHEN nc >= 2 THEN (SELECT min(k) FROM cl WHERE cl.frame_id = a.frame_id AND n > 0 AND hfr = cb) ELSE -1 END AS BIGINT) AS best_corner,
 CAST(CASE WHEN nc >= 2 THEN (SELECT min(k) FROM cl WHERE cl.frame_id = a.frame_id AND n > 0 AND hfr = cw) ELSE -1 END AS BIGINT) AS worst_corner, round(CASE WHEN nc >= 2 AND cb > 0 THEN (cw - cb) / cb * 100 ELSE 0 END, 6) AS tilt_pct, round(CASE WHEN nc > 0 AND ce > 0 THEN (mean - ce) / ce * 100 ELSE 0 END, 6) AS curvature_pct FROM a""")
def tilt_summary(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tilt.summary(tilt.cells(b.stars(spark, sf), 1000, 800)))


@query("tilt_nodes", f"""{TCELL}, nd AS (SELECT *, CAST(CASE WHEN k IS NOT NULL THEN k WHEN gy = 1 AND gx = 1 THEN 4 END AS BIGINT) AS node FROM cl WHERE n > 0), nn AS (SELECT *, avg(hfr) OVER (PARTITION BY frame_id) AS mean, min(hfr) OVER (PARTITION BY frame_id) AS lo FROM nd WHERE node IS NOT NULL)
SELECT frame_id, node, round(hfr, 6) AS hfr, round(greatest(0.6, least(1.55, 1 + 3 * (hfr - mean) / mean)), 6) AS factor, round((hfr - lo) / (0.2 * lo), 6) AS quality FROM nn""")
def tilt_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(tilt.nodes(tilt.cells(b.stars(spark, sf), 1000, 800)))


@query("grid_rotate", f"{TCELL} SELECT frame_id, round(hfr, 6) AS hfr, 90 AS turned, gx AS gy, 2 - gy AS gx FROM cl UNION ALL SELECT frame_id, round(hfr, 6), 180, 2 - gy, 2 - gx FROM cl UNION ALL SELECT frame_id, round(hfr, 6), 270, 2 - gx, gy FROM cl")
def grid_rotate(spark: SparkSession, sf: str) -> DataFrame:
    c = rounded(tilt.cells(b.stars(spark, sf), 1000, 800)).select("frame_id", "gy", "gx", "hfr")
    turned = [tilt.rotate(c, 3, 3, d).withColumn("turned", F.lit(d)) for d in (90, 180, 270)]
    return turned[0].unionByName(turned[1]).unionByName(turned[2])


# Background on the colour binding: 6 x 8 cells.
BR, BC = 6, 8
FLOOR = f"""{RGBL}, z AS (SELECT frame_id, (max(y) + 1) // 6 AS bh, (max(x) + 1) // 8 AS bw FROM px GROUP BY 1), fl AS (SELECT px.frame_id, y // bh AS i, x // bw AS j, list_sort(list(luma))[CAST(floor((count(*) - 1) * 0.25) AS BIGINT) + 1] AS b0 FROM px JOIN z USING (frame_id) WHERE y // bh < 6 AND x // bw < 8 GROUP BY 1, 2, 3)"""
#: Surface of the first round, in closed form: on a full grid 1, y, x, xy, y2 - mean and x2 - mean are orthogonal.
SURF = f"""{FLOOR}, cf AS (SELECT *, (i - 2.5) / 2.5 AS yn, (j - 3.5) / 3.5 AS xn FROM fl), av AS (SELECT frame_id, avg(yn * yn) AS qy, avg(xn * xn) AS qx FROM cf GROUP BY 1),
ft AS (SELECT frame_id, any_value(qy) AS qy, any_value(qx) AS qx, avg(b0) AS k0, sum(b0 * yn) / sum(yn * yn) AS ky, sum(b0 * xn) / sum(xn * xn) AS kx, sum(b0 * xn * yn) / sum(xn * yn * xn * yn) AS kxy,
 sum(b0 * (yn * yn - qy)) / sum((yn * yn - qy) * (yn * yn - qy)) AS kyy, sum(b0 * (xn * xn - qx)) / sum((xn * xn - qx) * (xn * xn - qx)) AS kxx FROM cf JOIN av USING (frame_id) GROUP BY 1),
sf AS (SELECT cf.*, k0 + ky * yn + kx * xn + kxy * xn * yn + kyy * (yn * yn - qy) + kxx * (xn * xn - qx) AS surface, sqrt(yn * yn + xn * xn) / sqrt(2.0::DOUBLE) AS r FROM cf JOIN ft USING (frame_id)), lv AS (SELECT frame_id, CASE WHEN {upper('surface')} = 0 THEN 1e-6 ELSE {upper('surface')} END AS bg FROM sf GROUP BY 1)"""


def _floor(spark: SparkSession, sf: str) -> DataFrame:
    return background.cell_floor(pixels.luma(b.rgb_pixels(spark, sf)), BR, BC, min_side=30)


@query("bg_cell_floor", f"{FLOOR} SELECT frame_id, i, j, round(b0, 6) AS b0 FROM fl")
def bg_cell_floor(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_floor(spark, sf))


@query("bg_surface_fit")
def bg_surface_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(background.surface_fit(_floor(spark, sf), BR, BC))


@query("bg_surface_first", f"{SURF} SELECT frame_id, i, j, round(b0, 6) AS b0, round(surface, 6) AS surface FROM sf")
def bg_surface_first(spark: SparkSession, sf: str) -> DataFrame:
    """The surface of the first round, before cells are left out."""
    return rounded(_fitted(spark, sf))


def _fitted(spark: SparkSession, sf: str) -> DataFrame:
    return background.surface_fit(_floor(spark, sf), BR, BC, rounds=1)


@query("bg_radial_profile", f"""{SURF}, rg AS (SELECT frame_id, greatest(0, least(11, floor(round(r * 12, 9)))) AS k, count(*) AS n, {upper('surface')} AS med, stddev_pop(surface) AS sd FROM sf GROUP BY 1, 2 HAVING count(*) >= 3),
pr AS (SELECT frame_id, arg_min(med, k) AS a, arg_max(med, k) AS e, avg(sd) AS sd FROM rg GROUP BY 1)
SELECT lv.frame_id, round(bg, 6) AS bg_median, round(CASE WHEN coalesce(a, bg) <> 0 THEN (coalesce(a, bg) - coalesce(e, bg)) / coalesce(a, bg) ELSE 0 END, 6) AS radial_drop, round(coalesce(sd, 0) / (abs(bg) + 1e-9), 6) AS azim_aniso FROM lv LEFT JOIN pr USING (frame_id)""")
def bg_radial_profile(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(background.radial_profile(_fitted(spark, sf), BR, BC))


@query("bg_radial_fit", f"""{SURF}, u AS (SELECT frame_id, surface AS v, r * r AS u FROM sf), s AS (SELECT frame_id, count(*)::DOUBLE AS n, sum(u) AS a, sum(u * u) AS b2, sum(u * u * u) AS c3, sum(u * u * u * u) AS d4, sum(v) AS p, sum(u * v) AS q, sum(u * u * v) AS w FROM u GROUP BY 1),
k AS (SELECT *, n * (b2 * d4 - c3 * c3) - a * (a * d4 - c3 * b2) + b2 * (a * c3 - b2 * b2) AS det FROM s),
co AS (SELECT frame_id, (p * (b2 * d4 - c3 * c3) - a * (q * d4 - c3 * w) + b2 * (q * c3 - b2 * w)) / det AS c0, (n * (q * d4 - c3 * w) - p * (a * d4 - c3 * b2) + b2 * (a * w - q * b2)) / det AS c1, (n * (b2 * w - q * c3) - a * (a * w - q * b2) + p * (a * c3 - b2 * b2)) / det AS c2 FROM k)
SELECT u.frame_id, round(1 - sum((v - c0 - c1 * u - c2 * u * u) * (v - c0 - c1 * u - c2 * u * u)) / CASE WHEN sum((v - bg) * (v - bg)) > 0 THEN sum((v - bg) * (v - bg)) ELSE 1e-12 END, 5) AS radial_r2 FROM u JOIN co USING (frame_id) JOIN lv USING (frame_id) GROUP BY 1""")
def bg_radial_fit(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(background.radial_fit(_fitted(spark, sf), BR, BC), 5)


@query("bg_plane_fit", f"""{SURF}, m AS (SELECT frame_id, sum(xn * surface) / sum(xn * xn) AS a, sum(yn * surface) / sum(yn * yn) AS e, avg(surface) AS c FROM sf GROUP BY 1)
SELECT sf.frame_id, round(any_value(2 * (abs(a) + abs(e)) / bg), 6) AS amplitude, round(any_value(CASE WHEN degrees(atan2(e, a)) < 0 THEN degrees(atan2(e, a)) + 360 ELSE degrees(atan2(e, a)) END), 5) AS direction,
 round(1 - sum((surface - a * xn - e * yn - c) * (surface - a * xn - e * yn - c)) / CASE WHEN sum((surface - bg) * (surface - bg)) > 0 THEN sum((surface - bg) * (surface - bg)) ELSE 1e-12 END, 6) AS plane_r2 FROM sf JOIN m USING (frame_id) JOIN lv USING (frame_id) GROUP BY 1""")
def bg_plane_fit(spark: SparkSession, sf: str) -> DataFrame:
    p = background.plane_fit(_fitted(spark, sf), BR, BC)
    return p.select("frame_id", F.round("amplitude", 6).alias("amplitude"), F.round("direction", 5).alias("direction"), F.round("plane_r2", 6).alias("plane_r2"))


@query("bg_corners", f"""{SURF}, rs AS (SELECT sf.*, b0 - surface AS resid FROM sf), md AS (SELECT frame_id, {upper('resid')} AS m FROM rs GROUP BY 1), sg AS (SELECT rs.frame_id, 1.4826::DOUBLE * {upper('abs(resid - m)')} AS sg FROM rs JOIN md USING (frame_id) GROUP BY 1),
cn AS (SELECT rs.*, c FROM rs, (VALUES (0), (1), (2), (3)) t(c) WHERE (c IN (0, 1) AND i <= 1 OR c IN (2, 3) AND i >= 4) AND (c IN (0, 2) AND j <= 1 OR c IN (1, 3) AND j >= 6)),
pc AS (SELECT frame_id, c, {upper('resid')} AS resid, {upper('surface')} AS lev FROM cn GROUP BY 1, 2)
SELECT pc.frame_id, round(max(resid / CASE WHEN sg > 0 THEN sg ELSE 1e-9 END), 6) AS corner_excess, round(stddev_pop(lev) / (abs(avg(lev)) + 1e-9), 6) AS corner_asymmetry FROM pc JOIN sg USING (frame_id) GROUP BY 1""")
def bg_corners(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(background.corners(_fitted(spark, sf), BR, BC))


@query("bg_heatmap", f"""{SURF}, q AS (SELECT frame_id, list_sort(list(surface)) AS v FROM sf GROUP BY 1), w AS (SELECT frame_id, v[CAST(floor(0.02::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] AS lo, v[CAST(floor(0.98::DOUBLE * (len(v) - 1)) AS BIGINT) + 1] AS hi FROM q)
SELECT sf.frame_id, i, j, round(greatest(0, least(1, (surface - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1 END)), 6) AS heat FROM sf JOIN w USING (frame_id)""")
def bg_heatmap(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(background.heatmap(_fitted(spark, sf)))


# Point spread on the star binding: small zones (cut 5), so 50-pixel frames have some.
ZONES = f"""WITH {b.MONO}, z AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h, max(r) AS top FROM pixels GROUP BY 1), s AS (SELECT *, greatest(10, CAST(floor(0.2::DOUBLE * least(w, h)) AS BIGINT)) AS sr, CAST(floor(0.03::DOUBLE * least(w, h)) AS BIGINT) AS m FROM z),
g AS (SELECT s.*, gy, gx FROM s, (SELECT unnest(range(3)) AS gy) a, (SELECT unnest(range(3)) AS gx) e),
c AS (SELECT *, CASE WHEN h - m - sr // 2 <= m + sr // 2 THEN h // 2 ELSE m + sr // 2 + gy * (h - m - sr // 2 - m - sr // 2) // 2 END AS cy, CASE WHEN w - m - sr // 2 <= m + sr // 2 THEN w // 2 ELSE m + sr // 2 + gx * (w - m - sr // 2 - m - sr // 2) // 2 END AS cx FROM g),
bx AS (SELECT frame_id, gy, gx, cy, cx, greatest(0, least(cy - sr // 2, h - sr)) AS y0, greatest(0, least(cx - sr // 2, w - sr)) AS x0, least(sr, w) AS rw, least(sr, h) AS rh, w, h, top FROM c),
zp AS (SELECT bx.frame_id, gy, gx, y - y0 AS zy, x - x0 AS zx, r AS luma, rh, rw, top FROM pixels p JOIN bx ON bx.frame_id = p.frame_id AND y >= y0 AND y < y0 + rh AND x >= x0 AND x < x0 + rw)"""
HIGH = f"""{ZONES}, bl AS (SELECT *, least(zy // greatest(rh // 4, 1), greatest(rh // greatest(rh // 4, 1) - 1, 0)) AS by_, least(zx // greatest(rw // 4, 1), greatest(rw // greatest(rw // 4, 1) - 1, 0)) AS bx_ FROM zp),
hp AS (SELECT *, greatest(0, luma - avg(luma) OVER (PARTITION BY frame_id, gy, gx, by_, bx_)) AS hp FROM bl)"""


def _zones(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    px = _mono(spark, sf)
    return px, psf.zones(px, 3, cut=5)


@query("psf_zones_assign", f"{ZONES} SELECT frame_id, gy, gx, count(*) AS n, round(sum(luma), 6) AS total, min(zy * 100 + zx) AS first_at, max(zy * 100 + zx) AS last_at FROM zp GROUP BY 1, 2, 3")
def psf_zones_assign(spark: SparkSession, sf: str) -> DataFrame:
    at = F.col("zy") * 100 + F.col("zx")
    return rounded(psf.zone_pixels(*_zones(spark, sf)).groupBy("frame_id", "gy", "gx").agg(F.count("*").alias("n"), F.sum("luma").alias("total"), F.min(at).alias("first_at"), F.max(at).alias("last_at")))


@query("psf_highpass", f"{HIGH} SELECT frame_id, gy, gx, zy, zx, round(hp, 6) AS hp FROM hp")
def psf_highpass(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(psf.highpass(psf.zone_pixels(*_zones(spark, sf)), blocks=4).select("frame_id", "gy", "gx", "zy", "zx", "hp"))


@query("psf_candidates", f"""{HIGH}, md AS (SELECT frame_id, gy, gx, {upper('hp')} AS med FROM hp GROUP BY 1, 2, 3), sg AS (SELECT frame_id, gy, gx, any_value(med) AS med, 1.4826::DOUBLE * {upper('abs(hp - med)')} AS sig FROM hp JOIN md USING (frame_id, gy, gx) GROUP BY 1, 2, 3),
lm AS (SELECT a.frame_id, a.gy, a.gx, a.zy, a.zx, max(c.hp) AS m FROM hp a JOIN hp c ON c.frame_id = a.frame_id AND c.gy = a.gy AND c.gx = a.gx AND c.zy BETWEEN a.zy - 3 AND a.zy + 3 AND c.zx BETWEEN a.zx - 3 AND a.zx + 3 GROUP BY 1, 2, 3, 4, 5)
SELECT hp.frame_id, hp.gy, hp.gx, hp.zy, hp.zx, round(hp, 6) AS hp FROM hp JOIN sg ON sg.frame_id = hp.frame_id AND sg.gy = hp.gy AND sg.gx = hp.gx JOIN lm ON lm.frame_id = hp.frame_id AND lm.gy = hp.gy AND lm.gx = hp.gx AND lm.zy = hp.zy AND lm.zx = hp.zx
WHERE hp > med + 1.5 * CASE WHEN sig > 0 THEN sig ELSE 1e-6 END AND luma < 0.92 * top AND hp.zy >= 1 AND hp.zx >= 1 AND hp.zy <= rh - 1 AND hp.zx <= rw - 1 AND hp >= m""")
def psf_candidates(spark: SparkSession, sf: str) -> DataFrame:
    hp = psf.highpass(psf.zone_pixels(*_zones(spark, sf)), blocks=4)
    return rounded(psf.candidates(hp, sigma=1.5, border=1).select("frame_id", "gy", "gx", "zy", "zx", "hp"))


#: Limits of the gate for event values, which are rather noise than stars: most candidates fail one of them.
LIMITS = {"snr": 2.0, "core": 0.02, "neighbours": 0.05, "fwhm": (0.5, 12.0)}


def _gated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    px, boxes = _zones(spark, sf)
    spots = psf.candidates(psf.highpass(psf.zone_pixels(px, boxes), blocks=4), sigma=1.0, border=1)
    spots = spots.join(boxes.select("frame_id", "gy", "gx", "y0", "x0"), ["frame_id", "gy", "gx"]).select("frame_id", "gy", "gx", (F.col("zy") + F.col("y0")).alias("y"), (F.col("zx") + F.col("x0")).alias("x"))
    return px, boxes, psf.star_gate(px, spots, **LIMITS)


@query("psf_star_gate")
def psf_star_gate(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_gated(spark, sf)[2])


@query("psf_adaptive_moments")
def psf_adaptive_moments(spark: SparkSession, sf: str) -> DataFrame:
    px, _, found = _gated(spark, sf)
    return rounded(psf.measure(px, found, cut=11))


@query("psf_topk_spaced")
def psf_topk_spaced(spark: SparkSession, sf: str) -> DataFrame:
    px, _, found = _gated(spark, sf)
    return rounded(psf.topk_spaced(psf.measure(px, found, cut=11), nstar=2, least=4.0))


@query("psf_zone_summary", f"""{ZONES}, sr AS (SELECT frame_id, y, x, 1 + r / 100 AS elong, r % 1 AS ecc, (r % 3) - 1.5 AS pa, y * 3 // 50 AS gy, x * 3 // 50 AS gx FROM pixels),
sz AS (SELECT frame_id, gy, gx, count(*) AS n, {upper('elong')} AS elong, {upper('ecc')} AS ecc, 0.5 * atan2(avg(sin(2 * pa)), avg(cos(2 * pa))) AS pa FROM sr GROUP BY 1, 2, 3),
zz AS (SELECT bx.frame_id, bx.gy, bx.gx, n, elong, ecc, pa, abs(fmod(abs(pa - atan2(cy - h / 2.0::DOUBLE, cx - w / 2.0::DOUBLE) + pi() / 2), pi()) - pi() / 2) AS d FROM bx LEFT JOIN sz ON sz.frame_id = bx.frame_id AND sz.gy = bx.gy AND sz.gx = bx.gx)
SELECT frame_id, gy, gx, coalesce(n, 0) AS n, round(coalesce(elong, 0), 6) AS elong, round(coalesce(ecc, 0), 6) AS ecc, round(coalesce(pa, 0), 6) AS pa, CASE WHEN n IS NULL THEN 'none' WHEN gy = 1 AND gx = 1 THEN 'ref' WHEN d < radians(25) THEN 'radial' WHEN d > radians(65) THEN 'tangential' ELSE 'oblique' END AS axis FROM zz""")
def psf_zone_summary(spark: SparkSession, sf: str) -> DataFrame:
    px, boxes = _zones(spark, sf)
    v = F.col("luma")
    made = px.select("frame_id", F.floor(F.col("y") * 3 / 50).alias("gy"), F.floor(F.col("x") * 3 / 50).alias("gx"), (1 + v / 100).alias("elong"), (v % 1).alias("ecc"), (v % 3 - 1.5).alias("pa"))
    return rounded(psf.zone_summary(made, boxes))


@query("psf_zone_summary_stars")
def psf_zone_summary_stars(spark: SparkSession, sf: str) -> DataFrame:
    """Zone summary of the stars of psf_topk_spaced; no SQL form, as the moments have none."""
    px, boxes, found = _gated(spark, sf)
    return rounded(psf.zone_summary(psf.topk_spaced(psf.measure(px, found, cut=11), 2, 4.0), boxes))
