import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions import order_stats
from framequarry.operators import background, pixels, psf, results, stars, tilt
from framequarry.sources import frames, headers
from framequarry.streaming import ingest

from . import fields


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def test_upper_median_and_quartile(spark):
    for n in (1, 2, 3, 4, 7, 10):
        r = one(spark.range(n).selectExpr("cast(id as double) v").agg(order_stats.upper_median("v").alias("m"), order_stats.lower_quartile("v").alias("q")))
        assert r.m == n // 2 and r.q == (n - 1) // 4


def test_constant_frame(spark):
    px = pixels.luma(fields.pixels(spark, np.full((64, 64), 1000.0)))
    s, m = one(pixels.stats(px)), one(pixels.median_mad(px))
    assert (s.pix_stddev, s.pix_min, s.pix_min_count, s.pix_max_count) == (0, 1000, 4096, 4096)
    assert (m.pix_median, m.pix_mad) == (1000, 0)
    r = one(pixels.source_range(px))
    assert (r.src_min, r.src_max) == (0, 1)
    assert stars.detect(px).count() == 0


def test_ramp_and_stride(spark):
    px = pixels.luma(fields.pixels(spark, np.arange(1024.0).reshape(32, 32)))
    assert one(pixels.stats(px)).pix_max == 1023
    assert one(pixels.median_mad(px)).pix_median == 512
    assert pixels.strided(px, 100).count() == math.ceil(1024 / 10)


def test_stars_and_summary(spark):
    img, spots = fields.star_field(200, 160, 8)
    px = pixels.luma(fields.pixels(spark, img, np.full((40, 40), 5.0)))
    found = stars.detect(px).collect()
    assert len(found) == 8
    for y, x in spots:
        s = min(found, key=lambda s: (s.cy - y) ** 2 + (s.cx - x) ** 2)
        assert abs(s.cy - y) < 0.3 and abs(s.cx - x) < 0.3 and 2.5 < s.fwhm < 4.5 and s.ecc < 0.5
    rows = {r.frame_id: r for r in stars.summary(px.select("frame_id").distinct(), stars.detect(px)).collect()}
    assert rows[0].star_count == 8 and rows[1].star_count == 0 and rows[1].hfr_median == 0
    assert abs(rows[0].hfr_median - 1.5 * 1.1774) < 0.3


def test_components_join_diagonals(spark):
    rows = [(0, y, x, 1.0, 1.0, 1.0) for y, x in [(0, 0), (1, 1), (2, 0), (5, 5), (5, 6), (0, 9), (1, 0)]]
    df = spark.createDataFrame(rows, "frame_id long, y long, x long, luma double, residual double, noise double")
    got = {(r.y, r.x): r.label for r in stars.components(df).collect()}
    assert got[(0, 0)] == got[(1, 1)] == got[(2, 0)] == got[(1, 0)] == 0 and got[(5, 5)] == got[(5, 6)] == 5_000_005 and got[(0, 9)] == 9


def test_crowded_frames_have_the_same_components(spark):
    rng = np.random.default_rng(8)
    rows = [(f, int(y), int(x), 1.0, 1.0, 1.0) for f, share in ((0, 0.35), (1, 0.5), (2, 0.05)) for y, x in zip(*np.nonzero(rng.random((40, 50)) < share), strict=True)]
    df = spark.createDataFrame(rows, "frame_id long, y long, x long, luma double, residual double, noise double")
    want = sorted(tuple(r) for r in stars.components(df).collect())
    for most in (0, 500):
        assert sorted(tuple(r) for r in stars.components(df, most).collect()) == want


def test_tilt_takes_each_frame_by_its_size(spark):
    df = spark.createDataFrame([(1, 90.0, 90.0, 2.0, 0.1), (2, 90.0, 90.0, 3.0, 0.2)], "frame_id long, x double, y double, hfr double, ecc double")
    sizes = spark.createDataFrame([(1, 100, 100), (2, 1000, 400), (3, 10, 10)], "frame_id long, width int, height int")
    got = {(r.frame_id, r.gy, r.gx): r.n for r in tilt.cells(df, frames=sizes).collect()}
    assert len(got) == 27 and {k for k, n in got.items() if n} == {(1, 2, 2), (2, 0, 0)}


def test_tilt(spark):
    rows = [(0, 20.0 + i, 20.0, 2.0, 0.1) for i in range(5)] + [(0, 220.0 + i, 220.0, 5.0, 0.1) for i in range(5)]
    df = spark.createDataFrame(rows, "frame_id long, x double, y double, hfr double, ecc double")
    s = one(tilt.summary(tilt.cells(df, 300, 300)))
    assert (s.best_corner, s.worst_corner, s.tilt_pct) == (0, 3, 150.0)
    single = one(tilt.summary(tilt.cells(df.limit(1), 300, 300)))
    assert single.tilt_pct == 0 and single.best_corner == -1 and single.success


@pytest.mark.parametrize("rows,cols", [(3, 3), (2, 5)])
def test_rotation_is_a_permutation(spark, rows, cols):
    df = spark.createDataFrame([(y, x, y * 10 + x) for y in range(rows) for x in range(cols)], "gy long, gx long, v long")
    turned = tilt.rotate(df, rows, cols, 90)
    assert {(r.gy, r.gx) for r in turned.collect()} == {(y, x) for y in range(cols) for x in range(rows)}
    back = tilt.rotate(turned, cols, rows, 270)
    assert {tuple(r) for r in back.select("gy", "gx", "v").collect()} == {tuple(r) for r in df.collect()}


def test_background(spark):
    flat = pixels.luma(fields.pixels(spark, np.full((120, 150), 1000.0)))
    r = one(background.report(flat, 12, 15, min_side=100))
    assert abs(r.radial_drop) < 1e-9 and r.bg_median == pytest.approx(1000, rel=1e-12)  # the solver rounds as the machine's library does
    assert background.cell_floor(flat, 12, 15).count() == 0  # too small for the default
    y, x = np.mgrid[:120, :150]
    s = one(background.report(pixels.luma(fields.pixels(spark, 1000.0 + x)), 12, 15, min_side=100))
    assert abs(s.direction) < 1e-6 and s.plane_r2 > 0.99


def test_psf_plate(spark):
    img, _ = fields.star_field(420, 420, 81, sigma=2.2, margin=22, dimmest=0.3)
    found, zones = psf.plate(pixels.luma(fields.pixels(spark, img)))
    rows, z = found.collect(), zones.collect()
    assert len(z) == 9 and len(rows) >= 4
    assert all(r.score > 15 and 2.5 < r.fwhm < 6 for r in rows) and np.mean([r.elong for r in rows]) < 1.35
    assert {r.axis for r in z if (r.gy, r.gx) == (1, 1)} <= {"ref", "none"}


def test_debayer_constant_colours(spark):
    y, x = np.mgrid[:8, :8]
    img = np.where((y % 2 == 0) & (x % 2 == 0), 100.0, np.where((y % 2 == 1) & (x % 2 == 1), 50.0, 200.0))
    for r in pixels.debayer(fields.pixels(spark, img), "RGGB").collect():
        assert (r.r, r.g, r.b) == (100, 200, 50)


def test_gray_world_and_stretch(spark):
    df = spark.createDataFrame([(0, 0, i, 10.0, 40.0, 20.0) for i in range(64)] + [(1, 0, i, 0.0, 40.0, 20.0) for i in range(16)], "frame_id long, y long, x long, r double, g double, b double")
    got = {r.frame_id: r for r in pixels.gray_world(df).where("x = 0").collect()}
    assert abs(got[0].r - got[0].g) < 1e-9 and got[1].gain_g == 1
    x = np.linspace(0, 1, 11)
    for m in (0.05, 0.5, 0.95):
        v = [r[0] for r in spark.createDataFrame([(float(a),) for a in x], "x double").select(pixels.transfer(F.col("x"), F.lit(m))).collect()]
        assert v[0] == 0 and v[-1] == 1 and v == sorted(v)


def test_medians_of_all_pixels(spark):
    """Frames beyond the usual sample sizes: every other pixel is 0, and one frame has two values only."""
    i = F.col("id")
    px = spark.range(0, 900_000, 1, 4).select(F.floor(i / 450_000).alias("frame_id"), F.floor(i % 450_000 / 600).alias("y"), (i % 600).alias("x"), F.when(i % 2 == 0, 0.0).otherwise(F.when(i < 450_000, i % 450_000 + 1.0).otherwise(7.0)).alias("r"))
    want = {}
    for k in (0, 1):
        v = np.sort(np.where(np.arange(450_000) % 2 == 0, 0, np.arange(450_000) + 1.0 if k == 0 else 7.0))
        m = v[len(v) // 2]
        want[k] = (m, np.sort(np.abs(v - m))[len(v) // 2])
    assert {r.frame_id: (r.pix_median, r.pix_mad) for r in pixels.median_mad(px, "r").collect()} == want
    rgb = px.select("*", (F.col("r") + 3).alias("g"), (9 - F.col("r")).alias("b"))
    m = {r.frame_id: (r.r, r.g) for r in pixels.medians(rgb, "rgb").collect()}
    assert m == {k: (want[k][0], want[k][0] + 3) for k in want}
    assert {r.gain_r for r in pixels.gray_world(rgb).where("frame_id = 1").select("gain_r").distinct().collect()} == {min(5.0, max(0.2, (7 + 10 + 9) / 3 / 7))}


def test_thumbnail_small_frames_stay(spark):
    img = np.arange(12.0).reshape(3, 4)
    assert {(r.oy, r.ox): r.v for r in pixels.thumbnail(fields.pixels(spark, img), 8, 8).collect()} == {(y, x): img[y, x] for y in range(3) for x in range(4)}
    assert pixels.thumbnail(fields.pixels(spark, np.ones((20, 10))), 5, 5).count() == 5 * 3


def test_cutouts_and_stamps(spark):
    c = pixels.cutouts(fields.pixels(spark, np.arange(2500.0).reshape(50, 50)), 3, 16).collect()
    assert len(c) == 9 and all(r.n == 256 and len(r["values"]) == 256 for r in c)
    n = pixels.normalise_stamps(spark.createDataFrame([(1, [0.0, 1.0, 2.0, 50.0])], "id long, values array<double>"))
    v = one(n)["values"]
    assert min(v) == 0 and max(v) <= 1


def test_header_values(spark):
    df = spark.createDataFrame([("  'M 31  '  ",), ("  12.5 ",), ("''",), ("'",), (None,)], "v string")
    assert [r[0] for r in df.select(headers.trim_value(F.col("v"))).collect()] == ["M 31", "12.5", "", "'", None]
    d = spark.createDataFrame([("2024-02-30",), ("2024-01-02T03:04:05.678",), ("2024-01-02",), ("1500-01-01",), ("x",), ("2024-01-02T03",)], "v string")
    got = [str(r[0]) for r in d.select(headers.date_obs(F.col("v"))).collect()]
    assert got == ["None", "2024-01-02 03:04:05.678000", "2024-01-02 00:00:00", "None", "None", "2024-01-02 03:00:00"]


def test_fits_tiles_and_cards(spark):
    img = np.arange(16.0).reshape(4, 4)
    cube = np.stack([np.full((4, 5), v) for v in (1000.0, 2000.0, 3000.0)])
    whole = fields.fits(img, [("OBJECT", "'M 31    '"), ("EXPTIME", "30.5 / s")])
    files = [("a.fits", whole), ("b.fits", fields.fits(cube)), ("c.fits", b"garbage" * 900), ("d.fits", whole[:2890]), ("e.fits", b""), ("f.fits", None), ("g.xisf", fields.xisf(img)), ("h.xisf", fields.xisf(img, geometry="2000000000:2000000000:1")), ("i.xisf", fields.xisf(img, offset=2**63)), ("j.xisf", fields.xisf(cube))]
    df = spark.createDataFrame(files, "path string, content binary")
    rows = {}
    for r in frames.tiles(df, tile=2).collect():
        rows.setdefault(r.path, []).append(r)
    assert all(rows[p][0].error for p in ("c.fits", "d.fits", "e.fits", "f.fits", "h.xisf", "i.xisf"))
    for p in ("a.fits", "g.xisf"):
        back = np.zeros((4, 4))
        for t in rows[p]:
            back[t.y0 : t.y0 + t.h, t.x0 : t.x0 + t.w] = np.array(t.r).reshape(t.h, t.w)
        assert (back == img).all()
    assert {(t.r[0], t.g[0], t.b[0]) for p in ("b.fits", "j.xisf") for t in rows[p]} == {(1000.0, 2000.0, 3000.0)}
    px = frames.tile_pixels(frames.tiles(df.where("path = 'a.fits'"), tile=3))
    assert {(r.y, r.x): r.r for r in px.collect()} == {(y, x): img[y, x] for y in range(4) for x in range(4)}
    cards = frames.fits_cards(df.where("path in ('a.fits', 'd.fits')").selectExpr("path frame_id", "content")).collect()
    assert {(c.frame_id, c.key): c.value for c in cards}[("a.fits", "OBJECT")] == "M 31"
    assert {(c.frame_id, c.key): (c.value, c.comment) for c in cards}[("d.fits", "EXPTIME")] == ("30.5", "s")


def test_odd_cards(spark):
    """Doubled and open quotes, slashes in quotes, other characters than ASCII, nameless cards; END far behind, or never."""
    cards = ["A       = 'it''s  '  / why/not", "B       = 'open / end", "C       = '' / empty", "D       = 'a/b' x", "E       =  5 / caf\xe9", "F       = '/' /", "        = 1", "COMMENT said 'x' / y", "G       = 'v' /\t tab"]
    block = "".join(c.ljust(80) for c in cards)
    far = block + "".join(f"K{i:<7}= {i}".ljust(80) for i in range(500))
    end = "END".ljust(80)
    data = [(1, (block + end + "Z       = 1".ljust(80)).encode("latin-1")), (2, (far + end + far).encode("latin-1")), (3, far.encode("latin-1") + b"cut"), (4, b""), (5, None), (6, end.encode()), (7, b"short")]
    got = {}
    for r in frames.fits_cards(spark.createDataFrame(data, "frame_id long, content binary")).collect():
        got.setdefault(r.frame_id, []).append((r.card_idx, r.key, r.value, r.comment))
    want = [("A", "it's", "why/not"), ("B", "'open", "end"), ("C", "", "empty"), ("D", "'a", "b' x"), ("E", "5", "caf\xe9"), ("F", "/", ""), ("COMMENT", "", "said 'x' / y"), ("G", "v", "tab")]
    want = [(i, *c) for i, c in enumerate(want)]
    more = [(8 + i, f"K{i}", str(i), "") for i in range(500)]
    assert {k: sorted(v) for k, v in got.items()} == {1: want, 2: want + more, 3: want + more}


def test_odd_xisf_headers(spark):
    """Keywords without some attributes keep theirs together; a header that breaks off, or is no XISF, fails no job."""
    image = '<xisf xmlns="x"><Image geometry="3:2" location="l"><FITSKeyword name="A" comment="a"/><FITSKeyword name="B" value=" 1 "/></Image><Image geometry="9:9"><FITSKeyword name="C" value="2"/></Image></xisf>'
    file = lambda x: b"XISF0100" + len(x).to_bytes(4, "little") + bytes(4) + x.encode()
    f, c = frames.xisf_cards(spark.createDataFrame([(1, file(image)), (2, file(image[:150])), (3, b"SIMPLE  = T" * 9), (4, None)], "frame_id long, content binary"))
    assert {r.frame_id: (r.width, r.height, r.channels, r.location) for r in f.collect()} == {1: (3, 2, 1, "l"), 2: (3, 2, 1, "l")}
    assert sorted(map(tuple, c.collect())) == [(1, 0, "A", "", "a"), (1, 1, "B", "1", ""), (2, 0, "A", "", "a"), (2, 1, "B", "1", "")]


def test_xisf_cards_and_formats(spark):
    df = spark.createDataFrame([(1, fields.xisf(np.ones((2, 3)), keywords=[("GAIN", " 100 "), ("OBJECT", "'x '")]))], "frame_id long, content binary")
    f, c = frames.xisf_cards(df)
    assert tuple(one(f))[1:4] == (3, 2, 1)
    assert {r.key: r.value for r in c.collect()} == {"GAIN": "100", "OBJECT": "x"}
    lead = spark.createDataFrame([(b"II*\0ab",), (b"MM\0*",), (b"SIMPLE  =",), (b"XISF0100",), (b"I",)], "content binary")
    assert [r.format for r in frames.detect_format(lead).collect()] == ["raw", "raw", "fits", "xisf", "fits"]


def test_results_table(spark, tmp_path):
    files = spark.createDataFrame([("a", b"x" * 70000), ("b", b"x" * 70000), ("c", b"x" * 65536), ("d", b"y" + b"x" * 69999)], "name string, content binary").withColumn("length", F.length("content"))
    keys = {r.name: r.cache_key for r in results.content_key(files).collect()}
    assert keys["a"] == keys["b"] and len(set(keys.values())) == 3
    schema = "cache_key string, schema_version int, computed_at long, hfr_median double"
    old = spark.createDataFrame([("k1", 3, 1, 2.0), ("k2", 2, 1, 3.0)], schema)
    new = spark.createDataFrame([("k1", 3, 2, 9.0), ("k3", 3, 1, 1.0)], schema)
    assert {r.cache_key: r.hfr_median for r in results.upsert(old, new).collect()} == {"k1": 9.0, "k2": 3.0, "k3": 1.0}
    assert {r.cache_key for r in results.misses(new.select("cache_key"), old).collect()} == {"k3"}
    results.save(results.upsert(old, new), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 3


def test_natural_order(spark):
    names = ["img10.fit", "Img2.fit", "img1.fit", "b.fit"]
    df = spark.createDataFrame([("d", n) for n in names], "dir string, name string")
    assert [r.name for r in results.natural_sort(df).collect()] == ["b.fit", "img1.fit", "Img2.fit", "img10.fit"]
    nav = {r.name: (r.prev_name, r.next_name) for r in results.neighbours(df).collect()}
    assert nav["b.fit"] == ("img10.fit", "img1.fit") and nav["img10.fit"] == ("Img2.fit", "b.fit")


def test_stream_is_idempotent(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("a",), ("b",), ("a",)], "cache_key string").coalesce(1).write.parquet(src)
    analyse = lambda todo: todo.select("cache_key", F.lit(3).alias("schema_version"), F.lit(0).alias("computed_at"))
    for _ in range(2):
        q = ingest.stream_into(spark.readStream.schema("cache_key string").parquet(src), spark, str(tmp_path / "t"), str(tmp_path / "c"), analyse)
        q.awaitTermination()
    assert sorted(r.cache_key for r in spark.read.parquet(str(tmp_path / "t")).collect()) == ["a", "b"]
