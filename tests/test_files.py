"""From bytes to result rows, and measurements against plain brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions.mosaic import balanced, demosaic
from framequarry.functions.text import general
from framequarry.operators import analysis, background, pixels, psf, results, tilework
from framequarry.sources import frames, headers
from framequarry.streaming import ingest

from . import fields


def test_general_numbers(spark):
    values = [0.0, 1.0, -1.0, 0.1234567, 1234567.0, 1310685.0, 1310695.0, 999999.5, 999999.4, 0.00003125, 0.000123456789, 123.4567, 100000.0, 1e6, 1e-300, 6.02214076e23, -2.5e-7, 65535.0, 1 / 3, float("nan"), float("inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(general(F.col("v"))).collect()]
    assert got == [f"{v:g}" for v in values]
    assert spark.range(1).select(general(F.lit(None).cast("double"))).first()[0] is None


def image(pix, cards=(), **options):
    return fields.fits(pix, cards, **options)


def test_all_cards_of_the_first_image_unit(spark):
    card = lambda s: s.ljust(80)
    block = lambda *c: "".join(map(card, [*c, "END"])).ljust(2880).encode()
    primary = block("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0", "COMMENT  of the primary")
    table = block("XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                    4", "NAXIS2  =                    3", "PCOUNT  =                    5", "GCOUNT  =                    1") + bytes(2880)
    ext = image(np.arange(6.0).reshape(2, 3), [("OBJECT", "'M 42'")]).replace(b"SIMPLE  =                    T", b"XTENSION= 'IMAGE   '          ")
    many = [(f"KEY{i}", str(i)) for i in range(700)]
    files = [("plain", image(np.ones((2, 2)), [("HISTORY", "x"), ("GAIN", "7 / e")])), ("ext", primary + table + ext), ("none", primary), ("long", image(np.ones((2, 2)), many)), ("cut", image(np.ones((2, 2)), many)[:40000]), ("empty", b""), ("null", None)]
    df = spark.createDataFrame(files, "frame_id string, content binary")
    rows = {}
    for c in frames.fits_cards(frames.image_units(df)).orderBy("frame_id", "card_idx").collect():
        rows.setdefault(c.frame_id, []).append(c)
    assert [c.key for c in rows["ext"]] == ["XTENSION", "BITPIX", "NAXIS", "NAXIS1", "NAXIS2", "OBJECT"] and rows["ext"][5].value == "M 42"
    assert (rows["none"][3].key, rows["none"][3].value, rows["none"][3].comment) == ("COMMENT", "", " of the primary")
    assert {c.key: (c.value, c.comment) for c in rows["plain"]}["GAIN"] == ("7", "e")
    assert len(rows["long"]) == 705 and rows["long"][-1].key == "KEY699" and len(rows["cut"]) == 500 and {"empty", "null"}.isdisjoint(rows)
    sizes = {r.frame_id: (r.width, r.height) for r in frames.frame_sizes(frames.fits_cards(frames.image_units(df))).collect()}
    assert sizes["ext"] == (3, 2) and sizes["none"] == (None, None)
    cat = {r.frame_id: r for r in headers.catalog(frames.fits_cards(frames.image_units(df)), frames.frame_sizes(frames.fits_cards(frames.image_units(df)))).collect()}
    assert cat["ext"].dimensions == "3 x 2" and cat["ext"].object == "M 42" and cat["none"].dimensions == "0 x 0"
    decoded = {r.path: r for r in frames.tiles(df.withColumnRenamed("frame_id", "path")).collect()}
    assert list(decoded["ext"].r) == list(range(6)) and decoded["none"].error == "no image"


def test_mosaic_frames_are_demosaiced_before_they_are_turned(spark):
    y, x = np.mgrid[:6, :8]
    native = np.where((y % 2 == 0) & (x % 2 == 0), 100.0, np.where((y % 2 == 1) & (x % 2 == 1), 50.0, 200.0)) + y * 10
    files = [(p, image(native[::-1], [("BAYERPAT", f"'{v}'"), *more])) for p, v, more in (("a", "RGGB", ()), ("b", "gbrg", [("YBAYROFF", "-1")]), ("c", "XXXX", ()))]
    for r in frames.tiles(spark.createDataFrame(files, "path string, content binary")).collect():
        if r.path == "c":
            assert r.channels == 1
            continue
        want = balanced(demosaic(native.astype(np.float32), "RGGB"))[:, ::-1]
        assert r.channels == 3 and all(np.allclose(np.array(g).reshape(6, 8), w) for g, w in zip((r.r, r.g, r.b), want, strict=True))


def plain_demosaic(cfa, pattern, dx, dy):
    h, w = cfa.shape
    at = lambda y, x: pattern[(y + dy) % 2 * 2 + (x + dx) % 2]
    out = {}
    for y in range(h):
        for x in range(w):
            for c in "RGB":
                near = [cfa[j, i] for j in range(max(0, y - 1), min(h, y + 2)) for i in range(max(0, x - 1), min(w, x + 2)) if (j, i) != (y, x) and at(j, i) == c]
                out[y, x, c] = cfa[y, x] if at(y, x) == c or not near else sum(near) / len(near)
    return out


@pytest.mark.parametrize("shape", [(7, 9), (5, 1), (1, 1)])
def test_demosaic_in_tiles(spark, shape):
    img = np.random.default_rng(0).uniform(0, 1000, shape)
    got = pixels.debayer(fields.pixels(spark, img), "GRBG", 1, 0, tile=3).collect()
    want = plain_demosaic(img, "GRBG", 1, 0)
    assert len(got) == img.size and all(abs(r[c.lower()] - want[r.y, r.x, c]) < 1e-9 for r in got for c in "RGB")


def test_colour_thumbnails_are_stretched_by_channel(spark):
    px = fields.pixels(spark, np.random.default_rng(1).uniform(0, 900, (20, 30))).withColumn("g", F.col("r") * 0.5).withColumn("b", 900 - F.col("r"))
    params = spark.createDataFrame([(0, 0.1, 0.9, 0.3)], "frame_id long, shadows double, highlights double, midtone double")
    r = pixels.source_range(px).first()
    means = {(t.oy, t.ox): t for t in pixels.thumbnail(px, 6, 6).collect()}
    for t in pixels.rendered_thumbnail(px, params, 6, 6).collect():
        for c, v in (("r8", "v"), ("g8", "g"), ("b8", "b")):
            i = min(4095, max(0, math.floor((means[t.oy, t.ox][v] - r.src_min) * 4096 / (r.src_max - r.src_min))))
            n = min(1, max(0, ((i + 0.5) / 4096 - 0.1) / 0.8))
            assert t[c] == math.floor((0 if n <= 0 else 1 if n >= 1 else (0.3 - 1) * n / ((2 * 0.3 - 1) * n - 0.3)) * 255 + 0.5)


def test_star_stamps(spark):
    img = np.random.default_rng(2).uniform(0, 100, (40, 35))
    c = spark.createDataFrame([(0, 1, 3.0, 3.0), (0, 2, 20.0, 17.0), (0, 3, 39.0, 34.0)], "frame_id long, star int, y double, x double")
    for r in pixels.normalise_stamps(pixels.stamps(fields.pixels(spark, img), c, 29)).collect():
        a = img[r.y0 : r.y0 + 29, r.x0 : r.x0 + 29].ravel()
        assert (r.y0, r.x0) == {1: (0, 0), 2: (6, 3), 3: (11, 6)}[r.star]
        a = np.maximum(0, a - np.sort(a)[len(a) // 2])
        p = max(np.sort(a)[int(0.995 * (len(a) - 1))], 1e-6)
        assert np.allclose(r["values"], np.clip(np.arcsinh(a / (p * 0.15)) / np.arcsinh(1 / 0.15), 0, 1))


def plain_moments(s):
    """Adaptive moments of one stamp, pixel by pixel."""
    side = len(s)
    grid = [(y, x) for y in range(side) for x in range(side)]
    total = sum(s[y][x] for y, x in grid)
    if total <= 0:
        return None
    x0, y0 = sum(s[y][x] * x for y, x in grid) / total, sum(s[y][x] * y for y, x in grid) / total
    xx, yy, xy = 2.0, 2.0, 0.0
    for _ in range(12):
        det = xx * yy - xy * xy
        if det <= 1e-6:
            return None
        w = {(y, x): s[y][x] * math.exp(-0.5 * (yy * (x - x0) ** 2 - 2 * xy * (x - x0) * (y - y0) + xx * (y - y0) ** 2) / (2 * det)) for y, x in grid}
        t = sum(w.values())
        if t <= 0:
            return None
        x0, y0 = sum(v * x for (_, x), v in w.items()) / t, sum(v * y for (y, _), v in w.items()) / t
        new = [sum(v * (x - x0) ** 2 for (_, x), v in w.items()) / t, sum(v * (y - y0) ** 2 for (y, _), v in w.items()) / t, sum(v * (x - x0) * (y - y0) for (y, x), v in w.items()) / t]
        moved = abs(new[0] - xx) + abs(new[1] - yy) + abs(new[2] - xy)
        xx, yy, xy = new
        if moved < 1e-3:
            break
    half, root = (xx + yy) / 2, math.sqrt(max(0, ((xx - yy) / 2) ** 2 + xy * xy))
    l1, l2 = half + root, max(half - root, 1e-6)
    return None if l1 <= 0 else {"fwhm": 2.3548 * math.sqrt((l1 + l2) / 2), "elong": math.sqrt(l1 / l2), "ecc": math.sqrt(max(0, 1 - l2 / l1)), "pa": 0.5 * math.atan2(2 * xy, xx - yy)}


def plain_gate(v, snr=15.0, core=0.12, neighbours=0.35, fwhm=(1.4, 12.0)):
    ring = sorted(v[y][x] for y in range(19) for x in range(19) if 6 <= math.hypot(y - 9, x - 9) <= 8.5)
    bg = ring[len(ring) // 2]
    dev = sorted(abs(a - bg) for a in ring)
    noise = 1.4826 * dev[len(dev) // 2] or 1e-6
    u = [[a - bg for a in line] for line in v]
    peak, sub = u[9][9], [[max(0, a) for a in line] for line in u]
    total = sum(map(sum, sub))
    if peak <= 0 or peak / noise < snr or (u[8][9] + u[10][9] + u[9][8] + u[9][10]) / 4 < neighbours * peak or total <= 0:
        return None
    if sum(sub[y][x] for y in (8, 9, 10) for x in (8, 9, 10)) < core * total:
        return None
    m = plain_moments(sub)
    return None if m is None or not fwhm[0] <= m["fwhm"] <= fwhm[1] else peak / noise


def test_gate_and_moments_against_plain_loops():
    rng = np.random.default_rng(5)
    y, x = np.mgrid[:19, :19]
    stamps = []
    for k in range(60):  # round, elongated, hot pixels, flat and faint stamps
        sy, sx = rng.uniform(0.3, 4), rng.uniform(0.3, 4)
        spot = rng.choice([0, 50, 500, 5000]) * np.exp(-((y - 9 - rng.uniform(-0.5, 0.5)) ** 2 / (2 * sy**2) + (x - 9) ** 2 / (2 * sx**2)))
        stamps.append(spot + rng.normal(100, 5 if k % 9 else 0, (19, 19)))
    stamps = np.array(stamps)
    want, got = [plain_gate(s.tolist()) for s in stamps], psf.gate(stamps)
    assert 5 < sum(w is not None for w in want) < 55
    assert all((w is None) == bool(np.isnan(g)) and (w is None or abs(w - g) < 1e-6 * w) for w, g in zip(want, got, strict=True))
    sub = np.maximum(stamps - 100, 0)
    m = psf.adaptive(sub)
    for k, s in enumerate(sub):
        w = plain_moments(s.tolist())
        assert (w is not None) == bool(m["ok"][k]) and (w is None or all(abs(w[c] - m[c][k]) < 1e-6 * max(1, abs(w[c])) for c in w if c != "pa") and abs(math.sin(w["pa"] - m["pa"][k])) < 1e-6)


def test_stars_without_moments_take_no_place(spark):
    img, _ = fields.star_field(420, 420, 81, sigma=2.2, margin=22, dimmest=0.3)
    px = pixels.luma(fields.pixels(spark, img))
    spots = spark.createDataFrame([(0, 1, 1, y, x) for y, x in ((0, 5), (200, 200), (210, 120))], "frame_id long, gy long, gx long, y long, x long")
    scored = spots.withColumn("score", F.lit(99.0) - F.col("y") / 1000)
    measured = psf.measure(px.withColumn("luma", F.when(F.col("y") < 40, 7.0).otherwise(F.col("luma"))), scored)
    best = psf.topk_spaced(measured, 1).collect()
    assert measured.count() == 2 and [(r.y, r.x) for r in best] == [(200, 200)]  # the first has a flat stamp


def test_surface_fit_against_least_squares(spark):
    rng = np.random.default_rng(4)
    i, j = np.mgrid[:6, :8]
    b0 = 100 + 3 * i - 2 * j + 0.5 * i * j + rng.normal(0, 0.1, (6, 8))
    b0[2, 3] += 50
    got = {(r.i, r.j): r.surface for r in background.surface_fit(spark.createDataFrame([(0, int(a), int(c), float(b0[a, c])) for a in range(6) for c in range(8)], "frame_id long, i long, j long, b0 double"), 6, 8).collect()}
    y, x = ((i - 2.5) / 2.5).ravel(), ((j - 3.5) / 3.5).ravel()
    basis, v, keep = np.stack([y * 0 + 1, y, x, y * y, x * x, x * y], 1), b0.ravel(), np.ones(48, bool)
    for _ in range(5):
        pred = basis @ np.linalg.lstsq(basis[keep], v[keep], rcond=None)[0]
        res = (v - pred)[keep]
        sigma = 1.4826 * np.sort(np.abs(res - np.sort(res)[len(res) // 2]))[len(res) // 2]
        new = v - pred < 2.5 * sigma
        if new.sum() < 12 or (new == keep).all():
            break
        keep = new
    assert not keep[2 * 8 + 3] and all(abs(got[a, c] - pred[a * 8 + c]) < 1e-6 for a in range(6) for c in range(8))


def test_files_to_result_rows(spark, tmp_path):
    img, _ = fields.star_field(200, 160, 8)
    good = image(img)
    files = [("a", good), ("copy", good), ("cut", good[:9000]), ("empty", b""), ("x", fields.xisf(np.full((32, 24), 1234.0)))]
    df = results.content_key(spark.createDataFrame(files, "path string, content binary").withColumn("length", F.length("content").cast("long")))
    keyed = df.select("path", "cache_key", "content", "length")
    calls = []

    def analyse(todo):
        calls.append(todo.count())
        return analysis.analyse_files(todo)

    for _ in range(2):
        ingest.ingest_into(keyed, str(tmp_path / "t"), analyse)
    assert calls == [4, 0]
    rows = {r.path: r for r in spark.read.parquet(str(tmp_path / "t")).join(keyed.select("path", "cache_key"), "cache_key").collect()}
    assert rows["a"].star_count == 8 and rows["copy"].cache_key == rows["a"].cache_key and rows["a"].success
    assert rows["x"].pix_mean == 1234 and rows["x"].pix_min_count == 32 * 24 and rows["x"].star_count == 0
    assert not rows["cut"].success and rows["cut"].error == "truncated pixels" and rows["cut"].star_count is None and rows["empty"].error


def test_upsert_against_plain_rules(spark):
    rng = np.random.default_rng(6)
    schema = "cache_key string, schema_version int, computed_at long, v int"
    old = [(f"k{i}", int(rng.integers(1, 4)), int(rng.integers(0, 5)), i) for i in range(40)]
    new = [(f"k{int(rng.integers(20, 60))}", int(rng.integers(1, 4)), int(rng.integers(0, 5)), 100 + i) for i in range(50)]
    got = {r.cache_key: r for r in results.upsert(spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)).collect()}
    assert len(got) == len({r[0] for r in old + new})
    for k, r in got.items():
        assert (r.computed_at, r.schema_version) == max((x[2], x[1]) for x in old + new if x[0] == k)
        tied = [x[3] for x in new if x[0] == k and (x[2], x[1]) == (r.computed_at, r.schema_version)]
        assert not tied or r.v in tied


def test_natural_order_of_long_numbers(spark):
    names = ["a" + "9" * 25 + ".fit", "a1" + "0" * 25 + ".fit", "a007.fit", "a7b.fit", "a10.fit", "a.fit"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in results.natural_sort(df).collect()] == ["a.fit", "a007.fit", "a7b.fit", "a10.fit", "a" + "9" * 25 + ".fit", "a1" + "0" * 25 + ".fit"]


def test_tiles_and_pixels_give_the_same_analysis(spark):
    img, _ = fields.star_field(300, 260, 20)
    colour = np.stack([img, img * 0.7 + 5, img[::-1] * 0.4])
    df = spark.createDataFrame([("a", image(img)), ("b", fields.fits(colour)), ("c", image(np.full((70, 90), 3.0)))], "path string, content binary")
    tiles = frames.tiles(df, 128)
    px = frames.tile_pixels(tiles).select(F.col("path").alias("frame_id"), "y", "x", "r", "g", "b")
    for options in ({}, {"target": 5000}):
        rows, found = tilework.analyse(tiles, **options)
        got = {r.frame_id: r for r in rows.collect()}
        want, stars_of = analysis.analyse(px)
        want = {r.frame_id: r for r in want.collect()}
        assert got.keys() == want.keys() == {"a", "b", "c"}
        skip = {"pix_median", "pix_mad"} if options else set()
        assert all(got[f][c] == pytest.approx(want[f][c], rel=1e-9, abs=1e-9) for f in got for c in analysis.METRICS if c not in skip)
        assert found.count() == stars_of.count() > 20
    sampled = {r.frame_id: r for r in pixels.median_mad(pixels.luma(px), target=5000).collect()}
    assert all(got[f][c] == pytest.approx(sampled[f][c]) for f in got for c in ("pix_median", "pix_mad"))
