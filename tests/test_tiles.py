"""Tile tables and reductions of tiles against the operators on pixel rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.functions.store import materialize
from framequarry.operators import analysis, background, pixels, psf, stars, tilereduce, tiletable, tilework, tilt
from framequarry.operators.results import content_key
from framequarry.sources import blocks, frames

from . import fields


def frame_files():
    img, _ = fields.star_field(300, 260, 20)
    rng = np.random.default_rng(3)
    return [("a", fields.fits(img)), ("b", fields.fits(np.stack([img, img * 0.7 + 5, img[::-1] * 0.4]))), ("c", fields.fits(np.full((70, 90), 3.0))), ("d", fields.fits(rng.integers(0, 40, (131, 77)) - 20, (), 16)), ("bad", b"x" * 3000)]


@pytest.fixture(scope="module")
def tiles(spark):
    df = spark.createDataFrame(frame_files(), "path string, content binary").repartition(3)
    return tilework.materialize(frames.tiles(df, 64), "tiles")


@pytest.fixture(scope="module")
def px(tiles):
    return frames.tile_pixels(tiles).select(F.col("path").alias("frame_id"), "y", "x", "r", "g", "b")


def close(got, want, keys, values):
    g, w = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert g.keys() == w.keys() and g
    for k in w:
        assert all(g[k][c] == pytest.approx(w[k][c], rel=1e-6, abs=1e-6) for c in values), (k, g[k], w[k])


def test_order_of_keys():
    v = np.array([-np.inf, -3e38, -2.5, -1e-40, -0.0, 0.0, 1e-40, 1.0, 1.0000001, 7e30, np.inf])
    k = tilereduce.order_key(v)
    assert (np.diff(k) >= 0).all() and k[4] == k[5] and len(set(k.tolist())) == len(v) - 1


def test_exact_statistics_from_value_counts(spark, tiles, px):
    counts = tilework.materialize(tilereduce.value_counts(tiles), "counts")
    luma = pixels.luma(px).withColumn("luma", F.col("luma").cast("float").cast("double"))
    close(tilereduce.statistics(counts), pixels.stats(luma).join(pixels.median_mad(luma, target=10**9).withColumn("pix_mad", F.col("pix_mad").cast("float").cast("double")), "frame_id"), ["frame_id"], ["pix_mean", "pix_stddev", "pix_median", "pix_mad", "pix_min", "pix_min_count", "pix_max", "pix_max_count"])
    assert counts.groupBy("frame_id").agg(F.sum("n")).where("frame_id = 'd'").first()[1] == 131 * 77 and counts.where("frame_id = 'd'").count() == 40
    close(tilereduce.source_range(tiles), pixels.source_range(px), ["frame_id"], ["src_min", "src_max"])
    first = tilereduce.value_counts(tiles, "r")
    close(tilereduce.histogram(first, tilereduce.source_range(tiles)), pixels.histogram(px), ["frame_id", "bin"], ["n", "log_n", "rel"])


def test_counts_shuffled_are_distinct_values(spark, monkeypatch):
    """Four megapixels of 12 bits: a task hands on each value once."""
    img = np.random.default_rng(1).integers(0, 4096, (2048, 2048)) - 2048
    t = frames.tiles(spark.createDataFrame([("big", fields.fits(img, [("BZERO", "2048")], 16))], "path string, content binary"), 256)
    counts = tilework.materialize(tilereduce.value_counts(t), "counts")
    assert counts.count() == 4096
    r = tilereduce.statistics(counts).first()
    v = np.sort(img + 2048, axis=None)
    dev = np.sort(np.abs(v - v[len(v) // 2]))
    assert (r.pix_median, r.pix_mad, r.pix_min, r.pix_max) == (v[len(v) // 2], dev[len(v) // 2], 0, 4095) and r.pix_stddev == pytest.approx(v.std(ddof=1))
    monkeypatch.setattr(tilereduce, "HELD", 3000)  # handed on in parts
    assert tilereduce.value_counts(t).count() == 4096 and tilereduce.value_counts(t).agg(F.sum("n")).first()[0] == img.size


@pytest.mark.parametrize("grid", [(7, 11), (48, 72), (3, 2)])
def test_cell_floors_of_tiles(tiles, px, grid):
    """Cells that straddle two or four tiles, and frames whose sizes are no multiples of anything."""
    close(tilereduce.cell_floor(tiles, *grid, min_side=60), background.cell_floor(pixels.luma(px), *grid, min_side=60), ["frame_id", "i", "j"], ["b0"])
    assert tilereduce.cell_floor(tiles, *grid).collect() == []


@pytest.mark.parametrize("box", [(16, 12), (100, 9), (500, 500), (1, 1)])
def test_thumbnails_of_tiles(spark, tiles, px, box):
    close(tilereduce.thumbnail(tiles, *box).withColumn("g", F.coalesce("g", F.lit(0.0))), pixels.thumbnail(px, *box).withColumn("g", F.coalesce("g", F.lit(0.0))), ["frame_id", "oy", "ox"], ["v", "g"])
    params = pixels.auto_stretch(px)
    if box == (16, 12):
        colour = px.where("frame_id = 'b'")
        got = {(r.oy, r.ox): (r.v8, r.g8, r.b8) for r in tilereduce.rendered_thumbnail(tiles, params, *box).where("frame_id = 'b'").collect()}
        assert got == {(r.oy, r.ox): (r.r8, r.g8, r.b8) for r in pixels.rendered_thumbnail(colour, params, *box).collect()}


@pytest.mark.parametrize("share", [0.02, 0.3, 0.45, 0.7])
def test_labels_across_tile_borders(spark, share):
    """Random masks, spirals included at the higher shares: labels of tiles joined along borders are those of whole frames."""
    rng = np.random.default_rng(int(share * 100))
    masks = {f"f{i}": rng.random((50 + 13 * i, 61)) < share for i in range(3)}
    side, rows = 16, []
    for f, m in masks.items():
        for y0 in range(0, m.shape[0], side):
            for x0 in range(0, m.shape[1], side):
                y, x = np.nonzero(m[y0 : y0 + side, x0 : x0 + side])
                if len(y):
                    pdf = stars._label(stars.pd.DataFrame({"y": y + y0, "x": x + x0}))
                    rows += [(f, int(a), int(b), int(c), bool(a in (y0, y0 + side - 1) or b in (x0, x0 + side - 1))) for a, b, c in pdf[["y", "x", "label"]].itertuples(index=False)]
    labelled = spark.createDataFrame(rows, "frame_id string, y long, x long, label long, edge boolean")
    got = sorted(map(tuple, stars.joined_labels(labelled).select("frame_id", "y", "x", "label").collect()))
    assert got == sorted(map(tuple, stars.components(labelled.select("frame_id", "y", "x")).select("frame_id", "y", "x", "label").collect()))
    assert len({r[:1] + r[3:] for r in got}) > 3


def test_tiles_stay_in_their_buckets(spark, tiles, monkeypatch):
    """Bands of one tile: the mesh comes to the tiles, which are not moved, and the analysis is that of loose tiles."""
    monkeypatch.setattr(tiletable, "BAND", 64)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = tiletable.write(tiles, 64)
        mesh = tilework.materialize(stars.mesh_smooth(tilework.reduced(table.tiles, 64, 1000).select("frame_id", F.inline("cells"))), "mesh")
        plan = tilework.above(table.tiles, mesh, 64, 4.0, table.band, stay=True)
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        beside = text[text.index("ShuffledHashJoin [path") : text.index("FileScan parquet spark_catalog")]
        assert "Exchange" not in beside and not [line for line in text.splitlines() if "Exchange" in line and "error#" in line]
        assert table.tiles.select("band").distinct().count() > 4
        rows, found = tilework.analyse(table)
        loose, loose_found = tilework.analyse(tiles)
        names = analysis.METRICS
        close(rows, loose, ["frame_id"], names)
        assert found.count() == loose_found.count() > 20
        table.drop()
        assert not spark.catalog.tableExists(table.name)
        with pytest.raises(ValueError):
            tilework.analyse(tiles, 48)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_files_to_rows_by_ranges(spark, tmp_path):
    """Headers with keys to result rows: copies read once, the rows of ``analyse_files``, and no exchange carries pixels or bytes."""
    files = [*frame_files(), ("copy", frame_files()[0][1])]
    for name, content in files:
        (tmp_path / f"{name}.fits").write_bytes(content)
    headers = blocks.read_headers(spark, str(tmp_path), ["path", "length", "format", "content", "data_at", "error", "cache_key"])
    got = analysis.analyse_headers(headers, tile=64, computed_at=0)
    df = spark.createDataFrame(files, "path string, content binary").withColumn("length", F.length("content").cast("long"))
    want = analysis.analyse_files(df, tile=64, computed_at=0)
    assert {r.cache_key for r in want.collect()} == {r.cache_key for r in content_key(df).collect()}
    close(got.where("success"), want.where("success"), ["cache_key"], analysis.METRICS)
    assert got.where("NOT success").count() == want.where("NOT success").count() == 1 and got.count() == 5
    plan = analysis.once(content_key(df))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "content" in line]


@pytest.mark.parametrize("grid", [1, 3, 5])
def test_plate_of_tiles(spark, grid):
    """Zones that straddle tiles and overlap at grid 5, a saturated star, a frame too small for its boxes, a colour frame."""
    img, _ = fields.star_field(420, 400, 81, sigma=2.2, margin=22, dimmest=0.3)
    img[200:203, 200:203] += 60000
    small, _ = fields.star_field(70, 50, 4, sigma=1.8, margin=18)
    files = [("a", fields.fits(img)), ("small", fields.fits(small)), ("flat", fields.fits(np.full((200, 210), 5.0))), ("c", fields.fits(np.stack([img[:300], img[:300] * 0.7 + 5, img[50:350] * 0.4])))]
    t = tilework.materialize(frames.tiles(spark.createDataFrame(files, "path string, content binary"), 64), "tiles")
    names = {r.id: r.path for r in t.select(F.xxhash64("path").alias("id"), "path").distinct().collect()}
    stars_, zones = psf.plate_of_tiles(t, grid)
    want_stars, want_zones = psf.plate(pixels.luma(frames.tile_pixels(t)), grid)
    got, want = ({(f(r.frame_id), r.gy, r.gx, r.y, r.x): r for r in df.collect()} for df, f in ((stars_, str), (want_stars, names.get)))
    assert got.keys() == want.keys() and len(got) >= grid
    assert all(got[k][c] == pytest.approx(w[c], rel=1e-6, abs=1e-6) for k, w in want.items() for c in ("score", "ecc", "elong", "pa", "fwhm", "x0", "y0", "siga", "sigb"))
    got, want = ({(f(r.frame_id), r.gy, r.gx): (r.n, round(r.elong, 6), round(r.ecc, 6), round(r.pa, 6), r.axis) for r in df.collect()} for df, f in ((zones, str), (want_zones, names.get)))
    assert got == want and len(got) == 4 * grid * grid


def test_boxes_follow_from_the_size(spark):
    sizes = [(w, h) for w in (30, 58, 300, 1001) for h in (29, 60, 777)]
    df = spark.createDataFrame([(i, w, h, 1.0) for i, (w, h) in enumerate(sizes)], "frame_id long, width long, height long, top double")
    for grid in (1, 3, 5):
        got = sorted((r.frame_id, r.gy, r.gx, r.y0, r.x0, r.rh, r.rw) for r in psf.zone_boxes(df, grid).collect())
        assert got == sorted((i, *b) for i, (w, h) in enumerate(sizes) for b in psf.boxes_of(w, h, grid))


@pytest.mark.parametrize("grid, side", [(1, 30), (3, 16), (4, 70)])
def test_cutouts_of_tiles(tiles, px, grid, side):
    got, want = ({(r.frame_id, r.gy, r.gx): (r.n, list(r["values"])) for r in f(x, grid, side).collect()} for f, x in ((tilereduce.cutouts, tiles), (pixels.cutouts, px)))
    assert got == want and len(got) >= 4 * grid * grid


def test_rows_of_pixels_cells_and_stars_are_not_broadcast(spark):
    """Such tables are small on disk, where the keys of their frames are packed: what is written is dealt by key all the same."""
    pixel = materialize(spark.range(4000).selectExpr("concat('f', id % 5) frame_id", "id % 40 y", "id div 40 x", "5D luma", "3D residual", "1D noise", "id % 8 label", "id % 7 = 0 edge"), "pixels")
    mesh = materialize(spark.range(500).selectExpr("concat('f', id % 5) frame_id", "id % 10 cy", "id div 50 cx", "1D bg", "1D noise"), "mesh")
    surface = materialize(spark.range(500).selectExpr("concat('f', id % 5) frame_id", "id % 10 i", "id div 50 j", "1D b0", "1D surface"), "surface")
    size = spark.range(5).selectExpr("concat('f', id) frame_id", "40L width", "40L height")
    star = materialize(pixel.select("frame_id", "y", "x", F.lit(1.0).alias("hfr"), F.lit(0.1).alias("ecc")), "stars")
    found = stars.quality_cuts(stars.moments(pixel), mesh, 4)
    counts = materialize(spark.range(4000).selectExpr("concat('f', id % 5) frame_id", "int(id) key", "double(id) v", "1L n"), "counts")
    plans = [stars.mesh_smooth(mesh), stars.joined_labels(pixel), stars.area_filter(pixel.drop("edge")), found, stars.half_flux_radius(pixel, found), background.heatmap(surface), background.corners(surface, 10, 10)]
    plans += [tilt.cells(star, frames=size), background.radial_fit(surface, 10, 10), background.plane_fit(surface, 10, 10), tilereduce.deviations(counts, size.select("frame_id", F.lit(1.0).alias("centre")))]
    for p in plans:
        assert "Broadcast" not in p._jdf.queryExecution().executedPlan().toString(), p.columns


def test_statistics_do_not_broadcast_samples(spark):
    """With medians too large for a broadcast, the samples, small on disk, are not broadcast in their place."""
    v = F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: (i * 37 % 200).cast("double"))
    parts = spark.range(60).select(F.concat(F.lit("f"), "id").alias("frame_id"), F.lit(200).cast("long").alias("n"), F.lit(19900.0).alias("total"), F.lit(1.0).alias("spread"), F.lit(0.0).alias("lo"), F.lit(1).cast("long").alias("n_lo"), F.lit(199.0).alias("hi"), F.lit(1).cast("long").alias("n_hi"), v.alias("sample"))
    parts = materialize(parts.coalesce(1), "parts")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "40k")
        s = tilework.statistics(parts)
        assert {(r.pix_median, r.pix_mad, r.pix_mean) for r in s.collect()} == {(100.0, 50.0, 99.5)} and s.count() == 60
        rows = s._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
        assert not [b for a, b in zip(rows, rows[1:], strict=False) if "BroadcastExchange" in a and "Generate" in b]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
