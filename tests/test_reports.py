"""The report of frame files against the operators on pixel rows."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import analysis, background, pixels, psf, reports, tilt, tilework
from framequarry.operators.results import content_key
from framequarry.plans import catalog
from framequarry.sources import blocks, frames

from . import fields

SKY = {"rows": 7, "cols": 11, "min_side": 100}


def frame_files():
    img, _ = fields.star_field(420, 400, 81, sigma=2.2, margin=22, dimmest=0.3)
    y, x = np.mgrid[:400, :420]
    img = img + 0.5 * x + 0.0004 * (y - 200.0) ** 2
    small, _ = fields.star_field(90, 80, 4, sigma=1.8, margin=18)
    colour = np.stack([img[:300], img[:300] * 0.7 + 5, img[50:350] * 0.4])
    return [("a", fields.fits(img)), ("again", fields.fits(img)), ("colour", fields.fits(colour)), ("small", fields.fits(small)), ("flat", fields.fits(np.full((120, 130), 5.0))), ("bad", b"x" * 3000)]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(frame_files(), "path string, content binary").withColumn("length", F.length("content").cast("long")).repartition(3)


@pytest.fixture(scope="module")
def report(files):
    return reports.report_files(files, tile=64, sky=SKY)


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def alike(got, want, values):
    assert got.keys() == want.keys() and got
    for k, w in want.items():
        assert all(got[k][c] == pytest.approx(w[c], rel=1e-6, abs=1e-6) for c in values), (k, got[k], w)


def test_report_is_that_of_pixel_rows(spark, files, report):
    keyed = analysis.once(content_key(files)).select(F.col("cache_key").alias("path"), "content")
    tiles = tilework.materialize(frames.tiles(keyed, 64), "tiles")
    names = tiles.where("error IS NULL").select(F.col("path").alias("name"), F.xxhash64("path").alias("frame_id")).distinct()
    px = pixels.luma(frames.tile_pixels(tiles)).select("frame_id", "y", "x", "luma")
    named = lambda df: df.join(names, "frame_id").drop("frame_id").withColumnRenamed("name", "frame_id")
    rows, found = analysis.analyse(px.withColumnRenamed("luma", "r"))
    cells = tilt.cells(found.select("frame_id", F.col("cy").alias("y"), F.col("cx").alias("x"), "hfr", "ecc"), frames=pixels.frame_size(px))
    alike(by(report.cells, "frame_id", "gy", "gx"), by(named(cells), "frame_id", "gy", "gx"), ["n", "hfr", "ecc"])
    place = lambda df: df.select("frame_id", F.round("cy", 4).alias("cy"), F.round("cx", 4).alias("cx"), "hfr", "ecc", "flux")
    alike(by(place(report.stars), "frame_id", "cy", "cx"), by(place(named(found)), "frame_id", "cy", "cx"), ["hfr", "ecc", "flux"])

    got = by(report.summary(), "cache_key")
    alike({k: r for k, r in got.items() if r.success}, by(named(rows), "frame_id"), analysis.METRICS)
    alike({k: r for k, r in got.items() if r.success}, by(named(tilt.summary(cells)), "frame_id"), [c for c in reports.TILT if c != "tilt_known"])
    sky = by(named(background.report(px, **SKY)), "frame_id")
    assert {k for k, r in got.items() if r.bg_median is not None} == sky.keys() and len(sky) == 3  # the small frame has no map
    alike({k: got[k] for k in sky}, sky, reports.SKY)
    _, zones = psf.plate(px)
    alike(by(report.zones, "frame_id", "gy", "gx"), by(named(zones), "frame_id", "gy", "gx"), ["n", "elong", "ecc", "pa"])
    assert max(r.psf_stars or 0 for r in got.values()) >= 9 and max(r.psf_zones or 0 for r in got.values()) > 3
    alike(by(report.heatmap(), "frame_id", "i", "j"), by(named(background.heatmap(background.surface_fit(background.cell_floor(px, **SKY), 7, 11))), "frame_id", "i", "j"), ["heat"])


def test_files_of_one_content_are_one_row_and_broken_files_say_why(report, files):
    rows = report.summary().collect()
    assert len(rows) == 5 == content_key(files).select("cache_key").distinct().count()
    bad = [r for r in rows if not r.success]
    assert len(bad) == 1 and bad[0].error and all(bad[0][c] is None for c in (*analysis.METRICS, *reports.TILT, *reports.SKY, *reports.PLATE))


def test_report_by_row_ranges(spark, report, tmp_path):
    for name, content in frame_files():
        (tmp_path / f"{name}.fits").write_bytes(content)
    headers = blocks.read_headers(spark, str(tmp_path), ["path", "length", "format", "content", "data_at", "error", "cache_key"])
    other = reports.report_headers(headers, tile=64, sky=SKY)
    got, want = by(other.summary(), "cache_key"), by(report.summary(), "cache_key")
    assert got.keys() == want.keys()
    ok = {k for k, r in want.items() if r.success}
    assert ok == {k for k, r in got.items() if r.success}
    alike({k: got[k] for k in ok}, {k: want[k] for k in ok}, [*analysis.METRICS, "tilt_pct", "curvature_pct", "psf_stars"])


def test_empty_table_and_release(spark):
    none = spark.createDataFrame([], "path string, content binary, length long")
    r = reports.report_files(none, tile=64, sky=SKY)
    assert r.summary().collect() == [] and r.heatmap().collect() == [] and r.nodes().collect() == []
    r.release()
    with pytest.raises(Exception):  # noqa: B017  its tables are gone
        r.rows.collect()


def test_contents_in_many_parts_are_few_tasks(spark):
    """The parts that small files come in do not become as many tasks that each write a file a bucket; copies are read once."""
    df = spark.createDataFrame([(f"f{i:03}", b"%d" % (i % 50)) for i in range(100)], "path string, content binary").withColumn("length", F.length("content").cast("long")).repartition(40)
    chosen = analysis.once(content_key(df))
    assert chosen.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and chosen.buckets <= spark.sparkContext.defaultParallelism
    assert sorted(r.path for r in chosen.collect()) == [f"f{i:03}" for i in range(50)]


def test_figures_of_five_digits_are_rounded_once(spark, tmp_path):
    """Frames whose radial_r2 or direction ends in 49.. after the fifth digit, exactly as SQL has them."""
    duck = duckdb.connect()
    duck.execute("CREATE TABLE events AS SELECT event_id % 2500 + CASE event_id // 2500 WHEN 28 THEN 0 ELSE 2500 END AS event_id, value FROM '/root/testdata/sf0.1/events.parquet' WHERE event_id // 2500 IN (28, 35)")
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet'")
    want = sorted(duck.execute(f"SELECT path, radial_r2, direction, bg_median FROM ({catalog.oracle_sql()['report_files']}) WHERE success").fetchall())
    got = catalog.queries()["report_files"](spark, str(tmp_path)).where("success").select("path", "radial_r2", "direction", "bg_median").collect()
    assert len(want) == 2 and sorted(map(tuple, got)) == want


def test_direction_along_an_axis_is_not_a_full_turn(spark):
    """A slope across that is 0 but for rounding, on either side, is the direction 0; a slope that is there stays."""
    cells = spark.range(48 * 3).selectExpr("id div 48 frame_id", "id % 48 div 8 i", "id % 8 j", "0D b0")
    across = F.element_at(F.array(F.lit(-1e-15), F.lit(1e-15), F.lit(-1e-4)), (F.col("frame_id") + 1).cast("int"))
    surface = cells.withColumn("surface", 5 + (F.col("j") - 3.5) / 3.5 + across * (F.col("i") - 2.5) / 2.5)
    got = {r.frame_id: r.direction for r in background.plane_fit(surface, 6, 8).collect()}
    assert got[0] < 1e-6 and got[1] < 1e-6 and got[2] == pytest.approx(360 - np.degrees(1e-4), abs=1e-6)
