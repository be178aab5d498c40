"""Headers and row ranges read from files, against the readers of whole files."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from framequarry.operators import stars, tiletable, tilework
from framequarry.sources import blocks, frames

from . import fields

CARD = lambda s: s.ljust(80)


def unit(*cards):
    return "".join(map(CARD, [*cards, "END"])).ljust(2880).encode()


def files():
    rng = np.random.default_rng(0)
    img = rng.uniform(0, 200, (37, 23))
    bayer = fields.fits(rng.uniform(50, 200, (41, 30)), [("BAYERPAT", "'GRBG'"), ("YBAYROFF", "1")])
    table = unit("XTENSION= 'BINTABLE'", "BITPIX  =                    8", "NAXIS   =                    2", "NAXIS1  =                    4", "NAXIS2  =                20000", "PCOUNT  =                    5", "GCOUNT  =                    1") + bytes(2880 * 28)
    ext = unit("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0") + table + fields.fits(img).replace(b"SIMPLE  =                    T", b"XTENSION= 'IMAGE   '          ")
    many = [(f"KEY{i}", str(i)) for i in range(700)]
    return {
        "a.fits": fields.fits(img, [("OBJECT", "'M 42'")]), "b.FIT": fields.fits(rng.integers(-90, 90, (30, 40)), [("BZERO", "32768"), ("BSCALE", "2")], 16), "c.fits": fields.fits(np.stack([img, img + 1, img * 2])),
        "d/e.fits": bayer, "d/dark.fits": fields.fits(np.zeros((20, 20)), [("BAYERPAT", "'RGGB'")]), "ext.fits": ext, "g.xisf": fields.xisf(img, keywords=[("GAIN", " 7 ")]), "h.xisf": fields.xisf(np.stack([img, img + 1, img * 2])),
        "nan.fits": fields.fits(np.array([[np.nan, 1.0], [np.inf, 2.0]])), "long.fits": fields.fits(img, many), "cut.fits": fields.fits(img)[:4000], "head.fits": fields.fits(img, many)[:3000], "empty.fits": b"", "garbage.fits": bytes(range(256)) * 40,
        "none.fits": unit("SIMPLE  =                    T", "BITPIX  =                    8", "NAXIS   =                    0"), "i.xisf": fields.xisf(img, offset=1 << 60), "j.xisf": fields.xisf(img, geometry="2000000000:2000000000:1"), "raw.nef": b"II*\0" + bytes(90), "notes.txt": b"no frame",
    }


@pytest.fixture
def folder(tmp_path):
    for name, content in files().items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    return tmp_path


def test_headers_against_whole_files(spark, folder):
    got = {os.path.relpath(r.path, folder): r for r in blocks.read_headers(spark, str(folder), files_a_task=3).collect()}
    assert set(got) == set(files()) - {"notes.txt"} and all(r.length == len(files()[n]) for n, r in got.items())
    assert {n: r.format for n, r in got.items() if r.format != "fits"} == {"g.xisf": "xisf", "h.xisf": "xisf", "i.xisf": "xisf", "j.xisf": "xisf", "raw.nef": "raw"}
    assert got["none.fits"].error == "no image" and got["empty.fits"].error and got["head.fits"].error == "truncated header" and got["cut.fits"].error is None
    whole = spark.createDataFrame([(f"file://{folder}/{n}", c) for n, c in files().items() if n.endswith((".fits", ".FIT")) and n != "garbage.fits"], "frame_id string, content binary")
    want = sorted(map(tuple, frames.fits_cards(frames.image_units(whole)).collect()))
    h = blocks.read_headers(spark, f"file://{folder}").where("path NOT LIKE '%garbage%'")
    cards = blocks.cards(h).collect()
    assert sorted(tuple(c) for c in cards if not c.frame_id.endswith("xisf")) == want
    assert [(c.key, c.value) for c in cards if c.frame_id.endswith("g.xisf")] == [("GAIN", "7")]


def test_bytes_read_do_not_grow_with_the_pixels(spark, folder, monkeypatch):
    sizes = {}
    for side in (10, 1000):
        (folder / f"side{side}.fits").write_bytes(fields.fits(np.zeros((side, side))))
    for r in blocks.read_headers(spark, str(folder)).collect():
        sizes[os.path.basename(r.path)] = r.bytes_read
        assert r.bytes_read <= -(-max(len(r.content), 1) // blocks.WINDOW) * blocks.WINDOW + 3 * blocks.WINDOW
    assert sizes["side10.fits"] <= sizes["side1000.fits"] <= blocks.WINDOW and sizes["ext.fits"] <= 3 * blocks.WINDOW
    (folder / "a.fits").unlink()  # a listing opens no file
    os.symlink(folder / "nowhere", folder / "gone.fits")
    listed = blocks.read_headers(spark, str(folder), ["length"])
    assert listed.columns == ["length"] and listed.count() == len(files()) - 2 + 2
    big = folder / "huge.fits"
    with big.open("wb") as f:  # 20 MB without END: read up to the limit only
        f.truncate(20 << 20)
    monkeypatch.setattr(blocks, "MOST_HEADER", 1 << 20)
    assert len(blocks.header_of(blocks.ByteRanges(str(big)))[1]) == 1 << 20


def as_rows(df):
    out = {}
    for r in df.collect():
        key = (os.path.basename(r.path), r.ty, r.tx)
        assert key not in out
        out[key] = (r.width, r.height, r.channels, r.y0, r.x0, r.h, r.w, r.error, *[None if v is None else np.array(v, np.float32) for v in (r.r, r.g, r.b)])
    return out


@pytest.mark.parametrize("range_bytes", [1, 700, 1 << 25], ids=["one tile row", "few", "whole"])
def test_row_ranges_against_whole_files(spark, folder, range_bytes):
    known = spark.createDataFrame([(n, c) for n, c in files().items() if n.split(".")[-1].lower() in ("fits", "fit", "xisf") and n not in ("garbage.fits", "head.fits", "empty.fits")], "path string, content binary")
    want = as_rows(frames.tiles(known, 8))
    headers = blocks.read_headers(spark, str(folder)).where("format <> 'raw'")
    got = as_rows(blocks.tiles(headers, 8, range_bytes).where("NOT path LIKE '%garbage%' AND NOT path LIKE '%head.fits' AND NOT path LIKE '%empty.fits'"))
    assert set(got) == set(want) and sum(w[7] is not None for w in want.values()) == 4
    for k, w in want.items():
        assert got[k][:8] == w[:8], k
        for a, b in zip(got[k][8:], w[8:], strict=True):
            assert (a is None) == (b is None) and (a is None or np.allclose(a, b, rtol=1e-6)), k
    broken = blocks.tiles(headers, 8, range_bytes).where("path LIKE '%garbage%' OR path LIKE '%head.fits' OR path LIKE '%empty.fits'").collect()
    assert len(broken) == 3 and all(r.error and r.r is None for r in broken)


def test_one_frame_is_many_tasks(spark, folder):
    (folder / "tall.fits").write_bytes(fields.fits(np.arange(64 * 400.0).reshape(400, 64)))
    ranges = blocks.materialize(blocks.row_ranges(blocks.read_headers(spark, str(folder / "tall.fits")), 16, 16 * 64 * 4), "ranges")
    t = blocks.range_tiles(spark, ranges, 16)
    assert ranges.count() == 25 and t.groupBy(F.spark_partition_id()).count().count() > 8 and t.agg(F.sum(F.size("r"))).first()[0] == 400 * 64
    assert "content" not in t._jdf.queryExecution().executedPlan().toString()


def test_file_beyond_two_gigabytes(spark, tmp_path):
    """Sparse: the file takes no room; of its 2.6 GB one range is read."""
    width, height = 32_000, 20_000
    head = unit("SIMPLE  =                    T", "BITPIX  =                   32", "NAXIS   =                    2", f"NAXIS1  = {width:>20}", f"NAXIS2  = {height:>20}")
    path = tmp_path / "wide.fits"
    with path.open("wb") as f:
        f.write(head)
        f.truncate(len(head) + 4 * width * height)
        f.seek(len(head) + 4 * (width * 5 + 7))  # the sixth row from below
        f.write((321).to_bytes(4, "big"))
    assert path.stat().st_size > 2 << 30
    headers = blocks.read_headers(spark, str(path))
    assert headers.first().bytes_read <= blocks.WINDOW
    ranges = blocks.materialize(blocks.row_ranges(headers), "ranges")
    assert ranges.count() > 70 and ranges.agg(F.sum(F.col("y1") - F.col("y0"))).first()[0] == height
    t = blocks.range_tiles(spark, blocks.materialize(ranges.where(f"y1 = {height}"), "last"), 256)
    hit = t.where(F.array_max("r") > 0).select("y0", "x0", "w", F.array_position("r", 321.0).alias("at")).collect()
    assert [(h.y0 + (h.at - 1) // h.w, h.x0 + (h.at - 1) % h.w) for h in hit] == [(height - 6, 7)]


def test_files_are_written_below_a_folder(spark, tmp_path):
    df = spark.createDataFrame([(f"f{i}.fits", fields.fits(np.full((4, 5), i))) for i in range(7)] + [("null.fits", None)], "path string, content binary").repartition(3)
    wrote = blocks.write_files(df, f"file://{tmp_path}/out").collect()
    assert len(wrote) == 8 and {r.length for r in wrote} == {0, 5760}
    back = blocks.tiles(blocks.read_headers(spark, f"file://{tmp_path}/out")).where("error IS NULL").select(F.element_at("r", 1)).collect()
    assert sorted(r[0] for r in back) == list(range(7))


def test_many_small_ranges_are_few_tasks(spark):
    """Tasks follow bytes and ranges: 1 000 small ranges share tasks, ranges of full size have their own."""
    names = blocks.RANGES
    rows = lambda n, width: spark.range(n).selectExpr("concat('f', id) path", "'n' name", "'<u2' kind", f"{width} width", "16 height", "1 channels", "0L data_at", "1D scale", "0D zero", "true flipped", "cast(null as string) pattern", "0 dx", "0 dy", "0 y0", "16 y1", "cast(null as string) error").to(spark.createDataFrame([], names).schema)
    assert blocks._dealt(rows(1000, 50)).rdd.getNumPartitions() <= 16 + spark.sparkContext.defaultParallelism
    assert blocks._dealt(rows(40, 1 << 20)).rdd.getNumPartitions() == 40


def test_tile_table_has_a_file_a_bucket(spark, tmp_path):
    """Small frames are dealt to the buckets of their tiles, and with fewer buckets than shuffle partitions the tiles stay."""
    for i in range(60):
        (tmp_path / f"{i}.fits").write_bytes(fields.fits(np.arange(20 * 20.0).reshape(20, 20) + i) if i % 3 else b"broken %d" % i)
    headers = blocks.read_headers(spark, str(tmp_path))
    table = tiletable.write(blocks.tiles(headers, 8), 8)
    found = [f for f in (tmp_path / table.path.removeprefix("file://")).iterdir() if f.suffix == ".parquet"]
    assert table.buckets == spark.sparkContext.defaultParallelism and len(found) <= table.buckets
    assert table.tiles.where("error IS NULL").count() == 40 * 9 and table.tiles.where("error IS NOT NULL").count() == 20
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.shuffle.partitions", "17")
        mesh = tilework.materialize(stars.mesh_smooth(tilework.reduced(table.tiles, 8, 1000).select("frame_id", F.inline("cells"))), "mesh")
        plan = tilework.above(table.tiles, mesh, 8, 4.0, table.band, True, table.buckets)
        plan.collect()
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in text.splitlines() if "Exchange" in line and "error#" in line]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
        table.drop()
