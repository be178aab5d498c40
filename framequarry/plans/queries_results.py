"""Registered source, header, catalog, result-table, triage and ingest queries, with their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions.store import materialize, shared_dir
from framequarry.operators import analysis, results, tilereduce, tilework, triage
from framequarry.operators.resulttable import ResultTable
from framequarry.sources import blocks, frames, headers
from framequarry.streaming import ingest

from . import bindings as b
from .queries_pixels import SUMMARY, TILE, K, rounded, upper

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


# Sources.
EXT = "('" + "', '".join(frames.EXTENSIONS) + "')"


@query("src_frames", f"WITH {b.FILES} SELECT doc_id, dir, name, length FROM files WHERE lower(regexp_extract(name, '\\.[^./]+$')) IN {EXT}")
def src_frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames.known_extension(b.files(spark, sf)).select("doc_id", "dir", "name", "length")


FORMAT = "CASE doc_id % 4 WHEN 0 THEN 'xisf' WHEN 1 THEN 'raw' WHEN 2 THEN 'raw' ELSE 'fits' END"


@query("src_detect_format", f"WITH {b.FILES} SELECT doc_id, name, {FORMAT} AS format FROM files")
def src_detect_format(spark: SparkSession, sf: str) -> DataFrame:
    return frames.detect_format(b.files(spark, sf)).select("doc_id", "name", "format")


@query("src_guard", f"WITH {b.FILES} SELECT doc_id, width, height, CASE WHEN width <= 0 OR height <= 0 THEN 'empty geometry' WHEN width > 100000 OR height > 100000 THEN 'side too long' WHEN width * height > 1000000000 THEN 'too many pixels' END AS error FROM files")
def src_guard(spark: SparkSession, sf: str) -> DataFrame:
    return headers.guard(b.files(spark, sf).select("doc_id", "width", "height"))


def _fits_files(spark: SparkSession, sf: str) -> DataFrame:
    """Header blocks made of the card binding: 80 characters a card, END last, the last card cut on every third frame."""
    line = lambda c: F.rpad(F.concat(F.rpad(F.upper(c["key"]), 8, " "), F.lit("= "), F.trim(c["value"])), 80, " ")
    lines = F.transform(F.filter("cards", lambda c: c["key"] != "object"), line)
    text = b.card_lists(spark, sf).select("frame_id", F.array_join(lines, "").alias("t"))
    whole = F.concat(F.rpad(F.lit("SIMPLE  =                    T / standard"), 80, " "), F.rpad(F.lit("COMMENT free text"), 80, " "), "t", F.rpad(F.lit("END"), 80, " "), F.rpad(F.lit("NOISE   = 1"), 80, " "))
    cut = F.when(F.col("frame_id") % 3 == 0, F.expr("substring(w, 1, 800)")).otherwise(F.col("w"))
    return text.select("frame_id", whole.alias("w")).select("frame_id", F.encode(cut, "US-ASCII").alias("content"))


TRIMMED = "CASE WHEN regexp_matches(trim(value), '^''.*''$') AND length(trim(value)) >= 2 THEN rtrim(substr(trim(value), 2, length(trim(value)) - 2)) ELSE trim(value) END"


@query("src_fits_cards", f"""WITH {b.CARDS}, c AS (SELECT frame_id, row_number() OVER (PARTITION BY frame_id ORDER BY card_idx) + 1 AS card_idx, upper(key) AS key, CASE WHEN contains(value, '/') THEN trim(split_part(value, '/', 1)) ELSE {TRIMMED} END AS value, CASE WHEN contains(value, '/') THEN trim(split_part(value, '/', 2)) ELSE '' END AS comment FROM cards WHERE key <> 'object'),
a AS (SELECT * FROM c UNION ALL SELECT DISTINCT frame_id, 0, 'SIMPLE', 'T', 'standard' FROM c UNION ALL SELECT DISTINCT frame_id, 1, 'COMMENT', '', 'free text' FROM c) SELECT * FROM a WHERE frame_id % 3 <> 0 OR card_idx <= 9""")
def src_fits_cards(spark: SparkSession, sf: str) -> DataFrame:
    return frames.fits_cards(_fits_files(spark, sf))


def _xisf_files(spark: SparkSession, sf: str) -> DataFrame:
    """XISF files of four pixels whose header carries an order."""
    k = F.col("o_orderkey")
    word = F.lit('<FITSKeyword name="')
    xml = F.concat(
        F.lit('<?xml version="1.0"?><xisf version="1.0" xmlns="http://www.pixinsight.com/xisf"><Image geometry="'), (k % 90 + 1).cast("string"), F.lit(":"), (k % 70 + 1).cast("string"), F.lit(':1" sampleFormat="UInt16" colorSpace="Gray" location="attachment:4096:8">'),
        word, F.lit('OBJECT" value="\' '), F.col("o_orderpriority"), F.lit("  '\" comment=\"c\"/>"), word, F.lit('GAIN" value=" '), F.col("o_custkey").cast("string"), F.lit(' " comment=""/></Image></xisf>'),
    )
    body = F.encode(xml, "UTF-8")
    little = F.unhex(F.concat(*[F.lpad(F.hex(F.expr(f"(CAST(length(b) AS BIGINT) >> {s}) & 255")), 2, "0") for s in (0, 8, 16, 24)]))
    return b.orders(spark, sf).select(k.alias("frame_id"), body.alias("b")).select("frame_id", F.concat(F.lit(b"XISF0100"), little, F.lit(b"\0\0\0\0"), "b").alias("content"))


@query("src_xisf_cards", "SELECT o_orderkey AS frame_id, o_orderkey % 90 + 1 AS width, o_orderkey % 70 + 1 AS height, i AS card_idx, CASE i WHEN 0 THEN 'OBJECT' ELSE 'GAIN' END AS key, CASE i WHEN 0 THEN ' ' || o_orderpriority ELSE o_custkey::VARCHAR END AS value FROM orders, (SELECT unnest(range(2)) AS i)")
def src_xisf_cards(spark: SparkSession, sf: str) -> DataFrame:
    return frames.image_cards(frames.xisf_images(_xisf_files(spark, sf)), "width", "height").drop("comment")


def _pixel_files(spark: SparkSession, sf: str, kind: str) -> DataFrame:
    """Frames of the star binding written as FITS or XISF bytes (16 bit), one file per frame, by Spark functions.

    A last row that the table does not fill ends in zeros.
    """
    # Dealt by frame as narrow rows: the lists of a frame are made where its pixels are, by many tasks whatever the row groups.
    px = b.star_pixels(spark, sf).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame_id")
    v = F.lpad(F.hex(F.floor("r").cast("long") % 65536), 4, "0")
    if kind == "fits":
        v = F.lpad(F.hex(F.pmod(F.floor("r").cast("long") - 32768, F.lit(65536))), 4, "0")
        order, zero = -F.col("y"), "8000"  # FITS rows run upwards; 0 is stored as -32768
    else:
        v, order, zero = F.concat(F.substring(v, 3, 2), F.substring(v, 1, 2)), F.col("y"), "0000"
    joined = lambda items: F.array_join(F.sort_array(F.collect_list(items))["v"], "")
    rows = px.groupBy("frame_id", "y").agg(F.rpad(joined(F.struct("x", v.alias("v"))), 200, zero).alias("line"))
    whole = rows.groupBy("frame_id").agg(joined(F.struct(order.alias("k"), F.col("line").alias("v"))).alias("hex"), (F.max("y") + 1).cast("string").alias("h"))
    if kind == "fits":
        card = lambda k, value: F.rpad(F.concat(F.rpad(F.lit(k), 8, " "), F.lit("= "), F.lpad(value, 20, " ")), 80, " ")
        head = F.concat(card("SIMPLE", F.lit("T")), card("BITPIX", F.lit("16")), card("NAXIS", F.lit("2")), card("NAXIS1", F.lit("50")), card("NAXIS2", F.col("h")), card("BZERO", F.lit("32768")), card("BSCALE", F.lit("1")), F.rpad(F.lit("END"), 80, " "))
        lead = F.encode(F.rpad(head, 2880, " "), "US-ASCII")
    else:
        xml = F.encode(F.concat(F.lit('<xisf><Image geometry="50:'), "h", F.lit(':1" sampleFormat="UInt16" colorSpace="Gray" location="attachment:256:'), (F.col("h").cast("int") * 100).cast("string"), F.lit('"/></xisf>')), "UTF-8")
        size = F.unhex(F.lpad(F.hex(F.length(xml)), 2, "0"))
        lead = F.rpad(F.concat(F.lit(b"XISF0100"), size, F.lit(bytes(7)), xml), 256, F.lit(b"\0"))
    return whole.select(F.concat(F.lit("frame-"), F.col("frame_id").cast("string"), F.lit(f".{kind}")).alias("path"), F.concat(lead, F.unhex("hex")).alias("content"))


#: The pixels that those files hold.
STORED = f"""{b.MONO.replace("pixels AS", "given AS")}, pixels AS (SELECT f.frame_id, f.y, g.x, coalesce(floor(p.r), 0) AS r, '' AS dir FROM (SELECT frame_id, unnest(range(my + 1)) AS y FROM (SELECT frame_id, max(y) AS my FROM given GROUP BY 1)) f
 CROSS JOIN (SELECT unnest(range(50)) AS x) g LEFT JOIN given p ON p.frame_id = f.frame_id AND p.y = f.y AND p.x = g.x)"""
TILE_SELECT = "SELECT 'frame-' || frame_id || '.{kind}' AS path, CAST(y // 16 AS INTEGER) AS ty, CAST(x // 16 AS INTEGER) AS tx, CAST(max(x) - min(x) + 1 AS INTEGER) AS w, CAST(max(y) - min(y) + 1 AS INTEGER) AS h, sum(r) AS total, arg_min(r, y * 50 + x) AS first_value FROM pixels GROUP BY 1, 2, 3"
TILE_SQL = f"WITH {STORED} {TILE_SELECT}"


def _summed_tiles(t: DataFrame) -> DataFrame:
    total = F.aggregate("r", F.lit(0.0).cast("double"), lambda s, v: s + v.cast("double"))
    return t.select(F.element_at(F.split("path", "/"), -1).alias("path"), "ty", "tx", "w", "h", total.alias("total"), F.element_at("r", 1).cast("double").alias("first_value"))


@query("src_fits_tiles", TILE_SQL.format(kind="fits"))
def src_fits_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return _summed_tiles(frames.tiles(_pixel_files(spark, sf, "fits"), tile=16))


@query("src_xisf_tiles", TILE_SQL.format(kind="xisf"))
def src_xisf_tiles(spark: SparkSession, sf: str) -> DataFrame:
    return _summed_tiles(frames.tiles(_pixel_files(spark, sf, "xisf"), tile=16))


def _headers(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """Headers of those frames once they are written as files into the shared folder."""
    folder = shared_dir(spark, "frame-files")
    for kind in kinds:
        blocks.write_files(_pixel_files(spark, sf, kind), folder).write.format("noop").mode("overwrite").save()
    return blocks.read_headers(spark, folder)


@query("src_header_blocks", f"""WITH {STORED}, h AS (SELECT frame_id, max(y) + 1 AS height FROM pixels GROUP BY 1),
c AS (SELECT frame_id, unnest(['SIMPLE', 'BITPIX', 'NAXIS', 'NAXIS1', 'NAXIS2', 'BZERO', 'BSCALE']) AS key, unnest(['T', '16', '2', '50', height::VARCHAR, '32768', '1']) AS value, unnest(range(7)) AS card_idx, 2880 + height * 100 AS length FROM h)
SELECT 'frame-' || frame_id || '.fits' AS path, CAST(length AS BIGINT) AS length, card_idx, key, value, true AS few_bytes FROM c""")
def src_header_blocks(spark: SparkSession, sf: str) -> DataFrame:
    h = _headers(spark, sf, "fits").select("*", (F.col("bytes_read") <= blocks.WINDOW).alias("few_bytes"))
    c = blocks.cards(h).withColumnRenamed("frame_id", "path").join(h.select("path", "length", "few_bytes"), "path")
    return c.select(F.element_at(F.split("path", "/"), -1).alias("path"), "length", "card_idx", "key", "value", "few_bytes")


@query("src_row_ranges", f"WITH {STORED} {TILE_SELECT.format(kind='fits')} UNION ALL {TILE_SELECT.format(kind='xisf')}")
def src_row_ranges(spark: SparkSession, sf: str) -> DataFrame:
    return _summed_tiles(blocks.tiles(_headers(spark, sf, "fits", "xisf"), 16, range_bytes=3200))


@query("src_exif_cards", """WITH e AS (SELECT o_orderkey AS k, 'make' || o_custkey % 5 AS make, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'model ' || o_orderkey % 7 END AS model, CASE WHEN o_orderkey % 8 < 4 THEN o_orderkey % 8 / 4.0::DOUBLE ELSE 1 / (o_orderkey % 977 * 40.0::DOUBLE + 3) END AS shutter, 50 + o_custkey / 7.0::DOUBLE AS focal, o_orderkey % 5 * 100.0::DOUBLE AS iso, epoch(o_orderdate)::BIGINT * (o_orderkey % 2) AS taken FROM orders),
n AS (SELECT k, make || CASE WHEN model = '' THEN '' ELSE ' ' || model END AS a0, CASE WHEN shutter > 0 THEN format('{:g}', shutter) END AS a1, format('{:g}', focal) AS a4, CASE WHEN iso > 0 THEN iso::BIGINT::VARCHAR END AS a2, '2.8' AS a3, CASE WHEN taken > 0 THEN strftime(make_timestamp(taken * 1000000), '%Y-%m-%dT%H:%M:%S') END AS a5 FROM e),
u AS (SELECT k, 0 AS i, 'INSTRUME' AS key, a0 AS value FROM n UNION ALL SELECT k, 1, 'EXPTIME', a1 FROM n UNION ALL SELECT k, 2, 'ISO', a2 FROM n UNION ALL SELECT k, 3, 'FNUMBER', a3 FROM n UNION ALL SELECT k, 4, 'FOCALLEN', a4 FROM n UNION ALL SELECT k, 5, 'DATE-OBS', a5 FROM n)
SELECT k AS frame_id, row_number() OVER (PARTITION BY k ORDER BY i) - 1 AS card_idx, key, value FROM u WHERE value IS NOT NULL""")
def src_exif_cards(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    exif = b.table(spark, sf, "orders").select(
        k.alias("frame_id"), F.concat(F.lit("make"), (F.col("o_custkey") % 5).cast("string")).alias("make"), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("model "), (k % 7).cast("string"))).alias("model"),
        F.when(k % 8 < 4, k % 8 / 4.0).otherwise(1 / (k % 977 * 40.0 + 3)).alias("shutter"), (k % 5 * 100.0).alias("iso"), F.lit(2.8).alias("aperture"), (50 + F.col("o_custkey") / 7.0).alias("focal_len"), (F.unix_timestamp("o_orderdate") * (k % 2)).alias("taken"),
    )
    return headers.exif_cards(exif)


@query("src_union", f"WITH {b.CARDS}, u AS (SELECT frame_id, card_idx, key, value FROM cards UNION ALL SELECT o_orderkey, 0, 'INSTRUME', 'camera' FROM orders) SELECT key, count(*) AS n, count(DISTINCT value) AS kinds FROM u GROUP BY key")
def src_union(spark: SparkSession, sf: str) -> DataFrame:
    cam = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"), F.lit(0).cast("long").alias("card_idx"), F.lit("INSTRUME").alias("key"), F.lit("camera").alias("value"), F.lit("from EXIF").alias("comment"))
    return frames.union_cards(b.cards(spark, sf), cam).groupBy("key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("kinds"))


# Header scalars and catalog.
@query("hdr_trim_value", f"WITH {b.CARDS} SELECT frame_id, card_idx, {TRIMMED} AS value FROM cards")
def hdr_trim_value(spark: SparkSession, sf: str) -> DataFrame:
    return b.cards(spark, sf).select("frame_id", "card_idx", headers.trim_value(F.col("value")).alias("value"))


@query("hdr_lookup", f"WITH {b.CARDS} SELECT frame_id, arg_min(value, card_idx) FILTER (upper(key) = 'OBJECT') AS object, arg_min(value, card_idx) FILTER (upper(key) = 'EXPOSURE') AS exposure, arg_min(value, card_idx) FILTER (upper(key) = 'FOCUSPOS') AS focuspos FROM cards GROUP BY 1")
def hdr_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return headers.lookup(b.cards(spark, sf), ["OBJECT", "EXPOSURE", "FOCUSPOS"]).toDF("frame_id", "object", "exposure", "focuspos")


NUM = r"TRY_CAST(nullif(regexp_extract(value, '^\s*([+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?)', 1), '') AS DOUBLE)"
INT = r"TRY_CAST(nullif(regexp_extract(value, '^\s*([+-]?\d+)', 1), '') AS BIGINT)"


@query("hdr_numeric", f"WITH {b.CARDS} SELECT frame_id, card_idx, {NUM} AS as_double, {INT} AS as_long FROM cards")
def hdr_numeric(spark: SparkSession, sf: str) -> DataFrame:
    return b.cards(spark, sf).select("frame_id", "card_idx", headers.to_double(F.col("value")).alias("as_double"), headers.to_long(F.col("value")).alias("as_long"))


DATES = "['', 'T05', 'T05:06', 'T05:06:07.25']"


@query("hdr_dateobs", f"""WITH d AS (SELECT o_orderkey AS frame_id, date_trunc('day', o_orderdate) AS day, {DATES}[o_orderkey % 4 + 1] AS tail, o_orderkey % 4 AS k, o_orderkey % 10 = 9 AS bad FROM orders)
SELECT frame_id, CASE WHEN bad THEN NULL ELSE day + to_milliseconds(CASE k WHEN 0 THEN 0 WHEN 1 THEN 18000000 WHEN 2 THEN 18360000 ELSE 18367250 END) END AS date_obs,
 CAST(CASE WHEN bad THEN NULL ELSE (epoch_us(day) + CASE k WHEN 0 THEN 0 WHEN 1 THEN 18000000000 WHEN 2 THEN 18360000000 ELSE 18367250000 END + 11644473600000000) * 10 END AS VARCHAR) AS ticks FROM d""")
def hdr_dateobs(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    tail = F.element_at(F.array(*map(F.lit, ("", "T05", "T05:06", "T05:06:07.25"))), (k % 4 + 1).cast("int"))
    text = F.when(k % 10 == 9, F.concat(F.lit("2024-02-30"), tail)).otherwise(F.concat(F.date_format("o_orderdate", "yyyy-M-d"), tail))
    when = headers.date_obs(text)
    return b.table(spark, sf, "orders").select(k.alias("frame_id"), when.cast("timestamp_ntz").alias("date_obs"), headers.ticks(when).cast("string").alias("ticks"))


CATALOG = f"""t AS (SELECT frame_id, card_idx, upper(key) AS key, {TRIMMED} AS value FROM cards),
f AS (SELECT frame_id, arg_min(value, card_idx) FILTER (key = 'OBJECT') AS object, arg_min({NUM}, card_idx) FILTER (key = 'EXPTIME') AS e1, arg_min({NUM}, card_idx) FILTER (key = 'EXPOSURE') AS e2, arg_min(value, card_idx) FILTER (key = 'FILTER') AS filter, arg_min(value, card_idx) FILTER (key = 'DATE-OBS') AS d,
 arg_min({INT}, card_idx) FILTER (key = 'GAIN') AS gain, arg_min({NUM}, card_idx) FILTER (key = 'CCD-TEMP') AS c1, arg_min({NUM}, card_idx) FILTER (key = 'CCDTEMP') AS c2, max({INT}) FILTER (key = 'OFFSET') AS off, arg_min({INT}, card_idx) FILTER (key = 'FOCUSPOS') AS foc FROM t GROUP BY 1),
catalog AS (SELECT frame_id, object, round(coalesce(e1, e2), 2) AS exposure_s, filter, CAST(d AS TIMESTAMP) AS date_obs, greatest(0, gain) AS gain, round(coalesce(c1, c2), 1) AS ccd_temp, CASE WHEN off IS NOT NULL THEN greatest(0, off) END AS "offset", greatest(0, foc) AS focuser_position FROM f)"""


@query("hdr_catalog", f"""WITH {b.CARDS}, {CATALOG} SELECT catalog.*, NULL::VARCHAR AS telescope, NULL::VARCHAR AS instrument, NULL::VARCHAR AS bayer_pattern, NULL::DOUBLE AS focal_length, NULL::DOUBLE AS focal_ratio, NULL::VARCHAR AS image_type, NULL::VARCHAR AS software,
 nullif(o_orderkey % 90, 0) AS width, nullif(o_orderkey % 70, 0) AS height, o_orderkey % 90 || ' x ' || o_orderkey % 70 AS dimensions FROM catalog JOIN orders ON o_orderkey = frame_id""")
def hdr_catalog(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey")
    sizes = b.table(spark, sf, "orders").select(k.alias("frame_id"), (k % 90).alias("width"), (k % 70).alias("height"))
    return headers.catalog(b.cards(spark, sf), sizes).withColumn("date_obs", F.col("date_obs").cast("timestamp_ntz"))


@query("cat_quality_columns", f"""WITH {b.INCOMING}, k AS (SELECT o_orderkey AS frame_id, sha256(o_orderkey::VARCHAR) AS cache_key FROM orders)
SELECT frame_id, k.cache_key, CASE WHEN success AND star_count > 0 THEN star_count::BIGINT END AS star_count, CASE WHEN success AND star_count > 0 THEN round(hfr_median, 2) END AS hfr, CASE WHEN success AND star_count > 0 THEN round(hfr_stddev, 2) END AS hfr_sd, CASE WHEN success AND star_count > 0 THEN round(fwhm_median, 2) END AS fwhm, CASE WHEN success AND star_count > 0 THEN round(ecc_median, 2) END AS ecc,
 CASE WHEN success THEN round(pix_mean, 0) END AS stat_mean, CASE WHEN success THEN round(pix_stddev, 0) END AS stat_sd, CASE WHEN success THEN round(pix_median, 0) END AS stat_median, CASE WHEN success THEN round(pix_mad, 0) END AS stat_mad,
 CASE WHEN success THEN format('{{:g}}', pix_min) || ' (' || pix_min_count || 'x)' END AS stat_min, CASE WHEN success THEN format('{{:g}}', pix_max) || ' (' || pix_max_count || 'x)' END AS stat_max FROM k LEFT JOIN incoming i ON i.cache_key = k.cache_key""")
def cat_quality_columns(spark: SparkSession, sf: str) -> DataFrame:
    keys = b.table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"), F.sha2(F.col("o_orderkey").cast("string"), 256).alias("cache_key"))
    return results.quality_columns(keys, b.incoming(spark, sf))


#: Star summary and statistics of the stored pixels (16-bit, so floors).
ANALYSED = f"""{SUMMARY.replace(b.MONO, STORED)}, st AS (SELECT frame_id, max(x) + 1 AS w, max(y) + 1 AS h, avg(r) AS pix_mean, coalesce(stddev_samp(r), 0) AS pix_stddev, {upper('r')} AS pix_median, min(r) AS pix_min, max(r) AS pix_max FROM pixels GROUP BY 1),
an AS (SELECT st.*, {upper('abs(r - pix_median)')} AS pix_mad, count(*) FILTER (r = pix_min) AS pix_min_count, count(*) FILTER (r = pix_max) AS pix_max_count FROM pixels JOIN st USING (frame_id) GROUP BY ALL)"""


def _with_broken(files: DataFrame) -> DataFrame:
    """``files`` and, of each, a copy that ends inside the pixels."""
    cut = files.select(F.concat(F.lit("cut-"), "path").alias("path"), F.expr("substring(content, 1, 3000)").alias("content"))
    return files.union(cut).withColumn("length", F.length("content").cast("long"))


@query("cat_check_line", f"{ANALYSED} SELECT 'frame-' || frame_id || '.fits' AS path, format('OK {{}}x{{}} headers=7 min={{:.3f}} max={{:.3f}} stars={{}} hfr={{:.2f}}', w, h, CASE WHEN pix_min < pix_max THEN pix_min ELSE 0 END, CASE WHEN pix_min < pix_max THEN pix_max ELSE 1 END, star_count, hfr_median) AS line FROM an JOIN su USING (frame_id)")
def cat_check_line(spark: SparkSession, sf: str) -> DataFrame:
    """Files to check lines: cards, decoded pixels, their range and stars."""
    files = materialize(_pixel_files(spark, sf, "fits"), "frame-files")
    tiles = materialize(frames.tiles(files, 16), "tiles")
    rows, _ = tilework.analyse(tiles, tile=TILE, k=K)
    sizes = tiles.groupBy(F.col("path").alias("frame_id")).agg(F.max("width").alias("width"), F.max("height").alias("height"))
    counted = frames.fits_cards(files.withColumnRenamed("path", "frame_id")).groupBy("frame_id").agg(F.count("*").alias("headers"))
    all_ = rows.join(counted, "frame_id").join(sizes, "frame_id").join(tilereduce.source_range(tiles), "frame_id")
    return results.check_line(all_).withColumnRenamed("frame_id", "path")


@query("ingest_files", f"""{ANALYSED} SELECT 'frame-' || frame_id || '.fits' AS path, true AS success, star_count, round(hfr_median, 6) AS hfr_median, round(hfr_stddev, 6) AS hfr_stddev, round(fwhm_median, 6) AS fwhm_median, round(ecc_median, 6) AS ecc_median,
 round(pix_mean, 6) AS pix_mean, round(pix_stddev, 6) AS pix_stddev, pix_median, pix_mad, pix_min, pix_min_count, pix_max, pix_max_count, NULL::VARCHAR AS error FROM an JOIN su USING (frame_id)
UNION ALL SELECT 'cut-frame-' || frame_id || '.fits', false, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'truncated pixels' FROM st""")
def ingest_files(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes of good and broken files to rows of the result table on disk; a second arrival of the same files adds none."""
    files = materialize(results.content_key(_with_broken(_pixel_files(spark, sf, "fits"))).select("path", "cache_key", "content", "length"), "arrived-files")
    table = shared_dir(spark, "results")
    for _ in range(2):
        ingest.ingest_into(files, table, lambda todo: analysis.analyse_files(todo, tile=16, computed_at=0, detection={"tile": TILE, "k": K}))
    rows = results.current(spark.read.parquet(table)).join(files.select("path", "cache_key"), "cache_key")
    return rounded(rows.select("path", "success", *analysis.METRICS, "error"))


# Result table and triage.
FILE_KEY = r"sha256(c[1:65536] || encode(octet_length(c)::VARCHAR))"
FILE_ROWS = r"(SELECT *, ['XISF0100'::BLOB, 'II*\x00'::BLOB, 'MM\x00*'::BLOB, 'SIMPLE'::BLOB][doc_id % 4 + 1] || encode(text) AS c, source || '_' || doc_id || ['.fit', '.FITS', '.xisf', '.cr2', '.txt'][doc_id % 5 + 1] AS name FROM documents)"


@query("key_content", f"SELECT doc_id, name, {FILE_KEY} AS cache_key FROM {FILE_ROWS}")
def key_content(spark: SparkSession, sf: str) -> DataFrame:
    return results.content_key(b.files(spark, sf)).select("doc_id", "name", "cache_key")


@query("key_duplicates", f"SELECT {FILE_KEY} AS cache_key, count(*) AS copies, min(name) AS first_name FROM {FILE_ROWS} GROUP BY 1 HAVING count(*) > 1")
def key_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return results.key_duplicates(results.content_key(b.files(spark, sf)))


CURRENT = f"WITH {b.STORE}, {b.INCOMING}"


@query("cache_lookup", f"{CURRENT} SELECT s.cache_key, s.computed_at, s.hfr_median FROM incoming i JOIN store s ON s.cache_key = i.cache_key AND s.schema_version = 3")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return results.lookup(b.incoming(spark, sf).select("cache_key"), b.store(spark, sf)).select("cache_key", "computed_at", "hfr_median")


@query("cache_misses", f"{CURRENT} SELECT cache_key FROM incoming WHERE cache_key NOT IN (SELECT cache_key FROM store WHERE schema_version = 3)")
def cache_misses(spark: SparkSession, sf: str) -> DataFrame:
    return results.misses(b.incoming(spark, sf).select("cache_key"), b.store(spark, sf))


UPSERT = "SELECT * FROM (SELECT * FROM store UNION ALL SELECT * FROM incoming) QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY computed_at DESC, schema_version DESC) = 1"


@query("cache_upsert", f"{CURRENT} {UPSERT}")
def cache_upsert(spark: SparkSession, sf: str) -> DataFrame:
    return results.upsert(b.store(spark, sf), b.incoming(spark, sf))


@query("cache_invalidate", f"{CURRENT} SELECT cache_key, schema_version, star_count FROM store WHERE schema_version = 3")
def cache_invalidate(spark: SparkSession, sf: str) -> DataFrame:
    return results.current(b.store(spark, sf)).select("cache_key", "schema_version", "star_count")


@query("sink_results", f"{CURRENT} SELECT schema_version, count(*) AS n, sum(star_count)::BIGINT AS stars FROM ({UPSERT}) GROUP BY 1")
def sink_results(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_dir(spark, "results")
    results.save(results.upsert(b.store(spark, sf), b.incoming(spark, sf)), path)
    return spark.read.parquet(path).groupBy(F.col("schema_version").cast("int").alias("schema_version")).agg(F.count("*").alias("n"), F.sum("star_count").alias("stars"))


@query("sink_result_table", f"{CURRENT} SELECT *, true AS touched FROM ({UPSERT})")
def sink_result_table(spark: SparkSession, sf: str) -> DataFrame:
    """The store is written as a table by key prefix, and the new results are folded in over its own path."""
    table = ResultTable(spark, shared_dir(spark, "result-table"), letters=1)
    new = b.incoming(spark, sf)
    table.append(b.store(spark, sf))
    touched = table.upsert(new)
    table.vacuum()
    return table.rows().withColumn("touched", F.substring("cache_key", 1, 1).isin(touched))


@query("ingest_file_stream", f"""{ANALYSED} SELECT 'frame-' || frame_id || '.fits' AS path, true AS success, star_count, round(hfr_median, 6) AS hfr_median, round(pix_mean, 6) AS pix_mean, pix_median, pix_mad, pix_max_count, NULL::VARCHAR AS error FROM an JOIN su USING (frame_id)
UNION ALL SELECT 'cut-frame-' || frame_id || '.fits', false, NULL, NULL, NULL, NULL, NULL, NULL, 'truncated pixels' FROM st""")
def ingest_file_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Frame files, broken ones among them, arrive in a folder; a stream of their paths fills the result table."""
    folder, state = shared_dir(spark, "frame-files"), shared_dir(spark, "stream-state")
    wrote = materialize(blocks.write_files(_with_broken(_pixel_files(spark, sf, "fits")), folder), "written-files")
    table = ResultTable(spark, shared_dir(spark, "result-table"))
    run = ingest.stream_files(spark, folder, table, state, lambda todo: analysis.analyse_headers(todo, tile=16, computed_at=0, detection={"tile": TILE, "k": K}))
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    paths = blocks.headers_of(wrote).select(F.element_at(F.split("path", "/"), -1).alias("path"), "cache_key")
    return rounded(table.rows().join(paths, "cache_key").select("path", "success", "star_count", "hfr_median", "pix_mean", "pix_median", "pix_mad", "pix_max_count", "error"))


INGESTED = f"{CURRENT} SELECT * FROM store WHERE schema_version = 3 UNION ALL SELECT * FROM incoming WHERE cache_key NOT IN (SELECT cache_key FROM store WHERE schema_version = 3)"


@query("ingest_incremental", f"{INGESTED}")
def ingest_incremental(spark: SparkSession, sf: str) -> DataFrame:
    fresh = b.incoming(spark, sf)
    _, new = ingest.ingest(fresh.select("cache_key"), results.current(b.store(spark, sf)), lambda todo: fresh.join(todo, "cache_key", "left_semi"))
    return new


@query("ingest_stream", f"WITH {b.MONO} SELECT sha256(frame_id::VARCHAR) AS cache_key, 3 AS schema_version, 0::BIGINT AS computed_at, count(*) AS n, round(sum(r), 4) AS total FROM pixels GROUP BY frame_id")
def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Arrivals: a stream of frame keys made of the events table; each new key is analysed from its pixels and stored."""
    px, source = b.star_pixels(spark, sf), shared_dir(spark, "arrivals")
    px.select("frame_id").distinct().select(F.sha2(F.col("frame_id").cast("string"), 256).alias("cache_key"), "frame_id").repartition(3, "frame_id").write.parquet(source)
    arrivals = spark.readStream.schema("cache_key string, frame_id long").option("maxFilesPerTrigger", 1).parquet(source)

    def analyse(todo: DataFrame) -> DataFrame:
        return px.join(todo, "frame_id").groupBy("cache_key").agg(F.count("*").alias("n"), F.round(F.sum("r"), 4).alias("total")).select("cache_key", F.lit(3).alias("schema_version"), F.lit(0).cast("long").alias("computed_at"), "n", "total")

    table = shared_dir(spark, "stream")
    run = ingest.stream_into(arrivals, spark, table, shared_dir(spark, "stream-state"), analyse)
    run.awaitTermination()
    if run.exception():
        raise run.exception()
    return spark.read.parquet(table).withColumn("schema_version", F.col("schema_version").cast("int"))


@query("rank_topk", f"WITH {b.MONO} SELECT dir, frame_id, y, round(v, 4) AS v, rank FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY v, frame_id * 100 + y) AS rank FROM (SELECT dir, frame_id, y, avg(r) AS v FROM pixels GROUP BY 1, 2, 3)) WHERE rank <= 5")
def rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    rows = b.star_pixels(spark, sf).groupBy("dir", "frame_id", "y").agg(F.avg("r").alias("v")).withColumn("tie", F.col("frame_id") * 100 + F.col("y"))
    return results.top_per_folder(rows, 5, by="v", tie="tie").select("dir", "frame_id", "y", F.round("v", 4).alias("v"), "rank")


NATURAL = r"array_to_string(list_transform(regexp_extract_all(lower({n}), '(\d+|\D+)'), lambda p: CASE WHEN regexp_matches(p, '^\d') THEN lpad(CAST(length(regexp_replace(p, '^0+(.)', '\1')) AS VARCHAR), 10, '0') || regexp_replace(p, '^0+(.)', '\1') ELSE p END), '')"


@query("nat_sort", f"WITH {b.FILES}, named AS (SELECT regexp_replace(name, '_', '_0001234567890123456789') AS name FROM files) SELECT name, row_number() OVER (ORDER BY {NATURAL.format(n='name')}, name) AS place FROM named")
def nat_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Place of each file: sorted by range, then numbered by the sizes of the ranges before."""
    return triage.places(b.files(spark, sf).select(F.regexp_replace("name", "_", "_0001234567890123456789").alias("name")))


@query("nav_prev_next", f"WITH {b.FILES}, k AS (SELECT dir, name, {NATURAL.format(n='name')} AS k FROM files) SELECT dir, name, coalesce(lag(name) OVER w, last_value(name) OVER (PARTITION BY dir ORDER BY k, name ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS prev_name, coalesce(lead(name) OVER w, first_value(name) OVER w) AS next_name FROM k WINDOW w AS (PARTITION BY dir ORDER BY k, name)")
def nav_prev_next(spark: SparkSession, sf: str) -> DataFrame:
    return triage.neighbours(b.files(spark, sf))

