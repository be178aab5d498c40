"""Given tables read as frames, stars, header cards, files and results (for the registered queries).

Every binding is a DataFrame and the DuckDB text of the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders dealt by key: what a row is expanded to is then made by many tasks, whatever row groups the file has, and is
    grouped by key where it is."""
    return table(spark, sf_dir, "orders").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey")


def rgb_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten colour frames 64 pixels wide: a row per embedding, a frame per label."""
    rows = table(spark, sf_dir, "embeddings").select("label", "embedding", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("y"))
    px = rows.select(F.col("label").cast("long").alias("frame_id"), F.col("y").cast("long").alias("y"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("x"))
    value = lambda k: 1000 + 1000 * F.element_at("embedding", ((F.col("x") + k) % 64 + 1).cast("int")).cast("double")
    return px.select("frame_id", "y", F.col("x").cast("long").alias("x"), value(0).alias("r"), value(1).alias("g"), value(2).alias("b"))


RGB = """pixels AS (SELECT CAST(label AS BIGINT) AS frame_id, y, x, 1000 + 1000 * CAST(embedding[x + 1] AS DOUBLE) AS r,
  1000 + 1000 * CAST(embedding[(x + 1) % 64 + 1] AS DOUBLE) AS g, 1000 + 1000 * CAST(embedding[(x + 2) % 64 + 1] AS DOUBLE) AS b
  FROM (SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, unnest(range(64)) AS x FROM embeddings))"""


def star_pixels(spark: SparkSession, sf_dir: str, rows: int = 50, cols: int = 50) -> DataFrame:
    """Mono frames with a long tail of bright pixels: event values laid out in raster order."""
    n = rows * cols
    e = table(spark, sf_dir, "events")
    frame = F.floor(F.col("event_id") / n).cast("long")
    return e.select(frame.alias("frame_id"), F.floor((F.col("event_id") % n) / cols).cast("long").alias("y"), (F.col("event_id") % cols).alias("x"), F.col("value").cast("double").alias("r"), F.concat(F.lit("night"), (frame % 2).cast("string")).alias("dir"))


MONO = """pixels AS (SELECT event_id // 2500 AS frame_id, (event_id % 2500) // 50 AS y, event_id % 50 AS x, value AS r, 'night' || (event_id // 2500 % 2) AS dir FROM events)"""


def stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("frame_id"), (F.col("l_partkey") * 37 % 1000).cast("double").alias("x"), (F.col("l_orderkey") * 53 % 800).cast("double").alias("y"),
        (1 + F.col("l_quantity") / 10).alias("hfr"), (F.col("l_discount") * 8).alias("ecc"), (2 * (1 + F.col("l_quantity") / 10)).alias("fwhm"), F.col("l_extendedprice").alias("flux"),
    )


STARS = """stars AS (SELECT l_suppkey AS frame_id, CAST(l_partkey * 37 % 1000 AS DOUBLE) AS x, CAST(l_orderkey * 53 % 800 AS DOUBLE) AS y,
  1 + l_quantity / 10 AS hfr, l_discount * 8 AS ecc, 2 * (1 + l_quantity / 10) AS fwhm, l_extendedprice AS flux FROM lineitem)"""


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw header cards (key, quoted value text) of one frame per order, with doubles, mixed case and missing keys."""
    c = card_lists(spark, sf_dir).select("frame_id", F.posexplode_outer("cards").alias("card_idx", "card"))  # never empty; the filter of posexplode would be made before they are dealt
    return c.select("frame_id", F.col("card_idx").cast("long").alias("card_idx"), "card.key", "card.value")


def card_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cards as one array per frame."""
    o = orders(spark, sf_dir)
    k, even = F.col("o_orderkey"), F.col("o_orderkey") % 2 == 0
    text = lambda v: v.cast("string")
    card = lambda key, value: F.struct((F.lit(key) if isinstance(key, str) else key).alias("key"), value.alias("value"))
    listed = F.array(
        card("OBJECT", F.concat(F.lit(" 'obj "), F.col("o_orderpriority"), F.lit("   ' "))),
        card(F.when(even, "EXPTIME").otherwise("Exposure"), F.concat(text(k % 600), F.lit(".25 / seconds"))),
        card("FILTER", F.concat(F.lit("'"), F.col("o_orderstatus"), F.lit("'"))),
        card("DATE-OBS", F.concat(F.lit("'"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".5'"))),
        card("GAIN", text(F.col("o_custkey") % 300 - 20)),
        card(F.when(k % 3 == 0, "CCD-TEMP").otherwise("CCDTEMP"), F.concat(F.lit("-"), text(k % 20), F.lit(".37"))),
        card("object", F.lit("'second'")),
        card("FOCUSPOS", text(k % 5000)),
        card("OFFSET", F.when(k % 7 == 0, F.lit("n/a")).otherwise(text(k % 50 - 5))),
    )
    return o.select(k.alias("frame_id"), listed.alias("cards"))


CARDS = """cards AS (SELECT frame_id, idx - 1 AS card_idx, ks[idx] AS key, vs[idx] AS value FROM (SELECT o_orderkey AS frame_id, unnest(range(1, 10)) AS idx,
  ['OBJECT', CASE WHEN o_orderkey % 2 = 0 THEN 'EXPTIME' ELSE 'Exposure' END, 'FILTER', 'DATE-OBS', 'GAIN', CASE WHEN o_orderkey % 3 = 0 THEN 'CCD-TEMP' ELSE 'CCDTEMP' END, 'object', 'FOCUSPOS', 'OFFSET'] AS ks,
  [' ''obj ' || o_orderpriority || '   '' ', (o_orderkey % 600)::VARCHAR || '.25 / seconds', '''' || o_orderstatus || '''', '''' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.5''',
   (o_custkey % 300 - 20)::VARCHAR, '-' || (o_orderkey % 20)::VARCHAR || '.37', '''second''', (o_orderkey % 5000)::VARCHAR, CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE (o_orderkey % 50 - 5)::VARCHAR END] AS vs FROM orders))"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with content, size and path; leading bytes of several formats, some extensions unknown."""
    d = table(spark, sf_dir, "documents")
    lead = F.element_at(F.array(F.lit(b"XISF0100"), F.lit(b"II*\0"), F.lit(b"MM\0*"), F.lit(b"SIMPLE")), (F.col("doc_id") % 4 + 1).cast("int"))
    kind = F.element_at(F.array(*map(F.lit, (".fit", ".FITS", ".xisf", ".cr2", ".txt"))), (F.col("doc_id") % 5 + 1).cast("int"))
    content = F.concat(lead, F.encode("text", "UTF-8"))
    return d.select(
        "doc_id", F.col("lang").alias("dir"), F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), kind).alias("name"), content.alias("content"), F.length(content).cast("long").alias("length"),
        ((F.col("n_chars") - 50) * 31 % 130000).alias("width"), ((F.col("n_chars") * 17) % 120000).alias("height"),
    )


FILES = r"""files AS (SELECT doc_id, lang AS dir, source || '_' || doc_id || ['.fit', '.FITS', '.xisf', '.cr2', '.txt'][doc_id % 5 + 1] AS name, content, octet_length(content) AS length,
  (n_chars - 50) * 31 % 130000 AS width, n_chars * 17 % 120000 AS height FROM (SELECT *, ['XISF0100'::BLOB, 'II*\x00'::BLOB, 'MM\x00*'::BLOB, 'SIMPLE'::BLOB][doc_id % 4 + 1] || encode(text) AS content FROM documents))"""


def store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result rows kept so far: a third of the keys, of two schema versions."""
    return _results(table(spark, sf_dir, "orders").where("o_orderkey % 3 = 0"), 2 + F.col("o_orderkey") % 2, 0.0)


def incoming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _results(table(spark, sf_dir, "orders"), F.lit(3), 86400.0)


def _results(o: DataFrame, version, later: float) -> DataFrame:
    k = F.col("o_orderkey")
    return o.select(
        F.sha2(k.cast("string"), 256).alias("cache_key"), version.cast("int").alias("schema_version"), (F.unix_timestamp("o_orderdate") + later).cast("long").alias("computed_at"), (k % 10 != 0).alias("success"), (k % 40).cast("int").alias("star_count"),
        (F.col("o_totalprice") / 100000).alias("hfr_median"), (F.col("o_totalprice") / 1000000).alias("hfr_stddev"), (F.col("o_totalprice") / 50000).alias("fwhm_median"), (k % 100 / 100.0).alias("ecc_median"),
        (F.col("o_totalprice") / 10).alias("pix_mean"), (F.col("o_custkey") / 7.0).alias("pix_stddev"), F.col("o_totalprice").alias("pix_median"), (F.col("o_custkey") / 3.0).alias("pix_mad"), (k % 500 / 7.0).alias("pix_min"), (k % 9 + 1).alias("pix_min_count"), ((65535 - k % 3) * (1 + k % 40)).cast("double").alias("pix_max"), (k % 11 + 1).alias("pix_max_count"),
    )


_RESULT = """SELECT sha256(o_orderkey::VARCHAR) AS cache_key, CAST({version} AS INTEGER) AS schema_version, CAST(epoch(o_orderdate) + {later} AS BIGINT) AS computed_at, o_orderkey % 10 <> 0 AS success, CAST(o_orderkey % 40 AS INTEGER) AS star_count,
  o_totalprice / 100000 AS hfr_median, o_totalprice / 1000000 AS hfr_stddev, o_totalprice / 50000 AS fwhm_median, o_orderkey % 100 / 100.0::DOUBLE AS ecc_median, o_totalprice / 10 AS pix_mean, o_custkey / 7.0::DOUBLE AS pix_stddev, o_totalprice AS pix_median,
  o_custkey / 3.0::DOUBLE AS pix_mad, o_orderkey % 500 / 7.0::DOUBLE AS pix_min, o_orderkey % 9 + 1 AS pix_min_count, CAST((65535 - o_orderkey % 3) * (1 + o_orderkey % 40) AS DOUBLE) AS pix_max, o_orderkey % 11 + 1 AS pix_max_count FROM orders"""
STORE = f"store AS ({_RESULT.format(version='2 + o_orderkey % 2', later='0')} WHERE o_orderkey % 3 = 0)"
INCOMING = f"incoming AS ({_RESULT.format(version='3', later='86400')})"
