"""Header cards to typed columns: value clean-up, first-match lookup, numbers, dates and the catalog row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions.text import general


#: White space of a value.
SPACE = " \t\n\x0b\f\r"


def trim_value(value: Column) -> Column:
    """Without outer white space; a quoted value also loses its quotes and the white space before the last one."""
    t = F.btrim(value, F.lit(SPACE))
    quoted = t.startswith("'") & t.endswith("'") & (F.length(t) >= 2)
    return F.when(quoted, F.rtrim(F.substring(t, F.lit(2), F.length(t) - 2), F.lit(SPACE))).otherwise(t)


def lookup(cards: DataFrame, keys: list[str]) -> DataFrame:
    """First card of each key, whatever its case: one column per key, all in one aggregation.

    A card's key is looked up once, not once for each of ``keys``.
    """
    place = F.array_position(F.array(*[F.lit(k.upper()) for k in keys]), F.upper("key")).cast("int")
    placed = cards.select("frame_id", "card_idx", "value", place.alias("place"))
    firsts = [F.expr(f"min_by(value, card_idx) FILTER (WHERE place = {i})").alias(k) for i, k in enumerate(keys, 1)]
    return placed.groupBy("frame_id").agg(*firsts)


def to_double(value: Column) -> Column:
    """Leading number of a text; null without one."""
    return F.regexp_extract(value, r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1).try_cast("double")


def to_long(value: Column) -> Column:
    return F.regexp_extract(value, r"^\s*([+-]?\d+)", 1).try_cast("long")


DATE = r"^\s*(\d{1,4})-(\d{1,2})-(\d{1,2})(?:T(\d{1,2})(?::(\d{1,2})(?::(\d+(?:\.\d*)?|\.\d+))?)?)?"


def date_obs(value: Column) -> Column:
    """Observation time in UTC from an ISO text (time may be partial); null where there is no such moment from 1601 on."""
    part = lambda i: F.regexp_extract(value, DATE, i)
    num = lambda i: F.coalesce(part(i).try_cast("int"), F.lit(0))
    seconds = F.coalesce(part(6).try_cast("double"), F.lit(0.0))
    millis = F.floor(F.round(seconds * 1000, 6)) / 1000
    ok = (num(1) >= 1601) & (num(4) < 24) & (num(5) < 60) & (seconds < 60)
    return F.when(ok, F.try_make_timestamp(num(1), num(2), num(3), num(4), num(5), millis.cast("decimal(8,3)")))


def ticks(ts: Column) -> Column:
    """100-nanosecond ticks since 1601."""
    return (F.unix_micros(ts) + 11644473600000000) * 10


CATALOG_KEYS = ["OBJECT", "EXPTIME", "EXPOSURE", "FILTER", "DATE-OBS", "GAIN", "CCD-TEMP", "CCDTEMP", "TELESCOP", "INSTRUME", "OFFSET", "BAYERPAT", "FOCALLEN", "FOCRATIO", "FOCPOS", "FOCUSPOS", "IMAGETYP", "SWCREATE"]


def catalog(cards: DataFrame, frames: DataFrame | None = None) -> DataFrame:
    """One typed row per frame; with ``frames`` (frame_id, width, height) also its sizes, positive or null, and dimensions."""
    if frames is not None:
        side = lambda k: F.when(F.col(k) > 0, F.col(k)).alias(k)
        sizes = frames.select("frame_id", side("width"), side("height"), F.format_string("%d x %d", F.coalesce("width", F.lit(0)), F.coalesce("height", F.lit(0))).alias("dimensions"))
        return sizes.join(catalog(cards), "frame_id", "left")
    found = lookup(cards, CATALOG_KEYS)
    c = found.select("frame_id", *[trim_value(F.col(f"`{k}`")).alias(k) for k in CATALOG_KEYS])
    text = lambda k: F.when(F.col(f"`{k}`") != "", F.col(f"`{k}`"))
    dbl = lambda *k: F.coalesce(*[to_double(F.col(f"`{x}`")) for x in k])
    whole = lambda *k: F.greatest(F.lit(0).cast("long"), F.coalesce(*[to_long(F.col(f"`{x}`")) for x in k]))
    only = lambda v, *k: F.when(F.coalesce(*[to_long(F.col(f"`{x}`")) for x in k]).isNotNull(), v)
    return c.select(
        "frame_id", text("OBJECT").alias("object"), F.round(dbl("EXPTIME", "EXPOSURE"), 2).alias("exposure_s"), text("FILTER").alias("filter"), date_obs(F.col("`DATE-OBS`")).alias("date_obs"),
        only(whole("GAIN"), "GAIN").alias("gain"), F.round(dbl("CCD-TEMP", "CCDTEMP"), 1).alias("ccd_temp"), text("TELESCOP").alias("telescope"), text("INSTRUME").alias("instrument"),
        only(whole("OFFSET"), "OFFSET").alias("offset"), text("BAYERPAT").alias("bayer_pattern"), F.round(dbl("FOCALLEN"), 0).alias("focal_length"), F.round(dbl("FOCRATIO"), 1).alias("focal_ratio"),
        only(whole("FOCPOS", "FOCUSPOS"), "FOCPOS", "FOCUSPOS").alias("focuser_position"), text("IMAGETYP").alias("image_type"), text("SWCREATE").alias("software"),
    )


def exif_cards(exif: DataFrame) -> DataFrame:
    """Cards from a camera table (frame_id, make, model, shutter, iso, aperture, focal_len, taken in epoch seconds)."""
    number = lambda v: F.when(v > 0, general(v))
    pairs = [
        ("INSTRUME", F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in ("make", "model")])),
        ("EXPTIME", number(F.col("shutter"))), ("ISO", F.when(F.col("iso") > 0, F.floor(F.col("iso") + 0.5).cast("string"))), ("FNUMBER", number(F.col("aperture"))), ("FOCALLEN", number(F.col("focal_len"))),
        ("DATE-OBS", F.when(F.col("taken") > 0, F.date_format(F.timestamp_seconds("taken"), "yyyy-MM-dd'T'HH:mm:ss"))),
    ]
    listed = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda c: c["value"] != "")
    return exif.select("frame_id", F.posexplode(listed).alias("card_idx", "c")).select("frame_id", F.col("card_idx").cast("long").alias("card_idx"), "c.key", "c.value")


def guard(frames: DataFrame, most_side: int = 100_000, most_pixels: int = 1_000_000_000) -> DataFrame:
    """``frames`` with ``error``: why the geometry is refused, or null."""
    w, h = F.col("width"), F.col("height")
    return frames.withColumn("error", F.when((w <= 0) | (h <= 0), "empty geometry").when((w > most_side) | (h > most_side), "side too long").when(w * h > most_pixels, "too many pixels"))


def split_valid(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    g = guard(frames)
    return g.where("error IS NULL").drop("error"), g.where("error IS NOT NULL")
