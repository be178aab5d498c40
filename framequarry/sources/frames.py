"""Readers of frame files: listing, format detection, FITS and XISF headers and pixel tiles.

Files are ``binaryFile`` rows. Headers are cut into cards in Arrow batches, and cards parsed with built-in functions; pixels are
decoded to tiles file by file in batches, so a file that cannot be read is an error row and never a failed job.
"""

from __future__ import annotations

import contextlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from xml.parsers import expat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions.mosaic import PATTERNS, balanced, demosaic
from framequarry.sources.headers import lookup, to_long, trim_value

# Extensions of frame files, FITS sample types by BITPIX and XISF sample formats.
EXTENSIONS = [".fit", ".fits", ".xisf", ".cr2", ".nef", ".arw", ".dng", ".raf", ".orf", ".rw2", ".pef", ".srw"]
FITS_TYPES = {8: ">u1", 16: ">i2", 32: ">i4", -32: ">f4", -64: ">f8"}
XISF_TYPES = {"UInt8": "<u1", "UInt16": "<u2", "UInt32": "<u4", "Float32": "<f4", "Float64": "<f8", "Int16": "<i2", "Int32": "<i4"}
TILES = "path string, width int, height int, channels int, ty int, tx int, y0 int, x0 int, h int, w int, r array<float>, g array<float>, b array<float>, error string"
#: Pixels of the tiles that are handed on together, about.
HELD = 1 << 19
MOST_SIDE, MOST_PIXELS = 100_000, 1_000_000_000


def read_frames(spark: SparkSession, path: str, header_only: bool = False) -> DataFrame:
    """Frame files below a folder: path, length, and content unless only the listing is wanted."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    df = known_extension(df, "path")
    return df.drop("content") if header_only else df


def known_extension(files: DataFrame, name: str = "name") -> DataFrame:
    return files.where(F.lower(F.regexp_extract(name, r"\.[^./]+$", 0)).isin(EXTENSIONS))


def detect_format(files: DataFrame) -> DataFrame:
    """``files`` with ``format`` by the leading bytes: xisf, raw, else fits."""
    lead = lambda n: F.hex(F.substring("content", 1, n))
    return files.withColumn("format", F.when(lead(8) == F.lit(b"XISF0100".hex().upper()), "xisf").when(lead(4).isin("49492A00", "4D4D002A"), "raw").otherwise("fits"))


#: Bytes of a header that are looked at first for its END: ten blocks.
FIRST_LOOK = 10 * 2880


def _grid(content, most: int | None = None) -> np.ndarray:
    """Whole cards of 80 bytes at the start of a binary Arrow value, a row each."""
    held = content.as_buffer() if content.is_valid else b""
    size = len(held) if most is None else min(len(held), most)
    return np.frombuffer(held, np.uint8, size // 80 * 80).reshape(-1, 80)


def _ends(grid: np.ndarray) -> np.ndarray:
    return np.flatnonzero((grid[:, :8] == np.frombuffer(b"END     ", np.uint8)).all(1))


def _texts(grid: np.ndarray) -> pa.Array:
    if grid.size and grid.max() > 127:
        return pa.array([row.tobytes().decode("latin-1") for row in grid], pa.string())
    return pa.StringArray.from_buffers(len(grid), pa.py_buffer((np.arange(len(grid) + 1) * 80).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(grid)))


def _card_rows(files: DataFrame) -> DataFrame:
    """(frame_id, card_idx, card, plain) of the named cards up to END; ``plain`` cards are printable ASCII.

    END is looked for in the first ``FIRST_LOOK`` bytes of all contents of a batch at once, and only where it is not there
    in all of a content. A batch is handed on in pieces.
    """

    def pieces(contents: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        grids = [_grid(c, FIRST_LOOK) for c in contents]
        cards, counts = np.concatenate(grids), np.array([len(g) for g in grids])
        stop = np.cumsum(counts)
        start, ends = stop - counts, _ends(cards)
        first = np.append(ends, len(cards) + 1)[np.searchsorted(ends, start)]
        found = first < stop
        longer = ~found & (counts == FIRST_LOOK // 80)
        kept = np.where(longer, 0, np.minimum(first, stop) - start)
        row = np.repeat(np.arange(len(grids)), kept)
        yield row, cards[np.repeat(start - (np.cumsum(kept) - kept), kept) + np.arange(len(row))]
        for i in np.flatnonzero(longer):
            whole = _grid(contents[int(i)])
            whole = whole[: _ends(whole)[0]] if len(_ends(whole)) else whole
            yield np.full(len(whole), i), whole

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, cards in pieces(batch.column(1)) if batch.num_rows else ():
                named = (cards[:, :8] != 32).any(1)
                row, cards = row[named], cards[named]
                if len(row):
                    first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                    idx = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
                    plain = ((cards >= 32) & (cards < 127)).all(1)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(idx.astype(np.int64)), _texts(cards), pa.array(plain)], ["frame_id", "card_idx", "card", "plain"])

    kind = files.schema["frame_id"].dataType.simpleString()
    return files.select("frame_id", "content").mapInArrow(run, f"frame_id {kind}, card_idx long, card string, plain boolean")


def fits_cards(files: DataFrame) -> DataFrame:
    """Cards (frame_id, card_idx, key, value, comment) of the header that ``content`` begins with, up to END.

    Commentary cards (COMMENT, HISTORY, any without a value sign) have an empty value and their text as comment; cards
    without a name are left out. Works on truncated content. Cards are cut in Arrow batches and parsed by built-in
    functions, by regular expressions only where a card has doubled quotes or other than printable characters; nothing
    is shuffled.
    """
    part = lambda c, i: F.substring(c, F.lit(i) if isinstance(i, int) else i, F.lit(80))
    c = _card_rows(files).select("frame_id", "card_idx", "plain", F.trim(F.substring("card", 1, 8)).alias("key"), (F.substring("card", 9, 1) == "=").alias("has"), F.substring("card", 11, 70).alias("rest"), F.substring("card", 9, 72).alias("free"))
    c = c.withColumn("t", F.ltrim("rest")).withColumn("body", F.when(F.col("t").startswith("'"), F.substring_index(part("t", 2), "'", 1)))
    size = F.length("body")
    c = c.withColumn("after", F.when(F.length("t") >= size + 2, part("t", size + 3)))  # behind the closing quote
    c = c.withColumn("tail", F.ltrim("after")).withColumn("slash", F.instr("rest", "/"))
    odd = ~F.col("plain") | F.coalesce(F.col("after").startswith("'"), F.lit(False))
    closed = F.coalesce((F.col("tail") == "") | F.col("tail").startswith("/"), F.lit(False))
    # The same by regular expressions, for all cards.
    rest = F.col("rest")
    quoted = F.regexp_extract(rest, r"^\s*('(?:[^']|'')*')\s*(?:/\s*(.*))?$", 1)
    slow_value = F.when(quoted != "", F.regexp_replace(trim_value(quoted), "''", "'")).otherwise(F.trim(F.regexp_extract(rest, r"^([^/]*)", 1)))
    slow_comment = F.when(quoted != "", F.regexp_extract(rest, r"^\s*'(?:[^']|'')*'\s*(?:/\s*(.*))?$", 1)).otherwise(F.regexp_extract(rest, r"/\s*(.*)$", 1))
    value = F.when(odd, slow_value).when(closed, F.rtrim("body")).otherwise(F.trim(F.substring_index("rest", "/", 1)))
    comment = F.when(odd, slow_comment).when(closed, F.ltrim(part("tail", 2))).when(F.col("slash") > 0, F.ltrim(part("rest", F.col("slash") + 1))).otherwise("")
    has = F.col("has")
    return c.select("frame_id", "card_idx", "key", F.when(has, value).otherwise("").alias("value"), F.rtrim(F.when(has, comment).otherwise(F.col("free"))).alias("comment"))


def image_units(files: DataFrame) -> DataFrame:
    """``files`` with ``content`` from the header of the first image unit on, and only that header where it is an extension.

    Content whose primary unit has an image, as nearly all have, is passed on as it is; only the others are walked.
    """
    head = F.decode(F.substring("content", 1, 2880), "ISO-8859-1")
    axes = F.regexp_extract(head, r"NAXIS {3}= *(\d+)", 1).try_cast("int")
    names = files.columns
    at = names.index("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [image_header(c.as_py()) for c in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(heads, batch.schema.field(at).type))

    tagged = files.withColumn("__axes", axes)
    return tagged.where("__axes >= 2 OR __axes IS NULL").drop("__axes").union(tagged.where("__axes < 2").drop("__axes").mapInArrow(run, files.schema))


def image_header(data: bytes) -> bytes:
    """Header of the first image unit of a FITS file; of the primary unit if there is none."""
    first = None
    for start, stop, keys in units(data or b""):
        first = first if first is not None else data[start:stop]
        if image_axes(keys):
            return data[start:stop]
    return first if first is not None else (data or b"")


def frame_sizes(cards: DataFrame) -> DataFrame:
    """(frame_id, width, height) from the axes of FITS headers; sizes that are not positive are null."""
    c = lookup(cards, ["NAXIS1", "NAXIS2"])
    side = lambda k: F.when(to_long(F.col(k)) > 0, to_long(F.col(k)))
    return c.select("frame_id", side("NAXIS1").alias("width"), side("NAXIS2").alias("height"))


def xisf_header(files: DataFrame) -> DataFrame:
    """``files`` with ``xml``: the header, by its length at byte 8; null where a file is not of format xisf."""
    little = lambda o: F.conv(F.hex(F.substring("content", o, 1)), 16, 10).cast("long")
    size = little(9) + little(10) * 256 + little(11) * 65536 + little(12) * 16777216
    ok = (F.hex(F.substring("content", 1, 8)) == b"XISF0100".hex().upper()) & (F.length("content") >= 16)
    return files.withColumn("__n", size).withColumn("xml", F.when(ok, F.expr("substring(content, 17, CAST(least(__n, length(content)) AS INT))"))).drop("__n")


IMAGE = ("geometry", "sampleFormat", "colorSpace", "location")


def image_of(xml: str) -> tuple[dict[str, str], list[dict[str, str]]]:
    """(attributes of the first image, keywords of the images that are the first below their parent) of an XISF header, in
    one pass. A header that breaks off gives what stands before."""
    first: dict[str, str] | None = None
    keywords: list[dict[str, str]] = []
    open_: list[list[bool]] = [[False, False]]  # per open element: has an image, is the first image of its parent

    def begin(name: str, attributes: dict[str, str]) -> None:
        nonlocal first
        parent = open_[-1]
        image = name == "Image" and not parent[0]
        if image:
            parent[0] = True
            first = attributes if first is None else first
        elif name == "FITSKeyword" and parent[1]:
            keywords.append({k: attributes.get(k, "") for k in ("name", "value", "comment")})
        open_.append([False, image])

    def end(_: str) -> None:
        open_.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler = begin, end
    with contextlib.suppress(expat.ExpatError):
        parser.Parse(xml, True)
    return first or {}, keywords


def xisf_images(files: DataFrame) -> DataFrame:
    """(frame_id, width, height, channels, sample_format, color_space, location, cards: an array of key, value, comment) of
    XISF headers, each parsed once. Other files have no row; they are left out here, not by a condition on ``content``,
    which would be pushed down to where it is made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = pa.string()
        kind = pa.list_(pa.struct([("key", text), ("value", text), ("comment", text)]))
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            found = [image_of(x.decode("utf-8", "replace")) for x in batch.column(1).to_pylist()]
            columns = [pa.array([f.get(a, "") for f, _ in found], text) for a in IMAGE]
            cards = pa.array([[{"key": k["name"], "value": k["value"], "comment": k["comment"]} for k in ks] for _, ks in found], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, cards], ["frame_id", *IMAGE, "cards"])

    kind = files.schema["frame_id"].dataType.simpleString()
    h = xisf_header(files).select("frame_id", "xml").mapInArrow(run, f"frame_id {kind}, {', '.join(f'{a} string' for a in IMAGE)}, cards array<struct<key:string,value:string,comment:string>>")
    geometry = F.split("geometry", ":")
    part = lambda i: F.try_element_at(geometry, F.lit(i)).try_cast("long")
    return h.select("frame_id", part(1).alias("width"), part(2).alias("height"), F.coalesce(part(3), F.lit(1)).alias("channels"), F.col("sampleFormat").alias("sample_format"), F.col("colorSpace").alias("color_space"), "location", "cards")


def image_cards(images: DataFrame, *beside: str) -> DataFrame:
    """Cards (frame_id, the columns ``beside``, card_idx, key, value, comment) of ``xisf_images``."""
    c = images.select("frame_id", *beside, F.posexplode("cards").alias("card_idx", "c"))
    return c.select("frame_id", *beside, F.col("card_idx").cast("long").alias("card_idx"), "c.key", trim_value(F.col("c.value")).alias("value"), "c.comment")


def xisf_cards(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames: frame_id, width, height, channels, sample_format, color_space, location; cards) from XISF headers."""
    images = xisf_images(files)
    return images.drop("cards"), image_cards(images)


def union_cards(*cards: DataFrame) -> DataFrame:
    """One cards table from all formats; columns that a format lacks are null."""
    out = cards[0]
    for c in cards[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def _check(width: int, height: int) -> None:
    if width <= 0 or height <= 0 or width > MOST_SIDE or height > MOST_SIDE or width * height > MOST_PIXELS:
        raise ValueError(f"geometry {width} x {height} is refused")


def units(data: bytes) -> Iterator[tuple[int, int, dict[str, str]]]:
    """(start and stop of the header, its values) of each unit of a FITS file."""
    at = 0
    while at + 2880 <= len(data):
        keys: dict[str, str] = {}
        start, done = at, False
        while not done:
            block = data[at : at + 2880]
            if len(block) < 2880:
                raise ValueError("truncated header")
            at += 2880
            for k in range(0, 2880, 80):
                card = block[k : k + 80].decode("latin-1")
                if card[:8].rstrip() == "END":
                    done = True
                    break
                if card[8] == "=":
                    keys.setdefault(card[:8].strip(), card[10:].split("/")[0].strip().strip("'").strip())
        yield start, at, keys
        at = next_unit(at, keys)


def next_unit(at: int, keys: dict[str, str]) -> int:
    """Where the unit after the one with these values begins, whose data begin at ``at``."""
    axes = [int(keys.get(f"NAXIS{i + 1}", 0)) for i in range(int(keys.get("NAXIS", 0)))]
    size = abs(int(keys.get("BITPIX", 8))) // 8 * (int(keys.get("PCOUNT", 0)) + math.prod(axes)) * int(keys.get("GCOUNT", 1)) if axes else 0
    return at + -(-size // 2880) * 2880


def image_axes(keys: dict[str, str]) -> list[int]:
    """Axes of a unit that holds an image of two dimensions at least, else nothing."""
    axes = [int(keys.get(f"NAXIS{i + 1}", 0)) for i in range(int(keys.get("NAXIS", 0)))]
    return axes if len(axes) >= 2 and (not keys.get("XTENSION") or keys["XTENSION"] == "IMAGE") else []


@dataclass
class Image:
    """Geometry and sample type of an image, and what its samples are turned into values with."""

    kind: str
    width: int
    height: int
    planes: int
    start: int = 0
    size: int = 0
    scale: float = 1.0
    zero: float = 0.0
    pattern: str | None = None
    dx: int = 0
    dy: int = 0

    @property
    def need(self) -> int:
        return self.width * self.height * self.planes * np.dtype(self.kind).itemsize


def fits_image(axes: list[int], kind: str, keys: dict[str, str]) -> Image:
    _check(axes[0], axes[1])
    out = Image(kind, axes[0], axes[1], 3 if len(axes) >= 3 and axes[2] == 3 else 1, scale=float(keys.get("BSCALE") or 1), zero=float(keys.get("BZERO") or 0))
    pattern = keys.get("BAYERPAT", "").strip().upper()
    if out.planes == 1 and pattern in PATTERNS:
        out.pattern = pattern
        out.dx, out.dy = (int(keys.get(a) or keys.get(b) or 0) for a, b in (("XBAYROFF", "BAYOFFX"), ("YBAYROFF", "BAYOFFY")))
    return out


def decode_fits(data: bytes) -> np.ndarray:
    """(channels, height, width) float32, top row first, of the first image unit.

    A plane with a colour filter pattern is demosaiced in its own row order and balanced before it is turned over.
    """
    for _, at, keys in units(data):
        axes, kind = image_axes(keys), FITS_TYPES.get(int(keys.get("BITPIX", 0)))
        if not axes or not kind:
            continue
        image = fits_image(axes, kind, keys)
        if len(data) - at < image.need:
            raise ValueError("truncated pixels")
        v = np.frombuffer(data, kind, image.need // np.dtype(kind).itemsize, at).astype(np.float64) * image.scale + image.zero
        v = np.where(np.isfinite(v), v, 0.0).astype(np.float32).reshape(image.planes, image.height, image.width)
        return (balanced(demosaic(v[0], image.pattern, image.dx, image.dy)) if image.pattern else v)[:, ::-1]
    raise ValueError("no image")


def xisf_image(data: bytes) -> Image:
    """Geometry, sample type and place of the image, from the header that ``data`` begins with."""
    if data[:8] != b"XISF0100" or len(data) < 16:
        raise ValueError("not an XISF file")
    xml = data[16 : 16 + int.from_bytes(data[8:12], "little")].decode("utf-8", "replace")
    image = re.search(r"<Image\b[^>]*>", xml)
    if not image:
        raise ValueError("no image")
    get = lambda a: (re.search(rf'\b{a}="([^"]*)"', image[0]) or [None, ""])[1]
    w, h, c = ([int(x) for x in get("geometry").split(":")] + [1])[:3]
    _check(w, h)
    kind, where = XISF_TYPES.get(get("sampleFormat")), get("location").split(":")
    if kind is None or where[0] != "attachment":
        raise ValueError("unknown sample format or location")
    if get("compression"):
        raise ValueError("compressed pixels are not read")
    return Image(kind, w, h, 3 if c == 3 and get("colorSpace") == "RGB" else 1, int(where[1]), int(where[2]))


def decode_xisf(data: bytes) -> np.ndarray:
    image = xisf_image(data)
    if image.start > len(data) or image.size > len(data) - image.start or image.need > image.size:
        raise ValueError("pixels outside the file")
    v = np.frombuffer(data, image.kind, image.need // np.dtype(image.kind).itemsize, image.start).astype(np.float32)
    return np.where(np.isfinite(v), v, np.float32(0)).reshape(image.planes, image.height, image.width)


def tiles(files: DataFrame, tile: int = 256) -> DataFrame:
    """Pixels of FITS and XISF files (path, content) as tiles, a row each; unreadable files are one row with ``error``."""
    names = [x.split()[0] for x in TILES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    data = bytes(content or b"")
                    v = decode_xisf(data) if data[:8] == b"XISF0100" else decode_fits(data)
                except Exception as e:  # noqa: BLE001  any broken file becomes an error row
                    yield pd.DataFrame([[path, *[None] * 12, str(e)[:200] or type(e).__name__]], columns=names)
                    continue
                planes, height, width = v.shape
                for y0 in range(0, height, tile):
                    for x0 in range(0, width, tile):
                        part = v[:, y0 : y0 + tile, x0 : x0 + tile]
                        flat = [p.ravel() for p in part]
                        rows.append([path, width, height, planes, y0 // tile, x0 // tile, y0, x0, part.shape[1], part.shape[2], flat[0], flat[1] if planes == 3 else None, flat[2] if planes == 3 else None, None])
                    held += v[0, y0 : y0 + tile].size
                    if held >= HELD:
                        yield pd.DataFrame(rows, columns=names)
                        rows, held = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "content").mapInPandas(run, TILES)


def tile_pixels(t: DataFrame) -> DataFrame:
    """Working view of tiles: frame_id (a hash of the path), y, x, r, g, b in double precision."""
    p = t.where("error IS NULL").select(F.xxhash64("path").alias("frame_id"), "path", "y0", "x0", "w", "g", "b", F.posexplode("r").alias("k", "r"))
    at = lambda c: F.element_at(c, F.col("k") + 1).cast("double").alias(c)
    return p.select("frame_id", "path", (F.col("y0") + F.floor(F.col("k") / F.col("w"))).cast("long").alias("y"), (F.col("x0") + F.col("k") % F.col("w")).cast("long").alias("x"), F.col("r").cast("double").alias("r"), at("g"), at("b"))
