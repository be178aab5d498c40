"""Frame files read by byte ranges: headers without pixels, and pixels by ranges of rows.

``frame_headers`` is a data source that reads a file block by block up to the end of its first image header; units before
it are stepped over by their sizes, so what is read does not grow with the pixels. Columns that a query does not ask for
by its schema are not made, and a listing alone opens no file. From a header follow the file's row ranges, narrow rows
that are dealt to as many tasks as there are ranges: one large frame is many tasks, no task holds more than a range, and
the size of a file has no limit. The pixels are the same as those of ``frames.tiles``.

Paths are those that ``pyarrow.fs`` opens; for other stores ``frames.read_frames`` and ``frames.tiles`` go through Spark.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from framequarry.functions.mosaic import GAIN_RANGE, PATTERNS, demosaic
from framequarry.functions.order_stats import upper_median
from framequarry.functions.store import materialize
from framequarry.sources import frames

#: Columns of a header; ``cache_key`` is read when asked for.
HEADERS = "path string, length long, format string, content binary, data_at long, bytes_read long, error string"
KEYED = HEADERS + ", cache_key string"
RANGES = "path string, name string, kind string, width int, height int, channels int, data_at long, scale double, zero double, flipped boolean, pattern string, dx int, dy int, y0 int, y1 int, error string"
#: Leading bytes of camera files, and the most that a header may take.
RAW_LEADS = (b"II*\0", b"MM\0*")
MOST_HEADER = 32 << 20
#: Bytes of one read of a header, in FITS blocks of 2 880.
WINDOW = 8 * 2880
#: Bytes of a file that its key is made of, beside its size.
HEAD_BYTES = 65536
#: Bytes of a range of rows, about.
RANGE_BYTES = 32 << 20
FILES_A_TASK = 64
RANGES_A_TASK = 64


def opened(path: str):
    """(file system, path in it) of a URI or a local path."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


class ByteRanges:
    """A file that is sliced like bytes, and read in windows of ``WINDOW`` bytes at least; ``read`` counts them."""

    def __init__(self, path: str, most: int | None = None):
        store, inner = opened(path)
        self.file = store.open_input_file(inner)
        self.size = self.file.size() if most is None else min(self.file.size(), most)
        self.read, self.held, self.at = 0, b"", 0

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        if start < self.at or stop > self.at + len(self.held):
            self.held, self.at = self.file.read_at(min(max(stop - start, WINDOW), self.size - start), start), start
            self.read += len(self.held)
        return self.held[start - self.at : stop - self.at]


def header_of(data: ByteRanges | bytes) -> tuple[str, bytes, int | None, str | None]:
    """(format, header, where the pixels begin, error) of a file.

    A FITS header without END is handed out as far as it goes, ``MOST_HEADER`` bytes at most, with an error.
    """
    lead = data[0:16]
    if lead[:8] == b"XISF0100":
        return "xisf", data[0 : 16 + min(int.from_bytes(lead[8:12], "little"), MOST_HEADER)], None, None
    if lead[:4] in RAW_LEADS:
        return "raw", lead, None, None
    first, begin = None, 0
    try:
        for start, stop, keys in frames.units(data):
            own = stop - start
            first = first or (start, own)
            begin = stop
            if frames.image_axes(keys):
                return "fits", data[start:stop], stop, None
            # The next header begins after this unit's data.
            begin = frames.next_unit(stop, keys)
    except ValueError as e:
        if first is None:
            return "fits", data[begin : begin + MOST_HEADER], None, str(e)
    if first is None:
        return "fits", data[0:MOST_HEADER], None, "truncated header"
    return "fits", data[first[0] : first[0] + first[1]], None, "no image"


def header_row(path: str, length: int, columns: Sequence[str]) -> dict:
    """Columns of ``KEYED`` for a file, of which only those of ``columns`` are made for sure."""
    row = {"path": path, "length": length}
    if set(columns) <= {"path", "length"}:
        return row
    try:
        data = ByteRanges(path)
        row |= zip(("format", "content", "data_at", "error"), header_of(data), strict=True)
        if "cache_key" in columns:  # as ``results.content_key`` has it
            row["cache_key"] = hashlib.sha256(data[0:HEAD_BYTES] + str(length).encode()).hexdigest()
        row["bytes_read"] = data.read
    except OSError as e:
        row["error"] = str(e)[:200]
    return row


@dataclass
class Files(InputPartition):
    found: list[tuple[str, int]]


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.each, self.columns = options["path"], int(options.get("filesATask", FILES_A_TASK)), columns

    def partitions(self) -> Sequence[InputPartition]:
        from pyarrow import fs

        store, inner = opened(self.path)
        lead = self.path[: len(self.path) - len(inner)] if "://" in self.path and self.path.endswith(inner) else ""
        info = store.get_file_info(inner)
        listed = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True))
        known = sorted((lead + f.path, f.size) for f in listed if f.type == fs.FileType.File and f".{f.base_name.rpartition('.')[2].lower()}" in frames.EXTENSIONS)
        return [Files(known[i : i + self.each]) for i in range(0, len(known), self.each)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path, length in partition.found:
            row = header_row(path, length, self.columns)
            yield tuple(row.get(c) for c in self.columns)


class HeaderSource(DataSource):
    """``spark.read.format("frame_headers").load(folder)``: a row of ``HEADERS`` for each frame file below the folder."""

    @classmethod
    def name(cls) -> str:
        return "frame_headers"

    def schema(self) -> str:
        return HEADERS

    def reader(self, schema: StructType) -> DataSourceReader:
        return HeaderReader(self.options, schema.names)


def read_headers(spark: SparkSession, path: str, columns: Sequence[str] | None = None, files_a_task: int = FILES_A_TASK) -> DataFrame:
    """Headers of the frame files below ``path``; the columns are ``HEADERS``, or those of ``KEYED`` that are named."""
    spark.dataSource.register(HeaderSource)
    kinds = dict(c.split() for c in KEYED.split(", "))
    schema = HEADERS if columns is None else ", ".join(f"{c} {kinds[c]}" for c in columns)
    return spark.read.format("frame_headers").option("filesATask", files_a_task).schema(schema).load(path)


def headers_of(files: DataFrame) -> DataFrame:
    """Headers, with cache_key, of the files of a listing (path, length), which may be a batch of a stream."""
    names = [c.split()[0] for c in KEYED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=names).astype({"data_at": "Int64", "bytes_read": "Int64"})
        rows, held = [], 0
        for pdf in batches:
            for path, length in zip(pdf["path"], pdf["length"], strict=True):
                row = header_row(path, int(length), names)
                rows.append([row.get(c) for c in names])
                held += len(row.get("content") or b"")
                if held > MOST_HEADER or len(rows) >= 1000:
                    yield frame(rows)
                    rows, held = [], 0
        if rows:
            yield frame(rows)

    return files.select("path", "length").mapInPandas(run, KEYED)


def cards(headers: DataFrame) -> DataFrame:
    """Cards (frame_id, which is the path, card_idx, key, value, comment) of FITS and XISF headers."""
    h = headers.select(F.col("path").alias("frame_id"), "format", "content")
    return frames.union_cards(frames.fits_cards(h.where("format = 'fits'")), frames.xisf_cards(h.where("format = 'xisf'"))[1])


def _geometry(path: str, kind: str, header: bytes, data_at: int | None, length: int) -> dict:
    """Geometry of a file; raises ValueError where ``frames.tiles`` has an error."""
    if kind == "xisf":
        image = frames.xisf_image(header)
        at, size = image.start, image.size
        if at > length or size > length - at or image.need > size:
            raise ValueError("pixels outside the file")
        return {"kind": image.kind, "width": image.width, "height": image.height, "channels": image.planes, "data_at": at, "scale": 1.0, "zero": 0.0, "flipped": False}
    _, _, keys = next(frames.units(header), (0, 0, {}))
    axes, sample = frames.image_axes(keys), frames.FITS_TYPES.get(int(keys.get("BITPIX", 0)))
    if not axes or not sample or data_at is None:
        raise ValueError("no image")
    image = frames.fits_image(axes, sample, keys)
    if length - data_at < image.need:
        raise ValueError("truncated pixels")
    pattern = {"pattern": image.pattern, "dx": image.dx, "dy": image.dy} if image.pattern else {}
    return {"kind": sample, "width": image.width, "height": image.height, "channels": image.planes, "data_at": data_at, "scale": image.scale, "zero": image.zero, "flipped": True} | pattern


def row_ranges(headers: DataFrame, tile: int = 256, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Ranges of whole rows of tiles of all frames, ``range_bytes`` of the file each or one row of tiles; a row with
    ``error`` for a file whose pixels cannot be read. A frame's name is its cache_key, if ``headers`` have one, or its path."""
    names = [x.split()[0] for x in RANGES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h in pdf.itertuples():
                try:
                    if h.error:
                        raise ValueError(h.error)
                    g = _geometry(h.path, h.format, bytes(h.content), None if pd.isna(h.data_at) else int(h.data_at), int(h.length))
                except Exception as e:  # noqa: BLE001  any broken file becomes an error row
                    rows.append({"path": h.path, "name": h.name, "error": str(e)[:200] or type(e).__name__})
                    continue
                line = g["width"] * np.dtype(g["kind"]).itemsize * g["channels"]
                step = tile * max(1, range_bytes // (line * tile))
                rows += [{"path": h.path, "name": h.name, "y0": y, "y1": min(y + step, g["height"])} | g for y in range(0, g["height"], step)]
            out = pd.DataFrame(rows, columns=names)
            for c in ("width", "height", "channels", "data_at", "dx", "dy", "y0", "y1"):
                out[c] = out[c].astype("Int64")
            for c in ("path", "name", "kind", "pattern", "error"):
                out[c] = out[c].astype(object).where(out[c].notna(), None)
            yield out.astype({"flipped": "boolean"})

    name = F.coalesce("cache_key", "path") if "cache_key" in headers.columns else F.col("path")
    return headers.select("path", name.alias("name"), "length", "format", "content", "data_at", "error").mapInPandas(run, RANGES)


def planes_of(data: ByteRanges, r, y0: int, y1: int) -> np.ndarray:
    """(channels, y1 - y0, width) float32 of rows counted from the top, before demosaicing."""
    kind = np.dtype(r.kind)
    first = r.height - y1 if r.flipped else y0
    out = np.empty((int(r.channels), y1 - y0, int(r.width)), np.float32)
    for p in range(int(r.channels)):
        at = int(r.data_at) + (p * int(r.height) + first) * int(r.width) * kind.itemsize
        raw = data.file.read_at((y1 - y0) * int(r.width) * kind.itemsize, at)
        if len(raw) < (y1 - y0) * int(r.width) * kind.itemsize:
            raise ValueError("truncated pixels")
        v = np.frombuffer(raw, kind).reshape(y1 - y0, int(r.width))
        v = v.astype(np.float64) * r.scale + r.zero if r.flipped else v.astype(np.float32)
        out[p] = np.where(np.isfinite(v), v, 0)[:: -1 if r.flipped else 1]
    return out


def coloured(data: ByteRanges, r, y0: int, y1: int) -> np.ndarray:
    """``planes_of``, demosaiced where the frame has a colour filter pattern: a row more is read at either end."""
    if not r.pattern:
        return planes_of(data, r, y0, y1)
    a, b = max(0, y0 - 1), min(int(r.height), y1 + 1)
    native = planes_of(data, r, a, b)[0][::-1]  # rows in the order of the file
    rgb = demosaic(native, r.pattern, int(r.dx), int(r.dy) + int(r.height) - b)
    return rgb[:, ::-1][:, y0 - a : y1 - a]


def _dealt(ranges: DataFrame) -> DataFrame:
    """``ranges``, a written table, dealt to tasks of about ``RANGE_BYTES`` or ``RANGES_A_TASK`` ranges each: narrow rows,
    whatever the sizes of their files. A large frame is many tasks, as many as it has ranges, and many small files are few.
    A frame of one range lies where ``tiletable`` has its bucket, if there are as many buckets as tasks. Rows with an error are dealt as well."""
    line = F.col("width").cast("long") * F.col("channels") * F.substring("kind", 3, 1).cast("int")
    rows = F.col("y1") - F.col("y0")
    of_one = F.max(F.when(F.col("y0") == 0, F.ceil(F.col("height") / rows)))  # ranges of the frame that is cut most
    n, size, most = ranges.agg(F.count("*"), F.coalesce(F.sum(rows * line), F.lit(0)), F.coalesce(of_one, F.lit(0))).first()
    tasks = max(-(-size // RANGE_BYTES), -(-n // RANGES_A_TASK), most, ranges.sparkSession.sparkContext.defaultParallelism)
    tasks = max(1, min(tasks, n, 20_000))
    dealt = ranges.repartition(tasks, "name", "y0")
    dealt.tasks = tasks
    return dealt


def gains(ranges: DataFrame, target: int = 100_000) -> DataFrame:
    """(path, gain, an array by channel) of the frames with a colour filter pattern, from the medians of a raster sample
    as ``mosaic.balanced`` takes them; frames that are left as they are have no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for r in pdf.itertuples():
                rgb = coloured(ByteRanges(r.path), r, int(r.y0), int(r.y1))[:, ::-1]
                step = max(1, int(r.width) * int(r.height) // target)
                start = (int(r.height) - int(r.y1)) * int(r.width)  # the sample counts in the order of the file
                flat = rgb.reshape(3, -1)[:, (-start) % step :: step]
                yield pd.DataFrame({"path": r.path, "c": np.repeat([0, 1, 2], flat.shape[1]), "v": flat.ravel().astype(float)})

    sample = ranges.where("pattern IS NOT NULL").mapInPandas(run, "path string, c int, v double")
    medians = sample.groupBy("path", "c").agg(upper_median("v").alias("m")).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("c", "m")))["m"].alias("m"))
    mean = F.aggregate("m", F.lit(0.0), lambda s, v: s + v) / 3
    low, high = GAIN_RANGE
    return medians.where(F.array_min("m") > 0).select("path", F.transform("m", lambda v: F.greatest(F.lit(low), F.least(F.lit(high), mean / v))).alias("gain"))


def tiles(headers: DataFrame, tile: int = 256, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The rows of ``frames.tiles``, read range by range. What is shuffled are the ranges, a narrow row each."""
    spark = headers.sparkSession
    ranges = materialize(row_ranges(headers, tile, range_bytes), "frame-ranges")
    return range_tiles(spark, ranges, tile)


def range_tiles(spark: SparkSession, ranges: DataFrame, tile: int) -> DataFrame:
    """Tiles of ``ranges`` (written), and the rows with errors as they are. ``tasks`` of the result is the number of tasks
    that they are dealt to."""
    names = [x.split()[0] for x in frames.TILES.split(", ")]
    dealt = _dealt(ranges)
    tasks = dealt.tasks
    if not ranges.where("pattern IS NOT NULL").isEmpty():
        dealt = dealt.join(materialize(gains(dealt), "frame-gains"), "path", "left")
    else:
        dealt = dealt.withColumn("gain", F.lit(None).cast("array<double>"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for pdf in batches:
            for r in pdf.itertuples():
                if isinstance(r.error, str):
                    rows.append([r.name, *[None] * 12, r.error])
                    continue
                try:
                    for row in rows_of(r):
                        rows += row
                        held += sum(x[8] * x[9] for x in row)
                        if held >= frames.HELD:
                            yield pd.DataFrame(rows, columns=names)
                            rows, held = [], 0
                except Exception as e:  # noqa: BLE001  a range that cannot be read is an error row
                    yield pd.DataFrame([[r.name, *[None] * 12, str(e)[:200] or type(e).__name__]], columns=names)
        if rows:
            yield pd.DataFrame(rows, columns=names)

    def rows_of(r) -> Iterator[list]:
        data, width, height = ByteRanges(r.path), int(r.width), int(r.height)
        for y0 in range(int(r.y0), int(r.y1), tile):
            v = coloured(data, r, y0, min(y0 + tile, height))
            if r.gain is not None:
                v = (v * np.asarray(r.gain, np.float64)[:, None, None]).astype(np.float32)
            rows = []
            for x0 in range(0, width, tile):
                flat = [p.ravel() for p in v[:, :, x0 : x0 + tile]]
                rows.append([r.name, width, height, len(v), y0 // tile, x0 // tile, y0, x0, v.shape[1], min(tile, width - x0), flat[0], *(flat[1:] if len(v) == 3 else (None, None)), None])
            yield rows

    read = dealt.mapInPandas(run, frames.TILES)
    read.tasks = tasks
    return read


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Write ``files`` (path: the name of a file, content) below ``folder``, which all executors share; (path, length) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, inner = opened(folder)
        store.create_dir(inner, recursive=True)
        for batch in batches:
            sizes = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = content.as_py() or b""
                with store.open_output_stream(f"{inner}/{name}") as out:
                    out.write(data)
                sizes.append(len(data))
            yield pa.RecordBatch.from_pydict({"path": pa.array([f"{folder}/{x}" for x in batch.column(0).to_pylist()], pa.string()), "length": pa.array(sizes, pa.int64())})

    return files.select("path", "content").mapInArrow(run, "path string, length long")
