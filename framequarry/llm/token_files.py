"""Token files: flat unsigned integers in ascending doc_id order, with 64-bit document offsets, read by memory map.

A dataset is a folder of shards ``NNNNNN.bin`` (ids, no header), ``NNNNNN.off`` (uint64: each document's first id,
counted from the shard's start, and the end) and ``NNNNNN.ids`` (int64 document ids). Shards are consecutive ranges
of doc_id, so their order is the order of the corpus. The manifest has one row per shard; a shard's base is the sum
of the ids before it (a prefix sum over the manifest). A task writes its shard under a name of its own and renames
it when complete, so a task that is run again after a lost executor leaves the same bytes.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize, shared_dir
from .tokens import encoder

MANIFEST = "shard int, first_doc long, documents long, tokens long, width int"
#: Documents handed back to Spark at once.
ROWS = 20_000


def file_system(uri: str):
    """(file system, path) of a URI, for tasks; any store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int | None, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write the token files of ``docs`` (doc_id, text) and return (folder, manifest).

    Null texts are empty: they hold only ``end_id`` (nothing if that is None). Rows that repeat a doc_id stay, side by
    side, ordered by text; rows without doc_id, which have no place in the order, are left out. An empty table has no shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    folder = folder or shared_dir(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, shard = encoder(tokenizer), TaskContext.get().partitionId()
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        fs, root = file_system(folder)
        out, names, offsets, ids, total = None, f"{shard:06d}", [0], [], 0
        part = f"{root}/.{names}-{uuid.uuid4().hex}"
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs.create_dir(root, recursive=True)
                out = fs.open_output_stream(f"{part}.bin")
            for i in range(batch.num_rows):
                blob = enc.encode(batch.column(1)[i].as_py()) + end
                out.write(blob)
                total += len(blob) // enc.dtype.itemsize
                offsets.append(total)
            ids.append(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8"))
        if out is None:
            return
        out.close()
        all_ids = np.concatenate(ids)
        for suffix, data in ((".off", np.array(offsets, "<u8")), (".ids", all_ids)):
            with fs.open_output_stream(part + suffix) as f:
                f.write(data.tobytes())
        for suffix in (".bin", ".off", ".ids"):
            fs.move(part + suffix, f"{root}/{names}{suffix}")
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "first_doc": [int(all_ids[0])], "documents": [len(all_ids)], "tokens": [total], "width": pa.array([enc.dtype.itemsize], pa.int32())})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    manifest = materialize(rows.mapInArrow(write, MANIFEST), "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return folder, manifest.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def open_shard(folder: str, shard: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of a shard: memory-mapped where the store is a local or mounted file system."""
    from pyarrow import fs as pafs

    fs, root = file_system(folder)
    out = []
    for suffix, kind in ((".bin", f"<u{width}"), (".off", "<u8"), (".ids", "<i8")):
        path = f"{root}/{shard:06d}{suffix}"
        if isinstance(fs, pafs.LocalFileSystem):
            out.append(np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, kind))
        else:
            with fs.open_input_file(path) as f:
                out.append(np.frombuffer(f.read(), dtype=kind))
    return tuple(out)


def read_tokens(folder: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, off, docs = open_shard(folder, row["shard"], row["width"])
                for a in range(0, len(docs), ROWS):
                    b = min(a + ROWS, len(docs))
                    at = off[a : b + 1].astype(np.int64)
                    data = {
                        "doc_id": pa.array(np.asarray(docs[a:b])),
                        "start": pa.array(at[:-1] + row["base"]),
                        "n_tokens": pa.array(np.diff(at)),
                        "ids_crc32": pa.array([zlib.crc32(ids[x:y].astype("<u4").data) for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.int64()),
                    }
                    if with_ids:
                        data["ids"] = pa.array([ids[x:y].astype("i4") for x, y in zip(at[:-1], at[1:], strict=True)], pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_pydict(data)

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("shard", "width", "base").repartition(tasks, "shard").mapInArrow(read, schema)
