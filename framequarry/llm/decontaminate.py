"""Benchmark decontamination: a broadcast hash set of normalised test windows against all training windows.

A window is 13 consecutive words of a benchmark item, or the whole item if it has fewer words. Windows go to the
tasks as a hash set (sorted 64-bit hashes with the places of their words in one byte buffer); every hit is verified by
comparing its words. The benchmark is split into blocks of at most ``block_bytes`` of text, about six times that in
memory; the driver holds one block at a time, and each block is a scan of all rows. Where there are several, the rows
are numbered and written once, each block's hits are written by row number, and all are put together per row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import bounded_batches, free, materialize, scratch

BLOCK_BYTES = 16 << 20
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
FILTER_BITS = 22


class Windows:
    """Hash set of the windows of a block of items (id, text)."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        raw = [(text or "").encode() for _, text in items]
        at = np.zeros(len(raw) + 1, np.int64)
        np.cumsum([len(x) for x in raw], out=at[1:])
        w = ta.words(np.frombuffer(b"".join(raw), np.uint8), at, ta.ALNUM, ta.LOWER)
        self.items = [item for item, _ in items]
        text, start, end = ta.spaced(w, ta.ALNUM, ta.LOWER)
        self.text, self.start, self.end = text, start.astype(np.int32), end.astype(np.int32)
        #: {window length: (sorted hashes, first word of each, item of each)}
        self.sets: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        doc, counts = w.doc, w.counts
        for k in sorted({min(n, c) for c in counts[counts > 0].tolist()}):
            h, fits = w.windows(k)
            mine = np.flatnonzero(fits & ((counts[doc] >= n) if k == n else (counts[doc] == k)))
            order = mine[np.argsort(h[mine], kind="stable")]
            self.sets[k] = h[order], order.astype(np.int32), doc[order].astype(np.int32)

    def words(self, first: int, k: int) -> bytes:
        return self.text[self.start[first] : self.end[first + k - 1]]


class Scanner:
    """Verified hits in chunks of documents."""

    def __init__(self, windows: Windows):
        self.windows = windows
        self.seen = {}
        for k, (keys, _, _) in windows.sets.items():
            self.seen[k] = np.zeros(1 << FILTER_BITS, bool)
            self.seen[k][keys >> ta.U64(64 - FILTER_BITS)] = True

    def hits(self, w: ta.Words) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Whether each word is hit, and the items found in each document of the chunk."""
        edge = np.zeros(len(w.hash) + 1, np.int32)
        items: dict[int, set[str]] = {}
        low, doc = None, None
        for k, (keys, first, item) in self.windows.sets.items():
            h, fits = w.windows(k)
            at = np.flatnonzero(self.seen[k][h >> ta.U64(64 - FILTER_BITS)] & fits)
            lo, hi = np.searchsorted(keys, h[at]), np.searchsorted(keys, h[at], "right")
            for i, a, b in zip(at[hi > lo].tolist(), lo[hi > lo].tolist(), hi[hi > lo].tolist(), strict=True):
                if low is None:
                    low, doc = ta.LOWER[w.data].tobytes(), w.doc
                words = b" ".join(low[s:e] for s, e in zip(w.start[i : i + k].tolist(), w.end[i : i + k].tolist(), strict=True))
                found = {self.windows.items[item[x]] for x in range(a, b) if self.windows.words(int(first[x]), k) == words}
                if found:
                    edge[i] += 1
                    edge[i + k] -= 1
                    items.setdefault(int(doc[i]), set()).update(found)
        return np.cumsum(edge[:-1]) > 0, items


#: What becomes of a slice of rows, given its words, the hit words, and the items of its rows.
Finish = Callable[[pa.RecordBatch, ta.Words, np.ndarray, dict[int, set[str]]], pa.RecordBatch]


def _chunks(batch: pa.RecordBatch, text_at: int) -> Iterator[tuple[pa.RecordBatch, ta.Words]]:
    data, offsets = ta.buffers(batch.column(text_at))
    for i, j in ta.chunks(offsets):
        w = ta.words(data, offsets[i : j + 1], ta.ALNUM, ta.LOWER)
        w.doc_start = offsets[i:j] - offsets[i]
        yield batch.slice(i, j - i), w


def _direct(windows, text_at: int, finish: Finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(windows.value)
        for batch in batches:
            for rows, w in _chunks(batch, text_at):
                yield finish(rows, w, *scanner.hits(w))

    return run


def _by_row(windows):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(windows.value)
        for batch in batches:
            for rows, w in _chunks(batch, 1):
                hit, items = scanner.hits(w)
                found = sorted(items)
                yield pa.RecordBatch.from_pydict({
                    "row": rows.column(0).take(pa.array(found, pa.int64())),
                    "hits": pa.array([np.packbits(hit[w.first[d] : w.first[d + 1]]).tobytes() for d in found], pa.binary()),
                    "items": pa.array([sorted(items[d]) for d in found], pa.list_(pa.string())),
                })

    return run


def _merged(text_at: int, finish: Finish):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, w in _chunks(batch, text_at):
                hit, items = np.zeros(len(w.hash), bool), {}
                every_hit, every_item = rows.column(rows.num_columns - 2), rows.column(rows.num_columns - 1)
                for d in range(rows.num_rows):
                    a, b = w.first[d], w.first[d + 1]
                    for bits in every_hit[d].as_py() or ():
                        hit[a:b] |= np.unpackbits(np.frombuffer(bits, np.uint8), count=b - a).astype(bool)
                    if found := every_item[d].as_py():
                        items[d] = set(found)
                yield finish(pa.RecordBatch.from_arrays(rows.columns[:-2], schema=pa.schema(list(rows.schema)[:-2])), w, hit, items)

    return run


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, Callable[[int], list[tuple[str, str]]]]:
    """(number of blocks, the items of a block). An item is in one block, whatever its size; repeated rows are one."""
    b = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("item_id IS NOT NULL AND text IS NOT NULL")
    size = b.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-2 * size // block_bytes) if size > block_bytes else 1

    def block(i: int) -> list[tuple[str, str]]:
        return [(r.item, r.text) for r in (b if n == 1 else b.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)).toLocalIterator()]

    return n, block


def _judged(docs: DataFrame, benchmark: DataFrame, n: int, block_bytes: int, finish: Finish, schema) -> DataFrame:
    """``finish`` over all rows of ``docs``, the same for any number of blocks."""
    spark = docs.sparkSession
    bounded_batches(spark)
    text_at = docs.columns.index("text")
    blocks, block = _blocks(benchmark, block_bytes)
    if blocks == 1:
        return docs.mapInArrow(_direct(spark.sparkContext.broadcast(Windows(block(0), n)), text_at, finish), schema)
    with scratch(spark):
        row, hits, items = free(docs, "row", "hits", "items")
        numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "decontamination-rows", compression="zstd")
        found = None
        for i in range(blocks):
            windows = spark.sparkContext.broadcast(Windows(block(i), n))
            part = materialize(numbered.select(F.col(row).alias("row"), "text").mapInArrow(_by_row(windows), "row long, hits binary, items array<string>"), "decontamination-hits")
            windows.destroy()
            found = part if found is None else found.unionByName(part)
        merged = found.groupBy(F.col("row").alias(row)).agg(F.collect_list("hits").alias(hits), F.array_distinct(F.flatten(F.collect_list("items"))).alias(items))  # one per block at most
        joined = numbered.join(merged, row, "left").select(*[numbered[c] for c in docs.columns], hits, items)
        return materialize(joined.mapInArrow(_merged(text_at, finish), schema), "decontaminated", keep=True, compression="zstd")


def _verdict(w: ta.Words, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hit words, contaminated) per row."""
    n_hit = np.bincount(w.doc[hit], minlength=len(w.counts)) if len(w.counts) else np.zeros(0, int)
    return n_hit, (n_hit > 0) & (20 * n_hit >= w.counts)


def _scanned(rows: pa.RecordBatch, w: ta.Words, hit: np.ndarray, items: dict) -> pa.RecordBatch:
    n_hit, bad = _verdict(w, hit)
    listed = [",".join(sorted(items.get(d, ()))) for d in range(rows.num_rows)]
    return pa.RecordBatch.from_pydict({
        "doc_id": rows.column(0).cast(pa.int64()),
        "n_words": pa.array(w.counts, pa.int64()),
        "n_hit": pa.array(n_hit, pa.int64()),
        "n_items": pa.array([len(items.get(d, ())) for d in range(rows.num_rows)], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(x.encode()).hexdigest() for x in listed], pa.string()),
        "contaminated": pa.array(bad),
    })


def _without_documents(rows: pa.RecordBatch, w: ta.Words, hit: np.ndarray, items: dict) -> pa.RecordBatch:
    return rows.filter(pa.array(~_verdict(w, hit)[1])) if items else rows


def _without_spans(text_at: int) -> Finish:
    def finish(rows: pa.RecordBatch, w: ta.Words, hit: np.ndarray, items: dict) -> pa.RecordBatch:
        if not items:
            return rows
        column = rows.column(text_at)
        texts = column.to_pylist()
        for d in sorted(items):
            a, b = w.first[d], w.first[d + 1]
            on = np.flatnonzero(np.diff(np.concatenate([[False], hit[a:b], [False]]).astype(np.int8)))
            raw, base, parts, at = texts[d].encode(), w.doc_start[d], [], 0
            for s, e in zip(on[::2] + a, on[1::2] + a - 1, strict=True):
                parts.append(raw[at : w.start[s] - base])
                at = w.end[e] - base
            texts[d] = b"".join([*parts, raw[at:]]).decode()
        return rows.set_column(text_at, rows.schema.field(text_at), pa.array(texts, column.type))

    return finish


def scan(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words; items without words or id are never found; items that repeat an id count once; an empty
    benchmark leaves every document clean, an empty table gives no rows. Rows that repeat a doc_id are judged one by
    one. Other columns are ignored.
    """
    return _judged(docs.select("doc_id", "text"), benchmark, n, block_bytes, _scanned, RESULT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated rows (``remove="documents"``) or with hit spans cut out (``"spans"``), with all columns.

    A span is the text from the first to the last word of a run of hit words. Every row is judged by its own text,
    whether or not its doc_id is repeated; null texts stay as they are.
    """
    finish = {"documents": _without_documents, "spans": _without_spans(docs.columns.index("text"))}[remove]
    return _judged(docs, benchmark, n, block_bytes, finish, docs.schema)


SQL = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bk AS (SELECT item_id, w, least(13, len(w)) AS k FROM bw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM bk)),
ks AS (SELECT DISTINCT k FROM win),
occ AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)),
hit AS (SELECT o.doc_id, o.i, o.k, win.item_id FROM occ o JOIN win ON o.k = win.k AND o.s = win.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM hit)) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN pos USING (doc_id) LEFT JOIN it USING (doc_id)
"""
