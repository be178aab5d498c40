"""Mixture-controlled packing: deficit round-robin over source queues into windows of a fixed length.

Every source is a queue of documents; a document may be cut anywhere. In each window the round-robin visits all
queues: a queue's deficit grows by its share of the window (share x window length, a fraction), the queue gives that
many whole tokens, and what is left below one token is its deficit in the next window. Deficits are carried exactly,
over windows and over partitions: the n tokens, queue after queue, fill the rows of a table with a column for each
window and L rows (floor(i*n/L) tokens before row i, as the last window can be short), and a queue (lo, hi] gives each
window what it has in that column. That never takes tokens back, even from queues with less than one token a window, and
has a closed form (``given_before``), so any task can resume the schedule at any window without the ones
before it. Nothing sequential is left but prefix sums over (source, partition) totals.

Natural proportions (the default) empty all queues at the same moment. Given weights, queues run dry one by one; the
schedule then has one phase per dry queue, in which the remaining weights share the windows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize
from .tokens import encoder

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STORE = "doc_id long, queue string, part int, local_start long, n_tokens long, ids binary"
#: Groups of queues whose token counts the driver adds up; within a group a window function does.
GROUPS = 1024
#: Rows (queue, partition, base, lo, hi) that are broadcast at most; each has a name, four numbers and some tens of bytes.
BROADCAST_ROWS = 500_000
OUT_BYTES, OUT_ROWS = 4 << 20, 50_000


def phases(totals: dict[str, int], weights: dict[str, float] | None, length: int) -> list[tuple[int, int, dict[str, tuple[int, int, int]]]]:
    """[(first sequence, tokens, {queue: (lo, hi, tokens of the queue given before)})] for queues with these totals.

    Queues without a weight, or with one of 0, come last, in their natural proportions.
    """
    left, given, out, seq = {q: n for q, n in sorted(totals.items()) if n}, dict.fromkeys(totals, 0), [], 0
    while left:
        live = {q: Fraction(weights.get(q, 0)).limit_denominator(10**6) for q in left} if weights else {}
        live = {q: w for q, w in live.items() if w > 0}
        if not live:
            amounts = dict(left)
        else:
            span = min(left[q] / w for q, w in live.items())
            amounts = {q: min(left[q], max(1, int(span * w))) for q, w in live.items()}
        lo, bounds = 0, {}
        for q, n in amounts.items():
            bounds[q] = (lo, lo + n, given[q])
            lo += n
            given[q] += n
            left[q] -= n
        out.append((seq, lo, bounds))
        seq += -(-lo // length)
        left = {q: n for q, n in left.items() if n}
    return out


def given_before(c: int, w: int, total: int, length: int) -> int:
    """Of the first ``c`` of ``total`` tokens, those in the windows before ``w``."""
    if w >= -(-total // length):
        return c
    row = ((c + 1) * length - 1) // total
    return row * w + min(c - row * total // length, w)


def token_store(docs: DataFrame, tokenizer: str, end_id: int | None, queue_col: str) -> DataFrame:
    """Ids of every document in the shared folder, with its place in its queue within its partition."""
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, given = encoder(tokenizer), TaskContext.get().partitionId(), {}
        end = b"" if end_id is None else np.array([end_id], enc.dtype).tobytes()
        rows, size = [], 0

        def flush() -> pa.RecordBatch:
            doc, queue, start, n, ids = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(queue, pa.string()), pa.array([part] * len(rows), pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "queue", "part", "local_start", "n_tokens", "ids"])

        for batch in batches:
            for i in range(batch.num_rows):
                doc, text, queue = (batch.column(k)[i].as_py() for k in range(3))
                blob = enc.encode(text) + end
                n = len(blob) // enc.dtype.itemsize
                rows.append((doc, queue, given.get(queue, 0), n, blob))
                given[queue] = given.get(queue, 0) + n
                size += len(blob)
                if size >= OUT_BYTES:
                    yield flush()
                    rows, size = [], 0
        if rows:
            yield flush()

    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col(queue_col).cast("string"), F.lit("")).alias("queue"))
    return materialize(d.mapInArrow(encode, STORE), "packing-tokens", compression="zstd")


def pack(docs: DataFrame, tokenizer: str, end_id: int | None = 1, length: int = 2048, queue_col: str = "source", weights: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts hold only ``end_id``; with ``end_id=None`` they have no piece. Null sources are one queue.
    Rows that repeat a doc_id are packed as documents of their own. An empty table gives no pieces. Only the last
    sequence of a phase can be short (natural proportions: one phase). Every source is a queue, however many there are.
    """
    spark = docs.sparkSession
    store = token_store(docs, tokenizer, end_id, queue_col)
    totals = materialize(store.groupBy("queue", "part").agg(F.sum("n_tokens").alias("n")), "packing-totals")
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("queue", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # Only queues with a weight are planned on the driver; the others share the last phase by prefix sums.
    named = [q for q, w in (weights or {}).items() if q is not None and Fraction(w).limit_denominator(10**6) > 0]
    mine = F.col("queue").isin(named) if named else F.lit(False)
    sums = totals.groupBy("queue").agg(F.sum("n").alias("n"))
    plan = phases({r["queue"]: r["n"] for r in sums.where(mine).collect()}, weights, length) if named else []
    rest = sums.where(~mine).withColumn("lot", F.pmod(F.xxhash64("queue"), F.lit(GROUPS)))
    rest_seq, rest_total, starts = sum(-(-total // length) for _, total, _ in plan), 0, []
    for r in rest.groupBy("lot").agg(F.sum("n").alias("n")).orderBy("lot").collect():  # GROUPS rows at most
        starts.append((r["lot"], rest_total))
        rest_total += r["n"]
    upto = Window.partitionBy("lot").orderBy("queue").rowsBetween(Window.unboundedPreceding, 0)
    hi = F.col("start") + F.sum("n").over(upto)
    rest = rest.join(F.broadcast(spark.createDataFrame(starts, "lot long, start long")), "lot").select("queue", (hi - F.col("n")).alias("lo"), hi.alias("hi"))
    bases = bases.join(rest, "queue", "left")
    by_queue: dict[str, list[tuple[int, int, int, int, int]]] = {}
    for seq, total, bounds in plan:
        for q, (lo, hi, given) in bounds.items():
            by_queue.setdefault(q, []).append((given, seq, total, lo, hi))
    wide = encoder(tokenizer).dtype

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for doc, queue, base, low_end, high_end, local, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids, at = np.frombuffer(blob, wide).astype("<u4"), 0
                for given, seq, total, lo, hi in by_queue.get(queue) or [(0, rest_seq, rest_total, low_end, high_end)]:
                    mine = base + local + at - given  # place of the next id in this phase's share of the queue
                    if at >= n or mine >= hi - lo:
                        continue
                    last = -(-total // length)
                    edge = lambda c, w: given_before(c, w, total, length)
                    w = bisect_right(range(last), mine, key=lambda w: edge(hi, w) - edge(lo, w)) - 1
                    low, high = edge(lo, w), edge(hi, w)
                    while at < n and mine < hi - lo:
                        low2, high2 = edge(lo, w + 1), edge(hi, w + 1)
                        take = min(high2 - low2 - mine, n - at)
                        if take > 0:
                            rows.append((doc, at, take, zlib.crc32(ids[at : at + take]), n, seq + w, low2 - low + mine - (high - low)))
                            at += take
                            mine += take
                        if mine >= high2 - low2:
                            w, low, high = w + 1, low2, high2
                            if at < n and mine < hi - lo and edge(hi, w + 1) - edge(lo, w + 1) <= mine:  # nothing in this window
                                w = bisect_right(range(last), mine, key=lambda w: edge(hi, w) - edge(lo, w)) - 1
                                low, high = edge(lo, w), edge(hi, w)
                if len(rows) >= OUT_ROWS:
                    yield _pieces(rows)
                    rows = []
        if rows:
            yield _pieces(rows)

    if totals.count() <= BROADCAST_ROWS:  # else the ids are joined by shuffling them
        bases = F.broadcast(bases)
    placed = store.join(bases, ["queue", "part"]).select("doc_id", "queue", "base", "lo", "hi", "local_start", "n_tokens", "ids")
    return placed.mapInArrow(cut, PIECES)


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in PIECES.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=names)
