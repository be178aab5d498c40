"""Substring deduplication with an FM-index per shard.

Two documents can share a window of ``n`` words only if they share the window's minimiser, the least hash of its
``k``-word grams. So the index is sharded by minimiser instead of by document: each shard holds the runs of windows
with its minimisers, and a streamed document asks for a window only in the one shard that can hold it. Work grows
with the corpus, not with corpus times shards.

1. Runs of windows by minimiser are emitted per document; streamed in minimiser order, those that only one document
   has are dropped.
2. The words of the other runs, their segments, are cut from the texts and sent to their shards. Where a minimiser has
   more than ``HOT`` runs, they are cut again by the minimisers of longer grams, which spreads them over more shards,
   and equal segments are combined with their least doc_id before they are sent.
3. A shard sorts its segments, so equal ones are adjacent and enter the index once with the smallest doc_id; the other
   documents that have the segment lose all of it, and stream past. Its FM-index (suffix array, BWT, wavelet matrix)
   then gives the matching statistics of every segment: for each word, how far back the words up to it occur in a
   segment of a document with a smaller id. The search goes backwards word by word, for all words of the shard at once,
   and a word drops out when no such document is left in its suffix range.
4. Intervals whose statistic is ``n`` or more are reported, and removed from their documents.

Rows are told apart by doc_id and a hash of their text, so ids may repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .fm_index import FMIndex
from .shared import bounded_batches, free, materialize, scratch, small

#: Runs of one minimiser beyond which they are cut again, and words of the grams for that.
HOT, HOT_GRAM = 1 << 15, 9
#: Words of an index at most, but for a single minimiser whose distinct runs are more.
INDEX_WORDS = 150_000
OUT_ROWS = 50_000


def runs_of(w: ta.Words, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimiser, first window, windows) of each maximal run of windows of a document with the same minimiser."""
    gram, _ = w.windows(k)
    _, fits = w.windows(n)
    m = len(gram)
    span = n - k + 1
    least = gram.copy()
    for t in range(1, span):
        np.minimum(least[: m - t], gram[t:], out=least[: m - t])
    new = np.ones(m, bool)
    new[1:] = (least[1:] != least[:-1]) | ~fits[:-1]
    new[w.first[:-1][w.counts > 0]] = True
    at = np.flatnonzero(new & fits)
    stop = np.flatnonzero(fits & np.append((new | ~fits)[1:], True))
    return least[at], at, stop - at + 1


def _digest(w: ta.Words, a: int, b: int, keep: np.ndarray | None = None) -> str:
    raw = w.data.tobytes() if not hasattr(w, "raw") else w.raw
    w.raw = raw
    s, e = w.start[a:b], w.end[a:b]
    if keep is not None:
        s, e = s[keep], e[keep]
    return hashlib.sha256(b" ".join([raw[x:y] for x, y in zip(s.tolist(), e.tolist(), strict=True)])).hexdigest()


RUNS = "anchor long, doc_id long, text_key long, first int, windows int"


def _anchors(n: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(2))
            for i, _, data, at in ta.texts_of(batch):
                w = ta.words(data, at, ta.NOT_SPACE)
                least, first, count = runs_of(w, n, k)
                doc = w.doc[first]
                yield pa.RecordBatch.from_pydict({
                    "anchor": pa.array(least.view(np.int64)),
                    "doc_id": pa.array(ids[i:][doc]),
                    "text_key": pa.array(keys[i:][doc]),
                    "first": pa.array((first - w.first[doc]).astype(np.int32)),
                    "windows": pa.array(count.astype(np.int32)),
                })

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, doc_id), those of anchors that several documents have."""
    held: pa.Table | None = None  # the last anchor's rows while they are of one document
    last, several = None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if held is not None:
            table = pa.concat_tables([held, table])
        anchor, doc = table["anchor"].to_numpy(), table["doc_id"].to_numpy()
        n = len(anchor)
        start = np.ones(n, bool)
        start[1:] = anchor[1:] != anchor[:-1]
        group = np.cumsum(start) - 1
        differs = np.zeros(n, bool)
        differs[1:] = ~start[1:] & (doc[1:] != doc[:-1])
        many = np.bincount(group, weights=differs) > 0
        if last is not None and anchor[0] == last and several:
            many[0] = True
        tail = group[-1]
        last, several = anchor[-1], bool(many[tail])
        held = None if several else table.slice(int(np.flatnonzero(start)[-1])).combine_chunks()
        keep = table.filter(pa.array(many[group]))
        yield from keep.combine_chunks().to_batches()


def _cut(n: int, hot, again: bool):
    """The words of each run, as bytes joined by one space, with its place: of the ``hot`` minimisers (a sorted array),
    cut again by longer grams, or of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed = hot.value
        for batch in batches:
            runs = batch.column(batch.schema.get_field_index("runs"))
            ids, keys = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            for i, j, data, at in ta.texts_of(batch):
                w = ta.words(data, at, ta.NOT_SPACE)
                raw, start, end = ta.spaced(w, ta.NOT_SPACE)
                part = runs.slice(i, j - i)
                flat = part.flatten()
                counts = part.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
                anchor, first, windows = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("anchor", "first", "windows"))
                a = np.repeat(w.first[:-1], counts) + first
                row = np.repeat(np.arange(i, j), counts)
                if len(listed):
                    mine = (listed[np.minimum(np.searchsorted(listed, anchor), len(listed) - 1)] == anchor) == again
                    anchor, first, windows, a, row = (v[mine] for v in (anchor, first, windows, a, row))
                if again and len(a):
                    finer, at2, _ = runs_of(w, n, HOT_GRAM)
                    f, t = np.searchsorted(at2, a, "right") - 1, np.searchsorted(at2, a + windows, "left")  # finer runs of each run
                    which = np.repeat(np.arange(len(a)), t - f)
                    own = f[which] + np.arange(len(which)) - np.repeat(np.cumsum(t - f) - (t - f), t - f)
                    lo = np.maximum(a[which], at2[own])
                    hi = np.minimum((a + windows)[which], np.append(at2, 1 << 62)[own + 1])
                    anchor, first, windows, row, a = finer.view(np.int64)[own], first[which] + (lo - a[which]), hi - lo, row[which], lo
                s, e = start[a].tolist(), end[a + windows + n - 2].tolist()
                if len(s):
                    yield pa.RecordBatch.from_pydict({
                        "anchor": pa.array(anchor, pa.int64()),
                        "segment": pa.array([raw[x:y] for x, y in zip(s, e, strict=True)], pa.binary()),
                        "doc_id": pa.array(ids[row], pa.int64()),
                        "text_key": pa.array(keys[row], pa.int64()),
                        "first": pa.array(first, pa.int32()),
                        "words": pa.array(windows + n - 1, pa.int32()),
                    })

    return run


class Minima:
    """Least value of ranges of an array, from minima over spans of powers of two."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.table = np.empty((max(1, n.bit_length()), n), values.dtype)
        self.table[0] = values
        for d in range(1, len(self.table)):
            half = 1 << (d - 1)
            self.table[d] = self.table[d - 1]
            np.minimum(self.table[d - 1][: n - half], self.table[d - 1][half:], out=self.table[d][: n - half])

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        depth = np.frexp((hi - lo).astype(float))[1] - 1
        return np.minimum(self.table[depth, lo], self.table[depth, hi - (1 << depth.astype(np.int64))])


def matching_statistics(segments: list[bytes], owners: list[int], n: int) -> list[np.ndarray]:
    """For each distinct segment, per word from the ``n``-th on: the longest run of words up to it that occurs in a
    segment of a smaller owner, 0 where none has ``n``."""
    words = b" \n ".join(segments).split(b" ")  # no word is a line end
    words.append(b"\n")
    ids = {x: i + 1 for i, x in enumerate(dict.fromkeys(words))}
    ids[b"\n"] = 0
    t = np.fromiter(map(ids.__getitem__, words), np.int64, len(words))
    bounds = np.concatenate([[0], np.flatnonzero(t == 0) + 1])
    index = FMIndex(t, len(ids) + 1)
    rank = np.unique(np.array(owners, np.int64), return_inverse=True)[1].astype(np.int32)
    minima = Minima(np.repeat(rank, np.diff(bounds))[index.sa])
    counts = np.diff(bounds) - n  # words with n - 1 before them
    first = np.cumsum(counts) - counts
    end = np.repeat(bounds[:-1] + n - 1, counts) + np.arange(int(counts.sum())) - np.repeat(first, counts)
    begin, own = np.repeat(bounds[:-1], counts), np.repeat(rank, counts)
    length = np.zeros(len(end), np.int64)
    active, lo, hi = np.arange(len(end)), np.zeros(len(end), np.int64), np.full(len(end), len(t), np.int64)
    while len(active):
        at = end[active] - length[active]
        lo, hi = index.extend(t[at], lo, hi)
        left = hi > lo
        left[left] = minima.least(lo[left], hi[left]) < own[active[left]]
        active, lo, hi = active[left], lo[left], hi[left]
        length[active] += 1
        more = end[active] - length[active] >= begin[active]
        active, lo, hi = active[more], lo[more], hi[more]
    length[length < n] = 0
    return [length[a : a + c] for a, c in zip(first.tolist(), counts.tolist(), strict=True)]


def intervals(statistics: np.ndarray, n: int) -> bytes | None:
    """Merged intervals [from, to) of words under statistics, as 32-bit integers; nothing where there are none."""
    at = np.flatnonzero(statistics)
    if not len(at):
        return None
    edge = np.zeros(len(statistics) + n, np.int64)
    np.add.at(edge, at + n - statistics[at], 1)
    np.add.at(edge, at + n, -1)
    on = np.diff(np.concatenate([[0], np.cumsum(edge) > 0]).astype(np.int8))
    return np.stack([np.flatnonzero(on == 1), np.flatnonzero(on == -1)], 1).astype("<i4").tobytes()


GONE = "doc_id long, text_key long, first int, words int, some binary"
VERDICTS = "anchor long, segment binary, owner long, some binary"


def _search(n: int, most_words: int, distinct: bool):
    """Streams rows sorted by (anchor, segment, doc_id): what each row loses, or with ``distinct`` a verdict per segment.

    A row whose segment a smaller doc_id has loses all words (``some`` is null); it is passed on at once. What stays in
    memory are distinct segments, of about ``most_words`` words.
    """
    kinds = {"doc_id": pa.int64(), "text_key": pa.int64(), "first": pa.int32(), "words": pa.int32(), "some": pa.binary()} if not distinct else {"anchor": pa.int64(), "segment": pa.binary(), "owner": pa.int64(), "some": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, owners, places, size, anchor = [], [], [], 0, None
        out: list[tuple] = []

        def solve():
            for found, rows, owner, segment in zip(matching_statistics(segments, owners, n), places, owners, segments, strict=True):
                some = intervals(found, n)
                if distinct:
                    out.append((rows[0], segment, owner, some))
                elif some:
                    out.extend((owner, *row, some) for row in rows)
            segments.clear()
            owners.clear()
            places.clear()

        def flush():
            rows = pa.RecordBatch.from_pydict({k: pa.array(x, kind) for x, (k, kind) in zip(zip(*out, strict=True), kinds.items(), strict=True)})
            out.clear()
            return rows

        for batch in batches:
            a_, s_, d_, *rest = (batch.column(k).to_pylist() for k in range(batch.num_columns))
            for a, segment, doc, *row in zip(a_, s_, d_, *rest, strict=True):
                if a != anchor and size > most_words:
                    solve()
                    size = 0
                if len(out) > OUT_ROWS:
                    yield flush()
                if not segments or a != anchor or segments[-1] != segment:
                    segments.append(segment)
                    owners.append(doc)  # rows are sorted: the first has the smallest id
                    places.append([])
                    size += segment.count(b" ") + 2
                anchor = a
                if distinct:
                    places[-1].append(a)
                elif doc == owners[-1]:
                    places[-1].append(row)
                else:
                    out.append((doc, *row, None))
        if segments:
            solve()
        if out:
            yield flush()

    return run


def _base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, at in ta.texts_of(batch):
            w = ta.words(data, at, ta.NOT_SPACE)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[i:j], "text_key": batch.column(1)[i:j], "n_words": pa.array(w.counts, pa.int64()), "all_sha256": pa.array([_digest(w, int(w.first[d]), int(w.first[d + 1])) for d in range(j - i)], pa.string())})


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = batch.column(batch.schema.get_field_index("gone"))
        for i, j, data, at in ta.texts_of(batch):
            w = ta.words(data, at, ta.NOT_SPACE)
            removed, sha, texts = [], [], []
            for d in range(j - i):
                a, b = int(w.first[d]), int(w.first[d + 1])
                edge = np.zeros(b - a + 1, np.int64)
                for g in gone[i + d].as_py():
                    spans = np.frombuffer(g["some"], "<i4").reshape(-1, 2) if g["some"] is not None else np.array([[0, g["words"]]])
                    np.add.at(edge, spans[:, 0] + g["first"], 1)
                    np.add.at(edge, spans[:, 1] + g["first"], -1)
                keep = np.cumsum(edge[:-1]) == 0
                removed.append(int((~keep).sum()))
                sha.append(_digest(w, a, b, keep))
                texts.append(b" ".join([w.raw[x:y] for x, y in zip(w.start[a:b][keep].tolist(), w.end[a:b][keep].tolist(), strict=True)]).decode())
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0)[i:j], "text_key": batch.column(1)[i:j], "n_removed": pa.array(removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "kept_text": pa.array(texts, pa.string())})


REMOVED = "doc_id long, text_key long, n_removed long, kept_sha256 string, kept_text string"


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")


def repeated_windows(docs: DataFrame, n: int = 13, k: int = 5, hot_runs: int = HOT, index_words: int = INDEX_WORDS) -> tuple[DataFrame, DataFrame]:
    """(texts with shared runs, what they lose): the operator's search, before anything is removed."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = keyed(docs).where("doc_id IS NOT NULL")
    anchors = docs.where(F.length("text") >= 2 * n - 1).mapInArrow(_anchors(n, k), RUNS)
    shared = materialize(anchors.repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_shared, RUNS), "substring-runs", compression="zstd")
    hot = materialize(shared.groupBy("anchor").count().where(f"count > {hot_runs}").select("anchor"), "substring-hot")
    listed = np.sort(np.array([r.anchor for r in hot.toLocalIterator()], np.int64))  # at most one for every ``hot_runs`` runs
    marked = shared.join(small(hot).withColumn("hot", F.lit(True)), "anchor", "left") if len(listed) else shared.withColumn("hot", F.lit(None).cast("boolean"))
    runs = F.collect_set(F.struct("anchor", "first", "windows")).alias("runs")  # bounded by the document
    per_doc = marked.groupBy("doc_id", "text_key").agg(runs, F.bool_or(F.coalesce("hot", F.lit(False))).alias("hot"))
    texts = materialize(docs.join(per_doc, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "runs", "hot"), "substring-texts", compression="zstd")
    shared_list = spark.sparkContext.broadcast(listed)
    cut = "anchor long, segment binary, doc_id long, text_key long, first int, words int"
    own = texts.mapInArrow(_cut(n, shared_list, False), cut)
    found = own.repartition("anchor").sortWithinPartitions("anchor", "segment", "doc_id").mapInArrow(_search(n, index_words, False), GONE)
    if len(listed):
        rows = materialize(texts.where("hot").mapInArrow(_cut(n, shared_list, True), cut), "substring-hot-rows", compression="zstd")
        owners = rows.groupBy("anchor", "segment").agg(F.min("doc_id").alias("owner"))
        verdicts = owners.repartition("anchor").sortWithinPartitions("anchor", "segment").mapInArrow(_search(n, index_words, True), VERDICTS)
        some = F.when(F.expr("doc_id = owner"), F.col("some")).alias("some")
        found = found.union(rows.join(verdicts, ["anchor", "segment"]).where("doc_id > owner OR some IS NOT NULL").select("doc_id", "text_key", "first", "words", some))
    gone = materialize(found, "substring-gone", compression="zstd").groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("first", "words", "some")).alias("gone"))
    return texts.select("doc_id", "text_key", "text"), gone


def changes(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, text_key, n_removed, kept_sha256, kept_text) of rows that lose words; rows that repeat both id and text are one."""
    texts, gone = repeated_windows(docs, **options)
    joined = texts.join(gone, ["doc_id", "text_key"]).select("doc_id", "text_key", "text", "gone")
    return joined.mapInArrow(_remove, REMOVED)


def removals(docs: DataFrame, **options) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    Null texts have no words; texts of fewer than ``n`` words have no windows and stay whole. A word repeated within
    one document only is never removed. Rows that repeat a doc_id are judged one by one, and take nothing from each
    other; rows without doc_id stay whole and take nothing. An empty table gives no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        changed = changes(docs, **options).drop("kept_text").dropDuplicates(["doc_id", "text_key"])
        base = keyed(docs).mapInArrow(_base, "doc_id long, text_key long, n_words long, all_sha256 string")
        found = base.join(changed, ["doc_id", "text_key"], "left")
        return materialize(found.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).alias("n_removed"), F.coalesce("kept_sha256", "all_sha256").alias("kept_sha256")), "substring-removals", keep=True)


def drop_repeats(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the text of changed rows replaced by its kept words, joined by single spaces."""
    own, key, kept = free(docs, "own", "key", "kept_text")
    with scratch(docs.sparkSession):
        changed = materialize(changes(docs, **options).select(F.col("doc_id").alias(own), F.col("text_key").alias(key), F.col("kept_text").alias(kept)).dropDuplicates([own, key]), "substring-changed", keep=True)
    joined = docs.join(changed, (docs["doc_id"] == F.col(own)) & (F.xxhash64(docs["text"]) == F.col(key)), "left")
    text = F.when(F.col(own).isNotNull(), F.col(kept)).otherwise(docs["text"])
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns])


SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
o AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM w WHERE len(w) >= 13)),
m AS (SELECT s, min(doc_id) AS least FROM o GROUP BY s HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM o JOIN m USING (s) WHERE doc_id > least),
x AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w WHERE len(w) > 0),
k AS (SELECT x.doc_id, count(g.p) AS n_removed, string_agg(CASE WHEN g.p IS NULL THEN x.w[x.p] END, ' ' ORDER BY x.p) AS t FROM x LEFT JOIN g ON g.doc_id = x.doc_id AND g.p = x.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
