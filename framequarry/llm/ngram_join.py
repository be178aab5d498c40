"""Exact Jaccard self-join of documents on word n-grams, by vertical partitioning of the global n-gram order.

1. Every document becomes a set of 64-bit shingle hashes. Documents with equal sets are one class (a node) from here on;
   classes are told apart by 128 bits.
2. Global order: rare before frequent, then by hash. Shingles count as frequent if their counts, over all tasks in
   which two documents have them, add up to ``FREQUENT``; they travel as a bitmap of bounded size. The bitmap decides
   only the order, so whatever it misses or has too much costs time, never a link.
3. Two sets with Jaccard >= t share a shingle among the first n - ceil(t n) + 1 of each. The members of such a shingle
   are a list; lists with the same members are one list. Most near copies share dozens of shingles, so few are left.
4. Round one: the members of every list against its pivot, the member that is in most lists. Rows are linear in the
   lists. What links is contracted, and lists that lie in one component are done.
5. Then only members of different components meet. Short lists give their pairs; long ones are cut into blocks of
   bounded size, in which sets are compared by their sketches: the parity sketch of a set (for each bit, whether an odd
   number of its shingles hash there) differs in no more bits than the sets in shingles, which excludes pairs for
   certain. A block with very many plausible pairs gives a forest over the components first, and the rest after the
   next contraction. Every plausible pair between components that stay apart is verified, so no link is lost, and a
   group of thousands of near copies costs a few comparisons per copy.
6. Verification: the order is cut into ``fragments``; the partial overlaps of each candidate pair are counted per
   fragment, apart from each other, and summed per pair.
7. Components of the links; each document gets the smallest doc_id of its component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textarrays as ta
from .components import components, gathered
from .shared import bounded_batches, few, free, materialize, scratch, small

#: Documents that make a shingle frequent; most bits of the bitmap of frequent shingles (128 MB).
FREQUENT, MOST_BITS = 12, 30
#: Shingles that are counted together within a task.
COUNTED = 2_000_000
#: A list of more members than this goes to blocks of sketches; members of a chunk of such a list; longest list that a
#: task holds to find out whether another shingle has the same members (a longer one is passed on under its own name).
SHORT_LIST, CHUNK, HELD = 24, 1000, 1 << 18
#: Plausible pairs per member beyond which a block gives a forest over its components first.
DENSE = 16
#: Members of a block of comparisons at most; a node with more partners has several blocks.
BLOCK_MEMBERS = 500
#: Pairs whose sets a task compares, about.
PAIRS_A_TASK = 5_000
OUT_ROWS = 100_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, offsets): the sorted set of each document of a chunk."""
    w = ta.words(data, offsets, ta.NOT_SPACE, ta.LOWER)
    h, fits = w.windows(n)
    doc = w.doc
    for k in np.unique(w.counts[w.counts < n]).tolist():  # whole sequences of fewer words
        if k:
            short, _ = w.windows(k)
            first = w.first[:-1][w.counts == k]
            h[first], fits[first] = ta.mix(short[first] + ta.U64(k)), True
    h, doc = h[fits], doc[fits]
    at = np.zeros(len(offsets), np.int64)
    np.cumsum(np.bincount(doc, minlength=len(offsets) - 1), out=at[1:])
    sets = [np.unique(h[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
    np.cumsum([len(s) for s in sets], out=at[1:])
    return np.concatenate(sets) if sets else h, at


def signature(s: np.ndarray) -> tuple[int, int]:
    """A 128-bit hash of a set, as two signed integers."""
    salts = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
    halves = [ta.mix(s ^ ta.U64(k)).sum(dtype=np.uint64) + ta.U64(len(s)) for k in salts]
    lo, hi = ta.mix(np.array(halves, np.uint64)).view(np.int64).tolist()
    return lo, hi


def parity(s: np.ndarray) -> bytes:
    """Parity sketch of a set, of about four bits per shingle (64 at least)."""
    bits = max(64, 4 << (max(1, len(s)) - 1).bit_length())
    at = (ta.mix(s ^ ta.U64(0x2545F4914F6CDD1D)) & ta.U64(bits - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").tobytes()


CLASSES = "doc_id long, size int, lo long, hi long, sketch binary, often binary"


def _classes(n: int):
    """Per document (doc_id, size, class, sketch); also rows with the shingles that several documents of a task have."""
    schema = pa.schema([("doc_id", pa.int64()), ("size", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("sketch", pa.binary()), ("often", pa.binary())])

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        token, count = np.unique(np.concatenate(sets), return_counts=True)
        keep = count > 1
        blob = np.stack([token[keep].view(np.int64), count[keep]]).astype("<i8").tobytes()
        return pa.RecordBatch.from_arrays([pa.nulls(1, f.type) for f in schema][:5] + [pa.array([blob], pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()
        for batch in batches:
            for i, j, data, at in ta.texts_of(batch):
                h, off = shingle_sets(data, at, n)
                sets = [h[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                classes = [signature(x) for x in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j].cast(pa.int64()), pa.array(np.diff(off).astype(np.int32)), pa.array([c[0] for c in classes], pa.int64()), pa.array([c[1] for c in classes], pa.int64()), pa.array([parity(x) for x in sets], pa.binary()), pa.nulls(j - i, pa.binary())],
                    schema=schema,
                )
                for c, x in zip(classes, sets, strict=True):
                    if len(x) and c not in seen:  # copies count once
                        seen.add(c)
                        held.append(x)
                        size += len(x)
                if size > COUNTED:
                    yield often(held)
                    held, size, seen = [], 0, set()
        if held:
            yield often(held)

    return run


def _each_often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            token, count = np.frombuffer(blob.as_buffer(), "<i8").reshape(2, -1)
            for a in range(0, len(token), OUT_ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(token[a : a + OUT_ROWS]), pa.array(count[a : a + OUT_ROWS])], names=["token", "n"])


def frequent_bitmap(often: DataFrame) -> tuple[np.ndarray, int]:
    """(bitmap over the highest bits of shingles, number of those bits)."""
    frequent = materialize(often.mapInArrow(_each_often, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(f"n >= {FREQUENT}").select("token"), "ngram-frequent")
    bits = min(MOST_BITS, max(20, (16 * frequent.count()).bit_length()))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((1 << bits) // 8, np.uint8)
        for batch in batches:
            at = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64) >> ta.U64(64 - bits)
            np.bitwise_or.at(out, at >> ta.U64(3), np.left_shift(1, (ta.U64(7) - (at & ta.U64(7))).astype(np.uint8)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"bits": [out.tobytes()]})

    total = np.zeros((1 << bits) // 8, np.uint8)
    for r in frequent.coalesce(8).mapInArrow(marked, "bits binary").toLocalIterator():
        total |= np.frombuffer(r.bits, np.uint8)
    return total, bits


def is_frequent(s: np.ndarray, bitmap: np.ndarray, bits: int) -> np.ndarray:
    at = s >> ta.U64(64 - bits)
    return (bitmap[at >> ta.U64(3)] >> (ta.U64(7) - (at & ta.U64(7))).astype(np.uint8)) & 1


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def _postings(frequent, n: int, percent: int):
    """(token, size, class) of the prefix shingles; the class is half of its name, the other half is looked up later."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (bitmap, bits), seen = frequent.value, set()
        for batch in batches:
            for _, _, data, at in ta.texts_of(batch):
                h, off = shingle_sets(data, at, n)
                tokens, sizes, classes, counts = [], [], [], []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    s = h[a:b]
                    if not len(s) or (c := signature(s)) in seen:
                        continue
                    if len(seen) < 2_000_000:  # copies within a task are one class; across tasks the lists merge them
                        seen.add(c)
                    lv = is_frequent(s, bitmap, bits)
                    if lv.any():
                        s = s[np.argsort(lv, kind="stable")]
                    p = prefix_length(len(s), percent)
                    tokens.append(s[:p])
                    sizes.append(len(s))
                    classes.append(c[0])
                    counts.append(p)
                if tokens:
                    yield pa.RecordBatch.from_pydict({"token": pa.array(np.concatenate(tokens).view(np.int64)), "size": pa.array(np.repeat(np.array(sizes, np.int32), counts)), "class": pa.array(np.repeat(np.array(classes, np.int64), counts))})

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by (token, size, class): (list, class, size) of lists with several members.

    A list is named by a hash of its members, so those of shingles with the same members are one. Should two lists
    share a name, their members meet in one list, which costs comparisons and loses none.
    """
    schema = pa.schema([("list", pa.int64()), ("class", pa.int64()), ("size", pa.int32())])
    seen: set[int] = set()
    names, classes, sizes, rows = [], [], [], 0
    at, held_c, held_s, passed = None, [], [], False  # the current list, part by part

    def take(name: int) -> None:
        nonlocal rows
        c = np.concatenate(held_c)
        names.append(np.full(len(c), name, np.int64))
        classes.append(c)
        sizes.append(np.concatenate(held_s))
        rows += len(c)

    def close() -> None:
        n = sum(map(len, held_c))
        if passed and n:
            take(int(ta.mix(np.array([at], np.int64).view(np.uint64)).view(np.int64)[0]))
        elif n > 1:
            c = np.concatenate(held_c).view(np.uint64)
            name = int(ta.mix(ta.mix(c * (ta.U64(2) * np.arange(n, dtype=np.uint64) + ta.U64(1))).sum(keepdims=True) + ta.U64(n)).view(np.int64)[0])
            if name not in seen:
                if len(seen) < 1_000_000:  # beyond that, lists met twice are merged after the shuffle only
                    seen.add(name)
                take(name)

    def flush() -> pa.RecordBatch:
        nonlocal rows
        out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (names, classes, sizes)], schema=schema)
        names.clear(), classes.clear(), sizes.clear()
        rows = 0
        return out

    with np.errstate(over="ignore"):
        for batch in batches:
            token, size, cls = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            if not len(token):
                continue
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])  # a class that several tasks have is one member
            token, size, cls = token[new], size[new], cls[new]
            n = len(token)
            starts = np.flatnonzero(np.append(True, token[1:] != token[:-1]))
            ends = np.append(starts[1:], n)
            # Lists that begin and end inside the batch with one row need no work at all.
            work = (ends - starts > 1) | (starts == 0) | (ends == n)
            for s, e in zip(starts[work].tolist(), ends[work].tolist(), strict=True):
                t = int(token[s])
                if t != at:
                    close()
                    at, held_c, held_s, passed = t, [], [], False
                elif held_c and held_c[-1][-1] == cls[s]:
                    s += 1
                if s < e:
                    held_c.append(cls[s:e])
                    held_s.append(size[s:e])
                if sum(map(len, held_c)) > HELD:
                    passed = True
                    close()
                    held_c, held_s = [held_c[-1][-1:]], [held_s[-1][-1:]]
                if rows > OUT_ROWS:
                    yield flush()
        close()
    if rows:
        yield flush()


def _pairs(percent: int):
    """Streams members sorted by (list, size): pairs within length reach whose parts differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, int]] = set()
        at, held = None, []

        def flush() -> pa.RecordBatch:
            a, b = zip(*out, strict=True)
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            for name, node, size, part in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if name != at:
                    at, held = name, []
                held = [x for x in held if 100 * x[1] >= percent * size]
                out.update((min(x[0], node), max(x[0], node)) for x in held if x[2] != part)
                held.append((node, size, part))
            if len(out) > OUT_ROWS:
                yield flush()
        if out:
            yield flush()

    return run


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Rows of sketches, folded to ``words`` 64-bit words."""
    while x.shape[1] > words:
        half = x.shape[1] // 2
        x = x[:, :half] ^ x[:, half:]
    return x


class _Side:
    """Members of one side of a block, by the length of their sketches and then by size."""

    def __init__(self, rows: list[tuple]):
        by_words: dict[int, list] = {}
        for node, part, size, sketch in rows:
            by_words.setdefault(len(sketch) // 8, []).append((size, node, part, sketch))
        self.by_words = {}
        for w, own in sorted(by_words.items()):
            own.sort(key=lambda x: x[0])
            size, node, part = (np.array([x[k] for x in own], np.int64) for k in range(3))
            self.by_words[w] = size, node, part, np.frombuffer(b"".join(x[3] for x in own), np.uint64).reshape(len(own), w)


def plausible_pairs(x: _Side, y: _Side, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(least distance, a, b, part of a, part of b) of pairs in different parts that the sketches don't exclude."""
    most = 1 - percent / 100
    for wx, (size_x, node_x, part_x, bits_x) in x.by_words.items():
        for wy, (size_y, node_y, part_y, bits_y) in y.by_words.items():
            if not wx <= 2 * wy <= 4 * wx:  # sizes within reach have sketches of the same or twice the length
                continue
            w = min(wx, wy)
            bx, by = folded(bits_x, w), folded(bits_y, w)
            first = np.searchsorted(size_y, -(-percent * size_x // 100))
            last = np.searchsorted(size_y, 100 * size_x // percent, "right")
            for i, (f, l) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
                if f >= l:
                    continue
                apart = np.bitwise_count(by[f:l] ^ bx[i]).sum(1)
                least = 2 * apart / (size_x[i] + size_y[f:l] + apart)
                k = np.flatnonzero((least <= most + 1e-9) & (part_y[f:l] != part_x[i]))
                if len(k):
                    yield least[k], np.full(len(k), node_x[i]), node_y[f:l][k], np.full(len(k), part_x[i]), part_y[f:l][k]


def forest(found: list[tuple[np.ndarray, ...]]) -> list[tuple[int, int]]:
    """Pairs that connect the parts as all of ``found`` would, nearest first."""
    least, a, b, pa_, pb = (np.concatenate(x) for x in zip(*found, strict=True))
    root: dict[int, int] = {}

    def find(p: int) -> int:
        while root.setdefault(p, p) != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    out = []
    order = np.argsort(least, kind="stable")
    for i, j, p, q in zip(a[order].tolist(), b[order].tolist(), pa_[order].tolist(), pb[order].tolist(), strict=True):
        p, q = find(p), find(q)
        if p != q:
            root[p] = q
            out.append((min(i, j), max(i, j)))
    return out


def _cross(percent: int, dense: int | None):
    """Streams blocks (list, x, y; side, node, part, size, sketch): plausible pairs of different parts.

    A block of more than ``dense`` such pairs per member gives a forest, and a row of nulls to say that there are more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sides = None, ([], [])

        def close() -> pa.RecordBatch | None:
            x = _Side(sides[0])
            y = _Side(sides[1]) if sides[1] else x
            found = list(plausible_pairs(x, y, percent))
            if not found:
                return None
            if dense is not None and sum(len(f[0]) for f in found) > dense * (len(sides[0]) + len(sides[1])):
                pairs = [(None, None), *forest(found)]
            else:
                pairs = {(min(p, q), max(p, q)) for f in found for p, q in zip(f[1].tolist(), f[2].tolist(), strict=True)}
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs, strict=True)], names=["a", "b"])

        for batch in batches:
            sketches = batch.column(7)
            for k, row in enumerate(zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True)):
                if row[:3] != at:
                    if sides[0] and (out := close()) is not None:
                        yield out
                    at, sides = row[:3], ([], [])
                sides[row[3]].append((row[4], row[5], row[6], sketches[k].as_buffer().to_pybytes()))
        if sides[0] and (out := close()) is not None:
            yield out

    return run


def _stored(n: int):
    """Sets of the nodes whose text it is; a row of the same doc_id with another text falls out by its signature."""
    schema = pa.schema([("node", pa.int64()), ("set", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, at in ta.texts_of(batch):
                h, off = shingle_sets(data, at, n)
                node, lo, hi = (batch.column(k)[i:j].to_pylist() for k in range(3))
                sets = [h[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                own = [k for k, s in enumerate(sets) if signature(s) == (lo[k], hi[k])]
                yield pa.RecordBatch.from_arrays([pa.array([node[k] for k in own], pa.int64()), pa.array([sets[k].tobytes() for k in own], pa.binary())], schema=schema)

    return run


def _segments(fragments: int):
    """Sets cut at the fragment bounds of the order, one row per fragment and block that waits for the node."""
    bits = fragments.bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, size = [], 0
            for cls, blob, seats in zip(*(batch.column(batch.schema.get_field_index(k)) for k in ("node", "set", "seats")), strict=True):
                s = np.frombuffer(blob.as_buffer(), np.uint64)
                cut = np.searchsorted(s >> ta.U64(64 - bits), np.arange(fragments + 1)) if bits else [0, len(s)]
                parts = [s[cut[f] : cut[f + 1]].tobytes() for f in range(fragments)]
                for seat in seats.as_py():
                    rows += [(seat["block"], f, seat["salt"], seat["member"], cls.as_py(), len(s), parts[f]) for f in range(fragments)]
                    size += 8 * len(s)
                    if size > 4 << 20:
                        yield _segment_rows(rows)
                        rows, size = [], 0
            if rows:
                yield _segment_rows(rows)

    return run


SEGMENT = "block long, fragment int, salt int, member boolean, node long, size int, segment binary"


def _segment_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SEGMENT.split(", ")])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial overlaps of one fragment: rows come sorted by block, the block's own segment first."""
    at, own, n_own = None, None, 0
    for batch in batches:
        block, frag, salt, member, cls, size = (batch.column(k).to_pylist() for k in range(6))
        segments = batch.column(6)
        out = []
        for i in range(batch.num_rows):
            s = np.frombuffer(segments[i].as_buffer(), np.uint64)
            if not member[i]:
                at, own, n_own = (block[i], frag[i], salt[i]), s.copy(), size[i]
                continue
            if at != (block[i], frag[i], salt[i]):
                raise ValueError("a block's own segment must come before its members")
            u, v = (s, own) if len(s) <= len(own) else (own, s)
            common = int((v[np.minimum(np.searchsorted(v, u), len(v) - 1)] == u).sum()) if len(u) else 0
            out.append((block[i], n_own, cls[i], size[i], common))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()], strict=True)], names=["a", "na", "b", "nb", "common"])


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        most, na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in (2, 3, 4))
        apart = np.zeros(batch.num_rows)
        for i, (p, q) in enumerate(zip(batch.column(5), batch.column(6), strict=True)):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64)[None] for v in (p, q))
            w = min(x.shape[1], y.shape[1])
            apart[i] = np.bitwise_count(folded(x, w) ^ folded(y, w)).sum()
        keep = 2 * apart <= (most + 1e-9) * (na.astype(float) + nb + apart)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))


def plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sketches allow a Jaccard similarity of ``percent`` or more."""
    side = lambda k: sketches.select(F.col("node").alias(k), F.col("size").alias(f"n{k}"), F.col("sketch").alias(f"s{k}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").withColumn("most", F.lit(1 - percent / 100))
    return joined.select("a", "b", "most", "na", "nb", "sa", "sb").mapInArrow(_within, "a long, b long")


def distances(pairs: DataFrame, sets: DataFrame, fragments: int) -> DataFrame:
    """(a, b, na, nb, common): exact overlap of each pair (a, b) of nodes, a written table.

    b's set travels to a's block once per pair, a's once per block; a block of very many members is salted.
    """
    n = pairs.count()
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK_MEMBERS).cast("int").alias("salts"))
    seats = few(pairs.join(blocks, "a"), n).select(F.col("b").alias("node"), F.col("a").alias("block"), F.pmod(F.hash("b"), F.col("salts")).alias("salt"), F.lit(True).alias("member"))
    own = few(blocks, n).select(F.col("a").alias("node"), F.col("a").alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("member"))
    wanted = few(seats.union(own).groupBy("node").agg(F.collect_list(F.struct("block", "salt", "member")).alias("seats")), n)
    parts = few(sets.join(wanted, "node"), n, PAIRS_A_TASK).mapInArrow(_segments(fragments), SEGMENT)
    dealt = few(parts.repartition("block", "fragment", "salt"), n, PAIRS_A_TASK).sortWithinPartitions("block", "fragment", "salt", "member")
    counted = dealt.mapInArrow(_overlaps, "a long, na int, b long, nb int, common long")
    return few(counted.groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"), F.sum("common").alias("common")), n)


def blocks_of(mixed: DataFrame, sketches: DataFrame, rows: int) -> DataFrame:
    """Blocks of long lists, in which all members of different parts meet once.

    A chunk holds about ``CHUNK`` members: several small parts, or a piece of one larger part. Two chunks of the same
    large part need not meet, so a list with one large part takes rows in proportion to its members.
    """
    sizes = mixed.groupBy("list", "part").agg(F.count("*").alias("own"))
    big = F.when(F.col("own") > CHUNK, F.col("part"))
    sub = F.pmod(F.hash("node"), F.ceil(F.col("own") / CHUNK).cast("int"))
    chunk = F.concat_ws(":", F.pmod(F.hash("part"), F.ceil(F.col("n") / CHUNK).cast("int")), F.coalesce(big.cast("string"), F.lit("")), F.when(big.isNull(), 0).otherwise(sub))
    members = materialize(few(mixed.join(sizes, ["list", "part"]), rows).select("list", "node", "part", chunk.alias("chunk"), big.alias("big")), "ngram-chunks")
    chunks = few(members.select("list", "chunk", "big").distinct(), rows)
    x, y = (chunks.select("list", F.col("chunk").alias(k), F.col("big").alias(f"{k}_big")) for k in "xy")
    met = x.join(y, "list").where("x <= y AND NOT coalesce(x_big = y_big, false)").select("list", "x", "y")
    seats = met.select("list", "x", "y", F.lit(0).alias("side"), F.col("x").alias("chunk")).union(met.where("x < y").select("list", "x", "y", F.lit(1), "y"))
    return few(few(seats.join(members, ["list", "chunk"]), rows).join(sketches, "node"), rows).select("list", "x", "y", "side", "node", "part", "size", "sketch")


def _near_duplicates(docs: DataFrame, n: int, percent: int, fragments: int) -> DataFrame:
    """(doc_id, lo, hi, size, component): ``near_duplicates`` with the names of the sets, without the clean-up."""
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select("doc_id", "text")
    first = materialize(docs.mapInArrow(_classes(n), CLASSES), "ngram-classes", compression="zstd")
    each = first.where("often IS NULL").select("doc_id", "size", "lo", "hi")
    # Numbers of the nodes are written once, so they hold whatever executor is lost later.
    nodes = each.where("size > 0 AND doc_id IS NOT NULL").groupBy("lo", "hi").agg(F.min("doc_id").alias("rep"), F.first("size").alias("size"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "ngram-nodes")
    frequent = spark.sparkContext.broadcast(frequent_bitmap(first.where("often IS NOT NULL").select("often")))
    postings = docs.mapInArrow(_postings(frequent, n, percent), "token long, size int, class long")
    lists = postings.repartition("token").sortWithinPartitions("token", "size", "class").mapInArrow(_lists, "list long, class long, size int").distinct()
    seats = materialize(lists.join(nodes.select(F.col("lo").alias("class"), "node"), "class").select("list", "node", "size"), "ngram-seats")
    rows = seats.count()
    active = materialize(few(seats.groupBy("node").agg(F.count("*").alias("fame")).join(nodes, "node"), rows).select("node", "fame", "lo", "hi", F.col("rep").alias("doc_id")), "ngram-active")
    sketches = first.where("often IS NULL").join(small(active), ["lo", "hi", "doc_id"]).groupBy("node").agg(F.first("size").alias("size"), F.first("sketch").alias("sketch"))
    sketches = materialize(few(sketches, rows, 20_000), "ngram-sketches")
    linked = f"100 * common >= {percent} * (na + nb - common)"

    def verified(pairs: DataFrame) -> DataFrame:
        """The links among ``pairs``, a written table."""
        k = pairs.count()
        wanted = few(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), k).join(active, "node")
        wanted = materialize(few(wanted, k).select("node", "lo", "hi", "doc_id"), "ngram-wanted")
        texts = docs.join(small(wanted), "doc_id").select("node", "lo", "hi", "text")
        sets = materialize(few(texts.mapInArrow(_stored(n), "node long, set binary").dropDuplicates(["node"]), k, PAIRS_A_TASK), "ngram-sets")
        return materialize(distances(pairs, sets, fragments).where(linked).select("a", "b"), "ngram-links")

    # Round one: every member against the pivot of its list.
    pivots = few(seats.join(active.select("node", "fame"), "node"), rows).groupBy("list").agg(F.max_by(F.struct("node", "size"), F.struct("fame", "node")).alias("p"))
    stars = few(seats.join(pivots, "list"), rows).where(f"node <> p.node AND 100 * least(size, p.size) >= {percent} * greatest(size, p.size)")
    stars = few(stars.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct(), rows)
    tried = materialize(few(plausible(stars, sketches, percent), rows), "ngram-pairs")
    links = verified(tried)
    parts = gathered(links, rows)
    # Then members of different components; dense blocks give a forest first.
    for dense in (DENSE, None):
        placed = few(seats.join(parts.withColumnRenamed("component", "part"), "node", "left"), rows).withColumn("part", F.coalesce("part", "node"))
        spread = placed.groupBy("list").agg(F.min("part").alias("lo"), F.max("part").alias("hi"), F.count("*").alias("n")).where("lo <> hi").select("list", "n")
        mixed = materialize(few(placed.join(spread, "list"), rows), "ngram-mixed")
        long = few(blocks_of(mixed.where(f"n > {SHORT_LIST}"), sketches, rows).repartition("list", "x", "y"), rows, 10_000).sortWithinPartitions("list", "x", "y", "side")
        crossed = materialize(few(long.mapInArrow(_cross(percent, dense), "a long, b long").distinct(), rows), "ngram-crossed")
        pairs = crossed.where("a IS NOT NULL")
        if dense:  # short lists give all their pairs at once
            short = few(mixed.where(f"n <= {SHORT_LIST}").select("list", "node", "size", "part").repartition("list"), rows).sortWithinPartitions("list", "size", "node")
            short = few(short.mapInArrow(_pairs(percent), "a long, b long").distinct(), rows).join(tried, ["a", "b"], "left_anti")
            pairs = pairs.union(plausible(short, sketches, percent)).distinct()
        pairs = materialize(few(pairs.join(tried, ["a", "b"], "left_anti"), rows), "ngram-pairs")
        if not pairs.isEmpty():
            links, tried = links.union(verified(pairs)), tried.union(pairs)
        if crossed.where("a IS NULL").isEmpty():  # no block held pairs back, whether or not there were new ones
            break
        parts = components(links)
    parts = components(links)
    placed = nodes.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    least = placed.groupBy("part").agg(F.min("rep").alias("component"))
    named = placed.join(least, "part").select("lo", "hi", "component")
    return each.join(named, ["lo", "hi"], "left").select("doc_id", "lo", "hi", "size", F.when(F.expr("size > 0 AND doc_id IS NOT NULL"), F.col("component")).otherwise(F.col("doc_id")).alias("component"))


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, fragments: int = 4) -> DataFrame:
    """Per row of ``docs``: doc_id, n_shingles, component_id. ``fragments`` is a power of two.

    Null, empty and blank texts have an empty set and are alone. A text of fewer than ``n`` words has its whole
    sequence as its one shingle. Rows that repeat a doc_id are judged one by one, each by its own text; a row without
    doc_id links with nothing and has no component. An empty table gives no rows. Other columns are ignored.
    """
    with scratch(docs.sparkSession):
        found = _near_duplicates(docs, n, percent, fragments)
        return materialize(found.select("doc_id", F.col("size").alias("n_shingles"), F.col("component").alias("component_id")), "near-duplicates", keep=True)


def _named(n: int, text_at: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = ta.buffers(batch.column(text_at))
            for i, j in ta.chunks(offsets):
                h, off = shingle_sets(data, offsets[i : j + 1], n)
                signed = [signature(h[a:b]) for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
                own = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array([x[0] for x in signed], pa.int64()), pa.array([x[1] for x in signed], pa.int64())], names=[*own.schema.names, *names])

    return run


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, fragments: int = 4) -> DataFrame:
    """The rows of ``docs`` that are the smallest doc_id of their component, with all columns.

    Of rows that repeat both doc_id and set, one stays; rows without doc_id stay.
    """
    with scratch(docs.sparkSession):
        found = materialize(_near_duplicates(docs, n, percent, fragments), "near-found", keep=True)
    key, a, b, lo, hi = free(docs, "key", "a", "b", "lo", "hi")
    lost = found.where("doc_id <> component").select(F.col("doc_id").alias(key), F.col("lo").alias(a), F.col("hi").alias(b)).distinct()
    lost = small(materialize(lost, "near-lost"))
    if found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return docs.join(lost, docs["doc_id"] == F.col(key), "left_anti")
    # Repeated ids: rows are told apart by their sets as well.
    named = docs.mapInArrow(_named(n, docs.columns.index("text"), [lo, hi]), T.StructType([*docs.schema.fields, T.StructField(lo, T.LongType()), T.StructField(hi, T.LongType())]))
    left = named.where("doc_id IS NOT NULL").join(lost, (F.col("doc_id") == F.col(key)) & (F.col(lo) == F.col(a)) & (F.col(hi) == F.col(b)), "left_anti")
    return left.dropDuplicates(["doc_id", lo, hi]).select(*docs.columns).union(docs.where("doc_id IS NULL"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + k - 1], ' '), k) AS g FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, m) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.m FROM r JOIN e ON r.doc_id = e.a WHERE r.m < e.b)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, coalesce(min(r.m), w.doc_id) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""
