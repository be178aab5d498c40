"""Alignment of two tokenizers over a corpus: where their tokens end together, which tokens overlap, and how often.

Both read a text with a space before it: A is a byte-level BPE of the ``tokenizers`` library, B a BPE with byte fallback
of ``sentencepiece``. Token bytes follow from the ids, so the cumulative ends of either token list are byte offsets into
one string. A dictionary from end to index for each list, and the intersection of their keys, sorted, cuts both lists
into groups; in a group, tokens whose byte ranges overlap are linked.

Neither tokenizer has a token across a change from anything but white space to a space, so a text is cut there into
chunks, and those that are new to a task are aligned together, in one string. Every document's links, as numbers of links
by id pair, are written; the pairs are counted from there over all documents, and every document is given its sums.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, materialize, scratch
from .tokens import LETTERS

#: A space and all up to the next space that follows something else than white space.
CHUNK = re.compile(r" \s*\S*(?:[^\S ]\s*\S*)*")
PART_END = re.compile(r"(?<=\S) ")
#: Chunks that are kept at once, and their characters; a full store is emptied.
KEPT_CHUNKS, KEPT_CHARS = 300_000, 1 << 25
#: Characters that are cut into chunks at once; a longer text is read in parts.
PART_CHARS = 1 << 20
#: Id pairs whose counts are broadcast at once (17 bytes each). More pairs are taken in blocks of whole B ids.
BLOCK_PAIRS = 4_000_000
#: Fixed value: the sign that stands for a space in B's pieces.
SPACE_SIGN = "\u2581"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
LINKED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary"


def names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def groups_of(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """For the ends that both token lists share, in order: the places after them in either list."""
    a_at, b_at = dict(zip(a_ends, range(1, len(a_ends) + 1), strict=True)), dict(zip(b_ends, range(1, len(b_ends) + 1), strict=True))
    common = sorted(a_at.keys() & b_at.keys())
    return list(map(a_at.__getitem__, common)), list(map(b_at.__getitem__, common))


def links_of(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in A and B of the tokens whose byte ranges overlap. Between two neighbouring ends of either list lies one
    token of each, and two tokens that overlap have one such stretch of bytes, in one slice of common ends, in common."""
    ends = np.union1d(a_ends, b_ends)
    return np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)


class Vocabularies:
    """Both tokenizers; an id pair is one number, that of B times ``2 ** bits`` and that of A."""

    def __init__(self, a_path: str, b_path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        letter = {v: k for k, v in LETTERS.items()}
        tokens = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(letter[c] for c in t) if all(c in letter for c in t) else t.encode() for t in tokens]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        byte = re.compile(r"<0x([0-9A-F]{2})>").fullmatch
        self.b_bytes = [bytes([int(m[1], 16)]) if (m := byte(p)) else p.replace(SPACE_SIGN, " ").encode() for p in pieces]
        self.a_text, self.b_text = list(map(str, range(len(tokens)))), list(map(str, range(len(pieces))))
        self.bits = len(tokens).bit_length()
        self.dtype = np.dtype("<u4" if self.bits + len(pieces).bit_length() <= 32 else "<u8")
        #: Whether no piece goes on with a space after something else, so that texts may be cut there.
        self.cuts = not any(re.search(f"[^{SPACE_SIGN}]{SPACE_SIGN}", p) for p in pieces)
        self.alone = [self.b.piece_to_id(SPACE_SIGN)]

    def pieces(self, text: str) -> list[str]:
        """Chunks of a text that begins with a space."""
        return CHUNK.findall(text) if self.cuts else [text]

    def ids(self, chunks: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of each chunk. B puts a space before a text itself, but not before an empty one."""
        a = [e.ids for e in self.a.encode_batch_fast(chunks, add_special_tokens=False)]
        return a, [x or self.alone for x in self.b.encode([c[1:] for c in chunks], num_threads=1)]

    def spelled(self, chunk: str, a: list[int], b: list[int]) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a)) == b"".join(map(self.b_bytes.__getitem__, b)) == chunk.encode()


@lru_cache(maxsize=2)
def vocabularies(paths: tuple[str, str]) -> Vocabularies:
    """One pair per worker process."""
    return Vocabularies(*paths)


def _grown(old: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``old``, of which ``used`` rows count, with room for ``more`` after them, and ``more`` put there."""
    if used + len(more) > len(old):
        old = np.concatenate([old[:used], np.zeros((used + 2 * len(more), *old.shape[1:]), old.dtype)])
    old[used : used + len(more)] = more
    return old


class Chunks:
    """Chunks seen so far, by number: groups as text; numbers of tokens of A and B, groups, links, whether they are not
    spelled; links as id pairs, in one array."""

    def __init__(self, both: Vocabularies):
        self.both = both
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.forms: list[str] = []
        self.chars = self.linked = 0
        self.figures = np.zeros((1024, 5), np.int64)
        self.start = np.zeros(1024, np.int64)
        self.pairs = np.zeros(4096, self.both.dtype)

    def full(self) -> bool:
        return len(self.forms) > KEPT_CHUNKS or self.chars > KEPT_CHARS

    def add(self, chunks: list[str]) -> None:
        """Align new chunks, one after the other as one string of bytes."""
        both = self.both
        a, b = both.ids(chunks)
        flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        good = np.ones(len(chunks), bool)
        if not both.spelled("".join(chunks), flat_a, flat_b):
            good = np.array(list(map(both.spelled, chunks, a, b)))
            a, b = ([x if g else [] for x, g in zip(ids, good, strict=True)] for ids in (a, b))
            flat_a, flat_b = list(chain.from_iterable(a)), list(chain.from_iterable(b))
        a_ends = list(accumulate(map(len, map(both.a_bytes.__getitem__, flat_a))))
        b_ends = list(accumulate(map(len, map(both.b_bytes.__getitem__, flat_b))))
        a_stop, b_stop = groups_of(a_ends, b_ends)
        a_text, b_text = list(map(both.a_text.__getitem__, flat_a)), list(map(both.b_text.__getitem__, flat_b))
        groups, i, j = [], 0, 0
        for p, q in zip(a_stop, b_stop, strict=True):
            groups.append(f"{a_text[i]}|{b_text[j]}" if p - i == q - j == 1 else f"{','.join(a_text[i:p])}|{','.join(b_text[j:q])}")
            i, j = p, q
        x, y = links_of(np.array(a_ends, np.int64), np.array(b_ends, np.int64))
        pairs = np.array(flat_b, both.dtype)[y] << both.dtype.type(both.bits) | np.array(flat_a, both.dtype)[x]
        n_a, n_b = np.fromiter(map(len, a), np.int64, len(a)), np.fromiter(map(len, b), np.int64, len(b))
        last = np.cumsum(n_a)
        ends = np.searchsorted(np.array(a_stop, np.int64), last, "right")
        n_groups, n_links = np.diff(ends, prepend=0), np.diff(np.searchsorted(x, last), prepend=0)
        k = len(self.forms)
        self.at.update(zip(chunks, range(k, k + len(chunks)), strict=True))
        stop = ends.tolist()
        self.forms += [";".join(groups[i:j]) for i, j in zip([0, *stop], stop, strict=False)]
        self.figures = _grown(self.figures, k, np.stack([n_a, n_b, n_groups, n_links, ~good], axis=1))
        self.start = _grown(self.start, k, self.linked + np.cumsum(n_links) - n_links)
        self.pairs = _grown(self.pairs, self.linked, pairs)
        self.linked += len(pairs)
        self.chars += sum(map(len, chunks))

    def read(self, parts: list[str]) -> list[tuple[np.ndarray, str, np.ndarray, np.ndarray]]:
        """(figures, groups as text, id pairs in order, number of links of each) of texts that begin with a space."""
        own = list(map(self.both.pieces, parts))
        flat = list(chain.from_iterable(own))
        found = list(map(self.at.get, flat))
        if None in found:
            self.add(list(dict.fromkeys(c for c, k in zip(flat, found, strict=True) if k is None)))
            found = list(map(self.at.__getitem__, flat))
        at = np.array(found, np.int64)
        size = np.fromiter(map(len, own), np.int64, len(own))
        first = np.cumsum(size) - size
        figures = np.add.reduceat(self.figures[at], first)
        n = self.figures[at, 3]
        places = np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        part = np.repeat(np.arange(len(parts), dtype=np.uint64), figures[:, 3])
        # The part goes before the pair, so one sort serves all parts; pairs of larger vocabularies are sorted part by part.
        if self.both.dtype.itemsize == 4:
            keys, times = np.unique(part << np.uint64(32) | self.pairs[places], return_counts=True)
            cut = np.searchsorted(keys, np.arange(len(parts) + 1, dtype=np.uint64) << np.uint64(32)).tolist()
            each = [((keys[i:j] & np.uint64(0xFFFFFFFF)).astype("<u4"), times[i:j]) for i, j in zip(cut, cut[1:], strict=False)]
        else:
            each = [np.unique(p, return_counts=True) for p in np.split(self.pairs[places], np.cumsum(figures[:, 3])[:-1])]
        return [(figures[i], ";".join(map(self.forms.__getitem__, found[f : f + s])), *each[i]) for i, (f, s) in enumerate(zip(first.tolist(), size.tolist(), strict=True))]


@lru_cache(maxsize=1)
def kept_chunks(paths: tuple[str, str]) -> Chunks:
    """One store per worker process."""
    return Chunks(vocabularies(paths))


def parts_of(text: str) -> Iterator[str]:
    """A space and ``text``, in parts that begin where a chunk does."""
    text, at = " " + text, 0
    while len(text) - at > PART_CHARS and (cut := PART_END.search(text, at + PART_CHARS)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


NONE = [0, 0, 0, 0], "", b"", b""


def _row(read: tuple) -> tuple[list[int], str, bytes, bytes]:
    figures, form, pairs, times = read
    if figures[4]:
        return NONE
    return figures[:4].tolist(), hashlib.sha256(form.encode()).hexdigest(), pairs.tobytes(), times.astype("<u4").tobytes()


def _long_row(chunks: Chunks, text: str) -> tuple[list[int], str, bytes, bytes]:
    """``_row`` of a text that is read part by part."""
    sha, figures, pairs, times = hashlib.sha256(), np.zeros(5, np.int64), np.zeros(0, chunks.both.dtype), np.zeros(0, np.int64)
    for i, part in enumerate(parts_of(text)):
        more, form, new, n = chunks.read([part])[0]
        figures += more
        sha.update(((";" if i else "") + form).encode())
        pairs, place = np.unique(np.concatenate([pairs, new]), return_inverse=True)
        times = np.bincount(place, np.concatenate([times, n]), len(pairs)).astype(np.int64)
        if chunks.full():
            chunks.clear()
    return NONE if figures[4] else (figures[:4].tolist(), sha.hexdigest(), pairs.tobytes(), times.astype("<u4").tobytes())


def _rows(chunks: Chunks, texts: list[str | None]) -> list[tuple[list[int], str, bytes, bytes]]:
    out: list = [NONE] * len(texts)
    held: list[int] = []

    def flush() -> None:
        for i, read in zip(held, chunks.read([" " + texts[i] for i in held]) if held else [], strict=True):
            out[i] = _row(read)
        held.clear()
        if chunks.full():
            chunks.clear()

    size = 0
    for i, text in enumerate(texts):
        if text and len(text) > PART_CHARS:
            out[i] = _long_row(chunks, text)
        elif text:
            held.append(i)
            size += len(text)
            if size > PART_CHARS:
                flush()
                size = 0
    flush()
    return out


def linked(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """Rows of ``LINKED`` of (row, doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = kept_chunks(paths)
        for batch in batches:
            rows = _rows(chunks, batch.column(2).to_pylist())
            figures = np.array([r[0] for r in rows], np.int64).reshape(-1, 4)
            own = [pa.array(figures[:, i]) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own, pa.array([r[1] for r in rows], pa.string()), *[pa.array([r[i] for r in rows], pa.binary()) for i in (2, 3)]], names=names(LINKED))

    return docs.mapInArrow(run, LINKED)


def _joined(column: pa.Array, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in column.to_pylist()), dtype)


def pair_counts(rows: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(b, a, n, best) of every id pair that is linked anywhere in ``rows`` (``LINKED``): its links, and whether no pair of b has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = vocabularies(paths)
        pairs, n = np.zeros(0, both.dtype), np.zeros(0, np.int64)
        held: list[pa.RecordBatch] = []

        def add() -> None:
            nonlocal pairs, n
            new = np.concatenate([pairs, *[_joined(b.column(0), both.dtype) for b in held]])
            times = np.concatenate([n, *[_joined(b.column(1), np.dtype("<u4")) for b in held]])
            pairs, place = np.unique(new, return_inverse=True)
            n = np.bincount(place, times, len(pairs)).astype(np.int64)
            held.clear()

        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) > 1 << 24:
                add()
        add()
        for i in range(0, len(n), 1 << 18):
            own = pairs[i : i + (1 << 18)].astype(np.int64)
            yield pa.RecordBatch.from_pydict({"b": pa.array((own >> both.bits).astype(np.int32)), "a": pa.array((own & ((1 << both.bits) - 1)).astype(np.int32)), "n": pa.array(n[i : i + (1 << 18)])})

    n = rows.where("n_links > 0").select("pairs", "times").mapInArrow(run, "b int, a int, n long").groupBy("b", "a").agg(F.sum("n").alias("n"))
    return n.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def summed(rows: DataFrame, pairs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """``rows`` (``LINKED``) with n_best and count_sum over the links of ``pairs``, which are broadcast."""
    bits, dtype = (both := vocabularies(paths)).bits, both.dtype
    t = pairs.select("b", "a", "n", "best").toArrow()
    keys = t["b"].to_numpy().astype(dtype) << dtype.type(bits) | t["a"].to_numpy().astype(dtype)
    order = np.argsort(keys)
    shared = rows.sparkSession.sparkContext.broadcast((keys[order], t["n"].to_numpy()[order], t["best"].to_numpy(zero_copy_only=False)[order]))
    kept = names(LINKED)[:-2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, best = shared.value
        for batch in batches:
            own, times = _joined(batch.column("pairs"), dtype), _joined(batch.column("times"), np.dtype("<u4")).astype(np.int64)
            stop = np.cumsum([len(x) // dtype.itemsize for x in batch.column("pairs").to_pylist()], dtype=np.int64)
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            here = keys[at] == own if len(keys) else np.zeros(len(own), bool)
            sums = [np.diff(np.concatenate([[0], np.cumsum(np.where(here, v[at] * times, 0))])[stop], prepend=0) if len(keys) else np.zeros(len(stop), np.int64) for v in (best, n)]
            yield pa.RecordBatch.from_arrays([*map(batch.column, kept), *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

    return rows.mapInArrow(run, ", ".join(LINKED.split(", ")[:-2]) + ", n_best long, count_sum long")


def blocks(pairs: DataFrame, most: int) -> list[DataFrame]:
    """``pairs`` (written) in blocks of whole B ids of at most ``most`` rows, which is at least the number of A's ids."""
    if pairs.count() <= most:
        return [pairs]
    out, at, held = [], [], 0
    for r in [*pairs.groupBy("b").count().orderBy("b").collect(), None]:  # a row for each id of B's vocabulary at most
        if at and (r is None or held + r["count"] > most):
            out.append(pairs.where(F.col("b").between(at[0], at[-1])))
            at, held = [], 0
        if r is not None:
            at.append(r.b)
            held += r["count"]
    return out


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", most_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Texts that are null or empty, and texts that either tokenizer does not spell byte for byte, have no tokens: zeros and
    an empty digest. Rows that repeat a doc_id, or have none, are aligned and counted one by one. A long text is read in
    parts. An empty table gives no rows; other columns are not looked at. ``most_pairs`` bounds what is broadcast at once;
    the result is the same for any.
    """
    paths = (a_path, b_path)
    with scratch(docs.sparkSession):
        own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        rows = materialize(linked(own, paths), "alignment-links", compression="zstd")
        pairs = materialize(pair_counts(rows, paths), "alignment-pairs")
        parts = blocks(pairs, most_pairs)
        if len(parts) == 1:
            found = summed(rows, parts[0], paths)
        else:
            each = [materialize(summed(rows, p, paths).select("row", "n_best", "count_sum"), "alignment-sums") for p in parts]
            total = each[0]
            for more in each[1:]:
                total = total.unionByName(more)
            found = rows.join(total.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum")), "row")
        return materialize(found.select(*names(RESULT)), "alignment", keep=True, compression="zstd")
