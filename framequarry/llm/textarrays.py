"""Vectorised word arithmetic on the UTF-8 buffers of Arrow string columns.

A batch of texts is one byte array with offsets. Words, word hashes and hashes of n consecutive words are
computed for all documents of a chunk at once, so no Python code runs per word or per document.
Null texts behave as empty texts throughout.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once. A longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
#: Odd multiplier of the rolling hash and its inverse modulo 2**64.
R = 0x9E3779B97F4A7C15
R_INV = pow(R, -1, 1 << 64)
C = 0xD6E8FEB86659FD93

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SAME = np.arange(256, dtype=np.uint8)
#: Bytes of words, for ``[^\x20\x09-\x0D]+`` and for ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, *range(9, 14)]] = False
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            have = np.full(max(n, CHUNK_BYTES + 1), base, dtype=U64)
            have[0] = 1
            np.cumprod(have, out=have)
        if n <= 4 * CHUNK_BYTES:
            _powers[base] = have
    return have[:n]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array; null entries have length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = np.int64 if kind == pa.large_binary() else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``most`` bytes; every document is in exactly one."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


@dataclass
class Words:
    """Words of the documents of a chunk: byte ranges into ``data``, hashes, and where each document's words begin."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray  # per document, and one more: index of its first word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``k`` words from each word on, and whether they all lie in its document."""
        n = len(self.hash)
        out = np.zeros(n, U64)
        fits = np.zeros(n, bool)
        if n >= k:
            whole = out[: n - k + 1]
            c = 1
            for t in range(k):
                whole += self.hash[t : n - k + 1 + t] * U64(c)
                c = c * C % (1 << 64)
            left = np.repeat(self.first[1:], self.counts) - np.arange(n)
            fits = left >= k
            out = mix(out)
        return out, fits


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray, fold: np.ndarray = SAME) -> Words:
    """Maximal runs of ``is_word`` bytes in each document; ``fold`` maps bytes before hashing."""
    base = offsets[0]
    data = data[base : offsets[-1]]
    at = offsets - base
    n = len(data)
    if not n:
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(len(offsets), np.int64))
    inside = is_word[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | edge[1:n]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | edge[1:n]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U64)
        np.cumsum((fold[data].astype(U64) + U64(1)) * powers(R, n), out=sums[1:])
        h = (sums[end] - sums[start]) * powers(R_INV, n)[start]
        h = mix(h + (end - start).astype(U64))
    return Words(data, start, end, h, np.searchsorted(start, at))


def spaced(w: Words, is_word: np.ndarray, fold: np.ndarray = SAME) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The chunk's words joined by single spaces, and where each word starts and ends in it."""
    size = w.end - w.start
    start = np.cumsum(size + 1) - (size + 1)
    out = np.full(int((size + 1).sum()), 32, np.uint8)
    out[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))] = fold[w.data[is_word[w.data]]]
    return out.tobytes(), start, start + size


def texts_of(batch: pa.RecordBatch, name: str = "text") -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, data, offsets) chunk by chunk."""
    data, offsets = buffers(batch.column(batch.schema.get_field_index(name)))
    for i, j in chunks(offsets):
        yield i, j, data, offsets[i : j + 1]
