"""Token ids of whole texts, exactly those of the ``tokenizers`` library, at the speed of a dictionary.

The library cuts a text by a public pattern into pieces and encodes every piece on its own, so the ids of a piece
can be kept. Texts with characters whose class is not sure to agree between regex engines go through the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: Fixed value: text of the special token of the byte-level vocabulary.
SPECIAL = "<|endoftext|>"
#: Code points beyond Latin letters, and rare controls, on whose class two regex engines might differ.
UNSURE = re.compile(r"[^\x00-\u024f]|[\x00-\x08\x0b-\x1f\x7f-\xa0]").search
#: Pieces whose ids are kept; past this count new pieces are encoded each time they come.
KEPT_PIECES = 400_000


def _class(kind: str) -> str:
    """Latin characters of a Unicode category, for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x250) if unicodedata.category(chr(c))[0] == kind)


#: The published splitting pattern of the vocabulary, with letters and numbers spelled out for Latin texts.
_L, _N = _class("L"), _class("N")
SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^\s{_L}{_N}]+|\s+(?!\S)|\s+").findall


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 stands for itself."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


LETTERS = _byte_letters()


class Encoder:
    """``encode(text)`` gives the ids as little-endian unsigned bytes of ``dtype``."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.kept: dict[str, bytes] = {}
        head = self.tokenizer.to_str()[:2000]
        self.plain = all(x in head for x in ('"ByteLevel","add_prefix_space":false', '"use_regex":true', '"normalizer":null'))

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.plain or SPECIAL in text:
            return self.whole(text)
        pieces = SPLIT(text)
        try:
            return b"".join(map(self.kept.get, pieces))
        except TypeError:  # a piece that is not kept
            return self._with_new(text, pieces)

    def _with_new(self, text: str, pieces: list[str]) -> bytes:
        new = {p for p in pieces if p not in self.kept}
        if UNSURE("".join(new)):
            return self.whole(text)
        model, size, fresh = self.tokenizer.model, self.dtype.itemsize, {}
        for p in new:
            fresh[p] = b"".join(t.id.to_bytes(size, "little") for t in model.tokenize("".join(map(LETTERS.__getitem__, p.encode()))))
        if len(self.kept) < KEPT_PIECES:
            self.kept.update(fresh)
            return b"".join(map(self.kept.__getitem__, pieces))
        return b"".join([self.kept.get(p) or fresh[p] for p in pieces])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)
