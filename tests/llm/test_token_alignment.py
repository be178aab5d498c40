"""Cross-tokenizer alignment against the libraries on whole texts and a plain overlap of byte ranges."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from framequarry.llm import token_alignment

from .test_llm import documents, hard_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def texts():
    odd = ["a  b", " a", "a ", "a\n b", "a \n  \n b", "\t x\ty", "x▁y", "▁", " ", "\n", "  \n\n   end  ", "<s> hi </s>", "<|endoftext|> and<|endoftext|>", "<unk><0x41>", "ａ　ｂ   c", "é é", "😀 a😀b", "x​ y", "don't we'll I'VE", "a\x1c b\x1f  c\x85 d\xa0 e", "x" * 300 + " y", "der Größte; français ñandú", "\x00 \x01a", "中文字 と"]
    return [*[t for t in hard_texts() if not t or len(t) < 9000], *odd, "word " * 400, ("a b\nc  d\r\n" * 50)]


def plain(rows):
    """Rows by the libraries' ids of whole texts and all pairs of overlapping ranges."""
    a_tok, b_tok = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a_tok.encode_special_tokens = True
    byte = {v: k for k, v in token_alignment.LETTERS.items()}
    found, counts = [], Counter()
    for doc, text in rows:
        a, b = a_tok.encode(" " + text, add_special_tokens=False).ids if text else [], b_tok.encode(text) if text else []
        a_raw = [bytes(byte[c] for c in a_tok.id_to_token(i)) for i in a]
        b_raw = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
        if not text or not b"".join(a_raw) == b"".join(b_raw) == (" " + text).encode():
            a, b, a_raw, b_raw = [], [], [], []
        ends = []
        for raw in (a_raw, b_raw):
            at = 0
            ends.append([at := at + len(x) for x in raw])
        groups, i, j = [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            p, q = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((a[i:p], b[j:q]))
            i, j = p, q
        links, first = [], 0
        for x, (end, raw) in enumerate(zip(ends[0], a_raw, strict=True)):
            while ends[1][first] <= end - len(raw):
                first += 1
            y = first
            while y < len(b) and ends[1][y] - len(b_raw[y]) < end:
                links.append((a[x], b[y]))
                y += 1
        counts.update(links)
        form = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        found.append((doc, len(a), len(b), len(groups), links, hashlib.sha256(form.encode()).hexdigest() if a else ""))
    best = {}
    for (x, y), n in counts.items():
        best[y] = max(n, best.get(y, 0))
    return sorted((d, na, nb, g, len(li), sum(counts[x] == best[x[1]] for x in li), sum(counts[x] for x in li), sha) for d, na, nb, g, li, sha in found)


@pytest.mark.parametrize("most", [token_alignment.BLOCK_PAIRS, 40], ids=["one block", "blocks"])
def test_alignment(spark, most, monkeypatch):
    rows = list(enumerate(texts()))
    monkeypatch.setattr(token_alignment, "PART_CHARS", 700)
    got = sorted(map(tuple, token_alignment.align(documents(spark, [t for _, t in rows]).repartition(3), A, B, most_pairs=most).collect()))
    want = plain(rows)
    for g, w in zip(got, want, strict=True):
        assert g == w, rows[g[0]]
    assert sum(w[1] > 0 for w in want) > 30 and sum(w[1] == 0 for w in want) >= 4


def test_small_store_and_parts(monkeypatch):
    both = token_alignment.vocabularies((A, B))
    assert both.cuts
    texts = ["ein Satz  mit\nWörtern und don't " * 300, None, "x\u2581y " * 20, "", "a b"]
    whole = token_alignment._rows(token_alignment.Chunks(both), texts)
    assert whole[1] == whole[2] == whole[3] == token_alignment.NONE and whole[0][0][0] > 2000
    monkeypatch.setattr(token_alignment, "PART_CHARS", 50)
    assert len(list(token_alignment.parts_of(texts[0]))) > 100 and "".join(token_alignment.parts_of(texts[0])) == " " + texts[0]
    assert token_alignment._rows(token_alignment.Chunks(both), texts) == whole
    monkeypatch.setattr(token_alignment, "KEPT_CHUNKS", 1)
    assert token_alignment._rows(token_alignment.Chunks(both), texts) == whole
    monkeypatch.setattr(both, "dtype", np.dtype("<u8"))
    wide = token_alignment._rows(token_alignment.Chunks(both), texts)
    assert [r[:2] for r in wide] == [r[:2] for r in whole] and np.array_equal(np.frombuffer(wide[0][2], "<u8"), np.frombuffer(whole[0][2], "<u4"))


def test_empty_table_and_repeated_rows(spark):
    docs = documents(spark, [])
    assert token_alignment.align(docs, A, B).collect() == []
    again = documents(spark, ["some words here"] * 3).selectExpr("CASE WHEN doc_id > 0 THEN 7L END AS doc_id", "text", "lang AS row", "source AS pairs")
    got = token_alignment.align(again, A, B).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 7, 7] and all(r.n_links == 3 and r.n_best == 3 and r.count_sum == 9 for r in got)
