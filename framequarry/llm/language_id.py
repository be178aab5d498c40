"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed character n-grams (letters folded to lower case, everything else
a gap). Each language has several centroids, clustered by spherical k-means, so dialects, registers and mixed
documents keep centres of their own. The language is that of the most similar centroid by cosine. A document is
rejected when it is further from every centroid than any plausible text of its length would be.

Fitting uses a bounded sample: at most ``per_language`` labelled documents of each language (fewer where ``sample``
rows are not enough for that, one at least), the first ones in the order of a hash of doc_id. Everything else covers every document in full.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import bounded_batches

BITS = 13
ORDERS = (1, 2, 3)
GAP = 0
RESULT = "lang_pred string, score double, rejected boolean"


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """Lower-case code point of every letter, 0 for all other code points."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def counts(text: str | None) -> tuple[np.ndarray, int]:
    """Counts of hashed n-grams within words (with a gap at both ends), and the number of letters."""
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    x = letter_table()[cp] if len(cp) else cp
    letters = int(np.count_nonzero(x))
    if not letters:
        return np.zeros(1 << BITS, np.float32), 0
    x = np.concatenate([[GAP], x, [GAP]]).astype(np.uint64)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != GAP) | (x[:-1] != GAP)  # runs of gaps count once
    x = x[keep]
    out = np.zeros(1 << BITS, np.int64)
    code = np.zeros(len(x), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        code = code[: len(x) - n + 1] * np.uint64(0x110000 + 1) + x[n - 1 :] + np.uint64(n)
        if n in ORDERS and len(code):
            slots = (code * np.uint64(ta.R)) >> np.uint64(64 - BITS)
            out += np.bincount(slots.astype(np.int64), minlength=1 << BITS)
    return out.astype(np.float32), letters


class Model:
    def __init__(self, languages: list[str], centroids: np.ndarray, owner: np.ndarray, idf: np.ndarray, floor: float):
        self.languages, self.centroids, self.owner, self.idf, self.floor = languages, centroids, owner, idf, floor

    def vectors(self, c: np.ndarray) -> np.ndarray:
        v = np.log1p(c) * self.idf
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.maximum(norm, 1e-9)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language (und without letters), score and rejection of each text."""
        found = [counts(t) for t in texts]
        letters = np.array([n for _, n in found])
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        cos = self.vectors(np.stack([c for c, _ in found])) @ self.centroids.T
        best = np.full((len(texts), len(self.languages)), -1.0)
        np.maximum.at(best.T, self.owner, cos.T)
        top = best.argmax(axis=1)
        p = np.exp(20 * (best - best.max(axis=1, keepdims=True)))
        score = p[np.arange(len(texts)), top] / p.sum(axis=1)
        near = best[np.arange(len(texts)), top]
        score = np.where(letters > 0, np.clip(score, 0, 1), 0.0)
        rejected = (letters == 0) | (near < self.reach(letters))
        return [self.languages[t] if n else "und" for t, n in zip(top.tolist(), letters.tolist(), strict=True)], score, rejected

    def reach(self, letters: np.ndarray) -> np.ndarray:
        """Least cosine of accepted texts: vectors of short texts are sparse, so less is asked of them."""
        return self.floor * np.sqrt(letters / (letters + 400.0))


def _kmeans(v: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means, seeded with the furthest points first, so the same sample gives the same centres."""
    centre = v.mean(axis=0)
    centres = [centre / max(np.linalg.norm(centre), 1e-9)]
    while len(centres) < min(k, len(v)):
        far = (v @ np.stack(centres).T).max(axis=1).argmin()
        centres.append(v[far])
    c = np.stack(centres)
    for _ in range(rounds):
        mine = (v @ c.T).argmax(axis=1)
        for i in range(len(c)):
            if (mine == i).any():
                c[i] = v[mine == i].mean(axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is 1 modulo 3."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def fit(docs: DataFrame, label_col: str = "lang", per_language: int = 200, sample: int = 2000, centroids: int = 4) -> Model:
    """Model from the labelled rows of ``docs`` (doc_id, text, label) that are not held out.

    Rows without label, text or id do not count; of rows that repeat a chosen doc_id, one does, so the sample is at most
    ``sample`` rows (or one of each language, if there are more languages). With no labelled rows the model knows no language.
    """
    bounded_batches(docs.sparkSession)
    spark = docs.sparkSession
    train = docs.where(F.col(label_col).isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col(label_col).alias("label"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    each = max(1, min(per_language, sample // max(1, train.select("label").distinct().count())))
    chosen = train.withColumn("turn", F.row_number().over(Window.partitionBy("label").orderBy(order, "doc_id"))).where(f"turn <= {each}")
    picked = {r.doc_id: r.label for r in chosen.collect()}  # about ``sample`` ids
    labels = spark.sparkContext.broadcast(picked)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = pa.array([d in labels.value for d in batch.column(0).to_pylist()])
            part = batch.filter(mask)
            if part.num_rows:
                ids = part.column(0).to_pylist()
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "label": [labels.value[d] for d in ids], "counts": [counts(t)[0].astype("<f4").tobytes() for t in part.column(1).to_pylist()]})

    rows = docs.where(F.col(label_col).isNotNull() & F.col("text").isNotNull()).select("doc_id", "text").mapInArrow(vectors, "doc_id long, label string, counts binary")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("label", "counts")).alias("r")).select("doc_id", "r.label", "r.counts").collect()  # a row for each chosen id
    rows.sort(key=lambda r: (r.label, r.doc_id))
    if not rows:
        return Model([], np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), np.ones(1 << BITS, np.float32), 0.0)
    c = np.stack([np.frombuffer(r.counts, "<f4") for r in rows])
    df = (c > 0).sum(axis=0)
    idf = np.log((1 + len(c)) / (1 + df)).astype(np.float32) + 1
    languages = sorted({r.label for r in rows})
    model = Model(languages, np.zeros((0, 1 << BITS)), np.zeros(0, int), idf, 0.0)
    v, of = model.vectors(c), np.array([languages.index(r.label) for r in rows])
    parts = [_kmeans(v[of == i], centroids) for i in range(len(languages))]
    model.centroids = np.concatenate(parts).astype(np.float32)
    model.owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    cos, letters = (v @ model.centroids.T).max(axis=1), c.sum(axis=1) / len(ORDERS)
    # Half the least similarity, relative to length, of any training text: only what is unlike all of them is rejected.
    model.floor = 0.5 * float((cos / np.sqrt(letters / (letters + 400.0))).min())
    return model


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score and rejected; null texts and texts without letters are ``und``, rejected."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                lang, score, rejected = shared.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score.astype(float)), "rejected": pa.array(rejected)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + RESULT)


def keep_recognised(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, with all columns."""
    bounded_batches(docs.sparkSession)
    shared, text_at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                yield part.filter(pa.array(~shared.value.predict(part.column(text_at).to_pylist())[2]))

    return docs.mapInArrow(run, docs.schema)
