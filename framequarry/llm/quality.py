"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of about ``PASSAGE_WORDS`` words; only the document has a label. Each passage becomes a
vector (pairs of neighbouring character classes, word statistics, repetition), which a layer encodes as h. A gated
attention, w . (tanh(V h) * sigmoid(U h)), gives each passage its weight by a softmax over the document, and the weighted
sum of the encodings is scored by a logistic unit. Encoder, attention and score are learned together from document labels.

Fitting uses a bounded sample: at most ``rows`` labelled documents of each label, the first ones in the order of a hash of
doc_id, and of a longer one ``BAG`` evenly spaced passages. Scoring reads every passage of every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .shared import bounded_batches

PASSAGE_WORDS = 64
#: Passages of a training document.
BAG = 32
#: Sizes of the encoding and of the attention.
WIDTH, GATE = 24, 12
STEPS, BATCH, RATE, DECAY = 300, 64, 0.01, 1e-4
#: Classes of bytes: signs one by one, then other signs, digits, lower and upper case, bytes beyond ASCII, space, other blanks.
SIGNS = "#$%&*|!.,;:?-'\"()/@_<>=+"
KINDS = len(SIGNS) + 7


def _kinds() -> np.ndarray:
    out = np.full(256, len(SIGNS), np.int64)
    for i, c in enumerate(SIGNS):
        out[ord(c)] = i
    for k, values in enumerate((range(48, 58), range(97, 123), range(65, 91), range(128, 256), (32,), (*range(9, 14), 0)), len(SIGNS) + 1):
        out[list(values)] = k
    return out


KIND = _kinds()
WORD_FEATURES = 7
FEATURES = KINDS * KINDS + WORD_FEATURES


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of all passages, for each document and one more: its first passage). A text without words has one, of zeros."""
    w = ta.words(data, offsets, ta.NOT_SPACE)
    n = w.counts
    parts = np.maximum(1, (n + PASSAGE_WORDS // 2) // PASSAGE_WORDS)
    first = np.concatenate([[0], np.cumsum(parts)])
    out = np.zeros((first[-1], FEATURES), np.float32)
    if not len(w.hash):
        return out, first
    doc, place = w.doc, np.arange(len(w.hash)) - np.repeat(w.first[:-1], n)
    passage = first[doc] + place * parts[doc] // n[doc]
    size = np.bincount(passage, minlength=len(out)).astype(np.float32)
    # The bytes of a passage: from its first word to the blank after its last.
    opens = np.flatnonzero(np.diff(passage, prepend=-1))
    finish = (offsets - offsets[0])[doc[opens] + 1]
    begin, stop = w.start[opens], np.minimum(w.end[np.append(opens[1:], len(passage)) - 1] + 1, finish)
    span = stop - begin
    of = np.repeat(passage[opens], span)
    at = np.arange(len(of)) + np.repeat(begin - (np.cumsum(span) - span), span)
    kind = np.append(KIND[w.data], KINDS - 1)
    pair = kind[at] * KINDS + np.where(at + 1 < np.repeat(finish, span), kind[at + 1], KINDS - 1)
    seen = np.bincount(of * (KINDS * KINDS) + pair, minlength=len(out) * KINDS * KINDS).reshape(len(out), -1)
    out[:, : KINDS * KINDS] = np.sqrt(seen / np.maximum(1, seen.sum(axis=1, keepdims=True)))
    whole = np.maximum(size, 1)
    share = lambda flag: np.bincount(passage, flag, len(out)) / whole
    length = (w.end - w.start).astype(np.float64)
    same = np.zeros(len(passage), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    order = np.lexsort((w.hash, passage))
    fresh = np.ones(len(order), bool)
    fresh[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (passage[order][1:] != passage[order][:-1])
    threes, fits = w.windows(3)
    key = np.where(fits, threes, w.hash) ^ ta.mix(doc.astype(np.uint64))
    _, place, times = np.unique(key, return_inverse=True, return_counts=True)
    mean = share(length)
    words = [np.bincount(passage[order], fresh, len(out)) / whole, share(same), share(fits & (times[place] > 1)), np.log1p(mean), np.log1p(np.sqrt(np.maximum(0, share(length**2) - mean**2))), share(length > 20), np.log1p(size) / 5]
    out[:, KINDS * KINDS :] = np.stack(words, axis=1)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Encoder (W, b), attention (V, U, a) and score (c, d); features are standardised by ``mean`` and ``scale``."""

    NAMES = ("W", "b", "V", "U", "a", "c", "d")

    def __init__(self, mean: np.ndarray, scale: np.ndarray, bias: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.mean, self.scale = mean.astype(np.float32), scale.astype(np.float32)
        self.W, self.b = draw(FEATURES, WIDTH), np.zeros(WIDTH, np.float32)
        self.V, self.U, self.a = draw(WIDTH, GATE), draw(WIDTH, GATE), draw(GATE)
        self.c, self.d = draw(WIDTH) * 0.1, np.array([bias], np.float32)

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        """(scores, weights of the passages, what ``gradients`` needs besides) of documents that begin at ``first[:-1]``."""
        h = np.tanh(x @ self.W + self.b)
        t, g = np.tanh(h @ self.V), _sigmoid(h @ self.U)
        e = (t * g) @ self.a
        at, n = first[:-1], np.diff(first)
        p = np.exp(e - np.repeat(np.maximum.reduceat(e, at), n))
        p /= np.repeat(np.add.reduceat(p, at), n)
        z = np.add.reduceat(p[:, None] * h, at)
        return _sigmoid(z @ self.c + self.d), p, (h, t, g, z)

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        s, p, (h, t, g, z) = self.forward(x, first)
        n = np.diff(first)
        ds = (s - y) / len(y)
        dz = np.repeat(ds[:, None] * self.c, n, axis=0)
        dp = (dz * h).sum(axis=1)
        de = p * (dp - np.repeat(np.add.reduceat(p * dp, first[:-1]), n))
        dt, dg = de[:, None] * g * self.a * (1 - t * t), de[:, None] * t * self.a * g * (1 - g)
        dh = (p[:, None] * dz + dt @ self.V.T + dg @ self.U.T) * (1 - h * h)
        return {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "a": (t * g).T @ de, "c": z.T @ ds, "d": ds.sum(keepdims=True)}

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) * self.scale, -8, 8)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        x, first = passages(data, offsets)
        return self.forward(self.standard(x), first)[0]


def learn(bags: list[np.ndarray], labels: np.ndarray, prior: float) -> Model:
    """Fit by Adam on the log loss, over as many documents of either label as there are, then set the threshold's place
    back to the share ``prior`` of label 1."""
    labels = np.asarray(labels, np.float32)
    if not len(bags):
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), np.log(prior / (1 - prior)))
    every = np.concatenate(bags).astype(np.float32)
    spread = every.std(axis=0)
    model = Model(every.mean(axis=0), np.where(spread > 1e-4, 1 / np.maximum(spread, 1e-2), 0), 0.0)
    bags = [model.standard(b.astype(np.float32)) for b in bags]
    rng = np.random.default_rng(11)
    kinds = [np.flatnonzero(labels == v) for v in (0, 1)]
    kinds = [k for k in kinds if len(k)]
    m, v = {k: 0.0 for k in Model.NAMES}, {k: 0.0 for k in Model.NAMES}
    for step in range(1, STEPS + 1):
        pick = np.concatenate([rng.choice(k, BATCH // 2) for k in kinds])
        x, first = np.concatenate([bags[i] for i in pick]), np.concatenate([[0], np.cumsum([len(bags[i]) for i in pick])])
        rate = RATE * (1 - step / (STEPS + 1))
        for k, grad in model.gradients(x, first, labels[pick]).items():
            now = getattr(model, k)
            grad = grad + DECAY * now
            m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
            now -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    model.d += np.float32(np.log(prior / (1 - prior)) if len(kinds) == 2 else 0)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: crc32 of its id as text is 0 modulo 5."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, rows: int = 1000) -> Model:
    """Learn from labelled documents that are not held out: at most ``rows`` of either label.

    Rows without id or label do not count; a document with conflicting labels counts as 0. Of rows of ``docs`` that repeat
    a chosen doc_id one counts, the longest. Null texts are bags of one empty passage. Without examples every text gets
    the score 0.5; with examples of one label only, scores tend to it.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    count = {r.label: r["count"] for r in marks.groupBy("label").count().collect()}
    order = F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")
    chosen = [r for kind in (0, 1) for r in marks.where(F.col("label") == kind).orderBy(*order).limit(rows).collect()]
    picked = F.broadcast(spark.createDataFrame(chosen, "doc_id long, label int"))  # 2 * rows ids

    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in ta.texts_of(batch):
                x, first = passages(data, offsets)
                for k in range(j - i):
                    own = x[first[k] : first[k + 1]]
                    own = own[np.linspace(0, len(own) - 1, min(len(own), BAG)).astype(int)]
                    yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).slice(i + k, 1), "label": batch.column(1).slice(i + k, 1), "size": pa.array([int(offsets[k + 1] - offsets[k])], pa.int64()), "bag": pa.array([own.astype("<f2").tobytes()], pa.binary())})

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(picked, "doc_id").select("doc_id", "label", "text")
    found = sample.mapInArrow(bag, "doc_id long, label int, size long, bag binary").groupBy("doc_id", "label").agg(F.max(F.struct("size", "bag")).alias("r"))
    found = found.select("doc_id", "label", "r.bag").toArrow().sort_by("doc_id")  # BAG passages at most of each chosen id
    bags = [np.frombuffer(b.as_py(), "<f2").reshape(-1, FEATURES) for b in found["bag"]]
    total = sum(count.values())
    return learn(bags, found["label"].to_numpy(), (count.get(1, 0) + 1) / (total + 2))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    Null and empty texts are scored as one passage without words. Rows that repeat a doc_id, or have none (not held out),
    are scored one by one. A text of any length is read whole. An empty table gives no rows; other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [shared.value.score(data, offsets) for _, _, data, offsets in ta.texts_of(batch)]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "score": pa.array(np.concatenate(s).astype(float) if s else [], pa.float64())})

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
