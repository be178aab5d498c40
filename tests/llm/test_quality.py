"""The passage model against plain loops and numeric derivatives; scores against held-out labels."""

import zlib

import numpy as np
import pyarrow as pa

from framequarry.llm import quality, textarrays

from .test_llm import documents, hard_texts, words


def vectors(texts):
    return quality.passages(*textarrays.buffers(pa.array(texts, pa.string())))


def test_passages_cover_each_word_once():
    texts = ["", "a b", words(500, 1), None, words(97, 2), " \n ", "same " * 200]
    x, first = vectors(texts)
    sizes = np.expm1(x[:, -1] * 5).round().astype(int)
    for i, t in enumerate(texts):
        own, n = sizes[first[i] : first[i + 1]], len((t or "").split())
        assert own.sum() == n and len(own) == max(1, (n + 32) // 64) and own.max() - own.min() <= 1
    alone = vectors(texts[2:3])[0]
    assert np.allclose(x[first[2] : first[3]], alone)  # neighbours in a batch change nothing
    distinct, same = x[first[6], -7], x[first[6] + 1, -6]
    assert distinct < 0.02 and same == 1
    assert vectors([])[0].shape == (0, quality.FEATURES)


def small_model(monkeypatch, rng):
    monkeypatch.setattr(quality, "FEATURES", 5)
    m = quality.Model(np.zeros(5), np.ones(5), 0.3)
    for k in m.NAMES:
        setattr(m, k, getattr(m, k).astype(float) + rng.normal(size=getattr(m, k).shape) * 0.2)
    return m


def test_gated_attention_and_its_gradients(monkeypatch):
    rng = np.random.default_rng(3)
    m = small_model(monkeypatch, rng)
    x, first, y = rng.normal(size=(9, 5)), np.array([0, 1, 5, 9]), np.array([1.0, 0.0, 1.0])
    s, weights, _ = m.forward(x, first)
    for i in range(3):
        h = [np.tanh(v @ m.W + m.b) for v in x[first[i] : first[i + 1]]]
        e = [float(np.sum(m.a * np.tanh(v @ m.V) / (1 + np.exp(-(v @ m.U))))) for v in h]
        a = np.exp(e) / np.exp(e).sum()
        assert np.allclose(weights[first[i] : first[i + 1]], a)
        assert np.isclose(s[i], 1 / (1 + np.exp(-(sum(w * v for w, v in zip(a, h, strict=True)) @ m.c + m.d[0]))))
    loss = lambda: -np.mean(y * np.log(m.forward(x, first)[0]) + (1 - y) * np.log(1 - m.forward(x, first)[0]))
    for k, grad in m.gradients(x, first, y).items():
        value = getattr(m, k)
        for at in list(np.ndindex(value.shape))[:6]:
            kept, value[at] = value[at], value[at] + 1e-5
            up = loss()
            value[at] = kept - 1e-5
            down = loss()
            value[at] = kept
            assert np.isclose(grad[at], (up - down) / 2e-5, atol=1e-6), (k, at)


def test_attention_finds_the_passages_that_decide():
    """Only some passages of bad documents are bad; the weights go there."""
    bad = lambda seed: " ".join(w + "%%%" for w in words(64, seed).split())
    texts = [" ".join(bad(i * 9 + j) if j == i % 4 and i % 2 else words(64, i * 9 + j) for j in range(4)) for i in range(160)]
    x, first = vectors(texts)
    y = np.arange(160) % 2 == 0
    m = quality.learn([x[first[i] : first[i + 1]] for i in range(120)], y[:120], 0.5)
    s, weights, _ = m.forward(m.standard(x), first)
    assert np.mean((s[120:] >= 0.5) == y[120:]) >= 0.95
    top = [weights[first[i] : first[i + 1]].argmax() == i % 4 for i in range(121, 160, 2)]
    assert np.mean(top) >= 0.9


def test_held_out_documents(spark):
    """Labels of documents that are held out, and of no document that is not."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels.withColumn("doc_id", labels.doc_id))
    got = quality.score(docs, model).collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 50 and np.mean(right) >= 0.97
    changed = labels.selectExpr("doc_id", "CASE WHEN crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 5 = 0 THEN 1 - quality ELSE quality END AS quality", "toxic")
    again = quality.fit(docs, changed)
    assert all(np.array_equal(getattr(model, k), getattr(again, k)) for k in model.NAMES)


def test_odd_texts_and_tables(spark):
    texts = [*hard_texts(), words(64, 1) + "%%%" * 3000, "x" * 200_000]
    docs = documents(spark, texts)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    flat = quality.score(docs, quality.fit(docs, none)).collect()
    assert len(flat) == len(texts) and {r.score for r in flat} == {0.5}
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(len(texts))] + [(None, 1, 0), (3, None, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs.union(docs), labels)
    one = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    twice = quality.score(docs.union(docs).repartition(5), model).collect()
    assert len(twice) == 2 * len(texts) and all(abs(one[r.doc_id] - r.score) < 1e-5 for r in twice)
    assert quality.score(documents(spark, []), model).collect() == []
    named = quality.score(docs.selectExpr("CAST(NULL AS LONG) AS doc_id", "text", "lang AS score", "source AS bag"), model).collect()
    assert len(named) == len(texts) and not any(r.held_out for r in named)
    one_label = quality.fit(docs, labels.where("quality = 1"))
    scores = {r.doc_id: r.score for r in quality.score(docs, one_label).collect()}
    assert all(scores[i] > 0.5 for i in range(1, len(texts), 2) if zlib.crc32(str(i).encode()) % 5), scores
