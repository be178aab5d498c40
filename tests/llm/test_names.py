"""Columns of the caller whose names are those that operators use on the way come back untouched."""

import pytest
from pyspark.sql import functions as F

from framequarry.llm import decontaminate, exact_dedup, ngram_join, shared, substring_dedup

from .test_llm import documents, words

NAMES = "row row_ hits items lost_id key sha chars a b lo hi own kept_text class size node list digest norm hash bucket link best component text_key n_removed __row __lost __id Row2 label score".split()


def table(spark, repeated):
    passage = words(60, 1)
    texts = [passage, passage + " x", words(90, 2), passage + " " + words(40, 3), words(90, 2), None, "", "short one", words(80, 9)]
    docs = documents(spark, texts).drop("hash", "kept")
    if repeated:
        docs = docs.union(docs.where("doc_id IN (2, 7)"))
    return docs.withColumns({n: F.concat(F.lit(n + "-"), "doc_id") if i % 2 else F.col("doc_id") * 10 + i for i, n in enumerate(NAMES)})


def test_free_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "row int, ROW_ int, x int")
    assert shared.free(df, "row", "x", "y", "y") == ["row__", "x_", "y", "y_"]


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("op", ["exact", "near", "substring", "documents", "documents in blocks", "spans in blocks"])
def test_columns_come_back(spark, op, repeated):
    docs = table(spark, repeated)
    benchmark = spark.createDataFrame([("i1", words(80, 9)), ("i2", words(20, 8))], "item_id string, text string")
    run = {
        "exact": lambda d: exact_dedup.drop_exact_copies(d), "near": lambda d: ngram_join.drop_near_duplicates(d), "substring": lambda d: substring_dedup.drop_repeats(d), "documents": lambda d: decontaminate.decontaminate(d, benchmark),
        "documents in blocks": lambda d: decontaminate.decontaminate(d, benchmark, block_bytes=200), "spans in blocks": lambda d: decontaminate.decontaminate(d, benchmark, remove="spans", block_bytes=200),
    }[op]
    out = run(docs)
    assert out.columns == docs.columns
    rows = out.collect()
    plain = sorted((r.doc_id, r.text) for r in run(docs.select("doc_id", "text", "lang", "source", "n_chars")).collect() if r.text is not None)
    assert sorted((r.doc_id, r.text) for r in rows if r.text is not None) == plain and rows
    for r in rows:
        assert all(r[n] == (f"{n}-{r.doc_id}" if i % 2 else r.doc_id * 10 + i) for i, n in enumerate(NAMES))
