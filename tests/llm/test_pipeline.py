import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framequarry.llm import decontaminate, exact_dedup, language_id, ngram_join
from framequarry.llm.shared import materialize

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "packing"]
    c = duckdb.connect()
    c.execute(f"CREATE VIEW benchmark AS SELECT * FROM '{SF}/benchmark.parquet'")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.toPandas()
        c.register("documents", before)
        out = materialize(stage(spark, docs, SF), "test-stage")
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == set(before.doc_id)
            assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n < 2048").count() <= 1
            break
        assert out.columns == docs.columns
        kept = {r.doc_id for r in out.select("doc_id").collect()}
        want = {
            "language_id": lambda: {r.doc_id for r in language_id.classify(docs, language_id.fit(docs)).where("NOT rejected").collect()},
            "exact_dedup": lambda: {r[0] for r in c.execute(f"SELECT doc_id FROM ({exact_dedup.SQL}) WHERE kept").fetchall()},
            "near_dedup": lambda: {r[0] for r in c.execute(f"SELECT doc_id FROM ({ngram_join.SQL}) WHERE doc_id = component_id").fetchall()},
            "decontamination": lambda: {r[0] for r in c.execute(f"SELECT doc_id FROM ({decontaminate.SQL}) WHERE NOT contaminated").fetchall()},
        }[name]()
        assert kept == want, name
        docs = out


ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (2, "", "en", "s", 0),
    (3, "some words here", None, "s", 15),
    (3, "some words here", None, "s", 15),
    (4, "some  words here", "en", None, 16),
    (5, "and other words there", "en", "s", None),
    (None, "words without an id", "en", "s", 1),
    (6, "a b c", "en", "s", 5),
    (7, "long words " * 3000, "en", "s", 1),
]


@pytest.mark.parametrize("rows", [[], ODD], ids=["empty", "odd"])
def test_odd_tables(spark, tmp_path, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.withColumn("class", F.lit("x")).withColumn("lo", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 1 and 2 have no letters, 3 is shorter than 4 but for blanks, 6 is the benchmark.
    assert {r.doc_id for r in out} == ({4, 5, 7, None} if rows else set())
    assert all(sum(r.length for r in out if r.doc_id == d) == n for d, n in {(r.doc_id, r.doc_tokens) for r in out})
    assert len([x for x in set(os.listdir(shared)) - before if not x.startswith(".")]) == 1  # only the result is left
