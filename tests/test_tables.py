"""The result table by key prefix, order over ranges, and the stream of files."""

import glob
import hashlib
import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from framequarry.operators import analysis, results, triage
from framequarry.operators.resulttable import ConcurrentWrite, ResultTable
from framequarry.streaming import ingest

from . import fields

ROWS = "cache_key string, schema_version int, computed_at long, v int"


def key(i):
    return hashlib.sha256(str(i).encode()).hexdigest()


def some(spark, ids, at, v=0):
    return spark.createDataFrame([(key(i), 3, at, v + i) for i in ids], ROWS)


def held(table):
    return sorted((r.cache_key, r.computed_at, r.v) for r in table.rows().collect())


def files_of(path):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


def test_a_batch_rewrites_the_prefixes_of_its_keys(spark, tmp_path):
    path = str(tmp_path / "t")
    table = ResultTable(spark, f"file://{path}")
    assert table.rows() is None and table.compact() == [] and table.vacuum() == 0
    table.upsert(some(spark, range(2000), 1))
    before = files_of(path)
    assert len(before) == 256
    table.upsert(some(spark, range(1995, 2005), 2, 100))  # reads the path that it writes
    after = files_of(path)
    assert all(after[f] == t for f, t in before.items()) and len(after.keys() - before.keys()) <= 10
    want = [(key(i), 1, i) for i in range(1995)] + [(key(i), 2, 100 + i) for i in range(1995, 2005)]
    assert held(table) == sorted(want)
    table.upsert(some(spark, [3, 2004], 1, 500))  # as old as one, older than the other
    want = [x for x in want if x[0] != key(3)] + [(key(3), 1, 503)]
    assert held(table) == sorted(want)
    assert table.vacuum() > 0 and held(table) == sorted(want) and len(files_of(path)) == 256
    assert table.upsert(some(spark, [], 9)) == [] and held(table) == sorted(want)


def test_appended_rows_are_folded(spark, tmp_path):
    table = ResultTable(spark, str(tmp_path / "t"), letters=1)
    for at in (1, 3, 2):
        table.append(some(spark, range(40), at, at * 1000))
    assert table.rows().count() == 120 and max(map(len, table.manifest().values())) == 3
    touched = table.upsert(some(spark, [7], 3, 9000))
    assert touched == [key(7)[0]] and len(table.manifest()[key(7)[0]]) == 1
    assert set(table.compact()) == {k for k in table.manifest() if k != touched[0]} and table.compact() == []
    assert held(table) == sorted((key(i), 3, (9000 if i == 7 else 3000) + i) for i in range(40))


def test_a_failed_or_overtaken_write_leaves_the_table(spark, tmp_path):
    table = ResultTable(spark, str(tmp_path / "t"))
    table.upsert(some(spark, range(50), 1))
    want, version = held(table), table.version()
    with pytest.raises(PySparkException):
        table.upsert(some(spark, range(50), 2).withColumn("v", F.when(F.col("v") < 40, F.col("v")).otherwise(F.raise_error(F.lit("broken")).cast("int"))))
    assert held(table) == want and table.version() == version
    other = ResultTable(spark, str(tmp_path / "t"))
    write = other._write

    def overtaken(rows):
        table.upsert(some(spark, [1], 5))
        return write(rows)

    other._write = overtaken
    with pytest.raises(ConcurrentWrite):
        other.upsert(some(spark, [2], 6))
    assert held(table) == sorted([x for x in want if x[0] != key(1)] + [(key(1), 5, 1)])
    assert not glob.glob(str(tmp_path / "t/manifests/.*[!c]"))  # nothing is left beside the manifests


def hot_folder(spark):
    """A folder with two thirds of all files, one of two, one of one, equal names, names without number, no folder."""
    rng = np.random.default_rng(2)
    names = [("hot", f"Img_{i}.fit") for i in rng.permutation(400).tolist()] + [(f"d{i % 9}", f"x{i * 7 % 50}_{i}.fit") for i in range(180)]
    return [*names, ("two", "b10.fit"), ("two", "b9.fit"), ("one", "only.fit"), ("same", "a.fit"), ("same", "a.fit"), (None, "n2.fit"), (None, "n1.fit")]


@pytest.mark.parametrize("ranges", [1, 7, 300])
def test_neighbours_over_ranges(spark, ranges):
    df = spark.createDataFrame(hot_folder(spark), "dir string, name string").repartition(5)
    got, want = (sorted(map(str, x.collect())) for x in (triage.neighbours(df, ranges=ranges), results.neighbours(df)))
    assert got == want and len(got) == len(hot_folder(spark))
    if ranges > 1:
        rows = triage.ranged(df, "dir", "name", ranges)
        assert rows.where("folder = 'hot'").select("part").distinct().count() > 3
    assert triage.neighbours(df.where("false")).collect() == []


@pytest.mark.parametrize("ranges", [1, 9])
def test_places_over_ranges(spark, ranges):
    df = spark.createDataFrame(hot_folder(spark), "dir string, name string").repartition(5)
    got = [r.name for r in sorted(triage.places(df, ranges=ranges).collect(), key=lambda r: r.place)]
    assert got == [r.name for r in results.natural_sort(df).collect()]
    assert sorted(r.place for r in triage.places(df, ranges=ranges).collect()) == list(range(1, len(got) + 1))


def test_files_arrive_in_batches(spark, tmp_path):
    img, _ = fields.star_field(200, 160, 8)
    good, other = fields.fits(img), fields.fits(np.full((40, 50), 7.0))
    drops = [{"a.fits": good, "cut.fits": good[:9000]}, {"sub/copy.fits": good, "b.fit": other, "tiny.fits": b"abc", "empty.fits": b"", "x.xisf": fields.xisf(np.full((32, 24), 1234.0)), "notes.txt": b"-"}]
    folder, table, state = tmp_path / "in", ResultTable(spark, str(tmp_path / "t")), str(tmp_path / "state")
    calls = []

    def analyse(todo):
        calls.append(todo.count())
        return analysis.analyse_headers(todo, tile=64, computed_at=0)

    for drop in drops:
        for name, content in drop.items():
            (folder / name).parent.mkdir(parents=True, exist_ok=True)
            (folder / name).write_bytes(content)
        ingest.stream_files(spark, str(folder), table, state, analyse, files_a_batch=2).awaitTermination()
    assert sum(calls) == 5  # the copy of a stored file is not analysed
    ingest.stream_files(spark, str(folder), table, str(tmp_path / "fresh state"), analyse).awaitTermination()  # all files once more
    ingest.stream_files(spark, str(folder), table, state, analyse).awaitTermination()  # nothing new
    assert sum(calls) == 5
    files = [(n, c) for drop in drops for n, c in drop.items() if not n.endswith("txt") and c]  # Spark's file source lists no empty files
    df = spark.createDataFrame(files, "path string, content binary").withColumn("length", F.length("content").cast("long"))
    want = {r.cache_key: r for r in analysis.analyse_files(df, tile=64, computed_at=0).collect()}
    got = {r.cache_key: r for r in table.rows().collect()}
    assert got.keys() == want.keys() and table.rows().count() == 5
    for k, w in want.items():
        assert got[k].success == w.success and (got[k].error is None) == (w.error is None)
        assert all(got[k][c] == (w[c] if w[c] is None else pytest.approx(w[c], rel=1e-9)) for c in analysis.METRICS)


def test_small_files_share_a_batch(spark, tmp_path, monkeypatch):
    """A batch is bounded by the bytes of its files, not by their number."""
    for i in range(1010):
        (tmp_path / f"{i}.fits").write_bytes(b"%08d" % i)
    calls = []

    def analyse(todo):
        calls.append(todo.count())
        return todo.select("cache_key", F.lit(3).alias("schema_version"), F.lit(0).cast("long").alias("computed_at"))

    def stream(name):
        calls.clear()
        table = ResultTable(spark, str(tmp_path / f"{name} table"), letters=1)
        ingest.stream_files(spark, str(tmp_path), table, str(tmp_path / f"{name} state"), analyse).awaitTermination()
        return table.rows().select("cache_key").distinct().count()

    assert stream("one") == 1010 and calls == [1010]
    monkeypatch.setattr(ingest, "BATCH_BYTES", 8 * 505)
    assert stream("two") == 1010 and len(calls) == 2 and sum(calls) == 1010
