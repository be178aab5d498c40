"""Folders that the driver and every executor can reach, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handed to a Python worker at once; keeps a task's memory independent of the partition's size.
ARROW_BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession, label: str) -> str:
    """URI of a new folder under ``spark.checkpoint.dir`` (a temporary folder where that is unset and Spark runs in this process, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: on a cluster it must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = ("file://" if base.startswith("/") else "file:///") + base
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


_active = threading.local()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``materialize`` writes inside are deleted at the end. Those written with ``keep=True`` outlive it, and
    are deleted with the scratch around it, if there is one."""
    levels = _active.__dict__.setdefault("levels", [])
    levels.append([])
    try:
        yield
    finally:
        for path in levels.pop():
            delete(spark, path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def materialize(df: DataFrame, label: str, keep: bool = False, **options) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: survives lost executors, has no lineage."""
    path = shared_dir(df.sparkSession, label)
    levels = getattr(_active, "levels", [])
    if len(levels) > keep:
        levels[-1 - keep].append(path)
    df.write.options(**options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(table: DataFrame) -> None:
    """Delete a table that ``materialize`` has written."""
    delete(table.sparkSession, table.stored_at)


def small(df: DataFrame, rows: int = 1 << 18) -> DataFrame:
    """``df``, a written table of narrow rows, to be broadcast if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def free(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores after it as it takes for ``df`` not to have such a column, in any case."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def few(df: DataFrame, rows: int, each: int = 50_000, least: int = 8) -> DataFrame:
    """``df``, made of ``rows`` rows or about, in tasks of about ``each`` rows: small tables need no task per shuffle partition."""
    return df.coalesce(max(least, -(-rows // each)))


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that Spark hands to Python by bytes, not only by rows."""
    for key in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxBytesPerOutputBatch"):
        now = spark.conf.get(key, None)
        if not str(now or "").strip("bB").isdigit() or not 0 < int(str(now).strip("bB")) <= ARROW_BATCH_BYTES:
            spark.conf.set(key, str(ARROW_BATCH_BYTES))
