"""Incremental and streaming ingest into the content-keyed result table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framequarry.functions.store import materialize, release
from framequarry.operators.analysis import analyse_headers
from framequarry.operators.results import SCHEMA_VERSION, append, current, misses, stored, upsert
from framequarry.operators.resulttable import ResultTable
from framequarry.sources.blocks import headers_of
from framequarry.sources.frames import known_extension

#: Bytes of the files of one batch of a stream: a thousand frames of 64 MB.
BATCH_BYTES = 1000 << 26


def ingest(arrived: DataFrame, store: DataFrame, analyse: Callable[[DataFrame], DataFrame], version: int = SCHEMA_VERSION) -> tuple[DataFrame, DataFrame]:
    """(rows served from the store, new store): keys without a current row are analysed once, whatever their copies.

    ``analyse`` gives a row for every key, for files that cannot be read one with success false and the error; such
    rows are kept like others, so a broken file is not tried again until the version changes.
    """
    todo = misses(arrived, store, version).dropDuplicates(["cache_key"])
    return current(store, version).join(arrived.select("cache_key").distinct(), "cache_key", "left_semi"), upsert(store, analyse(todo))


def ingest_into(arrived: DataFrame, path: str, analyse: Callable[[DataFrame], DataFrame], version: int = SCHEMA_VERSION) -> None:
    """Analyse the keys of ``arrived`` that the table at ``path`` lacks and append their rows."""
    store = stored(arrived.sparkSession, path)
    todo = (arrived if store is None else misses(arrived, store, version)).dropDuplicates(["cache_key"])
    append(analyse(todo), path)


def stream_into(arrivals: DataFrame, spark: SparkSession, path: str, checkpoint: str, analyse: Callable[[DataFrame], DataFrame]):
    """Run ``ingest_into`` for each micro-batch of a stream until what has arrived is done.

    A batch appends the rows of its own new keys. One that runs again after a failure finds the keys that it has stored
    and adds nothing twice.
    """
    return arrivals.writeStream.foreachBatch(lambda batch, _: ingest_into(batch, path, analyse)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def files_into(listing: DataFrame, table: ResultTable, analyse: Callable[[DataFrame], DataFrame] = analyse_headers, version: int = SCHEMA_VERSION) -> None:
    """Analyse the files of ``listing`` (path, length) whose keys ``table`` lacks, and add their rows.

    Of the files only headers and the bytes of their keys are read before it is known which are new; copies are read once.
    A file that cannot be opened is left out, and comes again with the next listing that has it.
    """
    headers = materialize(headers_of(listing).where("cache_key IS NOT NULL"), "arrived-headers")
    store = table.rows()
    todo = headers if store is None else misses(headers, store, version)
    if not todo.isEmpty():
        table.append(analyse(todo))
    release(headers)


def stream_files(spark: SparkSession, folder: str, table: ResultTable, checkpoint: str, analyse: Callable[[DataFrame], DataFrame] = analyse_headers, files_a_batch: int | None = None):
    """Run ``files_into`` for the frame files that arrive below ``folder``, until those that are there are done.

    A batch takes ``BATCH_BYTES`` of files, or ``files_a_batch`` if that is given: what a batch costs besides its bytes is
    then spent once for so many bytes, however small the files are.

    The stream lists files and carries no contents; files without bytes are not listed by Spark's file source. It goes on from its checkpoint; a batch that runs again finds its keys.
    """
    listed = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true")
    listed = (listed.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else listed.option("maxBytesPerTrigger", BATCH_BYTES)).load(folder)
    arrivals = known_extension(listed, "path").select("path", "length")
    return arrivals.writeStream.foreachBatch(lambda batch, _: files_into(batch, table, analyse)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
