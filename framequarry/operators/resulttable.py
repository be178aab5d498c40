"""The result table on disk: parts by key prefix, named by a manifest that is swapped.

A row lies in the part of the first letters of its key. A batch rewrites the parts of its own keys and no other; an append
adds files beside them, which the next upsert or ``compact`` folds. A version of the table is a manifest: for each prefix
the folders that hold it. Writers put new files into folders of their own and then create the next manifest, which fails if
another writer has created it; a write that breaks off leaves the version before it as it is, and an upsert may read the
table that it writes.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from framequarry.functions.store import materialize, release
from framequarry.operators.results import upsert

PREFIX = "key_prefix"


class ConcurrentWrite(Exception):
    """Another writer has made the next version; the table is unchanged by this one."""


class ResultTable:
    """Rows (cache_key, schema_version, computed_at, ...) below ``path``, at most one a key once folded."""

    def __init__(self, spark: SparkSession, path: str, letters: int = 2):
        self.spark, self.path, self.letters = spark, path.rstrip("/"), letters
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def version(self) -> int:
        """Number of the newest manifest, 0 before the first."""
        folder = self._at("manifests")
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)] if self.fs.exists(folder) else []
        return max([int(n.removesuffix(".json")) for n in names if n.endswith(".json")], default=0)

    def _manifest(self, version: int) -> dict:
        if not version:
            return {"parts": {}}
        return json.loads(self.spark.read.text(str(self._at("manifests", f"{version:012d}.json")), wholetext=True).first()[0])

    def manifest(self, version: int | None = None) -> dict[str, list[str]]:
        """Folders by prefix; at most ``16 ** letters`` prefixes, as keys are hexadecimal."""
        return self._manifest(self.version() if version is None else version)["parts"]

    def _swap(self, version: int, parts: dict[str, list[str]], schema: dict) -> None:
        """Create the manifest after ``version``: written aside, then renamed, which fails where there is one."""
        aside, to = self._at("manifests", f".{uuid.uuid4().hex}"), self._at("manifests", f"{version + 1:012d}.json")
        self.fs.mkdirs(self._at("manifests"))
        out = self.fs.create(aside, False)
        out.write(bytearray(json.dumps({"parts": parts, "schema": schema}).encode()))
        out.close()
        if self.fs.exists(to) or not self.fs.rename(aside, to):
            self.fs.delete(aside, False)
            raise ConcurrentWrite(f"version {version + 1} of {self.path}")

    def _read(self, parts: dict[str, list[str]], version: int) -> DataFrame | None:
        paths = sorted({f"{self.path}/{folder}/{PREFIX}={p}" for p, folders in parts.items() for folder in folders})
        if not paths:
            return None
        return self.spark.read.schema(StructType.fromJson(self._manifest(version)["schema"])).parquet(*paths)

    @staticmethod
    def _folded(rows: DataFrame) -> DataFrame:
        """One row a key, by the rules of ``results.upsert``."""
        return upsert(rows.where(F.lit(False)), rows)

    def rows(self) -> DataFrame | None:
        """All rows of the newest version, or None before the first. A key that was appended to has several until it is folded."""
        version = self.version()
        return self._read(self.manifest(version), version)

    def _write(self, rows: DataFrame) -> tuple[str, list[str]]:
        """(folder, prefixes) of ``rows`` written aside: a task for each group of prefixes, one file a prefix."""
        folder = f"data/{uuid.uuid4().hex}"
        rows.withColumn(PREFIX, F.substring("cache_key", 1, self.letters)).repartition(PREFIX).write.partitionBy(PREFIX).parquet(f"{self.path}/{folder}")
        found = [s.getPath().getName() for s in self.fs.listStatus(self._at(folder))]
        return folder, sorted(n.split("=", 1)[1] for n in found if n.startswith(f"{PREFIX}="))

    def append(self, rows: DataFrame) -> None:
        """Add rows, whose keys the table lacks; no file of the table is read or rewritten."""
        version = self.version()
        parts = self.manifest(version)
        folder, prefixes = self._write(rows)
        if prefixes:
            self._swap(version, parts | {p: [*parts.get(p, []), folder] for p in prefixes}, rows.schema.jsonValue())

    def upsert(self, new: DataFrame) -> list[str]:
        """Fold ``new`` in by the rules of ``results.upsert``; the prefixes that were rewritten, those of its keys."""
        version = self.version()
        parts = self.manifest(version)
        new = materialize(new, "new-results")
        touched = [r[0] for r in new.select(F.substring("cache_key", 1, self.letters)).distinct().collect()]
        old = self._read({p: parts[p] for p in touched if p in parts}, version)
        if old is not None and any(len(parts.get(p, [])) > 1 for p in touched):
            old = self._folded(old)
        folder, prefixes = self._write(self._folded(new) if old is None else upsert(old, new))
        if prefixes:
            self._swap(version, parts | {p: [folder] for p in prefixes}, new.schema.jsonValue())
        release(new)
        return prefixes

    def compact(self) -> list[str]:
        """Fold the prefixes that have files of several writes; which these were."""
        version = self.version()
        parts = self.manifest(version)
        many = {p: f for p, f in parts.items() if len(f) > 1}
        if not many:
            return []
        old = self._read(many, version)
        folder, prefixes = self._write(self._folded(old))
        self._swap(version, parts | {p: [folder] for p in prefixes}, old.schema.jsonValue())
        return prefixes

    def vacuum(self) -> int:
        """Delete the parts that the newest version does not name, and the manifests before it; how many parts."""
        version, data = self.version(), self._at("data")
        parts = self.manifest(version)
        old = 0
        for write in self.fs.listStatus(data) if self.fs.exists(data) else []:
            folder = f"data/{write.getPath().getName()}"
            own = [s.getPath() for s in self.fs.listStatus(write.getPath()) if s.getPath().getName().startswith(f"{PREFIX}=")]
            unused = [p for p in own if folder not in parts.get(p.getName().split("=", 1)[1], [])]
            for path in unused if len(unused) < len(own) else [write.getPath()]:
                self.fs.delete(path, True)
            old += len(unused)
        for i in range(1, version):
            self.fs.delete(self._at("manifests", f"{i:012d}.json"), False)
        return old
