"""A versioned table: Parquet files and one manifest for each version.

A writer stages its files, then publishes the next manifest by a rename that
fails if another writer was first. That is atomic on stores whose rename
does not replace a file (HDFS); elsewhere let one writer at a time commit.
Readers pin a version; files are removed only by ``sweep``. All paths go
through Hadoop's file systems.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import Conflict, InvalidArgument


class TableStore:
    """A table under ``path`` whose versions are lists of Parquet folders."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        if not path or ".." in path.split("/"):
            raise InvalidArgument(f"path {path!r}")
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._io = jvm.org.apache.commons.io.IOUtils

    def _manifest(self, version: int):
        return self._path(f"{self.path}/manifests/{version:012d}.json")

    def version(self) -> int:
        """The last version; 0 before the first commit."""
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return 0
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return max((int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version == 0:
            return {"version": 0, "parts": []}
        stream = self._fs.open(self._manifest(version))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last."""
        return self.read_parts(self.manifest(version)["parts"])

    def read_parts(self, parts: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{p}" for p in parts)) if parts else self.spark.createDataFrame([], self.schema)

    def stage(self, rows: DataFrame, *, bloom: str | None = None, rows_per_file: int = 0) -> str:
        """Write files that no version lists yet."""
        part = uuid.uuid4().hex
        writer = rows.write.option("maxRecordsPerFile", rows_per_file)
        if bloom:
            writer = writer.option(f"parquet.bloom.filter.enabled#{bloom}", "true")
        writer.parquet(f"{self.path}/data/{part}")
        return part

    def commit(self, base: int, parts: list[str]) -> int:
        """Publish version ``base`` + 1 with ``parts``; ``Conflict`` if it exists already."""
        temp = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, False)
        try:
            out.write(bytearray(json.dumps({"version": base + 1, "parts": parts}).encode()))
        finally:
            out.close()
        target = self._manifest(base + 1)
        if self._fs.exists(target) or not self._fs.rename(temp, target):
            self._fs.delete(temp, False)
            raise Conflict(f"version {base + 1} exists")
        return base + 1

    def append(self, rows: DataFrame) -> int:
        base = self.version()
        return self.commit(base, [*self.manifest(base)["parts"], self.stage(rows)])

    def replace(self, rows: DataFrame, base: int, *, bloom: str | None = None) -> int:
        """A version that holds ``rows`` alone, unless another was published since ``base``."""
        return self.commit(base, [self.stage(rows, bloom=bloom)])

    def snapshot(self, path: str, version: int | None = None) -> dict:
        """Copy a version's rows to ``path`` with a manifest of its own."""
        version = self.version() if version is None else version
        copy = TableStore(self.spark, path, self.schema)
        copy.commit(0, [copy.stage(self.read(version))])
        return {"version": version, "path": path}

    def sweep(self, keep_from: int) -> list[str]:
        """Remove data that no version from ``keep_from`` on lists; earlier versions are given up."""
        last = self.version()
        used = {p for v in range(keep_from, last + 1) for p in self.manifest(v)["parts"]}
        folder, gone = self._path(f"{self.path}/data"), []
        for v in range(1, keep_from):
            self._fs.delete(self._manifest(v), False)
        if self._fs.exists(folder):
            for s in self._fs.listStatus(folder):
                if (name := s.getPath().getName()) not in used:
                    self._fs.delete(s.getPath(), True)
                    gone.append(name)
        return gone
