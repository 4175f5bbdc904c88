"""Engine: the key-value interface over a versioned changelog, and the vector table."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument, KeyNotFound
from tidemark.operators import maintenance, state, vectors
from tidemark.sources.table_store import TableStore

CHANGELOG = "seq long, op_idx int, key binary, op string, value binary"


class Transaction:
    """Puts and deletes that are committed together."""

    def __init__(self):
        self.ops: list[tuple[str, bytes, bytes | None]] = []

    def put(self, key: bytes, value: bytes) -> None:
        self.ops.append(("put", bytes(key), bytes(value)))

    def delete(self, key: bytes) -> None:
        self.ops.append(("delete", bytes(key), None))


class Engine:
    """Point reads, ordered scans and atomic writes; every write is one version.

    A point read is a Spark job: read many keys at once with ``get_many``.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = TableStore(spark, path, CHANGELOG)

    def _log(self, version: int | None = None) -> DataFrame:
        return self.table.read(version).withColumn("seq", F.struct("seq", "op_idx"))

    def get(self, key: bytes) -> bytes:
        return bytes(state.get_value(self._log(), bytearray(key)))

    def get_many(self, keys: DataFrame) -> DataFrame:
        return state.get_many(self._log(), keys).select("key", "value")

    def put(self, key: bytes, value: bytes) -> None:
        with self.transaction() as t:
            t.put(key, value)

    def delete(self, key: bytes) -> None:
        with self.transaction() as t:
            t.delete(key)

    @contextmanager
    def transaction(self):
        """Commit what the block puts and deletes, or nothing if it raises."""
        txn = Transaction()
        yield txn
        self.execute(txn)

    def execute(self, txn: Transaction) -> int:
        """Operations apply in order; a delete of a key that is not live then aborts all."""
        if not txn.ops:
            return self.table.version()
        base = self.table.version()
        deleted = {k for op, k, _ in txn.ops if op == "delete"}
        live: set[bytes] = set()
        if deleted:
            wanted = self.spark.createDataFrame([(bytearray(k),) for k in deleted], "key binary")
            live = {bytes(r["key"]) for r in state.get_many(self._log(base), wanted).select("key").collect()}
        for op, key, _ in txn.ops:
            if op == "delete" and key not in live:
                raise KeyNotFound(key)
            live.discard(key) if op == "delete" else live.add(key)
        rows = [(base + 1, i, bytearray(k), op, None if v is None else bytearray(v)) for i, (op, k, v) in enumerate(txn.ops)]
        part = self.table.stage(self.spark.createDataFrame(rows, CHANGELOG).coalesce(1))
        return self.table.commit(base, [*self.table.manifest(base)["parts"], part])

    def load(self, rows: DataFrame) -> int:
        """Put the rows (key, value) of a DataFrame in one version."""
        base = self.table.version()
        ops = rows.select(F.lit(base + 1).cast("long").alias("seq"), F.lit(0).alias("op_idx"), "key", F.lit("put").alias("op"), "value")
        return self.table.commit(base, [*self.table.manifest(base)["parts"], self.table.stage(ops)])

    def scan(self, prefix: bytes = b"", *, cursor: bytes = b"", limit: int = 100, include_values: bool = True, max_value_bytes: int | None = None):
        """Rows of a page and its next cursor."""
        prefix, cursor = bytearray(prefix), bytearray(cursor)
        return state.scan(self._log(), state.ScanRequest(limit, bytes(prefix), cursor, include_values, max_value_bytes))

    def state(self, version: int | None = None) -> DataFrame:
        return state.live(self._log(version)).select("key", "value")

    def compact(self, *, max_entries: int = 0, max_bytes: int = 0) -> dict:
        """Rewrite the last version as its live rows, ordered by key; each keeps its seq."""
        if max_entries < 0 or max_bytes < 0:
            raise InvalidArgument("limits are 0 (none) or more")
        base = self.table.version()
        log = self._log(base)
        if max_entries or max_bytes:
            maintenance.check_limits(log, max_entries=max_entries or 1 << 62, max_bytes=max_bytes or 1 << 62)
        stats = maintenance.compact_stats(log).head().asDict()
        rows = maintenance.compacted(log).select(F.col("seq.seq").alias("seq"), F.col("seq.op_idx").alias("op_idx"), "key", "op", "value")
        self.table.replace(rows, base, bloom="key")
        return stats

    def merge_oldest(self, parts: int, *, max_entries: int = 0, rows_per_file: int = 0) -> dict:
        """Merge the ``parts`` oldest folders of the last version into one; the newer ones stay as they are.

        Rows keep their seq. As no older rows exist, deletes are dropped as
        well. ``rows_per_file`` bounds the files that are written.
        """
        if parts < 2 or max_entries < 0 or rows_per_file < 0:
            raise InvalidArgument("two parts or more, limits of 0 (none) or more")
        base = self.table.version()
        listed = self.table.manifest(base)["parts"]
        oldest = self.table.read_parts(listed[:parts]).withColumn("seq", F.struct("seq", "op_idx"))
        if max_entries:
            maintenance.check_limits(oldest, max_entries=max_entries, max_bytes=1 << 62)
        stats = maintenance.compact_stats(oldest).head().asDict()
        rows = maintenance.compacted(oldest).select(F.col("seq.seq").alias("seq"), F.col("seq.op_idx").alias("op_idx"), "key", "op", "value")
        self.table.commit(base, [self.table.stage(rows, bloom="key", rows_per_file=rows_per_file), *listed[parts:]])
        return stats

    def snapshot(self, path: str) -> dict:
        return self.table.snapshot(path)

    def backup(self, path: str) -> dict:
        """Copy the last version's live rows (``snapshot``) and whole log (``log``) to ``path``, with a record of both in ``backup``.

        The record comes last: without it a backup is not complete.
        """
        base = self.table.version()
        snapshot, log = f"{path}/snapshot", f"{path}/log"
        copy = TableStore(self.spark, snapshot, CHANGELOG)
        rows = maintenance.compacted(self._log(base)).select(F.col("seq.seq").alias("seq"), F.col("seq.op_idx").alias("op_idx"), "key", "op", "value")
        copy.commit(0, [copy.stage(rows)])
        self.table.snapshot(log, base)
        record = {"version": base, "snapshot": snapshot, "log": log, "entries": copy.read().count(), "log_rows": self._log(base).count()}
        self.spark.createDataFrame([tuple(record.values())], "version long, snapshot string, log string, entries long, log_rows long").coalesce(1).write.json(f"{path}/backup")
        return record


VECTORS = "seq long, id string, op string, values array<double>, metadata string"


class VectorTable:
    """Vectors with metadata (JSON text): add, get, delete."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.table = TableStore(spark, path, VECTORS)

    def _append(self, vector_id: str, op: str, values: list[float] | None, metadata: str | None) -> None:
        base = self.table.version()
        rows = self.spark.createDataFrame([(base + 1, vector_id, op, values, metadata)], VECTORS).coalesce(1)
        self.table.commit(base, [*self.table.manifest(base)["parts"], self.table.stage(rows)])

    def add(self, values: list[float], metadata: str | None = None) -> str:
        """Store a copy of a vector under a fresh id."""
        vector_id = str(uuid.uuid4())
        self._append(vector_id, "add", [float(x) for x in values], metadata)
        return vector_id

    def load(self, rows: DataFrame) -> int:
        """Add the rows (values, metadata) of a DataFrame in one version; ids are drawn once and stored."""
        base = self.table.version()
        drawn = rows.select(F.lit(base + 1).cast("long").alias("seq"), F.expr("uuid()").alias("id"), F.lit("add").alias("op"), F.col("values").cast("array<double>").alias("values"), "metadata")
        return self.table.commit(base, [*self.table.manifest(base)["parts"], self.table.stage(drawn)])

    def live(self) -> DataFrame:
        return vectors.live_vectors(self.table.read()).select("id", "values", "metadata")

    def get(self, vector_id: str):
        return vectors.get_vector_row(self.live(), vector_id)

    def delete(self, vector_id: str) -> None:
        self.get(vector_id)
        self._append(vector_id, "delete", None, None)
