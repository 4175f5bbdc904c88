"""Maintenance of a changelog: compaction, statistics, flush sizes, snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import LimitExceeded
from tidemark.functions.codec import partition_of
from tidemark.operators.state import latest, live

#: What an entry of the write buffer costs besides key and value.
ENTRY_BYTES = 16


def entry_bytes() -> Column:
    return F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))


def compact_stats(changelog: DataFrame) -> DataFrame:
    """One row (total, written, bytes_before, bytes_after): what a compaction reads and keeps."""
    before = changelog.agg(F.count("*").alias("total"), F.coalesce(F.sum(entry_bytes()), F.lit(0)).cast("long").alias("bytes_before"))
    after = live(changelog).agg(F.count("*").alias("written"), F.coalesce(F.sum(entry_bytes()), F.lit(0)).cast("long").alias("bytes_after"))
    return before.crossJoin(after).select("total", "written", "bytes_before", "bytes_after")


def compacted(changelog: DataFrame, *, partitions: int | None = None, keep_deletes: bool = False) -> DataFrame:
    """The changelog's latest rows, ordered by key within ranges of keys, each with its own seq.

    Deletes may be dropped only where all older rows of their keys take part.
    """
    rows = latest(changelog) if keep_deletes else live(changelog)
    ranged = rows.repartitionByRange(partitions, "key") if partitions else rows.repartitionByRange("key")
    return ranged.sortWithinPartitions("key")


def check_limits(changelog: DataFrame, *, max_entries: int, max_bytes: int) -> None:
    row = changelog.agg(F.count("*").alias("n"), F.coalesce(F.sum(entry_bytes()), F.lit(0)).alias("b")).head()
    if row["n"] > max_entries or row["b"] > max_bytes:
        raise LimitExceeded(f"{row['n']} entries of {row['b']} bytes")


def flush_batches(changelog: DataFrame, *, partitions: int = 8, max_entries: int = 50_000, max_bytes: int = 8 << 20) -> DataFrame:
    """Rows (part, batch, entries, bytes): the files that write buffers of a size would be flushed to.

    Each hash partition of the keys has a buffer of its own and takes its rows
    in the order of seq; a row that fills the buffer is the last of its batch.
    The rows stream through in sorted order, whatever their number.
    """
    rows = changelog.select(partition_of(F.col("key"), partitions).alias("part"), "seq", (entry_bytes() + ENTRY_BYTES).cast("long").alias("cost"))
    ordered = rows.repartition(partitions, "part").sortWithinPartitions("part", "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done = {"part": [], "batch": [], "entries": [], "bytes": []}
        part, number, n, size = None, 0, 0, 0

        def flush() -> None:
            for name, x in zip(done, (part, number, n, size), strict=True):
                done[name].append(x)

        for chunk in batches:
            for p, cost in zip(chunk.column("part").to_pylist(), chunk.column("cost").to_pylist(), strict=True):
                if p != part:
                    if n:
                        flush()
                    part, number, n, size = p, 0, 0, 0
                n, size = n + 1, size + cost
                if n >= max_entries or size >= max_bytes:
                    flush()
                    number, n, size = number + 1, 0, 0
        if n:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(done["part"], pa.int32()), *(pa.array(done[c], pa.int64()) for c in ("batch", "entries", "bytes"))], names=list(done))

    return ordered.mapInArrow(run, "part int, batch long, entries long, bytes long")


def segment_ranges(changelog: DataFrame, bucket: Column) -> DataFrame:
    """Rows (bucket, min_key, max_key, entries): the key ranges that prune segments."""
    return changelog.groupBy(bucket.alias("bucket")).agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"))


def snapshot_entries(changelog: DataFrame) -> DataFrame:
    """One row (entries, bytes) of what a snapshot holds: live rows only."""
    return live(changelog).agg(F.count("*").alias("entries"), F.coalesce(F.sum(entry_bytes()), F.lit(0)).cast("long").alias("bytes"))
