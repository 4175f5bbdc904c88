"""Key-value state as a view on a changelog: latest rows, point reads and ordered pages.

A changelog has the columns seq, key, op and value. State is the row of the
highest seq per key, unless that is a delete.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.errors import InvalidArgument, KeyNotFound, ValueTooLarge
from tidemark.functions.codec import prefix_end


def latest(changelog: DataFrame, *order: str) -> DataFrame:
    """The last row of each key, deletes included.

    One aggregation with partial maxima before its shuffle, so that a key
    that fills much of the log makes no hot task, where a window would.
    """
    order = order or ("seq",)
    rest = [c for c in changelog.columns if c != "key"]
    rank = F.struct(*order) if len(order) > 1 else F.col(order[0])
    return changelog.groupBy("key").agg(F.max_by(F.struct(*rest), rank).alias("last")).select("key", "last.*")


def live(changelog: DataFrame, *order: str) -> DataFrame:
    """The state: latest rows that are no delete."""
    return latest(changelog, *order).where("op <> 'delete'")


def get(changelog: DataFrame, key) -> DataFrame:
    """The live row of one key. The filter reaches the scan before anything is aggregated."""
    return live(changelog.where(F.col("key") == F.lit(key)))


def get_value(changelog: DataFrame, key):
    row = get(changelog, key).head()
    if row is None:
        raise KeyNotFound(key)
    return row["value"]


def get_many(changelog: DataFrame, keys: DataFrame) -> DataFrame:
    """Live rows of the column ``key`` of ``keys``: point reads in bulk."""
    return live(changelog.join(keys.select("key").distinct(), "key", "left_semi"))


def prefix_filter(key: Column, prefix: str | bytes) -> Column:
    """Keys with a prefix, as a range that is pushed down to the scan."""
    if not prefix:
        return F.lit(True)
    if isinstance(prefix, str):
        return key.startswith(prefix)  # pushed for text
    end = prefix_end(prefix)
    low = key >= F.lit(bytearray(prefix))
    return low & (key < F.lit(bytearray(end))) if end is not None else low


@dataclass(frozen=True)
class ScanRequest:
    """A page: keys above ``cursor`` that have ``prefix``, at most ``limit``."""

    limit: int
    prefix: str | bytes = ""
    cursor: str | bytes = ""
    include_values: bool = True
    max_value_bytes: int | None = None

    def validate(self) -> None:
        if self.limit <= 0:
            raise InvalidArgument("limit must be above 0")
        if self.include_values and self.max_value_bytes is not None and self.max_value_bytes <= 0:
            raise InvalidArgument("max_value_bytes must be above 0")


def page(state: DataFrame, request: ScanRequest) -> DataFrame:
    """The rows of a page in ascending order of key; top-k over the filtered scan, no full sort."""
    request.validate()
    rows = state.where(prefix_filter(F.col("key"), request.prefix))
    if request.cursor:
        rows = rows.where(F.col("key") > F.lit(request.cursor))
    rows = rows.select("key", "value") if request.include_values else rows.select("key")
    return rows.orderBy("key").limit(request.limit)


def scan_filter(changelog: DataFrame, request: ScanRequest) -> DataFrame:
    """The changelog rows that a page can depend on: both bounds apply before the fold."""
    rows = changelog.where(prefix_filter(F.col("key"), request.prefix))
    return rows.where(F.col("key") > F.lit(request.cursor)) if request.cursor else rows


def scan(changelog: DataFrame, request: ScanRequest) -> tuple[list, object]:
    """The rows of a page and the next cursor, which is None on the last page."""
    request.validate()
    more = ScanRequest(request.limit + 1, request.prefix, request.cursor, request.include_values, request.max_value_bytes)
    rows = page(live(scan_filter(changelog, request)), more).collect()
    out = rows[: request.limit]
    if request.include_values and request.max_value_bytes is not None:
        for r in out:
            value = r["value"]
            if len(value.encode() if isinstance(value, str) else value) > request.max_value_bytes:
                raise ValueTooLarge(r["key"])
    return out, out[-1]["key"] if len(rows) > request.limit else None


def next_cursor(state: DataFrame, request: ScanRequest) -> DataFrame:
    """One row (cursor): the page's last key if more keys follow, else null."""
    more = ScanRequest(request.limit + 1, request.prefix, request.cursor, False)
    keys = page(state, more)
    first = page(state, ScanRequest(request.limit, request.prefix, request.cursor, False))
    return keys.agg(F.count("*").alias("n")).crossJoin(first.agg(F.max("key").alias("last"))).select(F.when(F.col("n") > request.limit, F.col("last")).alias("cursor"))


def stream_pages(changelog: DataFrame, request: ScanRequest, page_rows: int = 256):
    """Rows of a long scan, fetched page by page."""
    left, cursor = request.limit, request.cursor
    while left > 0:
        rows, after = scan(changelog, ScanRequest(min(page_rows, left), request.prefix, cursor, request.include_values, request.max_value_bytes))
        yield from rows
        left -= len(rows)
        if after is None:
            return
        cursor = after
