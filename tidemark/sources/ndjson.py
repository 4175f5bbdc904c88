"""Import and export of events as lines of JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Schema of an event line; metadata stays the JSON that it is.
EVENT_SCHEMA = "type string, id string, tenant string, account_id string, timestamp string, units long, unit_price long, price_plan_id string, metadata string"


def read_events(spark: SparkSession, path: str, *, array: bool = False, strict: bool = True) -> DataFrame:
    """Event rows of a file of lines, or of JSON arrays. Blank and cursor lines are no events.

    A malformed line fails the read; with ``strict`` off it gives a row of
    nulls, which the ledger rejects as ``invalid``.
    """
    from tidemark.functions.codec import nanos_of_rfc3339

    rows = spark.read.schema(EVENT_SCHEMA).option("multiLine", array).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    return rows.where("coalesce(type, '') <> 'cursor'").select(
        F.col("id").alias("event_id"), "tenant", "account_id", nanos_of_rfc3339(F.col("timestamp")).alias("ts_nanos"), "units",
        F.coalesce("unit_price", F.lit(0).cast("long")).alias("unit_price"), F.col("price_plan_id").alias("plan_id"), "metadata",
    )


def event_lines(events: DataFrame) -> DataFrame:
    """Rows (line): events as JSON objects; nanoseconds are written out in full, in UTC whatever the session's zone."""
    rest = F.pmod(F.col("ts_nanos"), F.lit(1_000_000_000))
    seconds = F.expr("ts_nanos div 1000000000") - (F.col("ts_nanos") % 1_000_000_000 < 0).cast("long")  # div rounds to zero
    day = F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int")), "yyyy-MM-dd")
    second = F.pmod(seconds, F.lit(86_400))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    clock = F.concat_ws(":", two(F.floor(second / 3600)), two(F.floor(second / 60) % 60), two(second % 60))
    stamp = F.concat(day, F.lit("T"), clock, F.lit("."), F.lpad(rest.cast("string"), 9, "0"), F.lit("Z"))
    return events.select(F.to_json(F.struct(F.col("event_id").alias("id"), "tenant", "account_id", stamp.alias("timestamp"), "units", "unit_price", F.col("plan_id").alias("price_plan_id"), "metadata")).alias("line"))


def write_events(events: DataFrame, path: str) -> None:
    event_lines(events).write.text(path)
