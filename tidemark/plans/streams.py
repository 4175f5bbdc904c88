"""Streaming queries, run to the end of the given files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.billing import LEDGER, USAGE
from tidemark.plans.registry import query
from tidemark.sources.tables import accounts, events_stream, price_plans, scratch_folder, usage_of
from tidemark.streaming.ledger import stream_ledger, windowed_usage


def _finish(spark: SparkSession, rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there and read what it wrote."""
    base = scratch_folder(spark, "stream")
    writer = rows.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state")
    writer.format("parquet").trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{base}/out")


@query(f"with recursive {LEDGER} select event_id, tenant, account_id, cost, booked, balance_after::BIGINT as balance_after, hash from fold")
def stream_gated_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stream_ledger(usage_of(events_stream(spark, sf_dir)), accounts(spark, sf_dir), price_plans(spark))
    return _finish(spark, rows).select("event_id", "tenant", "account_id", "cost", "booked", "balance_after", "hash")


@query(f"""with {USAGE}, late as (select max(ts_nanos // 1000) as top from usage), days as (
  select tenant, (ts_nanos // 86400000000000) as day, sum(units)::BIGINT as units, count(*) as n from usage group by 1, 2)
select tenant, day, units, n from days, late where (day + 1) * 86400000000 <= top - 3600000000""")
def stream_windowed_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed windows only: the last one is still open when the files end."""
    done = _finish(spark, windowed_usage(usage_of(events_stream(spark, sf_dir))))
    return done.select("tenant", F.expr("unix_seconds(w.start) div 86400").alias("day"), "units", "n")
