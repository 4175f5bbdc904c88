"""Logical tables of ledger and store, derived from the event and order tables.

``events`` gives the usage events, the changelog and the log of transactions;
``embeddings`` the vectors.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Price plans by event type; the type ``error`` has none.
PRICES = (("click", 3, "click"), ("view", 1, "view"), ("purchase", 50, "order"), ("signup", 20, "account"))
#: Credit that every account starts with.
CREDIT = 2_000_000


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``; below a temporary one where that is unset and all runs on one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-tidemark-')}"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a stream of the files that are there."""
    schema = events(spark, sf_dir).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_of(events(spark, sf_dir))


def usage_of(rows: DataFrame) -> DataFrame:
    """Rows (event_id, tenant, account_id, ts_nanos, units, unit_price, plan_id, metadata) of event rows; price 0 asks for the plan's."""
    nanos = F.unix_micros(F.col("ts").cast("timestamp")) * F.lit(1000).cast("long")
    return rows.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.concat(F.lit("t"), (F.col("user_id") % 3).cast("string")).alias("tenant"),
        F.col("user_id").cast("string").alias("account_id"),
        nanos.alias("ts_nanos"),
        F.round(F.col("value") * 100).cast("long").alias("units"),
        F.when(F.col("event_id") % 17 == 0, F.lit(7)).otherwise(F.lit(0)).cast("long").alias("unit_price"),
        F.col("event_type").alias("plan_id"),
        F.col("props").alias("metadata"),
    )


def price_plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PRICES), "plan_id string, plan_price long, unit string")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (tenant, account_id, credit): the accounts that have a customer of the same number."""
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.col("c_custkey")
    return customers.select(F.concat(F.lit("t"), (key % 3).cast("string")).alias("tenant"), key.cast("string").alias("account_id"), F.lit(CREDIT).cast("long").alias("credit"))


def changelog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (seq, txn_id, key, op, value): four events make a transaction."""
    return events(spark, sf_dir).select(
        F.col("event_id").alias("seq"),
        F.expr("event_id div 4").alias("txn_id"),
        F.concat(F.lit("user/"), F.col("user_id").cast("string")).alias("key"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.col("props").alias("value"),
    )


def transaction_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (txn_id, status, commit_seq): one of five is aborted, one pending; commits are not in the order of their begin."""
    txn = changelog(spark, sf_dir).select("txn_id").distinct()
    status = F.when(F.col("txn_id") % 5 == 0, "aborted").when(F.col("txn_id") % 5 == 1, "pending").otherwise("committed")
    order = F.col("txn_id") + (F.col("txn_id") % 3) * 10
    return txn.select("txn_id", status.alias("status"), order.alias("commit_seq"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows (id, values, label)."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("values"), "label")
