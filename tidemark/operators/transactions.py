"""Transactions over a changelog: validation and replay of a commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.state import live


def duplicate_keys(ops: DataFrame) -> DataFrame:
    """Keys that a transaction touches more than once: rows (txn_id, key, n)."""
    return ops.groupBy("txn_id", "key").agg(F.count("*").alias("n")).where("n > 1")


def validate(ops: DataFrame, state: DataFrame) -> DataFrame:
    """Rows (txn_id, n_ops, bad_deletes, status): each transaction alone on top of ``state`` (live rows).

    The operations of a transaction count in their order. A delete is bad if
    the operation before it on the same key was a delete or, without one, if
    the key is not live; one bad delete aborts the whole transaction.
    """
    order = Window.partitionBy("txn_id", "key").orderBy("seq")
    before = ops.withColumn("before", F.lag("op").over(order))
    joined = before.join(state.select(F.col("key").alias("live_key")), F.col("key") == F.col("live_key"), "left")
    bad = (F.col("op") == "delete") & (F.coalesce(F.col("before"), F.when(F.col("live_key").isNotNull(), "put").otherwise("delete")) == "delete")
    return joined.groupBy("txn_id").agg(F.count("*").alias("n_ops"), F.count_if(bad).alias("bad_deletes")).withColumn("status", F.when(F.col("bad_deletes") > 0, "aborted").otherwise("committed"))


def validate_log(ops: DataFrame, *, block: int = 1 << 20) -> DataFrame:
    """Rows (txn_id, n_ops, bad_deletes, status): every transaction of a log against the log before it, as it was written.

    A delete is bad if the last earlier operation on its key was a delete or
    if there is none. Operations are compared within blocks of ``block``
    numbers of ``seq``; the first of a key in a block takes what the key's
    earlier blocks ended with, one row a block. So a key that fills much of
    the log is split by its blocks.
    """
    rows = ops.withColumn("block", F.floor(F.col("seq") / block))
    before = F.lag("op").over(Window.partitionBy("key", "block").orderBy("seq"))
    ends = rows.groupBy("key", "block").agg(F.max_by("op", "seq").alias("op"))
    carried = ends.select("key", "block", F.lag("op").over(Window.partitionBy("key").orderBy("block")).alias("carried"))
    joined = rows.withColumn("before", before).join(carried, ["key", "block"])
    bad = (F.col("op") == "delete") & (F.coalesce("before", "carried", F.lit("delete")) == "delete")
    return joined.groupBy("txn_id").agg(F.count("*").alias("n_ops"), F.count_if(bad).alias("bad_deletes")).withColumn("status", F.when(F.col("bad_deletes") > 0, "aborted").otherwise("committed"))


def replay(ops: DataFrame, log: DataFrame) -> DataFrame:
    """The state after a crash: committed transactions only, in the order of their commit records."""
    committed = log.where("status = 'committed'").select("txn_id", "commit_seq")
    return live(ops.join(committed, "txn_id"), "commit_seq", "txn_id", "seq")


def status_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("status").agg(F.count("*").alias("n"))
