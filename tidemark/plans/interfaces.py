"""Queries on the tables of the interfaces: what ``Engine``, ``VectorTable`` and ``Ledger`` hold after writes from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.engine import Engine, VectorTable
from tidemark.ledger import Ledger
from tidemark.plans.billing import LEDGER
from tidemark.plans.registry import query
from tidemark.sources.tables import PRICES, accounts, scratch_folder, usage_events, vectors

#: Credit that the account of customer 1 is given besides.
EXTRA = 500
CREDITED = LEDGER.replace("::BIGINT as credit from customer", f"::BIGINT + case when c_custkey = 1 then {EXTRA} else 0 end as credit from customer")


@query("""select 'c/' || c_custkey as key, case when c_custkey % 2 = 0 then c_mktsegment else c_name end as value from customer where c_custkey not in (1, 4)
union all select 'c/new', 'put twice'""")
def engine_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All customers are loaded, the even ones again with another value; one transaction puts and deletes."""
    db = Engine(spark, scratch_folder(spark, "engine"))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet")
    key = F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).cast("binary").alias("key")
    db.load(rows.select(key, F.col("c_name").cast("binary").alias("value")))
    db.load(rows.where("c_custkey % 2 = 0").select(key, F.col("c_mktsegment").cast("binary").alias("value")))
    with db.transaction() as t:
        t.delete(b"c/1")
        t.put(b"c/new", b"put once")
        t.put(b"c/new", b"put twice")
        t.delete(b"c/4")
    return db.state().select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


@query("select label::VARCHAR as metadata, len(embedding)::INTEGER as dims, count(*) as n from embeddings group by 1, 2")
def vector_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = VectorTable(spark, scratch_folder(spark, "vectors"))
    table.load(vectors(spark, sf_dir).select("values", F.col("label").cast("string").alias("metadata")))
    table.delete(table.add([1.0, 2.0, 3.0]))
    return table.live().groupBy("metadata", F.size("values").alias("dims")).agg(F.count("*").alias("n"))


def _booked(spark: SparkSession, sf_dir: str) -> Ledger:
    """Accounts, credits, plans, and the usage events in two batches: those of the second are as late or later."""
    ledger = Ledger(spark, scratch_folder(spark, "ledger"))
    ledger.load_accounts(accounts(spark, sf_dir))
    ledger.credit_account("t1", "1", EXTRA)
    for plan, price, unit in PRICES:
        ledger.put_price_plan(plan, price + 1, unit)
        ledger.put_price_plan(plan, price, unit)
    events = usage_events(spark, sf_dir)
    # Wherever the batches part, the same is booked; a sketch is bounded, exact quantiles hold all times in one task.
    middle = events.agg(F.percentile_approx("ts_nanos", 0.5).alias("m")).head()["m"]
    ledger.record_usage(events.where(F.col("ts_nanos") <= middle))
    ledger.record_usage(events)
    return ledger


@query(f"with recursive {CREDITED} select tenant, account_id, (any_value(a.credit) - coalesce(sum(case when booked then cost end), 0))::BIGINT as balance from accounts a left join fold using (tenant, account_id) group by tenant, account_id")
def ledger_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _booked(spark, sf_dir).balances().select("tenant", "account_id", "balance")


@query(f"with recursive {CREDITED} select event_id, cost, balance_after::BIGINT as balance_after, prev_hash, hash from fold where booked")
def ledger_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _booked(spark, sf_dir).usage().select("event_id", "cost", "balance_after", "prev_hash", "hash")
