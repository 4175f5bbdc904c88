"""Queries on transactions and their log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators import transactions as txn
from tidemark.plans.kv import LOG
from tidemark.plans.registry import query
from tidemark.sources.tables import changelog, transaction_log

TXN_LOG = """txns as (select distinct event_id // 4 as txn_id from events),
statuses as (select txn_id, case txn_id % 5 when 0 then 'aborted' when 1 then 'pending' else 'committed' end as status, txn_id + (txn_id % 3) * 10 as commit_seq from txns)"""


@query(f"""with {LOG}, ops as (select *, coalesce(lag(op) over (partition by key order by seq), 'delete') as before from log)
select txn_id, count(*) as n_ops, count(*) filter (op = 'delete' and before = 'delete') as bad_deletes,
case when count(*) filter (op = 'delete' and before = 'delete') > 0 then 'aborted' else 'committed' end as status from ops group by txn_id""")
def txn_sequential_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn.validate_log(changelog(spark, sf_dir))


@query(f"with {LOG} select txn_id, key, count(*) as n from log group by txn_id, key having count(*) > 1")
def txn_duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn.duplicate_keys(changelog(spark, sf_dir))


@query(f"""with {LOG}, {TXN_LOG}, done as (select log.*, commit_seq from log join statuses using (txn_id) where status = 'committed'),
ranked as (select *, row_number() over (partition by key order by commit_seq desc, txn_id desc, seq desc) as n from done)
select key, seq, value from ranked where n = 1 and op <> 'delete'""")
def wal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn.replay(changelog(spark, sf_dir), transaction_log(spark, sf_dir)).select("key", "seq", "value")


@query(f"with {TXN_LOG} select status, count(*) as n from statuses group by status")
def wal_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return txn.status_counts(transaction_log(spark, sf_dir))
