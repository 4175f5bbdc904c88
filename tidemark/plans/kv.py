"""Queries on key-value state and its maintenance, over the changelog of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.codec import fnv1a_32, partition_of
from tidemark.operators import maintenance, state
from tidemark.operators.state import ScanRequest
from tidemark.plans.registry import query
from tidemark.sources.tables import changelog

LOG = """log as (select event_id as seq, event_id // 4 as txn_id, 'user/' || user_id as key,
  case when event_type = 'error' then 'delete' else 'put' end as op, props as value from events)"""
LATEST = LOG + """, latest as (select key, arg_max(seq, seq) as seq, arg_max(op, seq) as op, arg_max(value, seq) as value from log group by key),
state as (select key, seq, value from latest where op <> 'delete')"""


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.live(changelog(spark, sf_dir)).select("key", "seq", "value")


@query(f"with {LATEST} select * from state")
def kv_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir)


@query(f"with {LATEST} select key, value from state where key = 'user/42'")
def kv_point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.get(changelog(spark, sf_dir), "user/42").select("key", "value")


@query(f"with {LATEST} select key, seq from latest where op = 'delete'")
def kv_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.latest(changelog(spark, sf_dir)).where("op = 'delete'").select("key", "seq")


@query(f"with {LATEST} select key, value from state where key in (select 'user/' || c_custkey from customer)")
def kv_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.concat(F.lit("user/"), F.col("c_custkey").cast("string")).alias("key"))
    return state.get_many(changelog(spark, sf_dir), keys).select("key", "value")


@query(f"with {LATEST} select key, value from state where starts_with(key, 'user/1')")
def kv_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = changelog(spark, sf_dir)
    return state.live(log.where(state.prefix_filter(F.col("key"), "user/1"))).select("key", "value").orderBy("key")


@query(f"with {LATEST} select key, value from state where starts_with(key, 'user/') order by key limit 10")
def kv_page_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.page(_live(spark, sf_dir), ScanRequest(10, "user/"))


@query(f"with {LATEST} select key, value from state where starts_with(key, 'user/') and key > 'user/110' order by key limit 10")
def kv_page_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    request = ScanRequest(10, "user/", "user/110")
    return state.page(state.live(state.scan_filter(changelog(spark, sf_dir), request)), request)


@query(f"""with {LATEST}, page as (select key from state where starts_with(key, 'user/1') order by key limit 21)
select case when (select count(*) from page) > 20 then (select max(key) from (select key from page order by key limit 20)) end as cursor""")
def kv_next_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.next_cursor(_live(spark, sf_dir), ScanRequest(20, "user/1"))


@query(f"with {LATEST} select key from state")
def kv_keys_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("key")


@query(f"with {LATEST} select key, octet_length(encode(value)) as bytes from state where octet_length(encode(value)) > 7")
def kv_value_too_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.octet_length("value")
    return _live(spark, sf_dir).where(size > 7).select("key", size.alias("bytes"))


@query(f"""with {LATEST}, hashed as (select key, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ord(substring(key, i, 1))::BIGINT)),
  lambda h, b: (xor(h, b) * 16777619) % 4294967296) as h from (select distinct key from log))
select key, h as hash, (h % 8)::INTEGER as part from hashed""")
def kv_partition_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = changelog(spark, sf_dir).select("key").distinct()
    return keys.select("key", fnv1a_32(F.col("key")).alias("hash"), partition_of(F.col("key"), 8).alias("part"))


@query(f"""with {LATEST} select (select count(*) from log) as total, (select count(*) from state) as written,
(select sum(length(key) + octet_length(encode(value)))::BIGINT from log) as bytes_before, (select coalesce(sum(length(key) + octet_length(encode(value))), 0)::BIGINT from state) as bytes_after""")
def compact_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.compact_stats(changelog(spark, sf_dir))


@query(f"with {LATEST} select * from state")
def compact_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.compacted(changelog(spark, sf_dir)).select("key", "seq", "value")


@query(f"""with recursive {LOG}, hashed as (select key, (list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, length(key) + 1), lambda i: ord(substring(key, i, 1))::BIGINT)),
  lambda h, b: (xor(h, b) * 16777619) % 4294967296) % 8)::INTEGER as part from (select distinct key from log)),
rows as (select part, (length(key) + octet_length(encode(value)) + 16)::BIGINT as cost, row_number() over (partition by part order by seq) as n from log join hashed using (key)),
fold as (
  select part, n, 0::BIGINT as batch, 1::BIGINT as entries, cost as bytes from rows where n = 1
  union all
  select r.part, r.n, case when f.entries >= 200 or f.bytes >= 6000 then f.batch + 1 else f.batch end,
    case when f.entries >= 200 or f.bytes >= 6000 then 1 else f.entries + 1 end, case when f.entries >= 200 or f.bytes >= 6000 then r.cost else f.bytes + r.cost end
  from fold f join rows r on r.part = f.part and r.n = f.n + 1)
select part, batch, max(entries) as entries, max(bytes) as bytes from fold group by part, batch""")
def memtable_flush_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.flush_batches(changelog(spark, sf_dir), partitions=8, max_entries=200, max_bytes=6000)


@query(f"with {LOG} select substring(key, 1, 6) as bucket, min(key) as min_key, max(key) as max_key, count(*) as entries from log group by 1")
def segment_minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.segment_ranges(changelog(spark, sf_dir), F.substring("key", 1, 6))


@query(f"with {LATEST} select count(*) as entries, coalesce(sum(length(key) + octet_length(encode(value))), 0)::BIGINT as bytes from state")
def snapshot_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintenance.snapshot_entries(changelog(spark, sf_dir))
