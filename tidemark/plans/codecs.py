"""Queries on the column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import codec
from tidemark.plans.registry import query
from tidemark.sources.tables import events


@query("select event_id, base64(encode('user/' || user_id || ':' || repeat(props, 12))) as b64 from events")
def codec_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("user/"), F.col("user_id").cast("string"), F.lit(":"), F.repeat("props", 12))
    return events(spark, sf_dir).select("event_id", codec.base64_of(codec.bytes_of(text)).alias("b64"))


@query("select event_id, json_extract_string(props, '$.k')::BIGINT as k from events")
def codec_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("select event_id, epoch_us(ts) * 1000 + 123 as ns from events")
def codec_rfc3339(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.concat(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("123Z"))
    return events(spark, sf_dir).select("event_id", codec.nanos_of_rfc3339(stamp).alias("ns"))


@query("select vec_id as id, len(embedding)::INTEGER as n, embedding[1]::DOUBLE::DECIMAL(18,6)::VARCHAR as head from embeddings")
def codec_float_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    text = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), ", ")
    numbers = codec.floats_of(text)
    return rows.select(F.col("vec_id").alias("id"), F.size(numbers).alias("n"), numbers[0].cast("decimal(18,6)").cast("string").alias("head"))


@query("select event_id, sha256(event_id::VARCHAR || '|' || event_type) as digest, lower(event_type) in ('get', 'put', 'delete') as is_op from events")
def codec_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws("|", F.col("event_id").cast("string"), "event_type")
    return events(spark, sf_dir).select("event_id", F.sha2(text, 256).alias("digest"), codec.operation_of(F.col("event_type")).isNotNull().alias("is_op"))
