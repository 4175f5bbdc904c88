"""Queries on the vector table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import vectors as ops
from tidemark.plans.registry import query
from tidemark.sources.tables import vectors


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is added; each tenth is deleted later."""
    added = vectors(spark, sf_dir).select(F.lit(1).alias("seq"), "id", F.lit("add").alias("op"), "values", F.col("label").alias("metadata"))
    gone = added.where("id % 10 = 0").select(F.lit(2).alias("seq"), "id", F.lit("delete").alias("op"), F.lit(None).cast("array<double>").alias("values"), F.lit(None).cast("int").alias("metadata"))
    return added.unionByName(gone)


@query("select vec_id as id, label, unnest(list_transform(embedding, lambda x: x::DOUBLE)) as x, unnest(range(len(embedding)))::INTEGER as pos from embeddings where vec_id = 7")
def vec_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = ops.get_vector(vectors(spark, sf_dir), 7)
    return row.select("id", "label", F.posexplode("values").alias("pos", "x"))


@query("select vec_id as id, label as metadata, len(embedding)::INTEGER as dims from embeddings where vec_id % 10 <> 0")
def vec_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.live_vectors(_log(spark, sf_dir)).select("id", "metadata", F.size("values").alias("dims"))


@query("select len(embedding)::INTEGER as dims, count(*) as n from embeddings group by 1")
def vec_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.dimensions(vectors(spark, sf_dir))
