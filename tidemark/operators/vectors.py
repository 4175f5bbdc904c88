"""Vectors with metadata: add, get, delete. A delete is a row without values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import VectorNotFound


def live_vectors(log: DataFrame) -> DataFrame:
    """The last row of each id of a log (seq, id, op, values, metadata), deletes left out."""
    rest = [c for c in log.columns if c != "id"]
    return log.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("last")).select("id", "last.*").where("op <> 'delete'")


def get_vector(vectors: DataFrame, vector_id) -> DataFrame:
    return vectors.where(F.col("id") == F.lit(vector_id))


def get_vector_row(vectors: DataFrame, vector_id):
    row = get_vector(vectors, vector_id).head()
    if row is None:
        raise VectorNotFound(vector_id)
    return row


def dimensions(vectors: DataFrame) -> DataFrame:
    """Rows (dims, n): how many vectors have how many components."""
    return vectors.groupBy(F.size("values").alias("dims")).agg(F.count("*").alias("n"))
