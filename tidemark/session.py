"""Session factory with the settings that the ledger's semantics rest on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tidemark", **conf: str) -> SparkSession:
    """A session in UTC with ANSI arithmetic (an overflow is an error) and unbroken base64."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.chunkBase64String.enabled": "false",
    }
    for key, value in (defaults | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
