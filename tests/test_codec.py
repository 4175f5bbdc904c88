from __future__ import annotations

import base64

from pyspark.sql import functions as F

from tidemark.functions import codec


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'binary' if isinstance(v, bytes | bytearray) else 'string' if isinstance(v, str) or v is None else 'long'}" for k, v in values.items()))
    return row.select(column.alias("x")).head()["x"]


def test_fnv(spark):
    def plain(text):
        h = 2166136261
        for b in text.encode():
            h = (h ^ b) * 16777619 % 2**32
        return h

    for text in ("", "a", "user/42", "é"):
        assert _one(spark, codec.fnv1a_32(F.col("t")), t=text) == plain(text)


def test_base64_is_unbroken_and_returns(spark):
    data = bytes(range(256))
    assert _one(spark, codec.base64_of(F.col("b")), b=bytearray(data)) == base64.b64encode(data).decode()
    assert bytes(_one(spark, codec.base64_to_bytes(F.col("t")), t=base64.b64encode(data).decode())) == data
    assert _one(spark, codec.base64_to_bytes(F.col("t")), t="a?") is None


def test_times(spark):
    ns = codec.nanos_of_rfc3339(F.col("t"))
    assert _one(spark, ns, t="1970-01-01T00:00:01.000000009Z") == 1_000_000_009
    assert _one(spark, ns, t="1970-01-01T01:00:00+01:00") == 0
    assert _one(spark, ns, t="yesterday") is None
    assert _one(spark, codec.nanos_key(F.col("n")), n=7) == "0" * 18 + "7"
    assert _one(spark, codec.nanos_key(F.col("n")), n=-1) is None


def test_strict_values(spark):
    assert _one(spark, codec.uint32_of(F.col("t")), t="4294967295") == 2**32 - 1
    assert _one(spark, codec.uint32_of(F.col("t")), t="4294967296") is None
    assert _one(spark, codec.uint32_of(F.col("t")), t="-1") is None
    assert _one(spark, codec.bool_of(F.col("t")), t="TRUE") is True
    assert _one(spark, codec.bool_of(F.col("t")), t="yes") is None
    assert _one(spark, codec.operation_of(F.col("t")), t=" PUT ") == "put"
    assert _one(spark, codec.floats_of(F.col("t")), t="0.1, 2") == [0.1, 2.0]
    assert _one(spark, codec.floats_of(F.col("t")), t="0.1,x") is None
    assert _one(spark, codec.path_unescape(F.col("t")), t="a+b%2Fc") == "a+b/c"
    assert _one(spark, codec.text_of(F.col("b")), b=bytearray(b"\xff")) is None
