"""Schemas of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

HEADERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("method", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("raw_query", T.StringType()),
        T.StructField("headers", HEADERS),
        T.StructField("body", T.BinaryType()),
        T.StructField("remote_addr", T.StringType()),
    ]
)
ROUTE = "pos int, path_prefix string, target_url string, timeout interval day to second"
REWRITE_RULE = "pos int, `from` string, `to` string"
HEADER_FORWARD = "pos int, path string, with_url string, without_url string"
