"""Schemas and limits of the change-log tables. Schemas are always given, never inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits of keys and values in bytes, and the default number of shards.
MAX_KEY_BYTES = 1024
MAX_VALUE_BYTES = 1024 * 1024
DEFAULT_SHARDS = 8

OPS = T.StructType([
    T.StructField("seq", T.LongType(), False),
    T.StructField("request_id", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
])

OPLOG = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("write_id", T.LongType()),
    T.StructField("version", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("seq", T.LongType()),
])

STATE = T.StructType([
    T.StructField("shard", T.IntegerType()),
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("version", T.LongType()),
    T.StructField("write_id", T.LongType()),
    T.StructField("tombstone", T.BooleanType()),
])

SNAPSHOT_META = T.StructType([
    T.StructField("generation", T.LongType()),
    T.StructField("shard", T.IntegerType()),
    T.StructField("boundary_write_id", T.LongType()),
    T.StructField("entry_count", T.LongType()),
])

WAL_RECORD = T.StructType([
    T.StructField("segment", T.StringType()),
    T.StructField("position", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("write_id", T.LongType()),
    T.StructField("version", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
])

SNAPSHOT_ENTRY = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("boundary_write_id", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("version", T.LongType()),
    T.StructField("write_id", T.LongType()),
    T.StructField("tombstone", T.BooleanType()),
])

REQUEST = T.StructType([
    T.StructField("connection", T.StringType()),
    T.StructField("position", T.LongType()),
    T.StructField("status", T.StringType()),
    T.StructField("opcode", T.StringType()),
    T.StructField("request_id", T.LongType()),
    T.StructField("term", T.LongType()),
    T.StructField("shard", T.LongType()),
    T.StructField("op", T.StringType()),
    T.StructField("write_id", T.LongType()),
    T.StructField("version", T.LongType()),
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
])
