"""Inputs of the registered queries, made from the given tables. Integer arithmetic only, so that SQL can repeat it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog import schemas, scratch
from loomlog.operators import oplog, state


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def from_events(events: DataFrame) -> DataFrame:
    op = F.when(F.col("event_type") == "view", "GET").when(F.col("event_type") == "error", "DELETE").otherwise("PUT")
    return events.select(F.col("event_id").alias("seq"), F.col("event_id").alias("request_id"), op.alias("op"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"), F.col("props").alias("value"))


def ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_events(table(spark, sf_dir, "events"))


def log(spark: SparkSession, sf_dir: str, shards: int = schemas.DEFAULT_SHARDS) -> DataFrame:
    return oplog.build(ops(spark, sf_dir), shards)


def stored_log(spark: SparkSession, sf_dir: str, shards: int = schemas.DEFAULT_SHARDS) -> DataFrame:
    """The log as a table: for queries that read it more than once."""
    return scratch.written(log(spark, sf_dir, shards))


def ops_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PUTs with keys of all lengths, and two with an empty key and a value that is too large."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.lit("PUT").alias("op"), F.col("text").alias("key"), F.col("source").alias("value"))
    extra = spark.range(1).select(F.lit(-1).cast("long").alias("seq"), F.lit("PUT").alias("op"), F.lit("").alias("key"), F.lit("v").alias("value"))
    large = spark.range(1).select(F.lit(-2).cast("long").alias("seq"), F.lit("PUT").alias("op"), F.lit("k").alias("key"), F.repeat(F.lit("x"), schemas.MAX_VALUE_BYTES + 1).alias("value"))
    return docs.unionByName(extra).unionByName(large)


def keys_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("o-"), F.col("o_orderkey").cast("string")).alias("key"))


def half_boundaries(records: DataFrame) -> DataFrame:
    """A snapshot at half of each shard's records."""
    return records.groupBy("shard").agg(F.floor(F.max("write_id") / 2).alias("boundary_write_id"))


def snapshot_at(records: DataFrame, boundaries: DataFrame) -> DataFrame:
    return state.materialize(records.join(boundaries, "shard").where(F.col("write_id") <= F.col("boundary_write_id")).drop("boundary_write_id"))


def arrivals(records: DataFrame) -> DataFrame:
    """Records as a network delivers them: every 11th comes five places late, every 7th comes again three places later."""
    late = F.when(F.col("write_id") % 11 == 0, 21).otherwise(0)
    first = records.withColumn("arrival", F.col("write_id") * 4 + late)
    again = records.where(F.col("write_id") % 7 == 0).withColumn("arrival", F.col("write_id") * 4 + 14 + late)
    return first.unionByName(again)


def replica(records: DataFrame) -> DataFrame:
    """The first nine tenths of each shard's records."""
    most = records.groupBy("shard").agg(F.floor(F.max("write_id") * 9 / 10).alias("upto"))
    return records.join(most, "shard").where(F.col("write_id") <= F.col("upto")).drop("upto")


def cluster_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    term = 1 + F.floor(F.col("event_id") / 200) - F.when(F.col("event_type") == "error", 1).otherwise(0)
    return e.select(F.col("event_id").alias("arrival"), (F.col("user_id") % 3).alias("node"), term.cast("long").alias("term"), F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).alias("at_ms"))


def positions(records: DataFrame) -> DataFrame:
    """Where followers are: those of even shards at a quarter of the log, the others at three quarters."""
    at = F.floor(F.max("write_id") * F.when(F.col("shard") % 2 == 0, 1).otherwise(3) / 4)
    return records.groupBy("shard").agg(at.alias("last_applied"))


def node_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests between nodes: the four opcodes in turn, with what they carry; every 50th has a payload that is too short."""
    turn = F.col("arrival") % 4
    opcode = F.when(turn == 0, "REPLICATE").when(turn == 1, "CATCHUP_QUERY").when(turn == 2, "HEARTBEAT").otherwise("ELECTION_QUERY")
    e = cluster_events(spark, sf_dir).where(F.col("term") >= 0)
    return e.select("arrival", "node", "term", opcode.alias("opcode"), (F.col("arrival") % 10).alias("shard"), F.when(F.col("arrival") % 3 == 0, "DELETE").otherwise("PUT").alias("op"), F.concat(F.lit("k"), F.col("arrival").cast("string")).alias("key"), (F.col("arrival") % 50 == 0).alias("cut"))


def peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select((F.col("s_suppkey") + 6380).alias("port"), F.lit(1).cast("long").alias("epoch"), F.floor(F.abs("s_acctbal")).cast("long").alias("total"), (F.col("s_suppkey") % 5 != 0).alias("reachable"))
