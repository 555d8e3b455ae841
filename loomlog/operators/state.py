"""Materialized state: latest entries, live values, reads as of a position, sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog import schemas
from loomlog.functions import hashing
from loomlog.operators import blocked, oplog


def materialize(log: DataFrame) -> DataFrame:
    """State of a log: the record with the highest write_id of each key, tombstones included.

    A key's records are in one shard, so write_ids compare. The aggregate combines before its shuffle: a hot key
    sends one row from each task.
    """
    last = F.max_by(F.struct("shard", "value", "version", "write_id", "op"), "write_id")
    found = log.groupBy("key").agg(last.alias("e"))
    return found.select("e.shard", "key", F.when(F.col("e.op") == "PUT", F.col("e.value")).alias("value"), "e.version", "e.write_id", (F.col("e.op") == "DELETE").alias("tombstone"))


def live(state: DataFrame) -> DataFrame:
    return state.where(~F.col("tombstone")).select("key", "value")


def peek(state: DataFrame, key: str, shards: int = schemas.DEFAULT_SHARDS) -> DataFrame:
    """The entry of a key. Its shard is worked out here and given as a literal, so that only its partition is read."""
    return state.where((F.col("shard") == hashing.shard_of(key, shards)) & (F.col("key") == key))


def get(state: DataFrame, key: str, shards: int = schemas.DEFAULT_SHARDS) -> DataFrame:
    return peek(state, key, shards).where(~F.col("tombstone")).select("value")


def reads_as_of(ops: DataFrame) -> DataFrame:
    """seq, key, status and value of every GET, each seeing the operations before it.

    The last valid mutation before decides: after a PUT its value is there, after a DELETE nothing is, whether the
    DELETE found something or not.
    """
    mutation = F.when(F.col("op") != "GET", F.struct("seq", "op", F.coalesce("value", F.lit("")).alias("value")))
    found = blocked.prior_max(oplog.valid(ops), ["key"], "seq", mutation, "last").where(F.col("op") == "GET")
    there = F.coalesce(F.col("last.op") == "PUT", F.lit(False))
    return found.select("seq", "key", F.when(there, "OK").otherwise("NOT_FOUND").alias("status"), F.when(there, F.col("last.value")).alias("value"))


def sizes(state: DataFrame, by: str = "shard") -> DataFrame:
    """Entries with and without tombstones."""
    return state.groupBy(by).agg(F.count("*").alias("size"), F.count_if(~F.col("tombstone")).alias("live"))


def recover(snapshot: DataFrame, boundaries: DataFrame, log: DataFrame) -> DataFrame:
    """State from a snapshot and the log's tail: records up to the shard's boundary are skipped, later ones replace.

    boundaries: (shard, boundary_write_id), a row for each shard at most. A shard without one has boundary 0. A
    record of the tail is newer than any entry of the snapshot, so the tail is materialized on its own, and entries
    without a newer record stay as they are: behind a short tail the snapshot is not shuffled.
    """
    tail = log.join(boundaries.select("shard", "boundary_write_id"), "shard", "left").where(F.col("write_id") > F.coalesce("boundary_write_id", F.lit(0)))
    newer = materialize(tail.drop("boundary_write_id"))
    return snapshot.select(newer.columns).join(newer.select("key"), "key", "left_anti").select(newer.columns).unionByName(newer)


def replay_counts(boundaries: DataFrame, log: DataFrame) -> DataFrame:
    """For each shard how many records a replay scans, and how many it applies."""
    found = log.join(boundaries.select("shard", "boundary_write_id"), "shard", "left")
    return found.groupBy("shard").agg(F.count("*").alias("scanned"), F.count_if(F.col("write_id") > F.coalesce("boundary_write_id", F.lit(0))).alias("applied"))


def boundary(log: DataFrame) -> DataFrame:
    """Highest write_id of each shard."""
    return log.groupBy("shard").agg(F.max("write_id").alias("boundary_write_id"))
