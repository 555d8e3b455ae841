"""The two merge rules for records from elsewhere. They look alike and are not the same, nor is recovery's (state.recover)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.operators import blocked


def accept_replicated(arrivals: DataFrame) -> DataFrame:
    """Replication: (shard, arrival, write_id, ...) that are above every write_id that came before in their shard.

    A lower write_id that was never seen is dropped too, so this is not a removal of duplicates.
    """
    found = blocked.prior_max(arrivals, ["shard"], "arrival", F.col("write_id"), "_high")
    return found.where(F.col("write_id") > F.coalesce("_high", F.lit(0))).drop("_high")


def newest_wins(records: DataFrame) -> DataFrame:
    """Migration: of each key the record with the highest write_id, whatever the order of arrival."""
    names = [c for c in records.columns if c != "key"]
    return records.groupBy("key").agg(F.max_by(F.struct(*names), "write_id").alias("e")).select("key", "e.*")


def entries_to_records(state: DataFrame) -> DataFrame:
    """State entries as log records: a tombstone is a DELETE without value."""
    return state.select("shard", "write_id", "version", F.when(F.col("tombstone"), "DELETE").otherwise("PUT").alias("op"), "key", F.when(~F.col("tombstone"), F.col("value")).alias("value"))


def last_applied(records: DataFrame) -> DataFrame:
    return records.groupBy("shard").agg(F.max("write_id").alias("last_applied"))
