"""From client operations to the log of effective mutations.

An operation is (seq, op, key, value) with a unique seq. A PUT is checked; a DELETE is effective only on a live key.
Effective mutations get a version within their key and a write_id within their shard. What is rejected or has no
effect uses up neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog import schemas
from loomlog.functions import hashing
from loomlog.operators import blocked


def size_in_bytes(value: Column) -> Column:
    return F.coalesce(F.octet_length(value), F.lit(0))


def put_status(key: Column, value: Column) -> Column:
    """What the checks of a PUT say, in their order: EMPTY_KEY, KEY_TOO_LARGE, VALUE_TOO_LARGE or OK."""
    return (
        F.when(size_in_bytes(key) == 0, "EMPTY_KEY")
        .when(size_in_bytes(key) > schemas.MAX_KEY_BYTES, "KEY_TOO_LARGE")
        .when(size_in_bytes(value) > schemas.MAX_VALUE_BYTES, "VALUE_TOO_LARGE")
        .otherwise("OK")
    )


def valid(ops: DataFrame) -> DataFrame:
    """Operations without rejected PUTs; GET and DELETE are not checked."""
    return ops.where((F.col("op") != "PUT") | (put_status(F.col("key"), F.col("value")) == "OK"))


def _placed(ops: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, blocks) of the valid mutations, from one pass for either.

    Rows are cut into blocks of seq, so that a key of any size is many window partitions. In a block all but its first
    row know the op before; how many of them are effective, and the first and last op, sum the block up. A window over
    these summaries tells each block the op before it and how many effective ones there were, from which every row's
    ``previous`` and ``version`` follow. blocks: (key, _block, effective). known: (key, version, live) of an older state.
    """
    # what joins use is never null, so that no filter is derived for one use of the summaries and not for the other: their shuffles are shared
    found = valid(ops).where(F.col("op") != "GET").withColumns({"key": F.coalesce("key", F.lit("")), "_block": F.coalesce(F.floor(F.col("seq") / F.lit(blocked.BLOCK)), F.lit(0))})
    within = Window.partitionBy("key", "_block").orderBy("seq")
    found = found.withColumn("_prev", F.lag("op").over(within))
    found = found.withColumn("_eff", ((F.col("op") == "PUT") | F.coalesce(F.col("_prev") == "PUT", F.lit(False))).cast("long"))
    blocks = found.groupBy("key", "_block").agg(F.min_by("op", "seq").alias("_first"), F.max_by("op", "seq").alias("_last"), F.sum("_eff").alias("_n"))
    old_op, old_version = F.lit(None).cast("string"), F.lit(0).cast("long")
    if known is not None:
        old = known.select(F.col("key").alias("_key"), F.when(F.col("live"), "PUT").otherwise("DELETE").alias("_old"), F.col("version").alias("_version"))
        blocks = blocks.join(old, F.col("key") == F.col("_key"), "left").drop("_key")
        old_op, old_version = F.col("_old"), F.coalesce("_version", F.lit(0))
    in_key = Window.partitionBy("key").orderBy("_block")
    blocks = blocks.withColumn("_prior", F.coalesce(F.lag("_last").over(in_key), old_op))
    # the block's first row, if it is a DELETE that finds something
    blocks = blocks.withColumn("_more", ((F.col("_first") == "DELETE") & F.coalesce(F.col("_prior") == "PUT", F.lit(False))).cast("long"))
    blocks = blocks.withColumn("effective", F.col("_n") + F.col("_more"))
    blocks = blocks.withColumn("_base", F.coalesce(F.sum("effective").over(in_key.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_more") + old_version)
    blocks = blocks.select("key", "_block", "effective", "_prior", "_base")
    before = blocks.select(F.col("key").alias("_key"), F.col("_block").alias("_b"), "_prior", "_base")
    rows = found.withColumn("_run", F.sum("_eff").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(before, (F.col("key") == F.col("_key")) & (F.col("_block") == F.col("_b"))).withColumn("previous", F.coalesce("_prev", "_prior"))
    return rows.withColumn("version", F.col("_base") + F.col("_run")).drop("_key", "_b", "_prior", "_base", "_run", "_prev", "_eff"), blocks.select("key", "_block", "effective")


def _effective(rows: DataFrame) -> DataFrame:
    kept = rows.where((F.col("op") == "PUT") | (F.col("previous") == "PUT"))
    return kept.withColumn("value", F.when(F.col("op") == "PUT", F.coalesce("value", F.lit(""))))


def mutations_with_previous(ops: DataFrame) -> DataFrame:
    """Valid PUTs and DELETEs with ``previous``: the op before in the key, null for its first."""
    return _placed(ops)[0].drop("_block", "version")


def effective(ops: DataFrame) -> DataFrame:
    """PUTs, and DELETEs of keys that are live, with their version. A key is live exactly after a PUT, so the op before decides."""
    return _effective(_placed(ops)[0]).drop("_block", "previous")


def build(ops: DataFrame, shards: int = schemas.DEFAULT_SHARDS, known: DataFrame | None = None, high: DataFrame | None = None) -> DataFrame:
    """The log (shard, write_id, version, op, key, value, seq) of operations on a store; value is null for DELETE.

    The store is empty, or has the entries ``known`` (key, version, live) of the keys that ops change and the highest
    write_ids ``high`` (shard, write_id). The source is read twice: once, by narrow columns, for the summaries of key
    blocks, from which those of shard blocks follow too, and once for the rows.
    """
    rows, blocks = _placed(ops, known)
    shard = F.coalesce(hashing.shard(F.col("key"), shards), F.lit(0))
    hashed = blocks.withColumn("shard", shard)
    by_shard = hashed.groupBy("shard", "_block").agg(F.sum("effective").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    by_shard = by_shard.withColumn("_first", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if high is not None:
        top = high.select(F.col("shard").alias("_shard"), F.col("write_id").alias("_high"))
        by_shard = by_shard.join(top, F.col("shard") == F.col("_shard"), "left").withColumn("_first", F.col("_first") + F.coalesce("_high", F.lit(0)))
    by_shard = by_shard.select(F.col("shard").alias("_shard"), F.col("_block").alias("_b"), "_first")
    found = _effective(rows).withColumn("shard", shard)
    found = found.withColumn("_place", F.row_number().over(Window.partitionBy("shard", "_block").orderBy("seq")))
    found = found.join(by_shard, (F.col("shard") == F.col("_shard")) & (F.col("_block") == F.col("_b")))
    return found.withColumn("write_id", (F.col("_first") + F.col("_place")).cast("long")).select(*schemas.OPLOG.names)


def statuses(ops: DataFrame) -> DataFrame:
    """seq, op and status of every PUT and DELETE: a PUT's check, OK or NOT_FOUND for a DELETE."""
    puts = ops.where(F.col("op") == "PUT").select("seq", "op", put_status(F.col("key"), F.col("value")).alias("status"))
    deletes = mutations_with_previous(ops).where(F.col("op") == "DELETE")
    return puts.unionByName(deletes.select("seq", "op", F.when(F.col("previous") == "PUT", "OK").otherwise("NOT_FOUND").alias("status")))
