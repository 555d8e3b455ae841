"""Placement analytics: distribution over shards, resharding, log segments, truncation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlog.functions import binary, hashing
from loomlog.operators import blocked


def distribution(keys: DataFrame, shards: int) -> DataFrame:
    """Keys of each shard and their relative deviation from the mean; shards without keys have a row too."""
    counts = keys.select(hashing.shard(F.col("key"), shards).alias("shard")).groupBy("shard").agg(F.count("*").alias("n"))
    every = keys.sparkSession.range(shards).select(F.col("id").cast("int").alias("shard"))
    found = every.join(counts, "shard", "left").select("shard", F.coalesce("n", F.lit(0)).alias("keys"))
    total = found.agg(F.sum("keys").alias("total"))
    mean = F.col("total") / F.lit(shards)
    return found.crossJoin(F.broadcast(total)).select("shard", "keys", F.when(F.col("total") > 0, (F.col("keys") - mean) / mean).otherwise(F.lit(0.0)).alias("deviation"))


def placement(keys: DataFrame, before: int, after: int) -> DataFrame:
    """(key, old_shard, new_shard): the hash is worked out once."""
    hashed = keys.select("key", hashing.fnv1a(F.col("key")).alias("h"))
    return hashed.select("key", hashing.unsigned_mod(F.col("h"), before).cast("int").alias("old_shard"), hashing.unsigned_mod(F.col("h"), after).cast("int").alias("new_shard"))


def moved_matrix(placed: DataFrame) -> DataFrame:
    return placed.groupBy("old_shard", "new_shard").agg(F.count("*").alias("keys"))


def reshard(state: DataFrame, shards: int) -> DataFrame:
    """State with every entry in its shard of a new layout; versions, write_ids and tombstones are kept."""
    return state.withColumn("shard", hashing.shard(F.col("key"), shards))


def lost_and_added(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: entries before and after, keys that are only on one side, and keys whose entries differ."""
    a = before.select("key", F.struct("value", "version", "write_id", "tombstone").alias("a"))
    b = after.select("key", F.struct("value", "version", "write_id", "tombstone").alias("b"))
    both = a.join(b, "key", "full_outer")
    return both.agg(
        F.count("a").alias("before"),
        F.count("b").alias("after"),
        F.count_if(F.col("b").isNull()).alias("lost"),
        F.count_if(F.col("a").isNull()).alias("added"),
        F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull() & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
    )


#: write_ids in a block of the fold, of which a Python worker holds one at a time, and in a piece of a block that finds its segments by itself.
SEGMENT_BLOCK, SEGMENT_PIECE = 1 << 16, 1 << 10


def assign_segments(log: DataFrame, limit: int, width: int = SEGMENT_BLOCK, piece: int = SEGMENT_PIECE) -> DataFrame:
    """Adds ``segment`` (from 1): a new one is begun when the active one is not empty and the record would exceed ``limit`` bytes.

    Where a segment ends depends on all before it, but a block of records can say in advance what it makes of any
    number of bytes that the active segment comes with: only where the first segment within it begins depends on
    that, the others follow. These answers, one row for each block, are chained shard by shard; then blocks place
    their segments at once. Sizes alone are read for this, twice. log is read three times and must not change.
    """
    piece = math.gcd(width, piece)
    sized = log.select("shard", "write_id", F.floor(F.col("write_id") / width).alias("_block"), binary.record_size(F.col("key"), F.col("value")).alias("bytes"))
    sized = sized.repartition("shard", "_block").sortWithinPartitions("shard", "_block", "write_id")
    answers = sized.mapInPandas(_answering(limit), "shard int, _block bigint, above array<bigint>, segments array<bigint>, used array<bigint>, fresh array<bigint>, total bigint")
    chained = answers.repartition("shard").sortWithinPartitions("shard", "_block").mapInPandas(_chaining, "shard int, _block bigint, segment bigint, used bigint")
    begins = chained.withColumnsRenamed({"shard": "_s", "_block": "_b"})
    known = sized.join(begins, (F.col("shard") == F.col("_s")) & (F.col("_block") == F.col("_b"))).select("shard", "_block", "write_id", "bytes", "segment", "used")
    known = known.repartition("shard", "_block").sortWithinPartitions("shard", "_block", "write_id")
    starts = known.mapInPandas(_placing(limit, piece), "_s int, _p bigint, _first bigint, _starts array<bigint>")
    found = log.join(starts, (F.col("shard") == F.col("_s")) & (F.floor(F.col("write_id") / piece) == F.col("_p")))
    return found.withColumn("segment", F.col("_first") + F.size(F.filter("_starts", lambda s: s <= F.col("write_id")))).drop("_s", "_p", "_first", "_starts")


def _blocks_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one (shard, block) at a time, which come one after the other."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        new = np.flatnonzero((np.diff(batch["shard"]) != 0) | (np.diff(batch["_block"]) != 0)) + 1
        for k, part in enumerate(np.split(np.arange(len(batch)), new)):
            rows = batch.iloc[part]
            if held and (k or (held[-1]["shard"].iloc[0], held[-1]["_block"].iloc[0]) != (rows["shard"].iloc[0], rows["_block"].iloc[0])):
                yield pd.concat(held)
                held = []
            held.append(rows)
    if held:
        yield pd.concat(held)


def _following(sums: np.ndarray, limit: int) -> np.ndarray:
    """For a segment begun at each record the record at which the next one begins; the number of records if none does. sums: 0 and all running sums."""
    n = len(sums) - 1
    at = np.arange(n)
    return np.minimum(np.maximum(np.searchsorted(sums, sums[:-1] + limit, side="right") - 1, at + 1), n)


def _answering(limit: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks_of(batches):
            sums = np.concatenate([[0], np.cumsum(rows["bytes"].to_numpy(np.int64))])
            n = len(sums) - 1
            # to the last segment of the block by doubling: last[i] is a later begin on the way from i, count[i] segments on; the last one leads to itself
            following = _following(sums, limit)
            last, count = np.where(following < n, following, np.arange(n)), (following < n).astype(np.int64)
            while ((hop := last[last]) != last).any():
                count, last = count + count[last], hop
            used = sums[n] - sums[last]
            # the first segment within the block begins at record j if more than limit - sums[j + 1] bytes come with it
            first = np.flatnonzero((sums[:-1] < limit) | (np.arange(n) == 0))
            above = limit - sums[first + 1]
            yield pd.DataFrame({"shard": rows["shard"].iloc[:1].to_numpy(), "_block": rows["_block"].iloc[:1].to_numpy(), "above": [above], "segments": [1 + count[first]], "used": [used[first]], "fresh": [np.array([count[0], used[0]])], "total": [sums[n]]})

    return run


def _chaining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The number of the active segment and its bytes at the begin of each block."""
    shard, segment, used = None, 1, 0
    for batch in batches:
        out = []
        for s, block, above, segments, left, fresh, total in batch.itertuples(index=False):
            if s != shard:
                shard, segment, used = s, 1, 0
            out.append((s, block, segment, used))
            # above falls: the first entry below ``used`` counts
            k = int(np.searchsorted(-np.asarray(above), -used, side="right"))
            if not used:
                segment, used = segment + int(fresh[0]), int(fresh[1])
            elif k < len(above):
                segment, used = segment + int(segments[k]), int(left[k])
            else:
                used += int(total)
        yield pd.DataFrame(out, columns=["shard", "_block", "segment", "used"])


def _placing(limit: int, piece: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in _blocks_of(batches):
            sums = np.concatenate([[0], np.cumsum(rows["bytes"].to_numpy(np.int64))])
            n, ids, used, segment = len(sums) - 1, rows["write_id"].to_numpy(), int(rows["used"].iloc[0]), int(rows["segment"].iloc[0])
            at = int(np.searchsorted(sums[1:], limit - used, side="right")) if used else 0
            following, begins = _following(sums, limit), []
            if not used:  # the shard's first segment begins here and is counted already
                at = int(following[0])
            while at < n:
                begins.append(at)
                at = int(following[at])
            begun = ids[np.array(begins, dtype=np.int64)]
            pieces = np.unique(ids // piece)
            cuts = np.searchsorted(begun, pieces * piece, side="left")
            ends = np.append(cuts[1:], len(begun))
            yield pd.DataFrame({"_s": rows["shard"].iloc[0], "_p": pieces, "_first": segment + cuts, "_starts": [begun[a:b] for a, b in zip(cuts, ends, strict=True)]})

    return run


def truncatable(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """(shard, segment) that a snapshot covers: closed, with all records up to the boundary, and no uncovered one before it."""
    from pyspark.sql import Window

    ends = segments.groupBy("shard", "segment").agg(F.max("write_id").alias("last"))
    found = ends.join(boundaries.select("shard", "boundary_write_id"), "shard")
    in_order = Window.partitionBy("shard").orderBy("segment")
    active = F.max("segment").over(Window.partitionBy("shard"))
    covered = ((F.col("last") <= F.col("boundary_write_id")) & (F.col("segment") < active)).cast("int")
    found = found.withColumn("_covered", covered).withColumn("_all", F.min("_covered").over(in_order))
    return found.where(F.col("_all") == 1).select("shard", "segment", "last")


def throttled(log: DataFrame, rate: int) -> DataFrame:
    """Adds ``done_ms``: when each record of a shard's copy is through a token bucket of ``rate`` bytes a second that starts empty (0: no limit)."""
    size = F.octet_length(F.coalesce("key", F.lit(""))) + F.octet_length(F.coalesce("value", F.lit("")))
    if not rate:
        return log.withColumn("done_ms", F.lit(0).cast("long"))
    found = blocked.prior_sum(log, ["shard"], "write_id", size, "_sent")
    return found.withColumn("done_ms", F.floor((F.col("_sent") + size) * 1000 / F.lit(rate))).drop("_sent")


def copied_bytes(state: DataFrame, rate: int) -> DataFrame:
    """Bytes of keys and values that a migration copies from each shard, and whole milliseconds at ``rate`` bytes a second (0: no limit)."""
    size = F.octet_length(F.coalesce("key", F.lit(""))) + F.octet_length(F.coalesce("value", F.lit("")))
    found = state.groupBy("shard").agg(F.sum(size).cast("long").alias("bytes"))
    return found.withColumn("millis", F.floor(F.col("bytes") * 1000 / F.lit(rate)) if rate else F.lit(0).cast("long"))
