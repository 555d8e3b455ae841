"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomlog.scratch import shared_folder

#: Rows that one window partition of a two-level rank or prefix sum is meant to hold.
RANK_ROWS = 1024


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stable(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: it no longer changes when tasks are run again, and lineage ends."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that no worker holds Python objects for a whole Arrow batch of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


#: Most bytes in an Arrow batch: both sides hold whole batches outside the JVM's heap, and texts may be long.
BATCH_BYTES = 8 << 20


def _give_back() -> None:
    """Memory that a task has used and its worker would keep."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def map_in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """df.mapInArrow(run, schema) with batches of bounded bytes; workers give memory back after each task.

    The bound is the session's own where it has set one.
    """
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if bound not in df.sparkSession.conf.getAll:
        df.sparkSession.conf.set(bound, BATCH_BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(slices(batches))
        finally:
            _give_back()

    return df.mapInArrow(tidy, schema)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def buckets_for(rows: int, per_bucket: int = RANK_ROWS) -> int:
    return max(1, math.ceil(rows / per_bucket))


def gapless_rank(df: DataFrame, group: str, spread: Column, rows: int, out: str) -> DataFrame:
    """Adds ``out``: 0, 1, 2, ... within each value of ``group`` (not null), ordered by bucket and then by ``spread``.

    Two levels keep a group of any size out of a single task: rows are ranked within (group, bucket of the
    random 64-bit ``spread``), and each bucket starts where the counts of those before it end. df is read twice
    and must not change in between, see :func:`stable`.
    """
    n = buckets_for(rows)
    df = df.withColumn("_ll_r", spread).withColumn("_ll_b", F.pmod(F.shiftright("_ll_r", 7), F.lit(n)))
    before = Window.partitionBy(group).orderBy("_ll_b").rowsBetween(Window.unboundedPreceding, -1)
    base = df.groupBy(group, "_ll_b").agg(F.count("*").alias("_ll_n")).select(group, "_ll_b", F.coalesce(F.sum("_ll_n").over(before), F.lit(0)).alias("_ll_base"))
    within = Window.partitionBy(group, "_ll_b").orderBy("_ll_r")
    return df.join(base, [group, "_ll_b"]).withColumn(out, F.col("_ll_base") + F.row_number().over(within) - 1).drop("_ll_r", "_ll_b", "_ll_base")


#: A bitmap has this many pieces of 32,768 bits: 2 MB in all, for data of any size.
BITMAP_PIECES = 512


def _bit(hashed: Column) -> tuple[Column, Column]:
    return F.pmod(hashed, F.lit(BITMAP_PIECES)).cast("int"), F.pmod(F.shiftright(hashed, 9), F.lit(32_768))


def bitmap_of(df: DataFrame, hashed: Column) -> DataFrame:
    """A bit for each 64-bit hash in df, as at most BITMAP_PIECES rows of 4 KB: small enough to broadcast whatever df is."""
    piece, place = _bit(hashed)
    return df.select(piece.alias("_ll_piece"), place.alias("_ll_place")).groupBy("_ll_piece").agg(F.bitmap_construct_agg("_ll_place").alias("_ll_bits"))


def _bit_is_set() -> Column:
    byte = F.conv(F.hex(F.substring("_ll_bits", (F.floor(F.col("_ll_place") / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    return F.getbit(byte, (F.col("_ll_place") % 8).cast("int")) == 1


def may_be_in(df: DataFrame, bitmap: DataFrame, hashed: Column) -> DataFrame:
    """Rows of df whose bit is set: all whose hash went into the bitmap, and few others while that is sparse.

    It spares a following join the shuffle of rows that find no partner; where the bitmap is full, it spares nothing.
    """
    piece, place = _bit(hashed)
    found = df.withColumns({"_ll_piece": piece, "_ll_place": place}).join(F.broadcast(bitmap), "_ll_piece")
    return found.where(_bit_is_set()).drop("_ll_piece", "_ll_place", "_ll_bits")


#: Rows of one key from which a join deals them out, and into how many parts.
HOT_ROWS, HOT_PARTS = 10_000, 256


def spread_join(rows: DataFrame, keys: DataFrame, on: str, count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """rows joined with keys, which has each value of ``on`` once and the number of its rows as ``count``.

    Rows of a key with more than ``hot_rows`` are dealt over HOT_PARTS parts and meet copies of the key's one row,
    so no key of any size lands in one task. Which keys are hot travels as a bitmap of bounded size; a key that shares
    a bit with a hot one is dealt out too, which does no harm. Both are read more than once and must not change, see
    :func:`stable`: a row's part is its place in its partition.
    """
    hot = bitmap_of(keys.where(F.col(count) > hot_rows), F.xxhash64(on))

    def flagged(df: DataFrame) -> DataFrame:
        piece, place = _bit(F.xxhash64(on))
        found = df.withColumns({"_ll_piece": piece, "_ll_place": place}).join(F.broadcast(hot), "_ll_piece", "left")
        return found.withColumn("_ll_hot", F.coalesce(_bit_is_set(), F.lit(False))).drop("_ll_piece", "_ll_place", "_ll_bits")

    part = F.when(F.col("_ll_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS))).otherwise(0).cast("int")
    parts = F.sequence(F.lit(0), F.when(F.col("_ll_hot"), HOT_PARTS - 1).otherwise(0))
    dealt = flagged(rows).withColumn("_ll_part", part).drop("_ll_hot")
    copies = flagged(keys).withColumn("_ll_part", F.explode(parts)).drop("_ll_hot")
    return dealt.join(copies, [on, "_ll_part"]).drop("_ll_part")
