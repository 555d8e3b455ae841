"""Window functions in two levels, for partitions of any size.

A shard is an eighth of all data and a hot key may be a third of it: a plain window would put either into one task.
Here rows are cut into blocks by ranges of their order column. Each (partition, block) is summed up first, in
partial aggregates; a window over these few summaries carries what blocks before it hold; and the window proper
runs within (partition, block). The order column must be a unique integer in its partition, and the input must give
the same rows when it is read again, as it is read twice: chained, these functions would double the plan each time,
so what they are applied to should be a stored table (scratch.written) or a plain scan. The log itself is built
without them, see oplog.build.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the order column in a block.
BLOCK = 1 << 16


def _with_block(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn("_block", F.floor(F.col(order) / F.lit(width)))


def _before(partition: list[str]) -> Window:
    return Window.partitionBy(*partition).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _attach(df: DataFrame, blocks: DataFrame, partition: list[str], add: list[str]) -> DataFrame:
    """Joins block summaries to rows; partitions may be null."""
    named = blocks.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*partition, "_block"])], *add)
    on = None
    for i, c in enumerate([*partition, "_block"]):
        same = df[c].eqNullSafe(named[f"_k{i}"])
        on = same if on is None else on & same
    return df.join(named, on).drop(*[f"_k{i}" for i in range(len(partition) + 1)])


def lag(df: DataFrame, partition: list[str], order: str, value: Column, out: str, width: int = BLOCK) -> DataFrame:
    """Adds ``out``: ``value`` of the row before in the partition; null for the first."""
    df = _with_block(df.withColumn("_value", F.struct(value.alias("v"))), order, width)
    blocks = df.groupBy(*partition, "_block").agg(F.max_by("_value", order).alias("_final"))
    blocks = blocks.withColumn("_prior", F.lag("_final").over(Window.partitionBy(*partition).orderBy("_block")))
    within = Window.partitionBy(*partition, "_block").orderBy(order)
    found = _attach(df, blocks, partition, ["_prior"]).withColumn("_prev", F.lag("_value").over(within))
    return found.withColumn(out, F.coalesce("_prev", "_prior")["v"]).drop("_prev", "_prior", "_value", "_block")


def prior_max(df: DataFrame, partition: list[str], order: str, value: Column, out: str, width: int = BLOCK) -> DataFrame:
    """Adds ``out``: the largest ``value`` (number or struct, nulls left out) of all rows before in the partition; null if none."""
    df = _with_block(df.withColumn("_value", value), order, width)
    blocks = df.groupBy(*partition, "_block").agg(F.max("_value").alias("_most"))
    blocks = blocks.withColumn("_prior", F.max("_most").over(_before(partition)))
    within = Window.partitionBy(*partition, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = _attach(df, blocks, partition, ["_prior"]).withColumn("_inside", F.max("_value").over(within))
    return found.withColumn(out, F.greatest("_prior", "_inside")).drop("_prior", "_inside", "_value", "_block")


def prior_sum(df: DataFrame, partition: list[str], order: str, value: Column, out: str, width: int = BLOCK) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before in the partition; 0 if none."""
    df = _with_block(df.withColumn("_value", value), order, width)
    blocks = df.groupBy(*partition, "_block").agg(F.sum("_value").alias("_sum"))
    blocks = blocks.withColumn("_prior", F.coalesce(F.sum("_sum").over(_before(partition)), F.lit(0)))
    within = Window.partitionBy(*partition, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    found = _attach(df, blocks, partition, ["_prior"])
    return found.withColumn(out, F.col("_prior") + F.coalesce(F.sum("_value").over(within), F.lit(0))).drop("_prior", "_value", "_block")
