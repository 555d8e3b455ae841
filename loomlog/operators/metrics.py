"""Measures of workloads: percentiles by floor index, throughput, speed-up, mix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_percentiles(samples: DataFrame, group: str, value: str, percents: tuple[int, ...] = (50, 95, 99)) -> DataFrame:
    """For each group and p the value at index floor(p * n / 100) of the sorted values, at most the last.

    That is no percentile_disc. Equal values are counted before anything is sorted, and the rank of a value is a
    running sum of counts over ranges of values, so that no group is sorted in one task.
    """
    counted = samples.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("_n"))
    spread = counted.groupBy(group).agg(F.min(value).alias("_low"), F.max(value).alias("_high"), F.sum("_n").alias("_total"))
    counted = counted.withColumnRenamed(group, "_g").join(spread, F.col("_g").eqNullSafe(F.col(group))).drop("_g")
    width = (F.col("_high") - F.col("_low")) / 256
    counted = counted.withColumn("_part", F.when(width > 0, F.least(F.floor((F.col(value) - F.col("_low")) / width), F.lit(255))).otherwise(0))
    parts = counted.groupBy(group, "_part").agg(F.sum("_n").alias("_sum"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_base", F.coalesce(F.sum("_sum").over(before), F.lit(0))).select(F.col(group).alias("_g"), F.col("_part").alias("_p"), "_base")
    within = Window.partitionBy(group, "_part").orderBy(value)
    ranked = counted.join(parts, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p"))).withColumn("_end", F.col("_base") + F.sum("_n").over(within))
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("_total") / 100), F.col("_total") - 1)
    hit = lambda p: F.max(F.when((F.col("_end") > at(p)) & (F.col("_end") - F.col("_n") <= at(p)), F.col(value))).alias(f"p{p}")
    return ranked.groupBy(group).agg(F.first("_total").alias("samples"), *[hit(p) for p in percents])


def workload_mix(ops: DataFrame, read: int, write: int) -> DataFrame:
    """Operations of a mix of ``read`` % GET, ``write`` % PUT and the rest DELETE, by seq: the roll is seq * 7919 mod 100."""
    roll = F.pmod(F.col("seq") * 7919, F.lit(100))
    return ops.withColumn("op", F.when(roll < read, "GET").when(roll < read + write, "PUT").otherwise("DELETE"))


# The key forms of the workloads; a form with a worker names it before the place.
KEY_FORMS = {"throughput": "c%d-k%d", "concurrency": "t%d-k%d", "rebalance": "pre-k%d", "restore": "key%d"}


def workload_keys(ops: DataFrame, form: str, workers: int = 1) -> DataFrame:
    """Adds ``key`` in a form of KEY_FORMS: rows are dealt to ``workers`` by seq, and a worker's places count from 0."""
    place = F.floor(F.col("seq") / workers)
    args = [F.pmod(F.col("seq"), F.lit(workers)), place] if KEY_FORMS[form].count("%d") == 2 else [F.col("seq")]
    return ops.withColumn("key", F.format_string(KEY_FORMS[form], *args))


def mix_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("op").agg(F.count("*").alias("n"))


def throughput(events: DataFrame, group: str, at_ms: str) -> DataFrame:
    """Events of each group, the milliseconds from the first to the last, and events a second (null for no time)."""
    found = events.groupBy(group).agg(F.count("*").alias("n"), (F.max(at_ms) - F.min(at_ms)).alias("millis"))
    return found.withColumn("per_second", F.when(F.col("millis") > 0, F.col("n") * 1000.0 / F.col("millis")))


def speed_up(before: Column, after: Column) -> Column:
    return after / before


def dip_percent(before: Column, during: Column) -> Column:
    return F.lit(100.0) * (during - before) / before
