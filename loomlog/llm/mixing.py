"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets.

Each document draws an exponential key, scaled by its quality weight: with u uniform in (0, 1), -ln(u) / weight.
The documents of a source, in the order of their keys, are a weighted sample without replacement at every prefix.
A source's budget is met by complete epochs first (every document once each), and what is left by the documents
in key order as far as the prefix sum of their sizes goes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlog.llm.common import buckets_for, stable, text_or_empty

#: What counts as a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Quality weights lie between this and 1.
LEAST_WEIGHT = 0.25
#: Documents that one bucket of the prefix sums is meant to hold.
SUM_ROWS = 256


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def quality_weight(text: Column) -> Column:
    """LEAST_WEIGHT plus the rest times the share of words among word-like runs: symbols between words lower it."""
    signs = F.length(text) - F.length(F.translate(text, "#$%&*!|", ""))
    return F.lit(LEAST_WEIGHT) + F.lit(1 - LEAST_WEIGHT) / (1 + 20 * signs / F.greatest(F.length(text), F.lit(1)))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to rows (source, source_size), one for each source.

    Sources weigh in the order of their code points, null last, by ``weights`` over and over. All share ``share``
    times the sum of sizes; no target is above ``most`` times its source's size, and the excess goes to the others
    by weight. That ends at target = min(most * size, level * weight), where the level is found in one pass: a
    source is at its limit if the budget that those with lower ratios leave is still enough for it.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_ratio = Window.orderBy("_ll_ratio", "_ll_place")
    below, above = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    s = sizes.withColumns({"_ll_place": place, "_ll_w": weight, "_ll_cap": most * F.col("source_size")}).withColumn("_ll_ratio", F.col("_ll_cap") / F.col("_ll_w"))
    s = s.withColumn("_ll_budget", share * F.sum("source_size").over(whole))
    s = s.withColumn("_ll_level", (F.col("_ll_budget") - F.coalesce(F.sum("_ll_cap").over(below), F.lit(0.0))) / F.sum("_ll_w").over(above))
    s = s.withColumn("_ll_full", F.col("_ll_level") >= F.col("_ll_ratio"))
    # the level that counts is the one at the first source that is not at its limit
    level = F.min(F.when(~F.col("_ll_full"), F.struct("_ll_ratio", "_ll_place", "_ll_level"))).over(whole)["_ll_level"]
    return s.withColumn("target", F.when(F.col("_ll_full"), F.col("_ll_cap")).otherwise(level * F.col("_ll_w"))).drop("_ll_place", "_ll_w", "_ll_cap", "_ll_ratio", "_ll_budget", "_ll_level", "_ll_full")


def mix(rows: DataFrame, seed: int = 0, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = (3, 1, 2)) -> DataFrame:
    """rows: (doc_id, source, size, weight, ...) -> with source_size, target, times, taken.

    ``times`` is how often the mix repeats the document (0 to ``most``, rounded up), ``taken`` its words in the mix.
    Each source's taken words differ from its target by half a document at most. A document without words is taken
    in complete epochs, and in the fractional selection only while some of the budget is left. The draw depends on
    doc_id and seed alone, so reruns agree. A null size counts as 0, a null or smaller weight as LEAST_WEIGHT; a null
    source is a source; repeated rows, and rows without a doc_id, are separate documents that draw the same key, ties
    going by size; clashing columns are replaced, others stay; an empty table gives an empty one. Prefix sums have two
    levels, so a source of any size is spread over tasks.
    """
    rows = rows.drop("source_size", "target", "times", "taken").withColumns({
        "size": F.coalesce(F.col("size"), F.lit(0)).cast("long"),
        "_ll_w": F.least(F.greatest(F.coalesce(F.col("weight"), F.lit(0.0)), F.lit(LEAST_WEIGHT)), F.lit(1.0)),
        # 52 bits of a hash, never 0: exact in a double
        "_ll_u": (F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")), 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(2**52)),
    })
    rows = stable(rows)
    n = buckets_for(rows.count(), SUM_ROWS)
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("_ll_epochs", epochs).withColumn("_ll_rest", F.col("target") - F.col("_ll_epochs") * F.col("source_size"))
    # u ** (least / w) falls as the key grows, and no bucket of it is over 1 / least times as full as the mean
    keyed = rows.withColumns({"_ll_key": -F.log("_ll_u") / F.col("_ll_w"), "_ll_b": F.floor(n * (1 - F.pow(F.col("_ll_u"), LEAST_WEIGHT / F.col("_ll_w"))))})
    sums = keyed.groupBy("source", "_ll_b").agg(F.sum("size").alias("_ll_sum"))
    before = Window.partitionBy("source").orderBy("_ll_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_ll_base", F.coalesce(F.sum("_ll_sum").over(before), F.lit(0)))
    sums = sums.join(targets.withColumnRenamed("source", "_ll_source"), F.col("source").eqNullSafe(F.col("_ll_source"))).drop("_ll_source", "_ll_sum")
    sums = sums.withColumnsRenamed({"source": "_ll_source", "_ll_b": "_ll_bucket"})
    all_rows = keyed.join(sums, keyed["source"].eqNullSafe(sums["_ll_source"]) & (keyed["_ll_b"] == sums["_ll_bucket"])).drop("_ll_source", "_ll_bucket")
    earlier = Window.partitionBy("source", "_ll_b").orderBy("_ll_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    prefix = F.col("_ll_base") + F.coalesce(F.sum("size").over(earlier), F.lit(0))
    some = (F.col("_ll_rest") > 0) & (prefix + F.col("size") / 2 <= F.col("_ll_rest"))
    all_rows = all_rows.withColumn("times", (F.col("_ll_epochs") + some.cast("int")).cast("int"))
    return all_rows.withColumn("taken", F.col("size") * F.col("times")).drop("_ll_w", "_ll_u", "_ll_key", "_ll_b", "_ll_base", "_ll_epochs", "_ll_rest")


def sized(docs: DataFrame) -> DataFrame:
    """What mix() needs of documents: doc_id, source, size in words (of texts of any length), quality weight, and text_key, a hash of the text."""
    return docs.select("doc_id", "source", word_count(text_or_empty()).alias("size"), quality_weight(text_or_empty()).alias("weight"), F.xxhash64("text").alias("text_key"))


#: DuckDB's version of op5: the same draws from MD5, the same targets, plain windows.
SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
s AS (
  SELECT doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS size,
    0.25::DOUBLE + 0.75::DOUBLE / (1 + (20 * (length(t) - length(translate(t, '#$%&*!|', '')))) / greatest(length(t), 1)) AS w,
    (('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM d),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM sums),
weighed AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][place % 3 + 1] AS sw, 2.0::DOUBLE * source_size AS cap FROM placed),
levels AS (
  SELECT *, cap / sw AS ratio,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / sw, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(sw) OVER (ORDER BY cap / sw, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN level >= ratio THEN cap ELSE sw * (SELECT arg_min(level, row(ratio, place)) FROM levels WHERE level < ratio) END AS target FROM levels),
spent AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
sorted AS (
  SELECT doc_id, s.source AS source, size, source_size, target, epochs,
    coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY -ln(u) / w, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prefix
  FROM s JOIN spent p ON s.source IS NOT DISTINCT FROM p.source),
taken AS (SELECT *, CAST(epochs + CASE WHEN target - epochs * source_size > 0 AND prefix + size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END AS INTEGER) AS times FROM sorted)
SELECT doc_id, size, source_size, target, size * times AS taken, source, times FROM taken
"""
