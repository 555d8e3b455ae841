"""Stages of the corpus pipeline: each applies one operator to all documents that the stage before kept.

All but the last return the columns that they get, whatever these are called: what an operator doesn't use travels
in one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import langid, line_dedup, mixing, ngram_join, packing, queries
from loomlog.llm.common import stable, text_or_empty
from loomlog.ship import ship

__all__ = ["language_id", "line_copies", "mix_sources", "near_dedup", "pack"]

_ROW = "_ll_row"


def _wrapped(docs: DataFrame, *used: str) -> DataFrame:
    """The columns ``used`` and all others as one struct."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in used]
    return docs.select(*used, F.struct(*others, F.lit(0).alias("_ll_one")).alias(_ROW))


def _unwrapped(rows: DataFrame, docs: DataFrame, *used: str, **new: Column) -> DataFrame:
    return rows.select(*[new.get(c, F.col(c) if c in used else F.col(f"{_ROW}.`{c}`")).alias(c) for c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language can't be told: null texts and texts without letters. The others are unchanged.

    Where there are no labels to learn from, nothing can be told apart and only those are dropped.
    """
    ship(spark)
    net = langid.fit(docs)
    rows = _wrapped(docs, "text")
    if not net.labels:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = langid.predict(rows, net).where(F.col("lang_pred") != langid.UNDETERMINED)
    return _unwrapped(found, docs, "text")


def line_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes copies of earlier lines out of the texts; documents that had lines and have none left go. n_chars follows the text."""
    ship(spark)
    out = line_dedup.dedup_lines(_wrapped(docs, "doc_id", "text"))
    kept = out.where((F.col("n_lines") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    new = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return _unwrapped(kept, docs, "doc_id", "text", **new)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five words, similarity 0.8) the document with the smallest doc_id stays.

    Rows that repeat its doc_id and text can't be told from it and stay too.
    """
    ship(spark)
    classes = ngram_join.jaccard_classes(docs)
    gone = stable(classes.where(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("_ll_doc"), F.col("t").alias("_ll_t")).distinct())
    rows = _wrapped(docs, "doc_id", "text").withColumn("_ll_key", ngram_join.text_key(text_or_empty()))
    kept = rows.join(gone, rows["doc_id"].eqNullSafe(gone["_ll_doc"]) & (rows["_ll_key"] == gone["_ll_t"]), "left_anti")
    return _unwrapped(kept, docs, "doc_id", "text")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or more; repeats are rows of their own.

    Rows that repeat doc_id, source and text are each taken as often as the one of them that is taken most.
    """
    ship(spark)
    mixed = mixing.mix(mixing.sized(docs))
    times = mixed.where(F.col("times") > 0).select(F.col("doc_id").alias("_ll_doc"), F.col("source").alias("_ll_source"), F.col("text_key").alias("_ll_t"), "times").groupBy("_ll_doc", "_ll_source", "_ll_t").agg(F.max("times").alias("_ll_times"))
    rows = _wrapped(docs, "doc_id", "source", "text").withColumn("_ll_key", F.xxhash64("text"))
    same = rows["doc_id"].eqNullSafe(times["_ll_doc"]) & rows["source"].eqNullSafe(times["_ll_source"]) & (rows["_ll_key"] == times["_ll_t"])
    taken = rows.join(times, same).withColumn("_ll_time", F.explode(F.sequence(F.lit(1), F.col("_ll_times"))))
    return _unwrapped(taken, docs, "doc_id", "source", "text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, queries.tokenizer_path())
