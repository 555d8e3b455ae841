"""The registered queries of the corpus operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlog.llm import exact_dedup, langid, line_dedup, media, mixing, ngram_join, packing, pii, secret_scan, sharding
from loomlog.llm.common import documents, text_or_empty


#: Public tokenizer that op1 and the pipeline's packing use by default.
TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path())


def op2_pii_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is the session's spark.loomlog.pii.key; without one the public demonstration key is used."""
    key = spark.conf.get("spark.loomlog.pii.key", None)
    return pii.with_counts(pii.pseudonymise(documents(spark, sf_dir), key.encode() if key else pii.DEMO_KEY))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(documents(spark, sf_dir)).drop("t")


def op4_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(documents(spark, sf_dir)).drop("error")


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(documents(spark, sf_dir))).select("doc_id", "size", "source_size", "target", "taken", "source", "times")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    rows = docs.select("doc_id", langid.held_out().alias("held_out"), "text")
    return langid.predict(rows, langid.fit(docs), keep=["doc_id", "held_out"])


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = text_or_empty().cast("binary")
    rows = documents(spark, sf_dir).select("doc_id", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    out = sharding.shuffle_to_shards(rows, 24)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "text")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(documents(spark, sf_dir)).drop("candidates")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pack, op2_pii_feistel, op3_ngram_join, op4_jpeg_media, op5_mix_sources, op6_line_dedup, op7_exact_dedup, op8_secret_scan, op9_language_id, op10_shard)}


def oracle_sql() -> dict[str, str]:
    return {"op3_ngram_join": ngram_join.SQL, "op5_mix_sources": mixing.SQL, "op6_line_dedup": line_dedup.SQL, "op7_exact_dedup": exact_dedup.SQL, "op8_secret_scan": secret_scan.SQL}
