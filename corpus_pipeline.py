"""Corpus pipeline: stages over the documents table, each an operator of loomlog.llm."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlog import scratch
from loomlog.llm import stages

STAGES = [
    ("language_id", stages.language_id),
    ("line_dedup", stages.line_copies),
    ("near_dedup", stages.near_dedup),
    ("mix_sources", stages.mix_sources),
    ("pack", stages.pack),
]

#: Trained models, hashed draws and tokenizers are outside SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents; each stage's rows are written to the shared folder and read back for the next, then removed."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = scratch.folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            scratch.remove(spark, before)
        before = path
    return docs
