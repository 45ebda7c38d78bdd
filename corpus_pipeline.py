"""The corpus pipeline: quality filter, line dedup, near-dedup, benchmark decontamination, token counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brinegrid.llm import stages

STAGES = [
    ("quality_classifier", stages.quality),
    ("line_dedup", stages.lines),
    ("minhash_near_dedup", stages.near),
    ("benchmark_decontamination", stages.leaks),
    ("bpe_encoding", stages.tokens),
]

#: The classifier, the sketches and the latent search are not expressible in SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
