"""Documents to token ids: quality, exact copies, near copies, mix, tokens. Counts as part of compindex.llm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from compindex.llm import stages
from compindex.llm.common import table
from compindex.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", stages.quality_rules),
    ("exact_dedup", stages.exact_dedup),
    ("simhash_near_dedup", stages.near_dedup),
    ("mix_sources", stages.mix_sources),
    ("bpe_encode", stages.encode),
]

# The quality stage fits its rule accuracies by expectation-maximisation, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage is written as Parquet below the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline_{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
