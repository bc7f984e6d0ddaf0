"""The pipeline's stages: each takes (spark, docs, sf_dir) and returns the rows that go on.

A stage decides by document: rows that share a doc_id (null is one more id) stay or go together, and stay if any of
them would. Extra columns are carried along; what a stage adds gets names that no column has (``_unused``). Null and empty
texts, repeated rows and empty tables are the operators' defined cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compindex.llm import bpe, exact, mixing, nearcopies, quality
from compindex.session import frees_shuffles, short_batches


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer than any column of ``docs``."""
    return name + "_" * max(map(len, docs.columns))


def _without(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``docs`` less the ids of which ``verdicts`` (doc_id, kept) keeps no row."""
    gone, stays = _unused(docs, "gone"), _unused(docs, "stays")
    out = verdicts.groupBy(F.col("doc_id").alias(gone)).agg(F.max("kept").alias(stays)).where(~F.col(stays)).select(gone)
    return docs.join(out, F.col("doc_id").eqNullSafe(F.col(gone)), "left_anti")


def _distinct(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated rows. Maps, which Spark cannot compare, are compared by their sorted entries."""
    maps = [f.name for f in docs.schema.fields if isinstance(f.dataType, T.MapType)]
    entries = {_unused(docs, f"entries{k}_"): F.array_sort(F.map_entries(F.col(f"`{name}`"))) for k, name in enumerate(maps)}
    return docs.withColumns(entries).dropDuplicates([c for c in docs.columns if c not in maps] + list(entries)).select([F.col(f"`{c}`") for c in docs.columns])


@frees_shuffles
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules accept."""
    short_batches(spark)
    return _without(docs, quality.judged(docs).select("doc_id", "kept"))


@frees_shuffles
def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one with the largest doc_id. Fully equal rows become one."""
    short_batches(spark)
    verdicts = exact.duplicates(docs).select("doc_id", "kept")
    again = verdicts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    kept = _without(docs, verdicts)
    return kept if again else _distinct(kept)


@frees_shuffles
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id.

    SimHash fingerprints of five-word shingles within two bits and MinHash bands name candidates, an exact Jaccard of 0.8 decides.
    """
    short_batches(spark)
    found = nearcopies.near_copies(docs)
    return _without(docs, found.select("doc_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")))


@frees_shuffles
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    id_name, copies, copy = _unused(docs, "id"), _unused(docs, "copies"), _unused(docs, "copy")
    counted = mixing.mixed(docs).groupBy(F.col("doc_id").alias(id_name)).agg(F.max("copies").cast("int").alias(copies))
    joined = docs.join(counted.where(F.col(copies) > 0), F.col("doc_id").eqNullSafe(F.col(id_name)))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select([F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    short_batches(spark)
    return bpe.digests(docs, bpe.default_path())
