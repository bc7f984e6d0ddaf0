"""Comparison of build variants (arms), all arms in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compindex.operators import stats as T
from compindex.session import cut_lineage


def comparison(arms: DataFrame, reference: DataFrame, base: str) -> DataFrame:
    """One row per arm: n, r-squared on the reference, phase agreement, residual sd, tau against the base arm."""
    arms = cut_lineage(arms)
    scored = arms.where(F.col("composite").isNotNull()).join(reference, "key", "left")
    counts = scored.groupBy("arm").agg(F.count("composite").alias("n_scored"))
    anchor = arms.where(F.col("arm") == base).select("key", F.round("composite", 8).alias("base_composite"))
    paired = scored.join(anchor, "key").withColumn("composite", F.round("composite", 8))
    return (
        counts.join(T.pearson(scored, ["arm"], "composite", "g").select("arm", "r2"), "arm", "left")
        .join(T.spearman(scored, ["arm"], "R", "E").select("arm", "rho"), "arm", "left")
        .join(T.residual_sd(scored, ["arm"], "composite", "g").select("arm", "residual_sd"), "arm", "left")
        .join(T.rank_agreement(paired, ["arm"], "composite", "base_composite", "key", least=10).select("arm", "tau_b"), "arm", "left")
    )


def variance_moves(domains: DataFrame, reference: DataFrame, base: str) -> DataFrame:
    """Change of reference-aligned and orthogonal variance per domain and arm, with its verdict."""
    split = cut_lineage(T.variance_split(domains.join(reference, "key"), ["domain", "arm"], "score", "g"))
    start = split.where(F.col("arm") == base).select("domain", F.col("aligned").alias("_a"), F.col("orthogonal").alias("_o"))
    moved = split.where(F.col("arm") != base).join(start, "domain")
    moved = moved.where(F.col("aligned").isNotNull() & F.col("_a").isNotNull())
    moved = moved.withColumn("d_aligned", F.col("_a") - F.col("aligned")).withColumn("d_orthogonal", F.col("_o") - F.col("orthogonal"))
    return moved.withColumn("verdict", T.variance_verdict(F.col("d_aligned"), F.col("d_orthogonal")))
