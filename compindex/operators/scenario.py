"""Re-scoring under other operators, weights and inputs; a scenario is a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compindex.operators import order as O
from compindex.operators import stats as T
from compindex.session import cut_lineage

LEAST_SCORE = 1e-6


def combined(first: Column, second: Column, weight: Column, operator: Column) -> Column:
    """Weighted arithmetic or geometric mean; ``weight`` belongs to the second part."""
    geometric = F.pow(F.greatest(first, F.lit(LEAST_SCORE)), 1.0 - weight) * F.pow(
        F.greatest(second, F.lit(LEAST_SCORE)), weight
    )
    both = first.isNotNull() & second.isNotNull()
    return F.when(both, F.when(operator == "arithmetic", (1.0 - weight) * first + weight * second).otherwise(geometric))


def focus_phases(domains: DataFrame, focus: int | str, overrides: dict[str, float]) -> DataFrame:
    """Phase means of one key with some of its domain scores replaced."""
    value = F.col("score")
    for domain, score in overrides.items():
        value = F.when(F.col("domain") == domain, F.lit(float(score))).otherwise(value)
    mine = domains.where((F.col("key") == F.lit(focus)) & F.col("scored") & F.col("score").isNotNull())
    return mine.groupBy("key").agg(
        F.avg(F.when(F.col("phase") == "R", value)).alias("focus_r"), F.avg(F.when(F.col("phase") == "E", value)).alias("focus_e")
    )


def rescore(scored: DataFrame, scenarios: list[dict], focus: DataFrame | None = None, r2: float = 0.0) -> DataFrame:
    """Every scenario applied to the whole field, with new ranks and changes.

    ``scored`` is (key, R, E, composite, rank). A scenario has ``scenario``, ``operator``,
    ``weight``, ``shrink`` and ``use_focus``; shrinking rescales the spread around the
    scenario's mean by ``sqrt(1 - r2)``.
    """
    rows = F.array(
        *[
            F.struct(
                F.lit(s["scenario"]).alias("scenario"), F.lit(s["operator"]).alias("operator"),
                F.lit(float(s["weight"])).alias("weight"), F.lit(bool(s.get("shrink", False))).alias("shrink"),
                F.lit(bool(s.get("use_focus", False))).alias("use_focus"),
            )
            for s in scenarios
        ]
    )
    field = scored.select("key", "R", "E", F.col("composite").alias("base"), F.col("rank").alias("base_rank"))
    if focus is not None:
        field = field.join(focus, "key", "left")
    else:
        field = field.withColumn("focus_r", F.lit(None).cast("double")).withColumn("focus_e", F.lit(None).cast("double"))
    wide = field.select("*", F.inline(rows))
    changed = F.col("use_focus") & F.col("focus_r").isNotNull() & F.col("focus_e").isNotNull()
    first = F.when(changed, F.col("focus_r")).otherwise(F.col("R"))
    second = F.when(changed, F.col("focus_e")).otherwise(F.col("E"))
    scores = wide.select(
        "key", "scenario", "shrink", "base", "base_rank",
        combined(first, second, F.col("weight"), F.col("operator")).alias("_raw"),
    ).where(F.col("_raw").isNotNull())
    scores = cut_lineage(scores)
    means = scores.groupBy("scenario").agg(F.avg("_raw").alias("_mean"))
    scores = O.attach(scores, means, ["scenario"])
    shrunk = F.greatest(F.lit(0.0), F.col("_mean") + (F.col("_raw") - F.col("_mean")) * F.lit((1.0 - r2) ** 0.5))
    scores = scores.withColumn("score", F.when(F.col("shrink"), shrunk).otherwise(F.col("_raw")))
    ranked = O.ranked(scores, ["scenario"], [F.col("score").desc(), F.col("base_rank")], "rank")
    return ranked.select(
        "key", "scenario", "base", "score", "base_rank", "rank", (F.col("score") - F.col("base")).alias("delta"),
        (F.col("base_rank") - F.col("rank")).alias("places"),
    )


def agreement(scores: DataFrame, groups: list[str], first: str, second: str, key: str, top: int) -> DataFrame:
    """Tau, gamma and top-set churn between two scores of the same keys, per group."""
    rows = cut_lineage(scores.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(*groups, key, first, second))
    tau = T.rank_agreement(rows, groups, first, second, key).select(*groups, "n", "tau_b", "gamma")
    a = O.ranked(rows, groups, [F.col(first).desc(), F.col(key)], "_ra")
    both = O.ranked(a, groups, [F.col(second).desc(), F.col(key)], "_rb")
    in_a, in_b = F.col("_ra") <= top, F.col("_rb") <= top
    churn = both.groupBy(*groups).agg(
        (F.count_if(in_a & ~in_b) / F.lit(float(top))).alias("churn"),
        (F.count_if(in_a != in_b) / F.lit(2.0 * top)).alias("churn_symmetric"),
    )
    if groups:
        return tau.join(churn, groups)
    both_churn = churn.select(F.struct("churn", "churn_symmetric")).scalar()
    return tau.select("*", both_churn["churn"].alias("churn"), both_churn["churn_symmetric"].alias("churn_symmetric"))


# Pre-registered cuts of the validation verdicts.
R2_CONDITIONAL, R2_FAIL = 0.80, 0.90
STRUCTURE_LOW, STRUCTURE_HIGH = 0.20, 0.95
RETENTION_FAIL = 0.50


def incremental_label(shown: Column) -> Column:
    return F.when(shown, "PASS").when(shown.isNotNull(), "NOT DEMONSTRATED").otherwise("NOT RUN")


def verdicts(metrics: DataFrame) -> DataFrame:
    """Verdict per criterion and overall, from one row of metrics.

    ``metrics`` has r2_reference, r_phases, top_retention, and incremental (true when any
    pre-registered association holds, null when it was not run).
    """
    m = F.col
    reference = F.when(m("r2_reference") > R2_FAIL, "FAIL").when(m("r2_reference") > R2_CONDITIONAL, "CONDITIONAL").when(
        m("r2_reference").isNotNull(), "PASS"
    ).otherwise("NOT RUN")
    structure = F.when((m("r_phases") > STRUCTURE_HIGH) | (m("r_phases") < STRUCTURE_LOW), "FAIL").when(
        m("r_phases").isNotNull(), "PASS"
    ).otherwise("NOT RUN")
    noise = F.when(m("top_retention") < RETENTION_FAIL, "FAIL").when(m("top_retention").isNotNull(), "PASS").otherwise("NOT RUN")
    incremental = incremental_label(m("incremental"))
    rows = metrics.select(
        reference.alias("discriminant"), structure.alias("structure"), noise.alias("uncertainty"), incremental.alias("incremental")
    )
    overall = F.when((m("discriminant") == "FAIL") | (m("structure") != "PASS"), "FAIL").when(
        (m("discriminant") == "PASS") & (m("incremental") == "PASS") & (m("uncertainty") == "PASS"), "PASS"
    ).otherwise("CONDITIONAL")
    return rows.withColumn("overall", overall)
