"""The de-bias sweep over the workload's signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compindex.operators import compose as C
from compindex.operators import stats as T
from compindex.session import cut_lineage
from compindex.workload import fixtures as X

# Weights of the sweep, over all domains and inside a single one, and the replacement arm.
TARGET_DOMAIN = "click_day"
SWEEP = (
    [{"arm": "base", "weight": 1.0, "only_domain": None, "replace": False}]
    + [{"arm": f"w{w}", "weight": w, "only_domain": None, "replace": False} for w in (0.5, 0.25, 0.0)]
    + [{"arm": f"one_w{w}", "weight": w, "only_domain": TARGET_DOMAIN, "replace": False} for w in (0.75, 0.5, 0.25, 0.0)]
    + [{"arm": "replaced", "weight": 1.0, "only_domain": None, "replace": True}]
)
DROPPED = [("purchase", "h1")]
REPLACED = [("click", "h2", "click_day")]
SCREEN_CUT = 0.05


def design_after_drops() -> list[tuple]:
    """(domain, phase, in composite, designed signals) of the composite domains."""
    return [
        (domain, phase, inside, len([s for s in sig if s not in DROPPED]))
        for domain, phase, inside, _, sig in X.DESIGN
        if inside
    ]


def sweep_domains(spark, sf: str) -> DataFrame:
    signals = cut_lineage(X.signals(spark, sf))
    reference = signals.where((F.col("tbl") == X.REFERENCE[0]) & (F.col("col") == X.REFERENCE[1])).select("key", F.col("value").alias("g"))
    screen = T.reference_screen(signals, reference, ["tbl", "col"], "key", cut=SCREEN_CUT)
    only = lambda t, c: signals.where((F.col("tbl") == t) & (F.col("col") == c)).select("key", "value")
    optional = only("purchase", "h7").withColumn("domain", F.lit("purchase_pair"))
    return C.weighted_domain_scores(
        signals, X.crosswalk(spark), design_after_drops(), SWEEP, screen.where("flagged"),
        dropped=DROPPED, optional=optional, replacement=only("error", "h7"), replaced=REPLACED,
    )


def sweep(spark, sf: str) -> DataFrame:
    phases = C.phase_scores(sweep_domains(spark, sf), C.phase_totals(design_after_drops()), ["key", "arm"])
    return C.composite(phases, list(X.PHASES), ["key", "arm"])
