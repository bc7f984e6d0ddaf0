"""Scaling of long (series, key, value) tables to 0-1."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compindex.config import config_table
from compindex.functions import scaling as S
from compindex.operators import order as O
from compindex.session import cut_lineage

# Accepted directions.
DIRECTIONS = ("high_risk", "low_risk")
SPEC_SCHEMA = (
    "series string, floor double, ceiling double, direction string, invert boolean, unit string, "
    "coverage_floor double, min_present int, inverted boolean"
)


def resolve_inverted(direction: str | None, invert: bool | None) -> bool:
    """Whether low raw values mean a high score; an explicit switch beats the direction."""
    if invert is not None:
        return bool(invert)
    if direction is None:
        return False
    if direction not in DIRECTIONS:
        raise ValueError(f"unknown direction {direction!r}; expected one of {DIRECTIONS}")
    return direction == "low_risk"


def anchor_spec(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """Validated anchors. A missing anchor, a zero span or an unknown direction fails here."""
    rows = []
    for spec in specs:
        floor, ceiling = spec.get("floor"), spec.get("ceiling")
        if floor is None or ceiling is None:
            raise ValueError(f"{spec['series']}: floor and ceiling are required")
        if float(floor) == float(ceiling):
            raise ValueError(f"{spec['series']}: floor equals ceiling")
        direction, invert = spec.get("direction", "high_risk"), spec.get("invert")
        rows.append(
            (
                spec["series"], float(floor), float(ceiling), direction, invert, spec.get("unit", ""),
                float(spec.get("coverage_floor", 0.5)), int(spec.get("min_present", 2)),
                resolve_inverted(direction, invert),
            )
        )
    return config_table(spark, rows, SPEC_SCHEMA)


def densify(universe: DataFrame, values: DataFrame, key: str = "key") -> DataFrame:
    """Every universe key, with nulls where nothing was observed."""
    return universe.join(values, key, "left")


def anchor_scale(long: DataFrame, spec: DataFrame, series: str = "series", value: str = "value") -> DataFrame:
    """Score of each observed value against its fixed anchors."""
    anchors = spec.select(F.col("series").alias(series), "floor", "ceiling", "inverted")
    raw = F.when(~F.isnan(value), F.col(value))
    score = S.anchored(raw, F.col("floor"), F.col("ceiling"), F.col("inverted"))
    return long.join(anchors, series).withColumn("score", score).drop("floor", "ceiling", "inverted")


def coverage_meta(scored: DataFrame, universe_size: DataFrame, spec: DataFrame, series: str = "series") -> DataFrame:
    """Coverage of each series against the universe, flagged below its floor.

    ``universe_size`` is a one-row table with ``n_total``. Keys that are absent from
    ``scored`` count as missing, so the densified table is never built just to count it.
    """
    total = universe_size.select("n_total").scalar()
    counts = scored.groupBy(series).agg(F.count("score").alias("n_present"))
    meta = spec.select(F.col("series").alias(series), "coverage_floor", "min_present").join(counts, series, "left")
    meta = meta.select(
        series,
        F.coalesce("n_present", F.lit(0)).alias("n_present"),
        total.alias("n_total"),
        "coverage_floor",
        "min_present",
    )
    below = S.below_coverage(F.col("n_present"), F.col("n_total"), F.col("coverage_floor"), F.col("min_present"))
    percent = S.coverage_percent(F.col("n_present"), F.col("n_total"))
    text = F.format_string(
        "BELOW-COVERAGE-FLOOR (%d/%d; floor %d%%/min %d) -- low-confidence",
        F.col("n_present"), F.col("n_total"), (F.col("coverage_floor") * 100).cast("int"), F.col("min_present"),
    )
    return meta.select(
        series, "n_present", "n_total", percent.alias("coverage_pct"), below.alias("below_floor"),
        F.when(below, text).otherwise("").alias("flags"),
    )


def _directed(score, inverted: bool):
    return 1.0 - score if inverted else score


def winsor_minmax(long: DataFrame, groups: list[str], value: str = "value", tail: float = 0.05, inverted: bool = False):
    """Min-max between two interpolated quantiles; a zero span counts as 1."""
    long = cut_lineage(long)
    cuts = O.quantiles(long, groups, value, {"_lo": tail, "_hi": 1.0 - tail})
    joined = O.attach(long, cuts, groups, "left")
    span = F.when(F.col("_hi") - F.col("_lo") == 0, 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    score = _directed(S.clamp((F.col(value) - F.col("_lo")) / span), inverted)
    return joined.withColumn("score", score).drop("_lo", "_hi")


# Texts of the flags of a relative scale.
RELATIVE_FLAG = "RELATIVE-FALLBACK (%s) -- no absolute anchor; not comparable across refreshes"
RELATIVE_COVERAGE_FLAG = "BELOW-COVERAGE-FLOOR (%d/%d = %.0f%%) -- low-confidence"


def relative_meta(scored: DataFrame, universe_size: DataFrame, spec: DataFrame, method: str, series: str = "series") -> DataFrame:
    """Coverage row of every relatively scaled series; the relative flag is always set, the coverage flag below the floor.

    ``spec`` is that of the absolute scale: its direction still holds, its anchors do not.
    """
    meta = coverage_meta(scored, universe_size, spec, series).drop("flags").join(spec.select(F.col("series").alias(series), "inverted"), series)
    low = F.format_string(RELATIVE_COVERAGE_FLAG, F.col("n_present"), F.col("n_total"), F.col("coverage_pct"))
    flags = F.array_compact(F.array(F.lit(RELATIVE_FLAG % method), F.when(F.col("below_floor"), low)))
    direction = F.when(F.col("inverted"), "low_risk").otherwise("high_risk")
    return meta.select(
        series, direction.alias("direction"), F.lit(f"relative:{method}").alias("method"), "coverage_pct", "n_present", "n_total", "below_floor", flags.alias("flags")
    )


def percentile_scale(long: DataFrame, groups: list[str], value: str = "value", inverted: bool = False) -> DataFrame:
    """Strictly-below count over ``n - 1``."""
    standing = O.with_standing(long, groups, value)
    score = _directed(O.percent_rank(F.col("below"), F.col("total")), inverted)
    return standing.withColumn("score", score).drop("n", "below", "total")


def minmax(long: DataFrame, groups: list[str], value: str = "value", inverted: bool = False) -> DataFrame:
    """Plain min-max; a zero span counts as 1."""
    long = cut_lineage(long)
    ends = long.groupBy(*groups).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    joined = O.attach(long, ends, groups, "left")
    span = F.when(F.col("_hi") - F.col("_lo") == 0, 1.0).otherwise(F.col("_hi") - F.col("_lo"))
    return joined.withColumn("score", _directed((F.col(value) - F.col("_lo")) / span, inverted)).drop("_lo", "_hi")


def log_index(df: DataFrame, count: str, name: str) -> DataFrame:
    """``log1p`` of a count over ``log1p`` of the largest one."""
    largest = df.agg(F.max(count)).scalar()
    return df.withColumn(name, S.log_index(F.col(count), largest))


def per_capita_or_relative(
    values: DataFrame, denominator: DataFrame | None, key: str, spec: dict, per: float = 1.0
) -> DataFrame:
    """Absolute anchors where a denominator table exists, else the flagged relative fallback.

    Both follow the direction of ``spec``; ``flag`` says why a score is relative.
    """
    if denominator is None:
        flip = resolve_inverted(spec.get("direction"), spec.get("invert"))
        scored = winsor_minmax(values.withColumn("_all", F.lit(1)), ["_all"], inverted=flip).drop("_all")
        return scored.withColumn("method", F.lit("relative:winsor_minmax")).withColumn("flag", F.lit("no per-capita base: relative scale of raw counts"))
    rate = F.when(F.col("population") > 0, F.try_divide(F.col("value"), F.col("population")) * F.lit(float(per)))
    joined = values.join(denominator.select(key, "population"), key, "left").withColumn("rate", rate)
    inverted = F.lit(resolve_inverted(spec.get("direction"), spec.get("invert")))
    score = S.anchored(F.col("rate"), F.lit(float(spec["floor"])), F.lit(float(spec["ceiling"])), inverted)
    return joined.withColumn("score", score).drop("population", "rate").withColumn("method", F.lit("absolute")).withColumn("flag", F.lit(""))


def trimmed_surface(df: DataFrame, value: str, name: str, least: float = 0.06) -> DataFrame:
    """Min-max of a surface with a guarded span; cells at or below ``least`` are dropped."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    share = (F.col(value) - ends["lo"]) / (ends["hi"] - ends["lo"] + F.lit(1e-12))
    return df.withColumn(name, share).where(F.col(name) > least)
