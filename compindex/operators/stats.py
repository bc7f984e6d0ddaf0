"""Association, dispersion and multiple-testing statistics, grouped so that all signals, arms
or layers are measured in one job."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from compindex.operators import order as O
from compindex.operators import ranking as R
from compindex.session import cut_lineage

LEAST_PAIRS = 10


def _paired(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y))


def _guarded(value: Column, n: Column, least: int) -> Column:
    return F.when(n >= least, F.when(~F.isnan(value), value))


def correlation(x: str | Column, y: str | Column) -> Column:
    """Aggregate correlation; null, not an error, where a series is constant."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, groups: list[str], x: str, y: str, least: int = LEAST_PAIRS) -> DataFrame:
    """r over complete pairs, null below ``least`` pairs; r-squared is rounded to 3 decimals,
    because thresholds are tested on the rounded value."""
    agg = _paired(df, x, y).groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), correlation(x, y).alias("_r"))
    r = _guarded(F.col("_r"), F.col("n"), least)
    return agg.select(*groups, "n", r.alias("r"), F.round(r * r, 3).alias("r2"))


def spearman(df: DataFrame, groups: list[str], x: str, y: str, least: int = LEAST_PAIRS) -> DataFrame:
    """Correlation of average ranks over complete pairs."""
    pairs = cut_lineage(_paired(df, x, y).select(*groups, x, y))
    pairs = R.average_ranks(pairs, groups, x, "_rx")
    pairs = R.average_ranks(pairs, groups, y, "_ry")
    agg = pairs.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), correlation("_rx", "_ry").alias("_r"))
    return agg.select(*groups, "n", _guarded(F.col("_r"), F.col("n"), least).alias("rho"))


def rank_agreement(df: DataFrame, groups: list[str], x: str, y: str, key: str, least: int = 2) -> DataFrame:
    """Kendall's tau-b and the gamma ratio (C - D) / (C + D) without comparing all pairs.

    Sorted by (x, y), a discordant pair is an inversion of y. Inversions are counted bit by
    bit: two values first differ in one bit, so each pair is seen once, at the level of that
    bit, among rows that share the higher bits. Each level splits the sorted sequence into
    blocks; blocks count inside themselves, and block totals combine along the sequence. Rows
    grow by log2(n); no group exceeds a block or the number of blocks.
    """
    pairs = cut_lineage(_paired(df, x, y).select(*groups, key, x, y))
    coded = O.with_standing(pairs, groups, y).withColumnRenamed("below", "_y").withColumnRenamed("total", "_n").drop("n")
    placed = O.ranked(coded, groups, [F.col(x), F.col(y), F.col(key)], "_at")
    levels = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n").cast("double"))).cast("int")))
    bits = placed.select(*groups, "_at", "_y", "_n", F.explode(levels).alias("_level"))
    side = F.greatest(F.lit(1024), F.floor(F.sqrt(F.col("_n").cast("double"))).cast("int"))
    bits = bits.select(
        *groups, "_level", "_at",
        F.expr("shiftright(_y, _level + 1)").alias("_head"), F.expr("shiftright(_y, _level) & 1").alias("_bit"),
        F.floor(F.col("_at") / side).cast("long").alias("_block"),
    )
    cell = [*groups, "_level", "_head", "_block"]
    inside = Window.partitionBy(*cell).orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    ones_before = F.coalesce(F.sum("_bit").over(inside), F.lit(0))
    counted = bits.withColumn("_inv", F.when(F.col("_bit") == 0, ones_before).otherwise(0))
    blocks = counted.groupBy(*cell).agg(
        F.sum("_inv").alias("_inside"), F.sum("_bit").alias("_ones"), F.sum(1 - F.col("_bit")).alias("_zeros")
    )
    along = Window.partitionBy(*groups, "_level", "_head").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    crossing = F.coalesce(F.sum("_ones").over(along), F.lit(0)) * F.col("_zeros")
    discordant = (
        blocks.withColumn("_cross", crossing).groupBy(*groups).agg((F.sum("_inside") + F.sum("_cross")).alias("discordant"))
    )
    both = pairs.groupBy(*groups, x, y).agg(F.count(F.lit(1)).alias("_c"))
    ties = lambda t, c, name: t.groupBy(*groups).agg(F.sum(F.col(c) * (F.col(c) - 1) / 2.0).alias(name))
    by_x = both.groupBy(*groups, x).agg(F.sum("_c").alias("_c"))
    by_y = both.groupBy(*groups, y).agg(F.sum("_c").alias("_c"))
    sizes = both.groupBy(*groups).agg(F.sum("_c").alias("n"))
    if groups:
        out = discordant.join(sizes, groups).join(ties(by_x, "_c", "_tx"), groups)
        out = out.join(ties(by_y, "_c", "_ty"), groups).join(ties(both, "_c", "_txy"), groups)
    else:
        out = discordant.select(
            "discordant", sizes.scalar().alias("n"), ties(by_x, "_c", "_tx").scalar().alias("_tx"),
            ties(by_y, "_c", "_ty").scalar().alias("_ty"), ties(both, "_c", "_txy").scalar().alias("_txy"),
        )
    pairs_all = F.col("n") * (F.col("n") - 1) / 2.0
    concordant = pairs_all - F.col("_tx") - F.col("_ty") + F.col("_txy") - F.col("discordant")
    out = out.withColumn("concordant", concordant.cast("long")).withColumn("_p", pairs_all)
    diff = (F.col("concordant") - F.col("discordant")).cast("double")
    denominator = F.sqrt((F.col("_p") - F.col("_tx")) * (F.col("_p") - F.col("_ty")))
    tau = F.when(F.col("n") >= least, F.when(denominator > 0, F.try_divide(diff, denominator)))
    gamma = F.when(F.col("n") >= 2, F.try_divide(diff, F.col("concordant") + F.col("discordant")))
    return out.select(*groups, "n", "concordant", "discordant", tau.alias("tau_b"), gamma.alias("gamma"))


def ols_line(df: DataFrame, groups: list[str], y: str, x: str) -> DataFrame:
    return _paired(df, x, y).groupBy(*groups).agg(
        F.try_divide(F.covar_pop(y, x), F.var_pop(x)).alias("slope"), F.avg(y).alias("_y"), F.avg(x).alias("_x"),
        F.count(F.lit(1)).alias("n_fit"),
    ).select(*groups, "slope", (F.col("_y") - F.col("slope") * F.col("_x")).alias("intercept"), "n_fit")


def residuals(df: DataFrame, groups: list[str], y: str, x: str, name: str = "residual", least: int = 2) -> DataFrame:
    """Residual of y on x where both are known; null elsewhere."""
    line = ols_line(df, groups, y, x)
    if groups:
        joined = O.attach(df, line, groups, "left")
        slope, intercept, n = F.col("slope"), F.col("intercept"), F.col("n_fit")
        value = F.when(n >= least, F.col(y) - (slope * F.col(x) + intercept))
        return joined.withColumn(name, value).drop("slope", "intercept", "n_fit")
    fit = line.select(F.struct("slope", "intercept", "n_fit")).scalar()
    value = F.when(fit["n_fit"] >= least, F.col(y) - (fit["slope"] * F.col(x) + fit["intercept"]))
    return df.withColumn(name, value)


def residual_sd(df: DataFrame, groups: list[str], y: str, x: str, least: int = LEAST_PAIRS) -> DataFrame:
    """Population deviation of the residuals, from second moments in the same aggregation."""
    agg = _paired(df, x, y).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(y).alias("_vy"), correlation(x, y).alias("_r")
    )
    sd = F.sqrt(F.greatest(F.lit(0.0), F.col("_vy") * (1.0 - F.col("_r") * F.col("_r"))))
    return agg.select(*groups, "n", _guarded(sd, F.col("n"), least).alias("residual_sd"))


def reference_screen(
    signals: DataFrame, reference: DataFrame, groups: list[str], key: str, cut: float = 0.55
) -> DataFrame:
    """r-squared of every signal against a reference column; at or above the cut it is flagged."""
    joined = signals.join(reference.select(key, "g"), key)
    out = pearson(joined, groups, "value", "g")
    return out.withColumn("flagged", F.coalesce(F.col("r2") >= cut, F.lit(False)))


def variance_split(df: DataFrame, groups: list[str], value: str, reference: str, least: int = LEAST_PAIRS) -> DataFrame:
    """Variance aligned with the reference and orthogonal to it."""
    agg = _paired(df, value, reference).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"), F.var_pop(value).alias("variance"), correlation(value, reference).alias("_r")
    )
    r2 = F.col("_r") * F.col("_r")
    enough = F.col("n") >= least
    return agg.select(
        *groups, "n", F.when(enough, F.col("variance")).alias("variance"),
        F.when(enough, r2 * F.col("variance")).alias("aligned"),
        F.when(enough, (1.0 - r2) * F.col("variance")).alias("orthogonal"),
    )


def variance_verdict(d_aligned: Column, d_orthogonal: Column) -> Column:
    """What a change removed: reference-aligned variance, orthogonal variance, or a mix."""
    tiny = (F.abs(d_aligned) < 1e-9) & (F.abs(d_orthogonal) < 1e-9)
    return (
        F.when(d_aligned.isNull() | d_orthogonal.isNull(), F.lit(None))
        .when(tiny, "no-op")
        .when((d_aligned > 0) & (d_orthogonal <= 0), "DE-BIAS+")
        .when((d_aligned <= 0) & (d_orthogonal <= 0), "added")
        .when(d_aligned >= 2 * F.abs(d_orthogonal), "de-bias")
        .when((d_orthogonal > 0) & (d_orthogonal >= 2 * F.abs(d_aligned)), "HOLLOW")
        .otherwise("mixed")
    )


def eta_squared(df: DataFrame, by: list[str], value: str, group: str, least: int = LEAST_PAIRS) -> DataFrame:
    """Between-group share of the total sum of squares, from group moments only."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    parts = known.groupBy(*by, group).agg(
        F.count(F.lit(1)).alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v")
    )
    n, grand = F.sum("_n"), F.sum(F.col("_n") * F.col("_m")) / F.sum("_n")
    moments = parts.groupBy(*by).agg(
        n.alias("n"), F.count(F.lit(1)).alias("n_groups"), grand.alias("_grand"),
        F.sum(F.col("_n") * F.col("_v")).alias("_within"), F.sum(F.col("_n") * F.col("_m") * F.col("_m")).alias("_mm"),
    )
    between = F.col("_mm") - F.col("n") * F.col("_grand") * F.col("_grand")
    total = between + F.col("_within")
    eta = F.when((F.col("n_groups") >= 2) & (F.col("n") >= least) & (total > 0), F.try_divide(between, total))
    return moments.select(*by, "n", "n_groups", eta.alias("eta2"), (1.0 - eta).alias("within_share"))


def benjamini_hochberg(df: DataFrame, family: list[str], p: str = "p", name: str = "q") -> DataFrame:
    """Adjusted p-values per family; null p-values stay null and stay out of the family."""
    df = cut_lineage(df)
    steps = O.ladder(df, family, p).withColumn("_raw", F.col(p) * F.col("total") / (F.col("below") + F.col("n")))
    running = O.prefix(steps, family, [F.col(p).desc()], mins={name: "_raw"})
    capped = running.select(*family, p, "n", "total", F.least(F.lit(1.0), F.col(name)).alias(name))
    return O.by_value(df, capped, family, p).drop("n", "total")


def correlation_p(df: DataFrame, rho: str, neff: str, name: str = "p") -> DataFrame:
    """Two-sided p of a correlation at an effective sample size."""
    df_eff = F.col(neff) - 2.0
    t = F.abs(F.col(rho)) * F.sqrt(df_eff / F.greatest(F.lit(1e-9), 1.0 - F.col(rho) * F.col(rho)))
    usable = (F.col(neff) > 2) & F.col(rho).isNotNull() & ~F.isnan(rho)
    return df.withColumn(name, F.when(usable, student_tail(t, df_eff)))


def association_family(base: DataFrame, targets: DataFrame, names: list[str], sizes, least: int = 10) -> DataFrame:
    """Zero-order and residual association of one score with several targets, their effective sizes, p and FDR over the family.

    ``base`` is (key, lon, lat, x, g), ``targets`` (target, key, y). The score's residual on g comes from all keys, a target's from its
    own. ``sizes(rows, names, x, y)`` gives (target, n_eff) of all targets at once. A target with fewer than ``least`` keys has no row.
    """
    fitted = cut_lineage(residuals(base, [], "x", "g", "rx"))
    rows = cut_lineage(residuals(targets.join(fitted, "key"), ["target"], "y", "g", "ry"))
    zero = pearson(rows, ["target"], "x", "y").select("target", "n", F.col("r").alias("zero_pearson"))
    zero_rho = spearman(rows, ["target"], "x", "y").select("target", F.col("rho").alias("zero_spearman"))
    rho = spearman(rows, ["target"], "rx", "ry").select("target", F.col("rho").alias("residual_spearman"))
    out = zero.join(zero_rho, "target").join(rho, "target").join(sizes(rows, names, "rx", "ry").select("target", "n_eff"), "target").where(F.col("n") >= least)
    return benjamini_hochberg(cut_lineage(correlation_p(out, "residual_spearman", "n_eff")), [], "p", "q")


def incremental(family: DataFrame, proximate: list[str], alpha: float = 0.05) -> DataFrame:
    """One row: whether any of the pre-registered targets is positively and significantly associated; null if none was tested."""
    shown = (F.col("residual_spearman") > 0) & (F.col("q") < alpha)
    return family.where(F.col("target").isin(*proximate) & F.col("q").isNotNull()).agg(F.max(shown).alias("incremental"))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _incomplete_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1.0 - x)
    ) / a
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 400):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            total *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * total


@F.pandas_udf(DoubleType())
def student_tail(t: pd.Series, degrees: pd.Series) -> pd.Series:
    """Two-sided tail of Student's t; it sees only the few result rows."""
    return pd.Series(
        [
            None if pd.isna(a) or pd.isna(v) or v <= 0 else _incomplete_beta(v / 2.0, 0.5, v / (v + a * a))
            for a, v in zip(t, degrees)
        ],
        dtype="float64",
    )


def collinearity(signals: DataFrame, names: list[str], key: str = "key", name: str = "series") -> DataFrame:
    """r of every pair of named signals over shared keys.

    One row per key holds all signals, so pairs never meet in a join; the number of pairs
    follows from the fixed signal list.
    """
    wide = signals.groupBy(key).agg(*[F.max(F.when(F.col(name) == s, F.col("value"))).alias(s) for s in names])
    # one nested loop over positions, so that the plan does not grow with the number of pairs
    values, labels, last = F.array(*[F.col(n) for n in names]), F.array(*[F.lit(n) for n in names]), len(names) - 1
    pair = lambda i, j: F.struct(i.alias("i"), j.alias("j"), F.get("v", i).alias("x"), F.get("v", j).alias("y"))
    loop = F.transform(F.sequence(F.lit(0), F.lit(last - 1)), lambda i: F.transform(F.sequence(i + 1, F.lit(last)), lambda j: pair(i, j)))
    long = wide.select(values.alias("v")).select(F.inline(F.flatten(loop)))
    found = pearson(long, ["i", "j"], "x", "y")
    out = found.withColumn("a", F.get(labels, F.col("i"))).withColumn("b", F.get(labels, F.col("j"))).drop("i", "j")
    size = F.abs(F.col("r"))
    label = F.when(size >= 0.85, "merge").when(size >= 0.6, "review").when(size.isNotNull(), "keep")
    return out.withColumn("screen", label)


def group_profile(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """n, mean, 90th percentile, max, min and range per group."""
    df = cut_lineage(df.where(F.col(value).isNotNull()).select(*by, value))
    basic = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min")
    )
    out = basic.join(O.quantiles(df, by, value, {"p90": 0.9}), by)
    return out.withColumn("range", F.col("max") - F.col("min"))


def member_contrast(df: DataFrame, value: str, member: str) -> DataFrame:
    """Medians of listed members and of the rest."""
    cuts = O.quantiles(df.where(F.col(value).isNotNull()), [member], value, {"median": 0.5})
    return cuts.select(member, "median")
