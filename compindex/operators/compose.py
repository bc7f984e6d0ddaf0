"""Signals to domains, domains to phases, phases to one score.

The signal table is partitioned by key once; the domain, phase and composite steps that
follow are all satisfied by that partitioning, so they add no further shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compindex.config import sql_literal
from compindex.functions import scaling as S
from compindex.operators import order as O


def coverage_flag(scored: Column, confidence: Column, n: Column, total: Column) -> Column:
    """Not scored, then insufficient by design, then low confidence, then ok."""
    thin = (confidence == "low_confidence") | ((total == 1) & (n == 1)) | ~S.meets_floor(n, total)
    return (
        F.when(~scored, "not_scored_coverage")
        .when(confidence == "insufficient_data", "insufficient_data")
        .when(thin, "low_confidence")
        .otherwise("ok")
    )


def is_scored(n: Column, total: Column) -> Column:
    """Coverage floor met, or the only signal of a single-signal domain is present."""
    return S.meets_floor(n, total) | ((total == 1) & (n == 1))


def signal_name(tbl: str, col: str) -> str:
    return f"{tbl}|{col}"


def wide_signals(signals: DataFrame, pairs: list[tuple[str, str]], by: str = "key") -> DataFrame:
    """One row per key with a column per designed signal. The only shuffle of the build."""
    picks = [
        F.expr(f"max(CASE WHEN tbl = {sql_literal(t)} AND col = {sql_literal(c)} THEN value END) AS `{signal_name(t, c)}`")
        for t, c in sorted(set(pairs))
    ]
    return signals.where(F.col("value").isNotNull()).groupBy(by).agg(*picks)


def _domain_row(domain: str, phase: str, inside: bool, confidence: str, pairs: list[tuple[str, str]]) -> str:
    """SQL of one domain of a wide row: the mean and number of its present signals."""
    names = [f"`{signal_name(t, c)}`" for t, c in pairs]
    count = " + ".join(f"int({n} IS NOT NULL)" for n in names)
    total = " + ".join(f"coalesce({n}, 0D)" for n in names)
    return (
        f"named_struct('domain', {sql_literal(domain)}, 'phase', {sql_literal(phase)}, 'in_composite', {sql_literal(bool(inside))}, "
        f"'confidence', {sql_literal(confidence)}, 'n_present', {count}, 'n_total', {len(pairs)}, "
        f"'raw', try_divide({total}, double({count})))"
    )


def domain_scores(signals: DataFrame, design: list[tuple], keys: DataFrame, by: str = "key") -> DataFrame:
    """Equal-weight mean of the present signals of every domain, for every key.

    ``signals`` is (key, tbl, col, value); ``design`` lists (domain, phase, in_composite,
    confidence, signals); ``keys`` holds one row per key to report on. The design is fixed, so
    a key's signals are one wide row and its domains are computed inside that row.
    """
    wide = wide_signals(signals, [pair for row in design for pair in row[4]], by)
    rows = ", ".join(_domain_row(*row) for row in design)
    frame = keys.select(by).join(wide, by, "left").select(by, F.expr(f"inline(array({rows}))"))
    scored = is_scored(F.col("n_present"), F.col("n_total"))
    return frame.withColumn("scored", scored).withColumn("score", F.when(F.col("scored"), F.col("raw"))).withColumn(
        "coverage_flag", coverage_flag(F.col("scored"), F.col("confidence"), F.col("n_present"), F.col("n_total"))
    )


def attenuate(domains: DataFrame, modulator: DataFrame, key: str = "key") -> DataFrame:
    """Scale scores by a risk-aligned modulator ``g`` in [0, 1]; unknown ``g`` leaves them alone."""
    dial = S.clamp(F.col("g"))
    joined = domains.join(modulator.select(key, "g"), key, "left")
    return joined.withColumn("attenuated", F.col("g").isNotNull()).withColumn(
        "score", F.col("score") * F.coalesce(dial, F.lit(1.0))
    ).drop("g")


def phase_totals(design: list[tuple]) -> dict[str, int]:
    """Designed number of domains per phase."""
    totals: dict[str, int] = {}
    for _, phase, *_ in design:
        totals[phase] = totals.get(phase, 0) + 1
    return totals


def phase_scores(domains: DataFrame, totals: dict[str, int], by: list[str] | None = None) -> DataFrame:
    """Mean of the scored domains of each phase, under the same floor and without exception.

    The designed number of domains comes from ``totals``, so domains without a score need no rows.
    """
    by = by or ["key"]
    counts = domains.groupBy(*by, "phase", "in_composite").agg(
        F.avg("score").alias("mean"), F.count("score").cast("int").alias("n_domains_scored")
    )
    total = F.lit(None).cast("int")
    for phase, n in totals.items():
        total = F.when(F.col("phase") == phase, F.lit(int(n))).otherwise(total)
    counts = counts.withColumn("n_domains_total", total)
    fine = S.meets_floor(F.col("n_domains_scored"), F.col("n_domains_total"))
    return counts.withColumn("score", F.when(fine, F.col("mean"))).drop("mean")


def geometric_mean(parts: list[Column]) -> Column:
    """Geometric mean; null when any part is missing, negatives count as 0."""
    known = reduce(lambda a, b: a & b, [p.isNotNull() for p in parts])
    product = reduce(lambda a, b: a * b, [F.greatest(p, F.lit(0.0)) for p in parts])
    root = F.sqrt(product) if len(parts) == 2 else F.pow(product, F.lit(1.0 / len(parts)))
    return F.when(known, root)


def composite(phases: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
    """One row per key with a column per phase and the composite."""
    by = by or ["key"]
    wide = phases.groupBy(*by).agg(
        *[F.max(F.when(F.col("phase") == p, F.col("score"))).alias(p) for p in names]
    )
    return wide.withColumn("composite", geometric_mean([F.col(p) for p in names]))


def weighted_domain_scores(
    signals: DataFrame,
    crosswalk: DataFrame,
    domains: list[tuple],
    arms: list[dict],
    flagged: DataFrame,
    dropped: list[tuple[str, str]] = (),
    optional: DataFrame | None = None,
    replacement: DataFrame | None = None,
    replaced: list[tuple[str, str, str]] = (),
) -> DataFrame:
    """Weighted domain means of every arm in one pass; a domain without any input has no row.

    An arm has ``arm``, ``weight``, ``only_domain`` (null means every domain) and ``replace``.
    Flagged signals carry the arm's weight; weight 0 keeps them in the designed number but
    not among the present ones. Dropped signals leave the design. Optional slots, given as
    (key, domain, value), count on both sides where present. In a ``replace`` arm the slots in
    ``replaced``, given as (tbl, col, domain), take their value from ``replacement`` only.
    ``domains`` lists (domain, phase, in_composite, n_total) after the drop list.
    """
    arm_rows = F.array(
        *[
            F.struct(
                F.lit(a["arm"]).alias("arm"), F.lit(float(a["weight"])).alias("w_arm"),
                F.lit(a.get("only_domain")).cast("string").alias("only_domain"),
                F.lit(bool(a.get("replace", False))).alias("replace"),
            )
            for a in arms
        ]
    )
    slots = crosswalk.select("domain", "tbl", "col")
    for tbl, col in dropped:
        slots = slots.where(~((F.col("tbl") == tbl) & (F.col("col") == col)))
    flags = flagged.select("tbl", "col", F.lit(True).alias("flagged"))
    base = O.attach(signals.where(F.col("value").isNotNull()).join(slots, ["tbl", "col"]), flags, ["tbl", "col"], "left")
    wanted = F.lit(False)
    for tbl, col, _ in replaced:
        wanted = wanted | ((F.col("tbl") == tbl) & (F.col("col") == col))
    base = base.select(
        "key", "domain", "value", F.coalesce("flagged", F.lit(False)).alias("flagged"), wanted.alias("replaceable"),
        F.lit(False).alias("extra"), F.lit(False).alias("stand_in"),
    )
    parts = [base]
    if replacement is not None:
        homes = F.array(*[F.lit(domain) for _, _, domain in replaced])
        stand_in = replacement.where(F.col("value").isNotNull()).withColumn("domain", F.explode(homes))
        parts.append(
            stand_in.select(
                "key", "domain", "value", F.lit(False).alias("flagged"), F.lit(False).alias("replaceable"),
                F.lit(False).alias("extra"), F.lit(True).alias("stand_in"),
            )
        )
    if optional is not None:
        parts.append(
            optional.where(F.col("value").isNotNull()).select(
                "key", "domain", "value", F.lit(False).alias("flagged"), F.lit(False).alias("replaceable"),
                F.lit(True).alias("extra"), F.lit(False).alias("stand_in"),
            )
        )
    entered = reduce(DataFrame.unionByName, parts).repartition("key").select("*", F.inline(arm_rows))
    # a replaced signal leaves the replacement arm, a stand-in enters no other arm
    entered = entered.where(
        ~(F.col("replace") & F.col("replaceable")) & ~(~F.col("replace") & F.col("stand_in"))
    )
    in_scope = F.col("only_domain").isNull() | (F.col("only_domain") == F.col("domain"))
    weight = F.when(F.col("flagged") & in_scope, F.col("w_arm")).otherwise(F.lit(1.0))
    entered = entered.withColumn("w", weight).where(F.col("w") > 0)
    means = entered.groupBy("key", "arm", "domain").agg(
        F.sum(F.col("value") * F.col("w")).alias("weighted"), F.sum("w").alias("w_sum"),
        F.count(F.lit(1)).alias("n"), F.count_if("extra").alias("n_extra"),
    )
    look = lambda i, kind: _by_domain({row[0]: row[i] for row in domains}, kind)
    total = look(3, "int") + F.col("n_extra")
    scored = is_scored(F.col("n"), total)
    known = means.where(F.col("domain").isin(*[row[0] for row in domains]))
    return known.select(
        "key", "arm", "domain", look(1, "string").alias("phase"), look(2, "boolean").alias("in_composite"),
        F.col("n").cast("int").alias("n_present"), total.cast("int").alias("n_total"), scored.alias("scored"),
        F.when(scored, F.try_divide(F.col("weighted"), F.col("w_sum"))).alias("score"),
    )


def _by_domain(values: dict, kind: str) -> Column:
    out = F.lit(None).cast(kind)
    for domain, value in values.items():
        out = F.when(F.col("domain") == domain, F.lit(value).cast(kind)).otherwise(out)
    return out


def fill_missing(observed: DataFrame, modeled: DataFrame, keys: list[str]) -> DataFrame:
    """Modeled values fill nulls only; the flag says where they did."""
    extra = modeled.select(*keys, F.col("value").alias("_modeled"))
    joined = observed.join(extra, keys, "left")
    return joined.withColumn("is_modeled", F.col("value").isNull() & F.col("_modeled").isNotNull()).withColumn(
        "value", F.coalesce("value", "_modeled")
    ).drop("_modeled")


def override_first(base: DataFrame, override: DataFrame, keys: list[str]) -> DataFrame:
    """An alternative derivation replaces the base value wherever it exists."""
    extra = override.select(*keys, F.col("value").alias("_override"))
    return base.join(extra, keys, "left").withColumn("value", F.coalesce("_override", "value")).drop("_override")


def flag_rollup(domains: DataFrame, by: str = "key") -> DataFrame:
    """Sorted lists of flagged and of unscored composite domains per key, with their sizes."""
    kept = domains.where("in_composite")
    weak = F.col("scored") & F.col("coverage_flag").isin("low_confidence", "insufficient_data")
    out = kept.groupBy(by).agg(
        F.array_sort(F.collect_list(F.when(weak, F.col("domain")))).alias("low_conf"),
        F.array_sort(F.collect_list(F.when(~F.col("scored"), F.col("domain")))).alias("not_scored_domains"),
    )
    return out.select(
        "*", F.size("low_conf").alias("domains_low_conf"), F.size("not_scored_domains").alias("domains_not_scored")
    )
