"""Differences, invariants, gates and reports over tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, NumericType, StructType

from compindex.functions import cleaning as K
from compindex.operators.stats import correlation
from compindex.session import cut_lineage

TOLERANCE = 1e-9


# --- document and table differences ----------------------------------------------------


def _leaf(path: Column, value: Column, kind: DataType) -> Column:
    number = value.cast("double") if isinstance(kind, NumericType) else F.lit(None).cast("double")
    return F.struct(path.alias("path"), value.cast("string").alias("text"), number.alias("number"))


def _leaves(path: Column, value: Column, kind: DataType) -> Column:
    """Array of leaves below a value; nesting follows the schema."""
    if isinstance(kind, StructType):
        return F.concat(*[_leaves(F.concat(path, F.lit("." + f.name)), value[f.name], f.dataType) for f in kind.fields])
    if isinstance(kind, ArrayType):
        inner = F.transform(
            value, lambda x, i: _leaves(F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), x, kind.elementType)
        )
        return F.coalesce(F.flatten(inner), F.array().cast("array<struct<path:string,text:string,number:double>>"))
    return F.array(_leaf(path, value, kind))


_LEAVES = "array<struct<path:string,text:string,number:double>>"
_DIFFERENCES = "array<struct<path:string,kind:string,a_text:string,b_text:string,delta:double>>"


def _difference(a: Column, b: Column) -> Column:
    """What distinguishes two leaves of one path; a missing one is null."""
    numeric = a["number"].isNotNull() & b["number"].isNotNull()
    kind = (
        F.when(b["path"].isNull(), "only_first").when(a["path"].isNull(), "only_second")
        .when(numeric, F.when(a["number"] != b["number"], "numeric"))
        .when(~a["text"].eqNullSafe(b["text"]), "text")
    )
    delta = F.when(numeric, F.abs(a["number"] - b["number"]))
    return F.struct(F.coalesce(a["path"], b["path"]).alias("path"), kind.alias("kind"), a["text"].alias("a_text"), b["text"].alias("b_text"), delta.alias("delta"))


def leaf_diff(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Leaves that differ, with the kind of difference and the numeric delta.

    The two tables are joined once, row by row as they are; equal rows end there, and of the others only leaves that differ
    become rows. Rows of either table without a partner are listed leaf by leaf.
    """
    fields = lambda df: [f for f in df.schema.fields if f.name not in keys]
    pack = lambda df, n: df.select(*keys, F.struct(*[F.col(f"`{f.name}`") for f in fields(df)]).alias(n))
    both = pack(first, "_a").join(pack(second, "_b"), keys, "full_outer")
    alike = [(f.name, f.dataType) for f in fields(first)] == [(f.name, f.dataType) for f in fields(second)]
    if alike and "map<" not in first.schema.simpleString():
        both = both.where(~F.col("_a").eqNullSafe(F.col("_b")))
    none = F.array().cast(_LEAVES)
    leaves = lambda df, n: F.when(
        F.col(n).isNotNull(), F.concat(none, *[_leaves(F.lit("." + f.name), F.col(n)[f.name], f.dataType) for f in fields(df)])
    ).otherwise(none)
    told = both.select(*keys, leaves(first, "_a").alias("_a"), leaves(second, "_b").alias("_b"))
    told = told.select(*keys, F.array_except("_a", "_b").alias("_a"), F.array_except("_b", "_a").alias("_b"))
    paths = lambda c: F.transform(c, lambda x: x["path"])
    missing = F.lit(None).cast("struct<path:string,text:string,number:double>")
    partner = lambda x, c: F.get(F.filter(c, lambda y: y["path"] == x["path"]), 0)
    one_sided = F.concat(
        F.transform("_a", lambda x: _difference(x, F.coalesce(partner(x, F.col("_b")), missing))),
        F.transform(F.filter("_b", lambda y: ~F.array_contains(paths(F.col("_a")), y["path"])), lambda y: _difference(missing, y)),
    )
    differing = F.when(paths(F.col("_a")) == paths(F.col("_b")), F.zip_with("_a", "_b", _difference)).otherwise(one_sided)
    return told.select(*keys, F.inline(differing.cast(_DIFFERENCES))).where(F.col("kind").isNotNull()).select(*keys, "path", "kind", "a_text", "b_text", "delta")


def diff_summary(diff: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("only_first", "only_second", "numeric", "text")]
    out = diff.agg(*counts, F.max("delta").alias("max_delta"))
    same = (F.col("only_first") == 0) & (F.col("only_second") == 0) & (F.col("text") == 0)
    return out.withColumn("within", same & (F.coalesce("max_delta", F.lit(0.0)) <= tolerance))


def unsanctioned(
    diff: DataFrame, allowed_paths: list[str], new_fields: list[str], allowed_leaves: DataFrame | None = None
) -> DataFrame:
    """Differences left after the sanctioned ones: path patterns, fields that may only be
    added, and listed leaves (keys, path)."""
    rest = diff
    for pattern in allowed_paths:
        rest = rest.where(~F.col("path").rlike(pattern))
    if new_fields:
        field = F.regexp_extract("path", r"^\.([^.\[]+)", 1)
        rest = rest.where(~((F.col("kind") == "only_first") & field.isin(*new_fields)))
    if allowed_leaves is not None:
        rest = rest.join(allowed_leaves, allowed_leaves.columns, "left_anti")
    return rest


# --- invariants and gates --------------------------------------------------------------


def score_violations(scores: DataFrame, meta: DataFrame) -> DataFrame:
    """Broken rules of a published score table as rows (level, rule, key).

    ``meta`` is one row with n_universe and n_scored. Ranks are 1..n exactly when they are
    whole, distinct, none is missing, the smallest is 1 and the largest equals n.
    """
    scores = cut_lineage(scores)
    n_scored = meta.select("n_scored").scalar()
    key = F.col("key").cast("string")
    scored, unscored = scores.where("scored"), scores.where(~F.col("scored"))
    bands = ("rank_p5", "rank_p50", "rank_p95", "tier_stability", "low_confidence")

    def row(df: DataFrame, test: Column, rule: str, level: str = "error") -> DataFrame:
        return df.where(test).select(F.lit(level).alias("level"), F.lit(rule).alias("rule"), key.alias("key"))

    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in bands])
    carried = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in bands])
    ordered = (
        (F.col("rank_p5") >= 1) & (F.col("rank_p5") <= F.col("rank_p50"))
        & (F.col("rank_p50") <= F.col("rank_p95")) & (F.col("rank_p95") <= n_scored)
    )
    counts = scores.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("scored").alias("scored"), F.max("rank").alias("top"),
        F.min("rank").alias("bottom"), F.count_if(F.col("rank") != F.floor("rank")).alias("broken"),
    )
    sizes = counts.select(
        F.explode(
            F.array(
                F.when(F.col("rows") != meta.select("n_universe").scalar(), "n_universe differs from the rows"),
                F.when(F.col("scored") != n_scored, "n_scored differs from the scored rows"),
                F.when(F.coalesce("top", F.lit(0)) != F.col("scored"), "largest rank is not n"),
                F.when((F.col("scored") > 0) & (F.coalesce("bottom", F.lit(0)) != 1), "smallest rank is not 1"),
                F.when(F.col("broken") > 0, "rank is not a whole number"),
            )
        ).alias("rule")
    ).where(F.col("rule").isNotNull()).select(F.lit("error").alias("level"), "rule", F.lit(None).cast("string").alias("key"))
    doubled = scored.where(F.col("rank").isNotNull()).groupBy("rank").agg(F.count(F.lit(1)).alias("_n"), F.min(key).alias("key"))
    doubled = doubled.where(F.col("_n") > 1).select(F.lit("error").alias("level"), F.lit("rank given twice").alias("rule"), "key")
    parts = [
        sizes,
        doubled,
        row(scored, F.col("rank").isNull(), "scored without a rank"),
        row(scored, missing, "scored without bands"),
        row(scored, ~ordered, "band out of order"),
        row(scored, ~F.col("tier_stability").between(0.0, 1.0), "stability outside 0-1"),
        row(scored, F.col("low_confidence") != (F.coalesce("domains_not_scored", F.lit(0)) >= 2), "badge does not follow its rule"),
        row(unscored, carried, "unscored with bands"),
        row(scored, ~F.col("rank").between(F.col("rank_p5"), F.col("rank_p95")), "rank outside its band", "warning"),
    ]
    return reduce(DataFrame.unionByName, parts)


def regression(current: DataFrame, stored: DataFrame, drops_fail: list[str], rises_note: list[str]) -> DataFrame:
    """Counts against a stored reference row: drops of some fail, rises of others are noted."""
    now, then = current.select(F.struct("*")).scalar(), stored
    rows = [
        F.struct(
            F.lit(c).alias("count"), F.col(c).cast("long").alias("stored"), now[c].cast("long").alias("current"),
            F.when(now[c] < F.col(c), "error").otherwise("ok").alias("status"),
        )
        for c in drops_fail
    ] + [
        F.struct(
            F.lit(c).alias("count"), F.col(c).cast("long").alias("stored"), now[c].cast("long").alias("current"),
            F.when(now[c] > F.col(c), "note").otherwise("ok").alias("status"),
        )
        for c in rises_note
    ]
    return then.select(F.inline(F.array(*rows)))


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """Row count and an order-free content hash."""
    total = F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))
    return df.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("rows"), total.cast("string").alias("hash"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Which snapshots changed, appeared or vanished."""
    a = before.select("name", F.col("rows").alias("rows_before"), F.col("hash").alias("_a"))
    b = after.select("name", F.col("rows").alias("rows_after"), F.col("hash").alias("_b"))
    status = F.when(F.col("_b").isNull(), "gone").when(F.col("_a").isNull(), "new").when(F.col("_a") != F.col("_b"), "changed").otherwise("same")
    return a.join(b, "name", "full_outer").select("name", "rows_before", "rows_after", status.alias("status"))


def change_report(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Added, removed and changed rows between two snapshots of a register."""
    columns = [c for c in after.columns if c not in keys]
    pack = lambda df, n: df.select(*keys, F.struct(*columns).alias(n))
    both = pack(before, "_a").join(pack(after, "_b"), keys, "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b")))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    changed = F.filter(
        F.array(*[F.when(~F.col("_a")[c].eqNullSafe(F.col("_b")[c]), c) for c in columns]), lambda c: c.isNotNull()
    )
    return both.select(*keys, status.alias("status"), F.when(status == "changed", F.array_join(changed, ",")).alias("changed"))


# --- reports ---------------------------------------------------------------------------


def vintages(register: DataFrame, today: Column) -> DataFrame:
    """Staleness, coverage-floor and gap flags per register row."""
    year_max = K.to_year(F.col("year_max"))
    countries = K.to_double(F.col("countries"))
    gap = (F.coalesce(countries, F.lit(0.0)) == 0) & year_max.isNull()
    return register.withColumn("staleness", K.staleness(year_max, today)).withColumn(
        "below_floor", F.coalesce(F.col("flags").contains("BELOW-COVERAGE-FLOOR"), F.lit(False))
    ).withColumn("gap_row", gap)


def vintage_rollup(report: DataFrame, by: list[str]) -> DataFrame:
    scored = ~F.col("gap_row")
    return report.groupBy(*by).agg(
        F.count_if(scored).alias("n_series"), F.count_if(F.col("gap_row")).alias("n_gaps"),
        F.count_if(scored & F.col("below_floor")).alias("n_below"), F.max(F.when(scored, F.col("staleness"))).alias("stalest"),
    )


def alternate_coverage(observed: DataFrame, universe: DataFrame, notes: DataFrame) -> DataFrame:
    """Key counts of unscored alternate series, beside note rows without counts."""
    counts = observed.join(universe, "key", "left_semi").groupBy("series").agg(F.count_distinct("key").alias("n_keys"))
    return counts.unionByName(notes.select("series", F.lit(None).cast("long").alias("n_keys")))


def reproduction(first: DataFrame, second: DataFrame, key: str, score: str) -> DataFrame:
    """Agreement of one score column between two builds."""
    a, b = first.select(key, F.col(score).alias("_a")), second.select(key, F.col(score).alias("_b"))
    both = a.join(b, key).where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
    return both.agg(
        F.count(F.lit(1)).alias("n"), correlation("_a", "_b").alias("r"), F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_diff")
    )


def reconciliation(domains: DataFrame, phases: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Published phase scores against the mean of the published domain scores."""
    means = domains.where(F.col("score").isNotNull()).groupBy("key", "phase").agg(F.avg("score").alias("_mean"))
    both = phases.where(F.col("score").isNotNull()).join(means, ["key", "phase"])
    return both.groupBy("phase").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.abs(F.col("score") - F.col("_mean"))).alias("max_diff")
    ).withColumn("within", F.col("max_diff") <= tolerance)


def zero_scores(scores: DataFrame) -> DataFrame:
    """Composites of exactly 0, which smell of missing values turned into numbers."""
    return scores.where(F.col("composite") == 0)


def coverage_ledger(domains: DataFrame, composites: DataFrame, phases: list[str]) -> DataFrame:
    """Scored keys in all, per phase and per domain."""
    kinds = [("composite", "composite"), *[(f"phase {p}", p) for p in phases]]
    overall = composites.select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("item"), F.col(c).isNotNull().alias("has")) for n, c in kinds]))
    ).groupBy("item").agg(F.count_if("has").alias("n_scored"))
    per_domain = domains.groupBy(F.concat(F.lit("domain "), F.col("domain")).alias("item")).agg(
        F.count_if("scored").alias("n_scored")
    )
    return overall.unionByName(per_domain)


def score_summary(scores: DataFrame, column: str) -> DataFrame:
    return scores.agg(
        F.count(F.lit(1)).alias("n_universe"), F.count(column).alias("n_scored"), F.min(column).alias("lowest"),
        F.max(column).alias("highest"),
    )
