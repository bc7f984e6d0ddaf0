"""Order statistics without a single-task window.

A window without partition columns, or partitioned by a handful of arms or draws, puts a
whole population into one task. Here rows are range-partitioned and sorted instead, every
partition counts for itself, and only one row per (partition, group) travels to combine them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compindex.session import cut_lineage

# A summary table of up to this many bytes is sent to every task.
BROADCAST_BYTES = 8 << 20
# Beyond it, rows of one key spread over this many join keys.
SALTS = 32
# A value held by more than one in HOT_SHARE rows of its group, and by more rows than one task easily takes, is hot.
HOT_SHARE, HOT_ROWS = 500, 10_000


def attach(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join a summary table to rows without a hot task.

    The summary is materialised and its bytes are counted. A small one is broadcast, which moves no row of ``big``.
    A larger one is copied once per salt and joined by shuffle on (keys, salt), so that a key with a third of all
    rows is ``SALTS`` keys; the salt is a hash of the row, so a recomputed row gets the same one.
    """
    small = cut_lineage(small)
    size = small.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0))).first()[0]
    if size <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), keys, how)
    return salted_join(big, small, keys, how)


def salted_join(big: DataFrame, small: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Inner or left join in which every key of ``big`` is split over ``SALTS`` keys."""
    hashed = [c for c, kind in big.dtypes if not kind.startswith(("map", "variant"))]
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*hashed), F.lit(SALTS)))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def _marked(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """Rows sorted by (groups, order) across partitions, with partition number and position."""
    ordered = df.orderBy(*[F.col(g) for g in groups], *order)
    return cut_lineage(
        ordered.withColumn("_pid", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id())
    )


def ranked(df: DataFrame, groups: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """``row_number`` within ``groups``; ``order`` must be a total order."""
    marked = _marked(df, groups, order)
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        marked.groupBy("_pid", *groups)
        .agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        .drop("_n")
    )
    joined = attach(marked, starts, ["_pid", *groups])
    number = F.col("_pos") - F.col("_first") + F.col("_before") + 1
    return joined.withColumn(name, number).drop("_pid", "_pos", "_first", "_before")


def prefix(
    df: DataFrame,
    groups: list[str],
    order: list[Column],
    sums: dict[str, str] | None = None,
    mins: dict[str, str] | None = None,
    totals: dict[str, str] | None = None,
) -> DataFrame:
    """Running aggregates along a total order within each group.

    ``sums`` adds exclusive running sums, ``mins`` inclusive running minima, ``totals`` the
    group totals; each maps a new column to the column it aggregates.
    """
    sums, mins, totals = sums or {}, mins or {}, totals or {}
    marked = _marked(df, groups, order)
    aggs = [F.sum(c).alias(f"_s_{n}") for n, c in sums.items()]
    aggs += [F.min(c).alias(f"_m_{n}") for n, c in mins.items()]
    aggs += [F.sum(c).alias(f"_t_{n}") for n, c in totals.items()]
    parts = marked.groupBy("_pid", *groups).agg(*aggs)
    earlier = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    offsets = parts.select(
        "_pid",
        *groups,
        *[F.coalesce(F.sum(f"_s_{n}").over(earlier), F.lit(0)).alias(f"_os_{n}") for n in sums],
        *[F.min(f"_m_{n}").over(earlier).alias(f"_om_{n}") for n in mins],
        *[F.sum(f"_t_{n}").over(whole).alias(n) for n in totals],
    )
    inside = Window.partitionBy("_pid", *groups).orderBy("_pos")
    before, upto = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(Window.unboundedPreceding, 0)
    local = marked.select(
        "*",
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_ls_{n}") for n, c in sums.items()],
        *[F.min(c).over(upto).alias(f"_lm_{n}") for n, c in mins.items()],
    )
    joined = attach(local, offsets, ["_pid", *groups])
    return joined.select(
        *df.columns,
        *[(F.col(f"_ls_{n}") + F.col(f"_os_{n}")).alias(n) for n in sums],
        *[F.least(f"_lm_{n}", f"_om_{n}").alias(n) for n in mins],
        *totals,
    )


def ladder(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """One row per distinct value: its count ``n``, the rows ``below`` it and the group ``total``.

    Equal values collapse before the sort, so a value that a third of all rows share is one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    return prefix(counts, groups, [F.col(value)], sums={"below": "n"}, totals={"total": "n"})


def share_at(probes: DataFrame, steps: DataFrame, groups: list[str], value: str, name: str) -> DataFrame:
    """``probes`` with the share of the population whose value is at most theirs; the values need not occur in it.

    ``steps`` is the ``ladder`` of the population. Its rows and the distinct asked values are sorted together by range, and each
    asked value takes the last step at or below it, so neither side is looked up by equality and no value is a hot key. A value below
    all others has a share of 0, one of a group without population null; null values keep null.
    """
    probes = cut_lineage(probes)
    asked = probes.where(F.col(value).isNotNull()).select(*groups, value).distinct()
    line = steps.select(*groups, value, (-(F.col("below") + F.col("n"))).alias("_upto"), F.col("n").alias("_n"), F.lit(False).alias("_asked"))
    line = line.unionByName(asked.select(*groups, value, F.lit(None).cast("long").alias("_upto"), F.lit(0).cast("long").alias("_n"), F.lit(True).alias("_asked")))
    # the running minimum of what is negative is the running count
    run = prefix(line, groups, [F.col(value), F.col("_asked")], mins={"_least": "_upto"}, totals={"_total": "_n"}).where("_asked")
    share = F.try_divide(F.coalesce(-F.col("_least"), F.lit(0)).cast("double"), F.col("_total"))
    return attach(probes, run.select(*groups, value, share.alias(name)), [*groups, value], "left").select(*probes.columns, name)


def quantiles(df: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact linear-interpolation quantiles per group, one column per named share."""
    steps = ladder(df, groups, value)
    outputs = []
    for name, share in shares.items():
        spot = F.lit(share) * (F.col("total") - 1)
        low, high = F.floor(spot), F.ceil(spot)
        holds = lambda k: (F.col("below") <= k) & (k < F.col("below") + F.col("n"))
        part = F.when(holds(low), F.col(value) * (1.0 - (spot - low))).otherwise(0.0)
        part = part + F.when(holds(high), F.col(value) * (spot - low)).otherwise(0.0)
        outputs.append(F.sum(part).alias(name))
    return steps.groupBy(*groups).agg(*outputs)


def with_standing(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Rows with the ladder columns of their value; rows without a value get nulls.

    The input is used several times, so it is materialised first.
    """
    df = cut_lineage(df)
    return by_value(df, ladder(df, groups, value), groups, value).select(*df.columns, "n", "below", "total")


def by_value(df: DataFrame, steps: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Rows beside the ladder row of their value, null where the value is; a value that many rows share is split.

    ``steps`` carries n and total. Values with more than one in ``HOT_SHARE`` rows of their group are fewer than that
    per group; their rows meet them by broadcast where they are. Null values take no part in the join.
    """
    steps, keys = cut_lineage(steps), [*groups, value]
    known, absent = df.where(F.col(value).isNotNull()), df.where(F.col(value).isNull())
    hot = steps.where(F.col("n") * HOT_SHARE > F.col("total") + HOT_ROWS * HOT_SHARE)
    if hot.isEmpty():
        return df.join(steps, keys, "left") if absent.isEmpty() else known.join(steps, keys, "left").unionByName(absent, True)
    spread = known.join(F.broadcast(hot), keys)
    rest = known.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(steps, keys, "left")
    return spread.unionByName(rest).unionByName(absent, True)


def average_rank(below: Column, n: Column) -> Column:
    """Average ascending rank of tied values."""
    return below + (n + 1) / 2.0


def percent_rank(below: Column, total: Column) -> Column:
    """Share of strictly smaller values over ``n - 1``; a lone value gets 0."""
    return F.when(total > 1, F.try_divide(below.cast("double"), total - 1)).when(total == 1, F.lit(0.0))


def cume_share(below: Column, n: Column, total: Column) -> Column:
    """Share of values less than or equal."""
    return F.try_divide((below + n).cast("double"), total)
