"""Spatial association over a weight table ``edges(i, j, w)``, with seeded permutations.

``units(layer..., id, y)`` may hold several layers; each is measured on the same graph.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compindex.functions import labels as B
from compindex.functions import noise as Z
from compindex.operators import order as O
from compindex.operators import ranking as R
from compindex.operators import stats as T
from compindex.session import compute_tasks, cut_lineage

ISOLATE = "Isolate (no neighbours)"
NOT_SIGNIFICANT = "Not-Significant"


def number_of(df: DataFrame, column: str = "id") -> Column:
    """The integer the seeded noise runs on: the id itself, or the head of a text id's SHA-256."""
    if dict(df.dtypes)[column] in ("bigint", "int", "smallint", "tinyint"):
        return F.col(column)
    return Z.text_number(F.col(column))


def centred(units: DataFrame, layers: list[str]) -> DataFrame:
    """Units with a value: ``z`` around the layer mean, beside layer size and sum of squares."""
    known = units.where(F.col("y").isNotNull())
    stats = known.groupBy(*layers).agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("_mean"), (F.var_pop("y") * F.count(F.lit(1))).alias("ss")
    )
    if layers:
        joined = O.attach(known, stats, layers)
    else:
        row = stats.select(F.struct("n", "_mean", "ss")).scalar()
        joined = known.select("*", row["n"].alias("n"), row["_mean"].alias("_mean"), row["ss"].alias("ss"))
    return joined.select(*layers, "id", "y", (F.col("y") - F.col("_mean")).alias("z"), "n", "ss")


def kept_edges(edges: DataFrame, units: DataFrame, layers: list[str]) -> DataFrame:
    """Edges between units that have a value, row-standardised again per layer."""
    ids = units.select(*layers, "id")
    left = edges.select("i", "j").join(ids.withColumnRenamed("id", "i"), "i")
    both = left.join(ids.withColumnRenamed("id", "j"), [*layers, "j"])
    degree = both.groupBy(*layers, "i").agg(F.count(F.lit(1)).alias("_k"))
    return both.join(degree, [*layers, "i"]).select(*layers, "i", "j", (1.0 / F.col("_k")).alias("w"))


def lagged(units: DataFrame, edges: DataFrame, layers: list[str], value: str = "z") -> DataFrame:
    """Units with their number of neighbours ``k`` and weighted neighbour mean ``lag``."""
    source = units.select(*layers, F.col("id").alias("j"), F.col(value).alias("_v"))
    lags = edges.join(source, [*layers, "j"]).groupBy(*layers, F.col("i").alias("id")).agg(
        F.sum(F.col("w") * F.col("_v")).alias("lag"), F.count(F.lit(1)).cast("int").alias("k"), F.sum("w").alias("w_sum")
    )
    joined = units.join(lags, [*layers, "id"], "left")
    return joined.withColumn("k", F.coalesce("k", F.lit(0))).withColumn("lag", F.coalesce("lag", F.lit(0.0)))


def moran(lag_table: DataFrame, layers: list[str]) -> DataFrame:
    """Global I per layer from the lag table."""
    agg = lag_table.groupBy(*layers).agg(
        F.max("n").alias("n"), F.count_if(F.col("k") == 0).alias("n_isolates"), F.sum("w_sum").alias("_s0"),
        F.sum(F.col("z") * F.col("lag")).alias("_num"), F.max("ss").alias("_ss"),
    )
    index = F.try_divide(F.col("n") * F.col("_num"), F.col("_s0") * F.col("_ss"))
    return agg.select(*layers, "n", "n_isolates", index.alias("moran_i"))


def group_moran(df: DataFrame, group: str, value: str) -> DataFrame:
    """I where all members of a group are neighbours, from group sums instead of pairs."""
    known = cut_lineage(df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(group, value))
    mean = known.agg(F.avg(value)).scalar()
    z = F.col(value) - mean
    parts = known.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(z).alias("_z"), F.sum(z * z).alias("_zz"))
    agg = parts.agg(
        F.sum("_n").alias("n"), F.sum(F.col("_n") * (F.col("_n") - 1)).alias("_w"),
        F.sum(F.col("_z") * F.col("_z") - F.col("_zz")).alias("_num"), F.sum("_zz").alias("_den"),
    )
    return agg.select("n", F.try_divide(F.col("n") * F.col("_num"), F.col("_w") * F.col("_den")).alias("moran_i"))


# A layer that every task may hold: units and edges, a few numbers each.
UNITS_AT_ONCE, EDGES_AT_ONCE, LAYERS_AT_ONCE = 50_000, 500_000, 100


def fits(base: DataFrame, edges: DataFrame) -> bool:
    return 0 < base.count() <= UNITS_AT_ONCE and edges.count() <= EDGES_AT_ONCE


def permuted_products(base: DataFrame, edges: DataFrame, perms: int, seed: int) -> DataFrame:
    """(_num): per permutation the sum of z times lag after a reshuffle, each task for its own range of permutations."""
    told = base.select("id", number_of(base).cast("long").alias("no"), "z").orderBy("id").toPandas()
    number, z = told["no"].to_numpy(np.int64), told["z"].to_numpy(float)
    place = pd.Series(np.arange(len(told)), index=told["id"])
    pairs = edges.select("i", "j", "w").toPandas()
    i, j, w = place.reindex(pairs["i"]).to_numpy(), place.reindex(pairs["j"]).to_numpy(), pairs["w"].to_numpy(float)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            moved = (z[np.argsort(Z.mixed_array(p, number, seed), kind="stable")] for p in batch["id"].tolist())
            yield pd.DataFrame({"_num": [float((m[i] * m[j] * w).sum()) for m in moved]})

    return cut_lineage(base.sparkSession.range(1, perms + 1, 1, compute_tasks(base)).mapInPandas(run, "_num double"))


def reshuffled(base: DataFrame, edges: DataFrame, perms: int, seed: int) -> DataFrame:
    """The same for a layer of any size: all reshuffles are ranked, joined and summed at once."""
    drawn = base.select("id", "z", F.explode(F.sequence(F.lit(1), F.lit(perms))).alias("perm"))
    drawn = drawn.withColumn("_h", Z.mixed(F.col("perm"), number_of(base), seed))
    shuffled = O.ranked(drawn, ["perm"], [F.col("_h"), F.col("id")], "place").select("perm", "place", "z")
    seats = O.ranked(base.select("id"), [], [F.col("id")], "place")
    seated = shuffled.join(seats, "place").select("perm", "id", "z")
    lag = edges.join(seated.select("perm", F.col("id").alias("j"), F.col("z").alias("_zj")), "j").groupBy("perm", "i").agg(
        F.sum(F.col("w") * F.col("_zj")).alias("lag")
    )
    sums = lag.join(seated.withColumnRenamed("id", "i"), ["perm", "i"]).groupBy("perm").agg(
        F.sum(F.col("z") * F.col("lag")).alias("_num")
    )
    return sums


def moran_permutations(units: DataFrame, edges: DataFrame, perms: int, seed: int) -> DataFrame:
    """Global I with its pseudo-p and z from seeded reshuffles of the values.

    A layer of up to ``UNITS_AT_ONCE`` units and ``EDGES_AT_ONCE`` edges (both are counted) goes to every task, and a task returns one
    number per reshuffle. A larger one is reshuffled as a table with the permutation number as a column.
    """
    base = cut_lineage(centred(units, []))
    edges = cut_lineage(kept_edges(edges, base, []))
    observed = cut_lineage(moran(lagged(base, edges, []), []))
    sums = permuted_products(base, edges, perms, seed) if fits(base, edges) else reshuffled(base, edges, perms, seed)
    row = observed.select(F.struct("n", "n_isolates", "moran_i")).scalar()
    ss = base.agg(F.max("ss")).scalar()
    active = row["n"] - row["n_isolates"]
    sims = sums.select(F.try_divide(row["n"] * F.col("_num"), active * ss).alias("_sim"))
    agg = sims.agg(
        F.count_if(F.col("_sim") >= row["moran_i"] - TIE).alias("_larger"), F.count(F.lit(1)).alias("perms"),
        F.avg("_sim").alias("_mean"), F.stddev_pop("_sim").alias("_sd"),
    )
    z = F.when(F.col("_sd") > 0, F.try_divide(row["moran_i"] - F.col("_mean"), F.col("_sd")))
    return agg.select(
        row["n"].alias("n"), row["moran_i"].alias("moran_i"), z.alias("z_sim"),
        folded_p(F.col("_larger"), F.col("perms")).alias("p_sim"),
    )


# Equal statistics may differ in their last digits by the order of summation; ties count as larger.
TIE = 1e-12


def folded_p(larger: Column, perms: Column) -> Column:
    """Pseudo-p of the smaller tail."""
    return (F.least(larger, perms - larger) + 1) / (perms + 1)


def conditional_draws(base: DataFrame, layers: list[str], value: str, most: int, perms: int, seed: int) -> DataFrame:
    """Sums over the first m units of one random order per permutation, for every m up to ``most``.

    A unit with m neighbours is compared with the first m units of each order, itself skipped.
    So only ``most + 1`` units per order are ever needed: the table has perms x (most + 1)
    rows per layer however many units there are.
    """
    drawn = base.select(*layers, "id", value, F.explode(F.sequence(F.lit(1), F.lit(perms))).alias("perm"))
    drawn = drawn.withColumn("_h", Z.mixed(F.col("perm"), number_of(base), seed))
    first = R.top_by_group(drawn, [*layers, "perm"], [F.col("_h"), F.col("id")], most + 1)
    order = Window.partitionBy(*layers, "perm").orderBy("place")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    return first.select(
        *layers, "perm", F.col("place").alias("k"), F.sum(value).over(upto).alias("_sum"),
        F.lead(value).over(order).alias("_next"), F.collect_list("id").over(upto).alias("_ids"),
    ).where(F.col("k") <= most)


def simulated(base: DataFrame, layers: list[str], value: str, perms: int, seed: int) -> DataFrame:
    """Every unit with neighbours beside its simulated neighbour sums, one row per permutation."""
    most = int(base.agg(F.max("k")).first()[0] or 0)
    draws = conditional_draws(base, layers, value, most, perms, seed)
    joined = O.attach(base.where(F.col("k") > 0), draws, [*layers, "k"])
    hit = F.array_contains("_ids", F.col("id"))
    return joined.withColumn(
        "_sim_sum", F.when(hit, F.col("_sum") + F.coalesce("_next", F.lit(0.0)) - F.col(value)).otherwise(F.col("_sum"))
    )


def conditional_counts(lag: DataFrame, layers: list[str], perms: int, seed: int) -> DataFrame | None:
    """(layers, id, _plain, _signed, _perms, _shift, _squares): every unit's neighbour sum against those of ``perms`` orders, counted where it is drawn.

    ``_signed`` counts simulated local statistics, ``_plain`` simulated sums with the unit itself, that are at least its own; ``_shift`` and
    ``_squares`` add up how far simulated means of neighbours lie from its own. None if the layers are too large for one task.
    """
    told_layers = [r.asDict() for r in lag.groupBy(*layers).count().limit(LAYERS_AT_ONCE + 1).collect()] if layers else [{"count": lag.count()}]
    if not told_layers or len(told_layers) > LAYERS_AT_ONCE or sum(t["count"] for t in told_layers) > UNITS_AT_ONCE or not told_layers[0]["count"]:
        return None
    told = lag.select(*layers, "id", number_of(lag).cast("long").alias("no"), "z", "k", (F.col("lag") * F.col("k")).alias("own"), "n", "ss").orderBy(*layers, "id").toPandas()
    parts = [group for _, group in told.groupby(layers, sort=True)] if layers else [told]
    arrays = [tuple(p[c].to_numpy() for c in ("no", "z", "k", "own", "n", "ss")) + (p.index.to_numpy(),) for p in parts]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plain, signed, count = np.zeros(len(told), np.int64), np.zeros(len(told), np.int64), 0
        shift, squares = np.zeros(len(told)), np.zeros(len(told))
        for perm in (p for batch in batches for p in batch["id"].tolist()):
            count += 1
            for number, z, k, own, n, ss, rows in arrays:
                order = np.argsort(Z.mixed_array(perm, number, seed), kind="stable")
                seat = np.empty(len(z), np.int64)
                seat[order] = np.arange(len(z))
                upto = np.append(0.0, np.cumsum(z[order]))
                after = np.append(z[order], 0.0)
                # the first k units of the order, the unit itself skipped
                sim = upto[k] + np.where(seat < k, after[k] - z, 0.0)
                size = np.maximum(k, 1)
                plain[rows] += (z + sim) / (k + 1) >= (z + own) / (k + 1) - np.sqrt(ss / n) * TIE
                signed[rows] += (n - 1) / ss * z * sim / size >= (n - 1) / ss * z * own / size - TIE
                away = (sim - own) / size
                shift[rows] += away
                squares[rows] += away * away
        if count:
            yield pd.DataFrame({"row": np.arange(len(told)), "_plain": plain, "_signed": signed, "_perms": count, "_shift": shift, "_squares": squares})

    spark = lag.sparkSession
    drawn = spark.range(1, perms + 1, 1, compute_tasks(lag)).mapInPandas(run, "row long, _plain long, _signed long, _perms long, _shift double, _squares double")
    counted = drawn.groupBy("row").agg(*[F.sum(c).alias(c) for c in ("_plain", "_signed", "_perms", "_shift", "_squares")])
    names = spark.createDataFrame(told[[*layers, "id"]].assign(row=range(len(told))), lag.select(*layers, "id", F.lit(0).cast("long").alias("row")).schema)
    return cut_lineage(names.join(counted, "row").drop("row"))


def local_moran(units: DataFrame, edges: DataFrame, layers: list[str], perms: int, seed: int, alpha: float = 0.05):
    """Local I, quadrant, conditional-permutation p, FDR and cluster labels.

    Units without neighbours carry their own label and no p, and stay out of the FDR family.
    """
    base = cut_lineage(centred(units, layers))
    edges = kept_edges(edges, base, layers)
    lag = cut_lineage(lagged(base, edges, layers))
    scale = (F.col("n") - 1) / F.col("ss")
    local = scale * F.col("z") * F.col("lag")
    counted = conditional_counts(lag, layers, perms, seed)
    if counted is None:
        sims = simulated(lag, layers, "z", perms, seed)
        sim_i = scale * F.col("z") * F.col("_sim_sum") / F.col("k")
        counted = sims.groupBy(*layers, "id").agg(
            F.count_if(sim_i >= local - TIE).alias("_larger"), F.count(F.lit(1)).alias("_perms"),
            F.avg(sim_i).alias("_mean"), F.stddev_pop(sim_i).alias("_sd"),
        )
        joined = lag.join(counted, [*layers, "id"], "left")
    else:
        # deviations from the unit's own value, which the local statistic only scales
        mean = F.col("_shift") / F.col("_perms")
        spread = F.sqrt(F.greatest(F.col("_squares") / F.col("_perms") - mean * mean, F.lit(0.0)))
        unit = scale * F.col("z")
        joined = lag.join(counted, [*layers, "id"], "left").withColumns(
            {"_larger": F.when(F.col("k") > 0, F.col("_signed")), "_mean": local + unit * mean, "_sd": F.when(F.col("k") > 0, F.abs(unit) * spread)}
        )
    joined = joined.select(
        *layers, "id", "y", "k", local.alias("local_i"), B.quadrant(F.col("z"), F.col("lag")).alias("quadrant"),
        F.when(F.col("_sd") > 0, F.try_divide(local - F.col("_mean"), F.col("_sd"))).alias("z_sim"),
        folded_p(F.col("_larger"), F.col("_perms")).alias("p_raw"),
    )
    tested = T.benjamini_hochberg(joined, layers, "p_raw", "p_fdr")
    label = lambda p: F.when(F.col("k") == 0, ISOLATE).when(F.col(p) < alpha, F.col("quadrant")).otherwise(NOT_SIGNIFICANT)
    return tested.withColumn("cluster_raw", label("p_raw")).withColumn("cluster_fdr", label("p_fdr"))


def local_gi_star(units: DataFrame, edges: DataFrame, layers: list[str], perms: int, seed: int, alpha: float = 0.05):
    """Gi* on contiguity, the unit itself included: z, permutation p, FDR and hot or cold labels."""
    base = cut_lineage(centred(units, layers))
    edges = kept_edges(edges, base, layers)
    lag = cut_lineage(lagged(base, edges, layers))
    size = F.col("k") + 1
    star = (F.col("z") + F.col("lag") * F.col("k")) / size
    spread = F.sqrt(F.col("ss") / F.col("n"))
    scale = spread * F.sqrt((F.col("n") / size - 1.0) / (F.col("n") - 1))
    z = F.when(scale > 0, F.try_divide(star, scale)).otherwise(0.0)
    counted = conditional_counts(lag, layers, perms, seed)
    if counted is None:
        sims = simulated(lag, layers, "z", perms, seed)
        sim_star = (F.col("z") + F.col("_sim_sum")) / size
        counted = sims.groupBy(*layers, "id").agg(
            F.count_if(sim_star >= star - spread * TIE).alias("_larger"), F.count(F.lit(1)).alias("_perms")
        )
    else:
        counted = counted.join(lag.select(*layers, "id", "k"), [*layers, "id"]).select(*layers, "id", F.when(F.col("k") > 0, F.col("_plain")).alias("_larger"), "_perms")
    joined = lag.join(counted, [*layers, "id"], "left").select(
        *layers, "id", "k", z.alias("gistar_z"), folded_p(F.col("_larger"), F.col("_perms")).alias("gistar_p")
    )
    tested = T.benjamini_hochberg(joined, layers, "gistar_p", "gistar_p_fdr")
    label = (
        F.when(F.col("k") == 0, ISOLATE).when(F.col("gistar_p_fdr") >= alpha, NOT_SIGNIFICANT)
        .when(F.col("gistar_z") > 0, "Hot-Spot").otherwise("Cold-Spot")
    )
    return tested.withColumn("gistar_cluster", label)


def discriminant_layers(values: DataFrame) -> DataFrame:
    """(layer, id, y) for composite, reference and residual; ``values`` is (id, composite, g)."""
    both = cut_lineage(values.where(F.col("composite").isNotNull() & F.col("g").isNotNull()))
    fitted = T.residuals(both, [], "composite", "g")
    parts = (("composite", "composite"), ("reference", "g"), ("residual", "residual"))
    rows = F.array(*[F.struct(F.lit(name).alias("layer"), F.col(column).alias("y")) for name, column in parts])
    return cut_lineage(fitted.select("id", F.inline(rows)))


def discriminant_moran(layers: DataFrame, edges: DataFrame) -> DataFrame:
    """Global I per layer with its share of the composite's."""
    base = cut_lineage(centred(layers, ["layer"]))
    overall = cut_lineage(moran(lagged(base, kept_edges(edges, base, ["layer"]), ["layer"]), ["layer"]))
    whole = overall.where(F.col("layer") == "composite").select("moran_i").scalar()
    return overall.withColumn("retained", F.try_divide(F.col("moran_i"), whole))


def discriminant_sets(layers: DataFrame, edges: DataFrame, perms: int, seed: int) -> DataFrame:
    """Membership of every unit in the High-High sets of the three layers."""
    local = local_moran(layers, edges, ["layer"], perms, seed)
    member = lambda name: F.max((F.col("layer") == name) & (F.col("cluster_fdr") == "High-High"))
    return local.groupBy("id").agg(
        member("composite").alias("in_composite"), member("reference").alias("in_reference"), member("residual").alias("in_residual")
    )
