"""Published tables: scores, domains, indicators, divergence, surfaces, overlays, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compindex.functions import labels as B
from compindex.functions import scaling as S
from compindex.operators import compose as C
from compindex.operators import order as O
from compindex.operators import ranking as R
from compindex.operators import scale as N
from compindex.operators import stats as T
from compindex.session import cut_lineage


def scores_table(composites: DataFrame, domains: DataFrame, bands: DataFrame, digits: int = 4) -> DataFrame:
    """Composite, phases, rank on the rounded score, flag lists, bands and badge per key."""
    rollup = C.flag_rollup(domains)
    shown = composites.select("key", *[F.round(c, digits).alias(c) for c in composites.columns if c != "key"])
    shown = cut_lineage(shown)
    ranks = R.rank_rounded(shown, "composite", ["key"], digits).select("key", "rank")
    out = shown.join(ranks, "key", "left").join(rollup, "key", "left").join(bands, "key", "left")
    scored = F.col("composite").isNotNull()
    return out.withColumn("scored", scored).withColumn(
        "low_confidence", F.when(scored, B.low_confidence(F.col("domains_not_scored")))
    )


def domains_table(
    signals: DataFrame, modeled: DataFrame, crosswalk: DataFrame, design: list[tuple], keys: DataFrame
) -> DataFrame:
    """Domain scores where modeled inputs are fenced: their interval follows from swapping the
    modeled value for its bounds, and the domain is always of low confidence.

    ``modeled`` is (key, tbl, col, value, lo, hi); it fills missing signals only.
    """
    known = signals.where(F.col("value").isNotNull())
    fenced = cut_lineage(modeled.join(known.select("key", "tbl", "col"), ["key", "tbl", "col"], "left_anti"))
    filled = known.select("key", "tbl", "col", "value").unionByName(fenced.select("key", "tbl", "col", "value"))
    domains = C.domain_scores(filled, design, keys)
    below, above = F.sum(F.col("value") - F.col("lo")), F.sum(F.col("hi") - F.col("value"))
    spans = fenced.join(crosswalk.select("tbl", "col", "domain"), ["tbl", "col"]).groupBy("key", "domain").agg(
        F.count(F.lit(1)).alias("modeled_n"), below.alias("_below"), above.alias("_above")
    )
    out = domains.join(spans, ["key", "domain"], "left")
    inside = F.col("modeled_n").isNotNull() & F.col("scored")
    return out.select(
        "key", "domain", "phase", "n_present", "scored", "score",
        (F.coalesce(F.col("coverage_flag").isin("low_confidence", "insufficient_data"), F.lit(False)) | inside).alias("low_conf"),
        inside.alias("modeled_input"),
        F.when(inside, F.col("score") - F.col("_below") / F.col("n_present")).alias("interval_lo"),
        F.when(inside, F.col("score") + F.col("_above") / F.col("n_present")).alias("interval_hi"),
    )


def indicators_table(
    signals: DataFrame, crosswalk: DataFrame, ramped: list[tuple[str, str]], overrides: DataFrame | None = None, modeled: DataFrame | None = None
) -> DataFrame:
    """As-entered values with their positional number; ramped signals pass the materiality ramp.

    ``overrides`` (key, tbl, col, value) replace what was observed and are entered as they are. ``modeled`` (key, tbl, col, value, lo, hi)
    fill what is neither observed nor overridden; they are marked, carry their interval and pass no ramp.
    """
    slot = ["key", "tbl", "col"]
    signals = signals.where(F.col("value").isNotNull()).select(*slot, "value", F.lit(0).alias("_rank"))
    for extra, rank in ((overrides, 1), (modeled, 2)):
        if extra is not None:
            ends = [(F.col(c) if rank == 2 else F.lit(None).cast("double")).alias(c) for c in ("lo", "hi")]
            signals = signals.unionByName(extra.select(*slot, "value", *ends, F.lit(rank).alias("_rank")), allowMissingColumns=True)
    if overrides is not None or modeled is not None:
        signals = signals if "lo" in signals.columns else signals.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
        first = F.when(F.col("_rank") == 1, 0).when(F.col("_rank") == 0, 1).otherwise(2)
        best = F.min_by(F.struct("value", "lo", "hi", "_rank"), first).alias("_b")
        signals = signals.groupBy(*slot).agg(best).select(*slot, "_b.*")
    else:
        signals = signals.withColumns({"lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double")})
    numbered = R.positional_numbers(crosswalk, "phase", "domain_pos", "pos")
    hit = F.lit(False)
    for tbl, col in ramped:
        hit = hit | ((F.col("tbl") == tbl) & (F.col("col") == col))
    entered = F.when(hit & (F.col("_rank") == 0), S.materiality_ramp(F.col("value"))).otherwise(F.col("value"))
    return signals.join(numbered, ["tbl", "col"]).select(
        "key", "number", "domain", "tbl", "col", entered.alias("value"), (F.col("_rank") == 1).alias("overridden"), (F.col("_rank") == 2).alias("modeled"), "lo", "hi"
    )


def modeled_list(indicators: DataFrame) -> DataFrame:
    """The fenced estimates of an indicator table with their intervals, each indicator of a key once."""
    return indicators.where("modeled").select("key", "tbl", "col", "value", "lo", "hi").distinct()


def divergence_table(units: DataFrame, ranked: DataFrame, universe_size: Column, share: float = 0.9, events: DataFrame | None = None) -> DataFrame:
    """Worst unit of each group against the group's own standing.

    ``units`` is (group, unit, risk); ``ranked`` is (group, rank) of the scored groups.
    Percentiles run over the scored groups, the quartile cut over the whole universe. ``events`` (group, hot) adds the number of
    significant events and whether the group occurs among them at all.
    """
    units = cut_lineage(units.where(F.col("risk").isNotNull()))
    profile = T.group_profile(units, ["group"], "risk")
    # the smallest unit id among the worst, whatever its type
    first = F.min(F.struct((-F.col("risk")).alias("down"), "unit", "risk")).alias("_w")
    worst = units.groupBy("group").agg(first).select("group", F.col("_w.unit").alias("worst_unit"), F.col("_w.risk").alias("worst_risk"))
    steps = cut_lineage(O.ladder(units, [], "risk"))
    ecdf = steps.select(F.col("risk").alias("worst_risk"), O.cume_share(F.col("below"), F.col("n"), F.col("total")).alias("corridor_pctile"))
    cut = O.quantiles(units, [], "risk", {"cut": share}).scalar()
    n_scored = ranked.agg(F.count("rank")).scalar()
    out = profile.join(worst, "group").join(ecdf, "worst_risk").join(ranked, "group", "left")
    out = O.share_at(out, steps.withColumnRenamed("risk", "p90"), [], "p90", "p90_pctile")
    if events is not None:
        out = event_marks(out, events, "group")
    marks = ["n_hot", "in_layer"] if events is not None else []
    national = R.percentile_from_rank(F.col("rank"), n_scored)
    top = F.col("worst_risk") >= cut
    return out.select(
        "group", "rank", F.when(F.col("rank").isNotNull(), national).alias("national_pctile"), F.col("n").alias("n_units"),
        F.col("mean").alias("risk_mean"), F.col("p90").alias("risk_p90"), "p90_pctile", "worst_unit", "worst_risk", "corridor_pctile",
        (F.col("corridor_pctile") - F.when(F.col("rank").isNotNull(), national)).alias("divergence"), F.col("range").alias("within_range"),
        top.alias("top_decile"), F.coalesce(top & (F.col("rank") > universe_size * 0.25), F.lit(False)).alias("headline"), *marks,
    )


def event_marks(groups: DataFrame, events: DataFrame, group: str) -> DataFrame:
    """Significant events per group beside whether the group occurs in the layer at all."""
    counts = events.groupBy(group).agg(F.count_if(F.col("hot").isin("99%", "95%")).alias("n_hot"))
    return groups.join(counts, group, "left").select(
        *groups.columns, F.coalesce("n_hot", F.lit(0)).alias("n_hot"), F.col("n_hot").isNotNull().alias("in_layer")
    )


def surface(units: DataFrame, parts: list[str], events: str, w_index: float = 0.70, w_shock: float = 0.30) -> DataFrame:
    """Index of the present signals (two at least), log shock index and their weighted surface."""
    values = [F.col(p) for p in parts]
    index = F.when(S.present_count(values) >= 2, S.present_mean(values))
    shocked = units.withColumn("_n", F.coalesce(F.col(events), F.lit(0)))
    shocked = N.log_index(cut_lineage(shocked), "_n", "shock_index").drop("_n")
    out = shocked.withColumn("n_signals", S.present_count(values)).withColumn("index", index)
    return out.withColumn("risk", S.weighted_pair(F.col("index"), F.col("shock_index"), w_index, w_shock))


# Weight sets of the layer-combination sweep.
WEIGHT_SETS = ((1.0, 0.0), (0.85, 0.15), (0.70, 0.30), (0.50, 0.50), (0.30, 0.70))


def surface_sweep(units: DataFrame, group: str) -> DataFrame:
    """Worst unit per group under every weight set, all sets in one pass."""
    rows = F.array(*[F.struct(F.lit(a).alias("w_index"), F.lit(b).alias("w_shock")) for a, b in WEIGHT_SETS])
    wide = units.where(F.col("index").isNotNull()).select(group, "index", "shock_index", F.inline(rows))
    risk = S.weighted_pair(F.col("index"), F.col("shock_index"), F.col("w_index"), F.col("w_shock"))
    return wide.groupBy(group, "w_index", "w_shock").agg(F.max(risk).alias("worst"))


def surface_sweep_agreement(sweep: DataFrame, group: str, base: tuple[float, float] = (0.70, 0.30)) -> DataFrame:
    """Rank correlation of the groups' worst units under each weight set with the base set."""
    sweep = cut_lineage(sweep)
    start = sweep.where((F.col("w_index") == base[0]) & (F.col("w_shock") == base[1])).select(group, F.col("worst").alias("_base"))
    return T.spearman(sweep.join(start, group), ["w_index", "w_shock"], "worst", "_base", least=2)


def spread_table(units: DataFrame, group_scores: DataFrame) -> DataFrame:
    """Within-group spread, group tier, and the hidden-risk mark (mid tier, p90 in the top quarter of units)."""
    units = cut_lineage(units.where(F.col("risk").isNotNull()))
    group_scores = cut_lineage(group_scores)
    profile = T.group_profile(units, ["group"], "risk")
    cuts = O.quantiles(group_scores, [], "score", {"lo": 0.33, "hi": 0.66}).select(F.struct("lo", "hi")).scalar()
    high = O.quantiles(units, [], "risk", {"cut": 0.75}).scalar()
    out = profile.join(group_scores, "group", "left").withColumn("tier", B.tercile(F.col("score"), cuts["lo"], cuts["hi"]))
    return out.withColumn("hidden", F.coalesce((F.col("tier") == "mid") & (F.col("p90") >= high), F.lit(False)))


def corridors(units: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` highest-risk units."""
    return units.where(F.col("risk").isNotNull()).orderBy(F.col("risk").desc(), "unit").limit(k)


def lens_table(domains: DataFrame, first: str, second: str, label_k: int = 12) -> DataFrame:
    """Mean of two lens domains (or the single one), its reading, and a label for the largest."""
    pick = lambda d: F.max(F.when((F.col("domain") == d) & F.col("scored"), F.col("score")))
    both = domains.groupBy("key").agg(pick(first).alias("first"), pick(second).alias("second"))
    lens = S.blend(F.col("first"), F.col("second"))
    rows = cut_lineage(both.withColumn("lens", lens).where(F.col("lens").isNotNull()))
    top = rows.orderBy(F.col("lens").desc(), "key").limit(label_k).select("key", F.lit(True).alias("_top"))
    out = rows.join(top, "key", "left")
    return out.select(
        "key", "first", "second", "lens", B.lens_class(F.col("first"), F.col("second")).alias("reading"),
        F.coalesce("_top", F.lit(False)).alias("labelled"),
    )


def overlay_corridors(scores: DataFrame, outbound: DataFrame, inbound: DataFrame, centres: DataFrame, ratios: DataFrame) -> DataFrame:
    """Corridor rows: two signals, role, composite, group centre and outflow ratio."""
    out = scores
    for extra in (outbound, inbound, centres, ratios):
        out = out.join(extra, "key", "left")
    return out.withColumn("role", B.corridor_role(F.col("outbound"), F.col("inbound")))


def ratio_of(amounts: DataFrame, bases: DataFrame, key: str = "key") -> DataFrame:
    """Amount over a non-zero base, over shared keys."""
    both = amounts.join(bases, key)
    return both.where(F.col("base") != 0).select(key, F.try_divide(F.col("amount"), F.col("base")).alias("ratio"))


def registry_document(
    crosswalk: DataFrame, register: DataFrame, labels: DataFrame, aliases: DataFrame | None = None, circular: DataFrame | None = None, defeaters: tuple[str, ...] = ()
) -> DataFrame:
    """phase > domain > indicator rows with provenance and role; a missing register row gets a note.

    ``register`` is (tbl, register_key, source, year_max); ``aliases`` (col, register_key) names the columns that the register keeps under
    another key. Signals in ``circular`` (domain, tbl, col) are flagged, those of the domains ``defeaters`` only attenuate, all others generate.
    """
    keyed = crosswalk if aliases is None else crosswalk.join(aliases, "col", "left")
    key = F.col("col") if aliases is None else F.coalesce("register_key", "col")
    keyed = keyed.withColumn("register_key", key)
    if circular is not None:
        keyed = keyed.join(circular.select("domain", "tbl", "col", F.lit(True).alias("_circular")).distinct(), ["domain", "tbl", "col"], "left")
    else:
        keyed = keyed.withColumn("_circular", F.lit(False))
    role = F.when(F.col("_circular"), "circular-flagged").when(F.col("domain").isin(*defeaters), "defeater").otherwise("generating")
    joined = keyed.withColumn("role", role).join(register, ["tbl", "register_key"], "left").join(labels, "domain", "left")
    note = F.when(F.col("source").isNull(), F.lit("no register row"))
    item = F.struct(
        "pos", F.concat_ws(".", "tbl", "col").alias("indicator"), "register_key", "role", F.col("source"), F.col("year_max"), note.alias("note")
    )
    domains = joined.groupBy("phase", "domain", F.coalesce("label", F.col("domain")).alias("label")).agg(
        F.array_sort(F.collect_list(item)).alias("indicators")
    )
    entry = F.struct("domain", "label", "indicators")
    return domains.groupBy("phase").agg(F.array_sort(F.collect_list(entry)).alias("domains"))
