"""Rank bands, noise stability, scenarios and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from compindex.config import values_sql
from compindex.functions import noise as Z
from compindex.operators import compose as C
from compindex.operators import ranking as R
from compindex.operators import scenario as P
from compindex.operators import spatial as G
from compindex.operators import stats as T
from compindex.operators import uncertainty as U
from compindex.session import cut_lineage
from compindex.workload import fixtures as X
from compindex.workload.core import r8
from compindex.workload.registry import query
from compindex.workload.spatial import family_ctes

DRAWS = U.DRAWS
OFFSET = U.SEED % 1000


def field(spark, sf):
    """Scored keys with phases and the number of unscored domains."""
    domains = cut_lineage(X.domain_scores(spark, sf))
    rollup = C.flag_rollup(domains).select("key", "domains_not_scored", "domains_low_conf")
    scores = C.composite(C.phase_scores(domains, X.TOTALS).where("in_composite"), list(X.PHASES))
    return scores.where(F.col("composite").isNotNull()).join(rollup, "key")


_FIELD = {
    "fld": "SELECT s.key, s.R, s.E, s.composite, d.ns, d.lc FROM scored s JOIN (SELECT key, count(*) FILTER (WHERE NOT scored) AS ns, "
           "count(*) FILTER (WHERE scored AND coverage_flag IN ('low_confidence', 'insufficient_data')) AS lc FROM dom WHERE in_composite GROUP BY key) d USING (key)",
}
_SD = "CASE WHEN ns >= 2 THEN 0.07 ELSE 0.04 END"
_TIER = "CASE WHEN {0} >= 0.402 THEN 'high' WHEN {0} >= 0.281 THEN 'mid' ELSE 'low' END"
def _draw_ctes(field_sql, number):
    """The simulation as CTEs; ``number`` is the integer that a key's noise runs on."""
    return {
        **field_sql,
        "base": "SELECT *, sqrt(R * E) AS c0, row_number() OVER (ORDER BY sqrt(R * E) DESC, key) AS base_rank FROM fld",
        "draws": f"SELECT key, draw, base_rank, c0, pow(least(1.0, greatest(1e-4, R + {_SD} * {Z.normal_sql('draw', number, OFFSET)})), w) * "
                 f"pow(least(1.0, greatest(1e-4, E + {_SD} * {Z.normal_sql('draw', number, OFFSET + 2)})), 1 - w) AS sim FROM "
                 f"(SELECT *, CAST(0.4 AS DOUBLE) + CAST(0.2 AS DOUBLE) * {Z.uniform_sql('draw', '0', OFFSET + 4)} AS w FROM base, (SELECT unnest(range(1, {DRAWS + 1})) AS draw))",
        "ranks": f"SELECT key, draw, base_rank, row_number() OVER (PARTITION BY draw ORDER BY sim DESC, key) AS rank, {_TIER.format('sim')} = {_TIER.format('c0')} AS in_tier FROM draws",
        "bands": "SELECT key, greatest(1, CAST(round_even(quantile_cont(rank, 0.05), 0) AS INTEGER)) AS rank_p5, CAST(round_even(quantile_cont(rank, 0.5), 0) AS INTEGER) AS rank_p50, "
                 "CAST(round_even(quantile_cont(rank, 0.95), 0) AS INTEGER) AS rank_p95, avg(in_tier::INT) AS tier_stability, quantile_cont(rank, 0.95) - quantile_cont(rank, 0.05) AS band_width FROM ranks GROUP BY key",
    }


_MC = _draw_ctes(_FIELD, "key")


@query("mc_rank_bands", X.sql("scored dom", "SELECT key, rank_p5, rank_p50, rank_p95, round(tier_stability, 6) AS tier_stability FROM bands", _MC))
def mc_rank_bands(spark, sf):
    out = U.rank_bands(U.simulated(field(spark, sf), DRAWS).histogram)
    return out.select("key", "rank_p5", "rank_p50", "rank_p95", F.round("tier_stability", 6).alias("tier_stability"))


_NAMED = {"fld": _FIELD["fld"].replace("SELECT s.key,", "SELECT c_name AS key,").replace("FROM scored s", "FROM scored s JOIN customer ON c_custkey = s.key").replace(") d USING (key)", ") d ON d.key = s.key")}


@query(
    "mc_rank_bands_named",
    X.sql("scored dom", "SELECT key, rank_p5, rank_p50, rank_p95, round(tier_stability, 6) AS tier_stability FROM bands", _draw_ctes(_NAMED, Z.text_number_sql("key"))),
)
def mc_rank_bands_named(spark, sf):
    """The same with customer names as keys."""
    names = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_name")
    named = field(spark, sf).join(names, "key").drop("key").withColumnRenamed("c_name", "key")
    out = U.rank_bands(U.simulated(named, DRAWS).histogram)
    return out.select("key", "rank_p5", "rank_p50", "rank_p95", F.round("tier_stability", 6).alias("tier_stability"))


@query(
    "mc_summary",
    X.sql("scored dom", """SELECT (SELECT max(n) FROM d) AS n, (SELECT count(*) FROM d) AS draws, (SELECT round(quantile_cont(rho, 0.5), 6) FROM d) AS rho_median,
      (SELECT round(quantile_cont(rho, 0.05), 6) FROM d) AS rho_p5, (SELECT round(avg(kept), 6) FROM d WHERE draw % 20 = 1) AS top_retention, (SELECT round(avg(kept_decile), 6) FROM d WHERE draw % 20 = 1) AS top_decile_retention,
      (SELECT round(quantile_cont(band_width, 0.5), 6) FROM bands) AS median_band_width, (SELECT round(avg(tier_stability), 6) FROM bands) AS tier_stability_mean,
      (SELECT round(avg((band_width <= 10)::INT), 6) FROM bands) AS share_within_10""",
      {**_MC, "d": "SELECT draw, count(*) AS n, corr(rank, base_rank) AS rho, count(*) FILTER (WHERE rank <= 10 AND base_rank <= 10) / 10.0 AS kept, "
      "count(*) FILTER (WHERE rank <= k AND base_rank <= k) / CAST(k AS DOUBLE) AS kept_decile FROM ranks, (SELECT greatest(1, CAST(round_even(count(*) / 10.0, 0) AS INTEGER)) AS k FROM base) GROUP BY draw, k"}),
)
def mc_summary(spark, sf):
    found = U.simulated(field(spark, sf), DRAWS)
    out = U.simulation_summary(found.agreement, U.rank_bands(found.histogram))
    rounded = ("rho_median", "rho_p5", "top_retention", "top_decile_retention", "median_band_width", "tier_stability_mean", "share_within_10")
    return out.select("n", "draws", *[F.round(c, 6).alias(c) for c in rounded])


# Draws, size of either end and stream of the noise test.
_NOISE_DRAWS, _TOP, _NOISE_SEED = 4000, 10, 7


def _noise_sql(levels, growth):
    rows = ", ".join(f"(CAST({v} AS DOUBLE))" for v in levels)
    return X.sql("scored dom", f"""SELECT w.level, round(top_retention, 6) AS top_retention, round(bottom_retention, 6) AS bottom_retention, round(mean_width, 6) AS mean_width,
        round(median_width, 6) AS median_width FROM (SELECT level, avg(width) AS mean_width, quantile_cont(width, 0.5) AS median_width FROM (SELECT level, key,
          quantile_cont(rank, 0.975) - quantile_cont(rank, 0.025) AS width FROM r GROUP BY 1, 2) GROUP BY 1) w
        JOIN (SELECT level, count(*) FILTER (WHERE place <= {_TOP} AND base_rank <= {_TOP}) / {_TOP * _NOISE_DRAWS}.0 AS top_retention,
          count(*) FILTER (WHERE place > n - {_TOP} AND base_rank > n - {_TOP}) / {_TOP * _NOISE_DRAWS}.0 AS bottom_retention FROM r GROUP BY 1) k USING (level)""",
        {**_FIELD,
         "b": "SELECT *, count(*) OVER () AS n, row_number() OVER (ORDER BY composite DESC, key DESC) AS base_rank FROM fld",
         "s": f"SELECT key, n, base_rank, level, draw, least(1.0, greatest(0.0, composite + level * ({growth}) * {Z.normal_sql('draw', 'key', _NOISE_SEED)})) AS sim "
              f"FROM b, (VALUES {rows}) AS l(level), (SELECT unnest(range(1, {_NOISE_DRAWS + 1})) AS draw)",
         "p": "SELECT *, row_number() OVER (PARTITION BY level, draw ORDER BY sim DESC, key DESC) AS place FROM s",
         "r": "SELECT *, avg(place) OVER (PARTITION BY level, draw, sim) AS rank FROM p"})


def _stability(spark, sf, levels, flags):
    out = U.noise_stability(field(spark, sf), levels, _NOISE_DRAWS, _TOP, _NOISE_SEED, flags)
    return out.select("level", *[F.round(c, 6).alias(c) for c in ("top_retention", "bottom_retention", "mean_width", "median_width")])


@query("noise_stability", _noise_sql([0.02, 0.04], "1.0"))
def noise_stability(spark, sf):
    return _stability(spark, sf, [0.02, 0.04], None)


@query("noise_stability_by_flags", _noise_sql([0.01, 0.02, 0.03], "1.0 + 0.5 * lc"))
def noise_stability_by_flags(spark, sf):
    return _stability(spark, sf, [0.01, 0.02, 0.03], "domains_low_conf")


# --- scenarios -------------------------------------------------------------------------

# Operator and weight alternatives of the sensitivity table.
_ALTERNATIVES = [("arithmetic", "arithmetic", 0.5), ("tilt_first", "geometric", 0.4), ("tilt_second", "geometric", 0.6)]
_ALT_CTE = {
    "alt": "SELECT * FROM " + values_sql(_ALTERNATIVES, ["scenario", "operator", "w"]),
    "x": "SELECT s.key, a.scenario, round(sqrt(R * E), 9) AS base, round(CASE WHEN operator = 'arithmetic' THEN (1 - w) * R + w * E ELSE pow(greatest(R, 1e-6), 1 - w) * pow(greatest(E, 1e-6), w) END, 9) AS alt "
         "FROM scored s, alt a",
    "xr": "SELECT *, row_number() OVER (PARTITION BY scenario ORDER BY base DESC, key) AS ra, row_number() OVER (PARTITION BY scenario ORDER BY alt DESC, key) AS rb FROM x",
}


@query(
    "operator_sensitivity",
    X.sql("scored", """SELECT c.scenario, n, round(tau, 8) AS tau_b, round(churn, 8) AS churn FROM
      (SELECT scenario, count(*) AS n, count(*) FILTER (WHERE ra <= 48 AND rb > 48) / 48.0 AS churn FROM xr GROUP BY 1) c JOIN
      (SELECT a.scenario, sum(sign(a.base - b.base) * sign(a.alt - b.alt)) / sqrt(CAST(sum((a.base <> b.base)::INT) AS DOUBLE) * sum((a.alt <> b.alt)::INT)) AS tau
       FROM x a JOIN x b ON a.scenario = b.scenario AND a.key < b.key GROUP BY 1) t USING (scenario)""", _ALT_CTE),
)
def operator_sensitivity(spark, sf):
    rows = F.array(*[F.struct(F.lit(s).alias("scenario"), F.lit(o).alias("operator"), F.lit(w).alias("w")) for s, o, w in _ALTERNATIVES])
    wide = X.scored(spark, sf).select("key", "R", "E", F.inline(rows))
    scores = wide.select(
        "key", "scenario", F.round(F.sqrt(F.col("R") * F.col("E")), 9).alias("base"),
        F.round(P.combined(F.col("R"), F.col("E"), F.col("w"), F.col("operator")), 9).alias("alt"),
    )
    out = P.agreement(scores, ["scenario"], "base", "alt", "key", 48)
    return out.select("scenario", "n", r8("tau_b"), r8("churn"))


@query(
    "attenuation_stability",
    X.sql("dom ref comp", """SELECT (SELECT count(*) FROM x) AS n, round((SELECT (count(*) FILTER (WHERE s > 0) - count(*) FILTER (WHERE s < 0)) / (count(*) FILTER (WHERE s > 0) + count(*) FILTER (WHERE s < 0))
        FROM (SELECT sign(a.con - b.con) * sign(a.coff - b.coff) AS s FROM x a JOIN x b ON a.key < b.key)), 8) AS gamma,
      round((SELECT count(*) FILTER (WHERE (ra <= 48) <> (rb <= 48)) / 96.0 FROM (SELECT row_number() OVER (ORDER BY con DESC, key) AS ra, row_number() OVER (ORDER BY coff DESC, key) AS rb FROM x)), 8) AS churn_symmetric""",
      {"att": "SELECT d.key, d.phase, d.score * CASE WHEN g IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, g)) END AS score FROM dom d LEFT JOIN ref ON ref.key = d.key WHERE d.in_composite",
       "ph": "SELECT key, phase, CASE WHEN count(score) >= 2 AND count(score) >= 0.5 * count(*) THEN avg(score) END AS score FROM att GROUP BY 1, 2",
       "c": "SELECT key, sqrt(max(score) FILTER (WHERE phase = 'R') * max(score) FILTER (WHERE phase = 'E')) AS composite FROM ph GROUP BY key",
       "x": "SELECT key, round(c.composite, 9) AS con, round(comp.composite, 9) AS coff FROM c JOIN comp USING (key) WHERE c.composite IS NOT NULL AND comp.composite IS NOT NULL"}),
)
def attenuation_stability(spark, sf):
    """Build with and without the attenuator: concordance and top-set churn."""
    domains = cut_lineage(X.domain_scores(spark, sf))
    build = lambda d, n: C.composite(C.phase_scores(d, X.TOTALS).where("in_composite"), list(X.PHASES)).select("key", F.round("composite", 9).alias(n))
    on = build(C.attenuate(domains, X.modulator(spark, sf)), "con")
    both = on.join(build(domains, "coff"), "key")
    return P.agreement(both, [], "con", "coff", "key", 48).select("n", r8("gamma"), r8("churn_symmetric"))


# Scenarios of the what-if table.
_SCENARIOS = [
    {"scenario": "published", "operator": "geometric", "weight": 0.5},
    {"scenario": "arithmetic", "operator": "arithmetic", "weight": 0.5},
    {"scenario": "second_60", "operator": "geometric", "weight": 0.6},
    {"scenario": "stripped", "operator": "geometric", "weight": 0.5, "shrink": True},
    {"scenario": "focus", "operator": "geometric", "weight": 0.5, "use_focus": True},
]
_FOCUS, _OVERRIDES, _R2 = 5, {"view_day": 0.9, "error_day": 0.8}, 0.36


@query(
    "scenario_rescore",
    X.sql("scored dom", f"""SELECT key, scenario, round(base, 8) AS base, round(score, 8) AS score, base_rank, row_number() OVER (PARTITION BY scenario ORDER BY round(score, 9) DESC, base_rank) AS rank,
        round(score - base, 8) AS delta FROM (SELECT *, CASE WHEN shrink THEN greatest(0.0, m + (raw - m) * sqrt(CAST(1 - {_R2} AS DOUBLE))) ELSE raw END AS score FROM
          (SELECT *, avg(raw) OVER (PARTITION BY scenario) AS m FROM (SELECT key, composite AS base, base_rank, scenario, shrink, CASE WHEN operator = 'arithmetic' THEN (1 - w) * R + w * E
            ELSE pow(greatest(R, 1e-6), 1 - w) * pow(greatest(E, 1e-6), w) END AS raw FROM (SELECT b.key, b.composite, b.base_rank, s.*, CASE WHEN use_focus AND f.fr IS NOT NULL AND f.fe IS NOT NULL THEN fr ELSE R END AS R,
            CASE WHEN use_focus AND f.fr IS NOT NULL AND f.fe IS NOT NULL THEN fe ELSE E END AS E FROM b CROSS JOIN s LEFT JOIN f ON f.key = b.key))))""",
      {"b": "SELECT *, row_number() OVER (ORDER BY composite DESC, key) AS base_rank FROM scored",
       "s": "SELECT * FROM " + values_sql([(s["scenario"], s["operator"], s["weight"], s.get("shrink", False), s.get("use_focus", False)) for s in _SCENARIOS], ["scenario", "operator", "w", "shrink", "use_focus"]),
       "f": f"SELECT key, avg(v) FILTER (WHERE phase = 'R') AS fr, avg(v) FILTER (WHERE phase = 'E') AS fe FROM (SELECT key, phase, CASE domain WHEN 'view_day' THEN 0.9 WHEN 'error_day' THEN 0.8 ELSE score END AS v "
            f"FROM dom WHERE key = {_FOCUS} AND scored) GROUP BY key"}),
)
def scenario_rescore(spark, sf):
    domains = cut_lineage(X.domain_scores(spark, sf))
    base = C.composite(C.phase_scores(domains, X.TOTALS).where("in_composite"), list(X.PHASES))
    ranked = R.rank_scored(base, "composite", ["key"])
    out = P.rescore(ranked, _SCENARIOS, P.focus_phases(domains, _FOCUS, _OVERRIDES), _R2)
    return out.select("key", "scenario", r8("base"), r8("score"), "base_rank", "rank", r8("delta"))


@query(
    "verdicts",
    X.sql("scored ref pts", f"""SELECT CASE WHEN r2 > 0.9 THEN 'FAIL' WHEN r2 > 0.8 THEN 'CONDITIONAL' ELSE 'PASS' END AS discriminant, CASE WHEN re > 0.95 OR re < 0.2 THEN 'FAIL' ELSE 'PASS' END AS structure,
      CASE WHEN kept < 0.5 THEN 'FAIL' ELSE 'PASS' END AS uncertainty, inc AS incremental, CASE WHEN r2 > 0.9 OR re > 0.95 OR re < 0.2 THEN 'FAIL' WHEN r2 <= 0.8 AND inc = 'PASS' AND kept >= 0.5 THEN 'PASS' ELSE 'CONDITIONAL' END AS overall FROM
      (SELECT (SELECT corr(composite, g) * corr(composite, g) FROM scored JOIN ref USING (key)) AS r2, (SELECT corr(R, E) FROM scored) AS re,
        (SELECT count(*) FILTER (WHERE place <= {_TOP} AND base_rank <= {_TOP}) / {_TOP * _NOISE_DRAWS}.0 FROM p) AS kept,
        (SELECT CASE WHEN count(q) = 0 THEN 'NOT RUN' WHEN bool_or(rho > 0 AND q < 0.05) THEN 'PASS' ELSE 'NOT DEMONSTRATED' END FROM family) AS inc)""",
      {**family_ctes(
          "SELECT s.key, lon, lat, s.composite AS x, ref.g FROM scored s JOIN pts USING (key) LEFT JOIN ref USING (key)",
          "SELECT 'balance' AS target, c_custkey AS key, CAST(c_acctbal AS DOUBLE) AS y FROM customer UNION ALL SELECT 'orders', o_custkey, CAST(count(*) AS DOUBLE) FROM orders GROUP BY 2"),
       "b": "SELECT *, row_number() OVER (ORDER BY composite DESC, key DESC) AS base_rank FROM scored",
       "s": f"SELECT key, base_rank, draw, least(1.0, greatest(0.0, composite + CAST(0.02 AS DOUBLE) * {Z.normal_sql('draw', 'key', _NOISE_SEED)})) AS sim FROM b, (SELECT unnest(range(1, {_NOISE_DRAWS + 1})) AS draw)",
       "p": "SELECT *, row_number() OVER (PARTITION BY draw ORDER BY sim DESC, key DESC) AS place FROM s"}),
)
def verdicts(spark, sf):
    rows = cut_lineage(X.scored(spark, sf).join(X.modulator(spark, sf), "key", "left"))
    both = T.pearson(rows, [], "composite", "g").select((F.col("r") * F.col("r")).alias("r2")).scalar()
    stability = U.noise_stability(rows, [0.02], _NOISE_DRAWS, _TOP, _NOISE_SEED).select("top_retention").scalar()
    metrics = T.pearson(rows, [], "R", "E").select(
        both.alias("r2_reference"), F.col("r").alias("r_phases"), stability.alias("top_retention"),
        T.incremental(_verdict_family(spark, sf, rows), ["balance", "orders"]).scalar().alias("incremental"),
    )
    return P.verdicts(metrics)


def _verdict_family(spark, sf, rows):
    """Association of the composite, beyond its reference, with two attributes of the keys that it is not built from."""
    base = X.located(rows.select("key", F.col("composite").alias("x"), "g"))
    balance = X.table(spark, sf, "customer").select(F.lit("balance").alias("target"), F.col("c_custkey").alias("key"), F.col("c_acctbal").cast("double").alias("y"))
    orders = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).cast("double").alias("y"))
    return T.association_family(base, balance.unionByName(orders.select(F.lit("orders").alias("target"), "key", "y")), ["balance", "orders"], G.effective_sizes)
