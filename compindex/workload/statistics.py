"""Correlations, ranks, residuals, screens, arms and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from compindex.config import config_table, values_sql
from compindex.functions import labels as B
from compindex.operators import compose as C
from compindex.operators import latest as L
from compindex.operators import order as O
from compindex.operators import ranking as R
from compindex.operators import stats as T
from compindex.plans import arms as A
from compindex.session import cut_lineage
from compindex.workload import fixtures as X
from compindex.workload import sweep as W
from compindex.workload.core import r8
from compindex.workload.registry import query


def re_frame(spark, sf):
    """Scored keys with both phases, the composite and the reference column."""
    scored = X.scored(spark, sf)
    return scored.join(X.modulator(spark, sf), "key", "left")


# Halves are compared at nine digits: the last digits of a mean depend on the order of summation.
_HALVES = "SELECT key, round(R, 9) AS R, round(E, 9) AS E FROM scored"
_RANKED_RE = {
    "halves": _HALVES,
    "rk": "SELECT key, rank() OVER (ORDER BY R) + (count(*) OVER (PARTITION BY R) - 1) / 2.0 AS rx, "
          "rank() OVER (ORDER BY E) + (count(*) OVER (PARTITION BY E) - 1) / 2.0 AS ry FROM halves",
}
_PAIRS = """SELECT count(*) FILTER (WHERE s > 0) AS c, count(*) FILTER (WHERE s < 0) AS d FROM
  (SELECT sign(a.R - b.R) * sign(a.E - b.E) AS s FROM halves a JOIN halves b ON a.key < b.key)"""


def halves(spark, sf):
    return X.scored(spark, sf).select("key", F.round("R", 9).alias("R"), F.round("E", 9).alias("E"))


@query("pearson", X.sql("scored", "SELECT count(*) AS n, round(corr(R, E), 8) AS r, round(round(corr(R, E) * corr(R, E), 8), 3) AS r2 FROM scored"))
def pearson(spark, sf):
    return T.pearson(X.scored(spark, sf), [], "R", "E").select("n", r8("r"), "r2")


@query("average_rank", X.sql("lat", """SELECT key, series, rank() OVER (PARTITION BY series ORDER BY v)
   + (count(*) OVER (PARTITION BY series, v) - 1) / 2.0 AS rank FROM (SELECT *, round(value, 0) AS v FROM lat)"""))
def average_rank(spark, sf):
    latest = L.latest_value(X.observations(spark, sf), ["key", "series"]).withColumn("v", F.round("value", 0))
    return R.average_ranks(latest, ["series"], "v", "rank").select("key", "series", "rank")


@query("spearman", X.sql("scored", "SELECT count(*) AS n, round(corr(rx, ry), 8) AS rho FROM rk", _RANKED_RE))
def spearman(spark, sf):
    return T.spearman(halves(spark, sf), [], "R", "E").select("n", r8("rho"))


@query(
    "kendall_and_gamma",
    X.sql("scored", f"""SELECT (SELECT count(*) FROM scored) AS n, c AS concordant, d AS discordant,
      round((c - d) / (c + d), 8) AS gamma,
      round((c - d) / sqrt(CAST((SELECT count(*) FROM halves a JOIN halves b ON a.key < b.key AND a.R <> b.R) AS DOUBLE)
        * (SELECT count(*) FROM halves a JOIN halves b ON a.key < b.key AND a.E <> b.E)), 8) AS tau_b FROM ({_PAIRS})""", {"halves": _HALVES}),
)
def kendall_and_gamma(spark, sf):
    out = T.rank_agreement(halves(spark, sf), [], "R", "E", "key")
    return out.select("n", "concordant", "discordant", r8("gamma"), r8("tau_b"))


@query(
    "kendall_tied",
    X.sql("scored", """SELECT n, c AS concordant, d AS discordant, round((c - d) / sqrt((p - tx) * (p - ty)), 8) AS tau_b,
      round((c - d) / (c + d), 8) AS gamma
      FROM (SELECT count(*) FILTER (WHERE s > 0) AS c, count(*) FILTER (WHERE s < 0) AS d, count(*) AS p, sum((x0 = 0)::INT) AS tx,
        sum((y0 = 0)::INT) AS ty, (SELECT count(*) FROM t) AS n FROM (SELECT sign(a.x - b.x) * sign(a.y - b.y) AS s, a.x - b.x AS x0,
        a.y - b.y AS y0 FROM t a JOIN t b ON a.key < b.key))""",
        {"t": "SELECT key, round(R, 1) AS x, round(E, 1) AS y FROM scored"}),
)
def kendall_tied(spark, sf):
    rows = X.scored(spark, sf).select("key", F.round("R", 1).alias("x"), F.round("E", 1).alias("y"))
    out = T.rank_agreement(rows, [], "x", "y", "key")
    return out.select("n", "concordant", "discordant", r8("tau_b"), r8("gamma"))


@query(
    "ols_residual",
    X.sql("scored ref", """SELECT s.key, round(s.composite - ((SELECT regr_slope(composite, g) FROM scored JOIN ref USING (key)) * g
       + (SELECT regr_intercept(composite, g) FROM scored JOIN ref USING (key))), 8) AS residual FROM scored s LEFT JOIN ref USING (key)"""),
)
def ols_residual(spark, sf):
    return T.residuals(re_frame(spark, sf), [], "composite", "g").select("key", r8("residual"))


@query(
    "residual_sd",
    X.sql("scored ref", """SELECT count(*) AS n, round(stddev_pop(composite - (slope * g + icept)), 8) AS residual_sd
       FROM (SELECT *, (SELECT regr_slope(composite, g) FROM scored JOIN ref USING (key)) AS slope,
       (SELECT regr_intercept(composite, g) FROM scored JOIN ref USING (key)) AS icept FROM scored JOIN ref USING (key))"""),
)
def residual_sd(spark, sf):
    return T.residual_sd(re_frame(spark, sf), [], "composite", "g").select("n", r8("residual_sd"))


@query(
    "reference_screen",
    X.sql("sig ref", """SELECT tbl, col, n, CASE WHEN n >= 10 THEN round(round(r * r, 8), 3) END AS r2,
      coalesce(n >= 10 AND round(r * r, 3) >= 0.05, FALSE) AS flagged FROM (SELECT tbl, col, count(*) AS n, corr(value, g) AS r
      FROM sig JOIN ref USING (key) GROUP BY 1, 2)"""),
)
def reference_screen(spark, sf):
    """All signals against the reference in one job. The cut is a parameter; signals here are
    independent draws, so the published cut of .55 would flag the reference alone."""
    out = T.reference_screen(X.signals(spark, sf), X.modulator(spark, sf), ["tbl", "col"], "key", cut=0.05)
    return out.select("tbl", "col", "n", "r2", "flagged")


@query(
    "reference_blend",
    X.sql("sig uni", """SELECT u.key, round(CASE WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE (a + b) / 2 END, 8) AS g FROM uni u
      LEFT JOIN (SELECT key, max(value) FILTER (WHERE tbl = 'signup' AND col = 'h3') AS a,
        max(value) FILTER (WHERE tbl = 'error' AND col = 'h2') AS b FROM sig GROUP BY key) USING (key)"""),
)
def reference_blend(spark, sf):
    sig = X.signals(spark, sf)
    pick = lambda t, c, n: F.max(F.when((F.col("tbl") == t) & (F.col("col") == c), F.col("value"))).alias(n)
    wide = sig.groupBy("key").agg(pick("signup", "h3", "a"), pick("error", "h2", "b"))
    from compindex.functions.scaling import blend

    rows = X.universe(spark, sf).join(wide, "key", "left")
    return rows.select("key", F.round(blend(F.col("a"), F.col("b")), 8).alias("g"))


@query(
    "variance_split",
    X.sql("dom ref", """SELECT domain, n, round(v, 8) AS variance, round(r * r * v, 8) AS aligned, round((1 - r * r) * v, 8) AS orthogonal
      FROM (SELECT domain, count(*) AS n, var_pop(score) AS v, corr(score, g) AS r FROM dom JOIN ref USING (key)
      WHERE score IS NOT NULL GROUP BY domain) WHERE n >= 10"""),
)
def variance_split(spark, sf):
    joined = X.domain_scores(spark, sf).join(X.modulator(spark, sf), "key")
    out = T.variance_split(joined, ["domain"], "score", "g").where(F.col("n") >= 10)
    return out.select("domain", "n", r8("variance"), r8("aligned"), r8("orthogonal"))


@query(
    "eta_squared",
    """WITH t AS (SELECT c_acctbal AS v, c_nationkey AS g FROM customer), m AS (SELECT avg(v) AS grand FROM t)
    SELECT (SELECT count(*) FROM t) AS n, (SELECT count(DISTINCT g) FROM t) AS n_groups, round(b / w, 8) AS eta2, round(1 - b / w, 8) AS within_share
    FROM (SELECT (SELECT sum(k * (mv - grand) * (mv - grand)) FROM (SELECT g, count(*) AS k, avg(v) AS mv FROM t GROUP BY g), m) AS b,
                 (SELECT sum((v - grand) * (v - grand)) FROM t, m) AS w)""",
)
def eta_squared(spark, sf):
    rows = X.table(spark, sf, "customer").select(F.col("c_acctbal").alias("v"), F.col("c_nationkey").alias("g"))
    out = T.eta_squared(rows, [], "v", "g")
    return out.select("n", "n_groups", r8("eta2"), r8("within_share"))


_P = "CASE WHEN c_custkey % 11 <> 0 THEN ((c_custkey * 7919) % 1000 + 1) / CAST(1001 AS DOUBLE) END"
_BH = f"""WITH t AS (SELECT c_custkey AS key, c_mktsegment AS family, {_P} AS p FROM customer),
  r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, key) AS i, count(*) OVER (PARTITION BY family) AS n FROM t WHERE p IS NOT NULL),
  q AS (SELECT key, least(CAST(1 AS DOUBLE), min(p * n / i) OVER (PARTITION BY family ORDER BY i DESC ROWS UNBOUNDED PRECEDING)) AS q FROM r)
  SELECT t.key, t.family, round(q.q, 8) AS q FROM t LEFT JOIN q USING (key)"""


@query("bh_fdr", _BH)
def bh_fdr(spark, sf):
    key = F.col("c_custkey")
    p = F.when(key % 11 != 0, ((key * 7919) % 1000 + 1).cast("double") / F.lit(1001.0))
    rows = X.table(spark, sf, "customer").select(key.alias("key"), F.col("c_mktsegment").alias("family"), p.alias("p"))
    return T.benjamini_hochberg(rows, ["family"]).select("key", "family", r8("q"))


@query(
    "collinearity",
    X.sql("sig", """SELECT a, b, n, round(r, 8) AS r, CASE WHEN abs(r) >= 0.85 THEN 'merge' WHEN abs(r) >= 0.6 THEN 'review'
      WHEN r IS NOT NULL THEN 'keep' END AS screen FROM (SELECT x.s AS a, y.s AS b, count(*) AS n,
        CASE WHEN count(*) >= 10 THEN corr(x.value, y.value) END AS r FROM t x JOIN t y ON x.key = y.key AND x.s < y.s GROUP BY 1, 2)""",
        {"t": "SELECT key, tbl || '_' || col AS s, value FROM sig"}),
)
def collinearity(spark, sf):
    names = sorted(f"{t}_h{i}" for t in X.TYPES for i in range(X.SLOTS))
    rows = X.signals(spark, sf).select("key", F.concat_ws("_", "tbl", "col").alias("series"), "value")
    return T.collinearity(rows, names).select("a", "b", "n", r8("r"), "screen")


@query(
    "group_profile",
    """SELECT c_nationkey AS grp, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(quantile_cont(c_acctbal, 0.9), 6) AS p90,
      max(c_acctbal) AS max, min(c_acctbal) AS min, round(max(c_acctbal) - min(c_acctbal), 6) AS range FROM customer GROUP BY 1""",
)
def group_profile(spark, sf):
    rows = X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("v"))
    out = T.group_profile(rows, ["grp"], "v")
    rounded = [F.round(c, 6).alias(c) for c in ("mean", "p90", "range")]
    return out.select("grp", "n", "max", "min", *rounded)


@query(
    "worst_unit_per_group",
    """SELECT grp, key, v FROM (SELECT c_nationkey AS grp, c_custkey AS key, c_acctbal AS v, row_number() OVER
      (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rn FROM customer) WHERE rn = 1""",
)
def worst_unit_per_group(spark, sf):
    rows = X.table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("grp"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("v")
    )
    return L.pick_first(rows, ["grp"], [F.col("v"), -F.col("key")], ["key", "v"])


@query(
    "top_groups_by_mean",
    "SELECT c_nationkey AS grp, round(avg(c_acctbal), 6) AS mean FROM customer GROUP BY 1 ORDER BY avg(c_acctbal) DESC, grp LIMIT 4",
)
def top_groups_by_mean(spark, sf):
    means = X.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("grp")).agg(F.avg("c_acctbal").alias("mean"))
    top = means.orderBy(F.col("mean").desc(), "grp").limit(4)
    return top.select("grp", F.round("mean", 6).alias("mean"))


@query(
    "member_contrast",
    """SELECT c_mktsegment = 'BUILDING' AS member, round(quantile_cont(c_acctbal, 0.5), 6) AS median FROM customer GROUP BY 1""",
)
def member_contrast(spark, sf):
    rows = X.table(spark, sf, "customer").select((F.col("c_mktsegment") == "BUILDING").alias("member"), F.col("c_acctbal").alias("v"))
    return T.member_contrast(rows, "v", "member").select("member", F.round("median", 6).alias("median"))


@query(
    "member_percentile",
    """SELECT key, round(below / n, 8) AS pct FROM (SELECT c_custkey AS key, c_mktsegment AS seg, count(*) OVER () AS n,
      rank() OVER (ORDER BY c_acctbal) - 1 AS below FROM customer) WHERE seg = 'BUILDING'""",
)
def member_percentile(spark, sf):
    """Share of all values strictly below each listed member."""
    rows = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), "c_mktsegment", F.col("c_acctbal").alias("v"))
    out = O.with_standing(rows, [], "v").where(F.col("c_mktsegment") == "BUILDING")
    return out.select("key", F.round(F.col("below") / F.col("total"), 8).alias("pct"))


@query(
    "terciles",
    X.sql("scored", """SELECT key, CASE WHEN composite >= (SELECT quantile_cont(composite, 0.66) FROM scored) THEN 'high'
      WHEN composite <= (SELECT quantile_cont(composite, 0.33) FROM scored) THEN 'low' ELSE 'mid' END AS tier FROM scored"""),
)
def terciles(spark, sf):
    rows = cut_lineage(X.scored(spark, sf))
    cuts = O.quantiles(rows, [], "composite", {"lo": 0.33, "hi": 0.66}).select(F.struct("lo", "hi")).scalar()
    return rows.select("key", B.tercile(F.col("composite"), cuts["lo"], cuts["hi"]).alias("tier"))


@query(
    "ecdf_asof",
    """WITH g AS (SELECT o_custkey % 25 AS grp, avg(o_totalprice) / 20 AS asked FROM orders GROUP BY 1)
    SELECT CAST(grp AS BIGINT) AS grp, round((SELECT count(*) FILTER (WHERE c_acctbal <= asked) / count(*) FROM customer WHERE c_nationkey = grp), 8) AS share,
      round((SELECT count(*) FILTER (WHERE c_acctbal <= asked) / count(*) FROM customer), 8) AS share_of_all FROM g""",
)
def ecdf_asof(spark, sf):
    """Where values that do not occur in a population stand in it, by group and overall."""
    units = X.table(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("grp"), F.col("c_acctbal").alias("v"))
    asked = X.table(spark, sf, "orders").groupBy((F.col("o_custkey") % 25).cast("long").alias("grp")).agg((F.avg("o_totalprice") / 20).alias("v"))
    own = O.share_at(asked, O.ladder(units, ["grp"], "v"), ["grp"], "v", "share")
    both = O.share_at(own, O.ladder(units, [], "v"), [], "v", "share_of_all")
    return both.select("grp", r8("share"), r8("share_of_all"))


@query(
    "ecdf_position",
    """WITH g AS (SELECT c_nationkey AS grp, max(c_acctbal) AS worst FROM customer GROUP BY 1)
    SELECT grp, worst, round((SELECT count(*) FROM customer WHERE c_acctbal <= worst) / (SELECT count(*) FROM customer), 8) AS ecdf FROM g""",
)
def ecdf_position(spark, sf):
    """Where each group's worst unit sits in the whole unit population."""
    units = X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("grp"), F.col("c_acctbal").alias("v"))
    steps = O.ladder(units, [], "v").select(F.col("v").alias("worst"), O.cume_share(F.col("below"), F.col("n"), F.col("total")).alias("ecdf"))
    worst = units.groupBy("grp").agg(F.max("v").alias("worst"))
    return worst.join(steps, "worst").select("grp", "worst", r8("ecdf"))


# --- arms ------------------------------------------------------------------------------

_ARM_ROWS = [(a["arm"], float(a["weight"]), a["only_domain"], a["replace"]) for a in W.SWEEP]
_ARM_CTE = {
    "screen": "SELECT tbl, col FROM sig JOIN ref USING (key) GROUP BY 1, 2 HAVING count(*) >= 10 AND round(corr(value, g) * corr(value, g), 3) >= 0.05",
    "arms": "SELECT * FROM " + values_sql(_ARM_ROWS, ["arm", "weight", "only_domain", "replace"]),
    "kept": "SELECT domain, tbl, col FROM xw WHERE NOT (tbl = 'purchase' AND col = 'h1')",
    "design": "SELECT s.domain, s.phase, s.in_composite, count(k.col) AS n_design FROM slots s LEFT JOIN kept k USING (domain) "
              "WHERE s.in_composite GROUP BY 1, 2, 3",
    "entered": """
      SELECT a.arm, s.key, k.domain, s.value, FALSE AS extra, CASE WHEN f.tbl IS NOT NULL AND (a.only_domain IS NULL OR a.only_domain = k.domain)
        THEN a.weight ELSE 1.0 END AS w FROM sig s JOIN kept k USING (tbl, col) CROSS JOIN arms a LEFT JOIN screen f
        ON f.tbl = s.tbl AND f.col = s.col WHERE NOT (a.replace AND s.tbl = 'click' AND s.col = 'h2')
      UNION ALL SELECT a.arm, s.key, 'click_day', s.value, FALSE, 1.0 FROM sig s, arms a WHERE a.replace AND s.tbl = 'error' AND s.col = 'h7'
      UNION ALL SELECT a.arm, s.key, 'purchase_pair', s.value, TRUE, 1.0 FROM sig s, arms a WHERE s.tbl = 'purchase' AND s.col = 'h7'""",
    "armdom": """
      SELECT key, arm, domain, phase, n_present, n_total, CASE WHEN (n_present >= 2 AND n_present >= 0.5 * n_total) OR (n_total = 1 AND n_present = 1)
        THEN weighted / w_sum END AS score FROM (SELECT u.key, a.arm, d.domain, d.phase, count(e.value) AS n_present,
          d.n_design + count(*) FILTER (WHERE e.extra) AS n_total, sum(e.value * e.w) AS weighted, sum(e.w) AS w_sum
        FROM uni u CROSS JOIN arms a CROSS JOIN design d LEFT JOIN (SELECT * FROM entered WHERE w > 0) e
          ON e.key = u.key AND e.arm = a.arm AND e.domain = d.domain GROUP BY u.key, a.arm, d.domain, d.phase, d.n_design)""",
    "armcomp": """
      SELECT key, arm, max(CASE WHEN phase = 'R' THEN s END) AS R, max(CASE WHEN phase = 'E' THEN s END) AS E,
        sqrt(max(CASE WHEN phase = 'R' THEN s END) * max(CASE WHEN phase = 'E' THEN s END)) AS composite FROM (
        SELECT key, arm, phase, CASE WHEN count(score) >= 2 AND count(score) >= 0.5 * count(*) THEN avg(score) END AS s
        FROM armdom GROUP BY 1, 2, 3) GROUP BY 1, 2""",
}


@query("weighted_domain_mean", X.sql("sig ref xw slots uni", "SELECT key, arm, domain, n_present, n_total, round(score, 8) AS score FROM armdom WHERE score IS NOT NULL", _ARM_CTE))
def weighted_domain_mean(spark, sf):
    out = W.sweep_domains(spark, sf).where(F.col("score").isNotNull())
    return out.select("key", "arm", "domain", "n_present", "n_total", r8("score"))


@query("debias_arms", X.sql("sig ref xw slots uni", "SELECT key, arm, round(R, 8) AS R, round(E, 8) AS E, round(composite, 8) AS composite "
       "FROM armcomp WHERE R IS NOT NULL OR E IS NOT NULL", _ARM_CTE))
def debias_arms(spark, sf):
    out = W.sweep(spark, sf).where(F.col("R").isNotNull() | F.col("E").isNotNull())
    return out.select("key", "arm", r8("R"), r8("E"), r8("composite"))


@query(
    "arm_comparison",
    X.sql("sig ref xw slots uni", """SELECT b.arm, b.n_scored, b.r2, round(sp.rho, 3) AS rho, round(b.sd, 4) AS residual_sd,
      round(k.tau, 3) AS tau FROM (SELECT arm, count(composite) AS n_scored, round(corr(composite, g) * corr(composite, g), 3) AS r2,
        sqrt(var_pop(CASE WHEN g IS NOT NULL THEN composite END) * (1 - corr(composite, g) * corr(composite, g))) AS sd
        FROM armcomp LEFT JOIN ref USING (key) WHERE composite IS NOT NULL GROUP BY arm) b
      JOIN (SELECT arm, corr(rx, ry) AS rho FROM (SELECT arm, rank() OVER (PARTITION BY arm ORDER BY R) + (count(*) OVER (PARTITION BY arm, R) - 1) / 2.0 AS rx,
        rank() OVER (PARTITION BY arm ORDER BY E) + (count(*) OVER (PARTITION BY arm, E) - 1) / 2.0 AS ry FROM armcomp
        WHERE R IS NOT NULL AND E IS NOT NULL) GROUP BY arm) sp USING (arm)
      JOIN (SELECT arm, sum(sign(dx) * sign(dy)) / sqrt(sum((dx <> 0)::INT) * CAST(sum((dy <> 0)::INT) AS DOUBLE)) AS tau
        FROM (SELECT a.arm, round(a.composite, 8) - round(b.composite, 8) AS dx, round(p.composite, 8) - round(q.composite, 8) AS dy
        FROM armcomp a JOIN armcomp b ON a.arm = b.arm AND a.key < b.key JOIN armcomp p ON p.key = a.key AND p.arm = 'base'
        JOIN armcomp q ON q.key = b.key AND q.arm = 'base' WHERE a.composite IS NOT NULL AND b.composite IS NOT NULL) GROUP BY arm) k USING (arm)""", _ARM_CTE),
)
def arm_comparison(spark, sf):
    out = A.comparison(W.sweep(spark, sf), X.modulator(spark, sf), "base")
    return out.select("arm", "n_scored", "r2", F.round("rho", 3).alias("rho"), F.round("residual_sd", 4).alias("residual_sd"), F.round("tau_b", 3).alias("tau"))


@query(
    "variance_verdict",
    X.sql("sig ref xw slots uni", """SELECT domain, arm, round(d_aligned, 8) AS d_aligned, round(d_orthogonal, 8) AS d_orthogonal,
       CASE WHEN abs(d_aligned) < 1e-9 AND abs(d_orthogonal) < 1e-9 THEN 'no-op' WHEN d_aligned > 0 AND d_orthogonal <= 0 THEN 'DE-BIAS+'
         WHEN d_aligned <= 0 AND d_orthogonal <= 0 THEN 'added' WHEN d_aligned >= 2 * abs(d_orthogonal) THEN 'de-bias'
         WHEN d_orthogonal > 0 AND d_orthogonal >= 2 * abs(d_aligned) THEN 'HOLLOW' ELSE 'mixed' END AS verdict
       FROM (SELECT s.domain, s.arm, b.r * b.r * b.v - s.r * s.r * s.v AS d_aligned, (1 - b.r * b.r) * b.v - (1 - s.r * s.r) * s.v AS d_orthogonal
         FROM vs s JOIN vs b ON b.domain = s.domain AND b.arm = 'base' WHERE s.arm <> 'base' AND s.n >= 10 AND b.n >= 10)""",
        {**_ARM_CTE, "vs": "SELECT domain, arm, count(*) AS n, var_pop(score) AS v, corr(score, g) AS r FROM armdom JOIN ref USING (key) "
                           "WHERE score IS NOT NULL GROUP BY 1, 2"}),
)
def variance_verdict(spark, sf):
    out = A.variance_moves(W.sweep_domains(spark, sf), X.modulator(spark, sf), "base")
    return out.select("domain", "arm", r8("d_aligned"), r8("d_orthogonal"), "verdict")


@query(
    "rank_shift_movers",
    X.sql("sig ref xw slots uni", """SELECT key, rank_a, rank_b, shift, side FROM (
        (SELECT *, 'top' AS side FROM m ORDER BY shift DESC, key LIMIT 8) UNION ALL (SELECT *, 'bottom' AS side FROM m ORDER BY shift, key LIMIT 8))""",
        {**_ARM_CTE, "rk": "SELECT key, arm, row_number() OVER (PARTITION BY arm ORDER BY round(composite, 4) DESC, key) AS rank FROM armcomp WHERE composite IS NOT NULL",
         "m": "SELECT a.key, a.rank AS rank_a, b.rank AS rank_b, a.rank - b.rank AS shift FROM rk a JOIN rk b USING (key) WHERE a.arm = 'base' AND b.arm = 'w0.25'"}),
)
def rank_shift_movers(spark, sf):
    ranks = cut_lineage(R.rank_rounded(W.sweep(spark, sf), "composite", ["key"], groups=["arm"]))
    moved = R.rank_shift(ranks.where(F.col("arm") == "base"), ranks.where(F.col("arm") == "w0.25"), "key")
    return R.both_ends(moved, [F.col("shift").desc(), F.col("key")], [F.col("shift"), F.col("key")], 8)


@query(
    "build_reproduction",
    X.sql("sig ref xw slots uni", """SELECT count(*) AS n, round(corr(a.composite, b.composite), 8) AS r, round(max(abs(a.composite - b.composite)), 8) AS max_diff
      FROM armcomp a JOIN armcomp b USING (key) WHERE a.arm = 'base' AND b.arm = 'w0.5' AND a.composite IS NOT NULL AND b.composite IS NOT NULL""", _ARM_CTE),
)
def build_reproduction(spark, sf):
    from compindex.operators.quality import reproduction

    all_arms = cut_lineage(W.sweep(spark, sf))
    pick = lambda name: all_arms.where(F.col("arm") == name).select("key", "composite")
    return reproduction(pick("base"), pick("w0.5"), "key", "composite").select("n", r8("r"), r8("max_diff"))
