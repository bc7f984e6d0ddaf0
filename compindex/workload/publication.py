"""Quality reports and published tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from compindex.config import config_table
from compindex.functions import scaling as S
from compindex.operators import compose as C
from compindex.operators import order as O
from compindex.operators import quality as D
from compindex.operators import ranking as R
from compindex.operators import stats as T
from compindex.operators import uncertainty as U
from compindex.plans import publish as P
from compindex.session import cut_lineage
from compindex.sources import writers as Y
from compindex.workload import fixtures as X
from compindex.workload import uncertain as W
from compindex.workload.core import r8
from compindex.workload.registry import query


# --- differences -----------------------------------------------------------------------


def _snapshots(spark, sf):
    """Customers as published, and an edited staging copy: some rows gone, some balances and segments changed, one field added."""
    base = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    key = F.col("key")
    staging = base.where(key % 50 != 3).select(
        "key", F.when(key % 20 == 1, F.col("balance") + 0.5).otherwise(F.col("balance")).alias("balance"),
        F.when(key % 25 == 2, "OTHER").otherwise(F.col("segment")).alias("segment"),
    )
    return staging, base


_DIFF = """SELECT c_custkey AS key, '.balance' AS path, CASE WHEN c_custkey % 50 = 3 THEN 'only_second' ELSE 'numeric' END AS kind, CASE WHEN c_custkey % 50 <> 3 THEN round(abs(c_acctbal + 0.5 - c_acctbal), 6) END AS delta
    FROM customer WHERE c_custkey % 50 = 3 OR c_custkey % 20 = 1
  UNION ALL SELECT c_custkey, '.segment', CASE WHEN c_custkey % 50 = 3 THEN 'only_second' ELSE 'text' END, NULL FROM customer WHERE c_custkey % 50 = 3 OR c_custkey % 25 = 2"""


@query("table_diff", _DIFF)
def table_diff(spark, sf):
    staging, base = _snapshots(spark, sf)
    return D.leaf_diff(staging, base, ["key"]).select("key", "path", "kind", F.round("delta", 6).alias("delta"))


@query(
    "table_diff_summary",
    f"""SELECT count(*) FILTER (WHERE kind = 'only_first') AS only_first, count(*) FILTER (WHERE kind = 'only_second') AS only_second, count(*) FILTER (WHERE kind = 'numeric') AS numeric,
      count(*) FILTER (WHERE kind = 'text') AS text, round(max(delta), 6) AS max_delta, FALSE AS within FROM ({_DIFF})""",
)
def table_diff_summary(spark, sf):
    staging, base = _snapshots(spark, sf)
    out = D.diff_summary(D.leaf_diff(staging, base, ["key"]))
    return out.select("only_first", "only_second", "numeric", "text", F.round("max_delta", 6).alias("max_delta"), "within")


@query("sanctioned_diff", f"SELECT key, path, kind FROM ({_DIFF}) WHERE path <> '.segment' AND NOT (path = '.balance' AND key % 20 = 1 AND key % 50 <> 3)")
def sanctioned_diff(spark, sf):
    """Segment changes are allowed by pattern, an added field by name, some balances leaf by leaf."""
    staging, base = _snapshots(spark, sf)
    staging = staging.withColumn("band", F.lit(1))
    listed = base.where((F.col("key") % 20 == 1) & (F.col("key") % 50 != 3)).select("key", F.lit(".balance").alias("path"))
    diff = D.leaf_diff(staging, base, ["key"])
    return D.unsanctioned(diff, [r"^\.segment$"], ["band"], listed).select("key", "path", "kind")


@query(
    "nested_document_diff",
    X.sql("phase", """SELECT key, '.phases[' || (CASE phase WHEN 'E' THEN 0 WHEN 'M' THEN 1 ELSE 2 END) || '].score' AS path, 'numeric' AS kind, CAST(0.25 AS DOUBLE) AS delta FROM phase WHERE phase = 'E' AND score IS NOT NULL"""),
)
def nested_document_diff(spark, sf):
    """Documents with an array of structs, compared leaf by leaf."""
    phases = cut_lineage(C.phase_scores(X.domain_scores(spark, sf), X.TOTALS).select("key", "phase", "score"))
    nest = lambda df: df.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("phase", "score"))).alias("phases"))
    moved = phases.withColumn("score", F.when(F.col("phase") == "E", F.col("score") + 0.25).otherwise(F.col("score")))
    diff = D.leaf_diff(nest(moved), nest(phases), ["key"])
    return diff.select("key", "path", "kind", F.round("delta", 6).alias("delta"))


# --- gates -----------------------------------------------------------------------------


def published(spark, sf):
    field = W.field(spark, sf)
    bands = U.rank_bands(U.simulated(field, W.DRAWS).histogram).select("key", "rank_p5", "rank_p50", "rank_p95", "tier_stability")
    domains = cut_lineage(X.domain_scores(spark, sf))
    composites = C.composite(C.phase_scores(domains, X.TOTALS).where("in_composite"), list(X.PHASES))
    # nine digits first, so that a value on the rounding edge is published alike on every run
    steady = composites.select("key", *[F.round(c, 9).alias(c) for c in ("R", "E", "composite")])
    return P.scores_table(steady, domains, bands)


@query(
    "scores_table",
    X.sql("comp scored dom", """SELECT c.key, round(round(c.R, 9), 4) AS R, round(round(c.E, 9), 4) AS E, round(round(c.composite, 9), 4) AS composite, c.composite IS NOT NULL AS scored, r.rank, d.lc AS domains_low_conf, d.ns AS domains_not_scored,
      d.lowlist AS low_conf, d.nslist AS not_scored, b.rank_p5, b.rank_p50, b.rank_p95, round(b.tier_stability, 6) AS tier_stability, CASE WHEN c.composite IS NOT NULL THEN d.ns >= 2 END AS low_confidence
      FROM comp c LEFT JOIN (SELECT key, row_number() OVER (ORDER BY round(round(composite, 9), 4) DESC, key) AS rank FROM scored) r USING (key) LEFT JOIN bands b USING (key) LEFT JOIN (SELECT key,
        count(*) FILTER (WHERE scored AND coverage_flag IN ('low_confidence', 'insufficient_data')) AS lc, count(*) FILTER (WHERE NOT scored) AS ns,
        array_to_string(list_sort(list(domain) FILTER (WHERE scored AND coverage_flag IN ('low_confidence', 'insufficient_data'))), ',') AS lowlist,
        array_to_string(list_sort(list(domain) FILTER (WHERE NOT scored)), ',') AS nslist FROM dom WHERE in_composite GROUP BY key) d USING (key)""", W._MC),
)
def scores_table(spark, sf):
    out = published(spark, sf)
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return out.select(
        "key", "R", "E", "composite", "scored", "rank", "domains_low_conf", "domains_not_scored", listed("low_conf").alias("low_conf"),
        listed("not_scored_domains").alias("not_scored"), "rank_p5", "rank_p50", "rank_p95", F.round("tier_stability", 6).alias("tier_stability"), "low_confidence",
    )


@query(
    "score_invariants",
    X.sql("comp scored dom", """SELECT 'error' AS level, 'rank given twice' AS rule, min(CAST(key AS VARCHAR)) AS key FROM rk GROUP BY shown HAVING count(*) > 1
      UNION ALL SELECT 'error', 'n_universe differs from the rows', NULL WHERE (SELECT count(*) FROM comp WHERE composite IS NULL) > 0
      UNION ALL SELECT 'error', 'largest rank is not n', NULL FROM rk HAVING max(shown) <> count(*)
      UNION ALL SELECT 'error', 'smallest rank is not 1', NULL FROM rk HAVING min(shown) <> 1
      UNION ALL SELECT 'warning', 'rank outside its band', CAST(key AS VARCHAR) FROM rk JOIN bands USING (key) WHERE NOT shown BETWEEN rank_p5 AND rank_p95""",
      {**W._MC, "rk": "SELECT key, rank, CASE rank WHEN 1 THEN 2 WHEN n THEN n + 1 ELSE rank END AS shown FROM (SELECT key, row_number() OVER (ORDER BY round(round(composite, 9), 4) DESC, key) AS rank, (SELECT count(*) FROM scored) AS n FROM scored)"}),
)
def score_invariants(spark, sf):
    """Rules over the published table, where the first rank was given as 2, the last as n + 1 and one unscored key was lost on purpose."""
    table = cut_lineage(published(spark, sf))
    last = table.agg(F.max("rank")).scalar()
    moved = F.when(F.col("rank") == 1, 2).when(F.col("rank") == last, last + 1).otherwise(F.col("rank"))
    lost = table.agg(F.min(F.when(~F.col("scored"), F.col("key")))).scalar()
    out = cut_lineage(table.withColumn("rank", moved).where(F.coalesce(F.col("key") != lost, F.lit(True))))
    # what the table should hold comes from the build, not from the table
    meta = X.composite(spark, sf).agg(F.count(F.lit(1)).alias("n_universe"), F.count("composite").alias("n_scored"))
    return D.score_violations(out, meta)


@query(
    "regression_counts",
    X.sql("comp dom", """SELECT 'n_universe' AS count, n AS stored, n AS current, 'ok' AS status FROM c UNION ALL SELECT 'n_scored', s + 1, s, 'error' FROM c
      UNION ALL SELECT 'n_low', l - 1, l, 'note' FROM c""",
      {"c": "SELECT (SELECT count(*) FROM comp) AS n, (SELECT count(composite) FROM comp) AS s, (SELECT count(*) FROM (SELECT key FROM dom WHERE in_composite GROUP BY key HAVING count(*) FILTER (WHERE NOT scored) >= 2)) AS l"}),
)
def regression_counts(spark, sf):
    rollup = C.flag_rollup(X.domain_scores(spark, sf))
    rows = X.composite(spark, sf).join(rollup, "key")
    now = cut_lineage(rows.agg(
        F.count(F.lit(1)).alias("n_universe"), F.count("composite").alias("n_scored"), F.count_if(F.col("domains_not_scored") >= 2).alias("n_low")
    ))
    stored = now.select("n_universe", (F.col("n_scored") + 1).alias("n_scored"), (F.col("n_low") - 1).alias("n_low"))
    return D.regression(now, stored, ["n_universe", "n_scored"], ["n_low"])


@query(
    "drift_gate",
    """SELECT 'customer' AS name, (SELECT count(*) FROM customer) AS rows_before, (SELECT count(*) FROM customer) AS rows_after,
        CASE WHEN (SELECT count(*) FROM (SELECT c_custkey, c_acctbal FROM customer EXCEPT SELECT c_custkey, CASE WHEN c_custkey = 5 THEN c_acctbal + 1 ELSE c_acctbal END FROM customer)) > 0 THEN 'changed' ELSE 'same' END AS status
      UNION ALL SELECT 'nation', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation), CASE WHEN (SELECT count(*) FROM (FROM nation EXCEPT FROM nation)) > 0 THEN 'changed' ELSE 'same' END UNION ALL SELECT 'supplier', (SELECT count(*) FROM supplier), NULL, 'gone'
      UNION ALL SELECT 'part', NULL, (SELECT count(*) FROM part), 'new'""",
)
def drift_gate(spark, sf):
    """Content hashes of several tables before and after an edit."""
    t = lambda n: X.table(spark, sf, n)
    edited = t("customer").withColumn("c_acctbal", F.when(F.col("c_custkey") == 5, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    before = D.fingerprint(t("customer"), "customer").unionByName(D.fingerprint(t("nation"), "nation")).unionByName(D.fingerprint(t("supplier"), "supplier"))
    shuffled = t("nation").repartition(3, "n_name")
    after = D.fingerprint(edited, "customer").unionByName(D.fingerprint(shuffled, "nation")).unionByName(D.fingerprint(t("part"), "part"))
    return D.drift(before, after)


@query(
    "register_changes",
    """SELECT c_custkey AS key, CASE WHEN c_custkey % 50 = 3 THEN 'removed' ELSE 'changed' END AS status, CASE WHEN c_custkey % 50 = 3 THEN NULL WHEN c_custkey % 20 = 1 AND c_custkey % 25 = 2 THEN 'balance,segment'
      WHEN c_custkey % 20 = 1 THEN 'balance' ELSE 'segment' END AS changed FROM customer WHERE c_custkey % 50 = 3 OR c_custkey % 20 = 1 OR c_custkey % 25 = 2""",
)
def register_changes(spark, sf):
    staging, base = _snapshots(spark, sf)
    return D.change_report(base, staging, ["key"]).select("key", "status", "changed")


def _vintage_register(spark, sf):
    """One register row per supplier: years and counts from its line items, gap rows for some."""
    sums = X.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(
        F.max(F.year("l_shipdate")).alias("year_max"), F.count_distinct("l_orderkey").alias("n")
    )
    rows = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("connector")).join(sums, "key", "left")
    gap = F.col("key") % 9 == 4
    return rows.select(
        "key", "connector", F.when(~gap, F.col("year_max").cast("string")).alias("year_max"),
        F.when(gap, "n/a").otherwise(F.col("n").cast("string")).alias("countries"),
        F.when(F.col("n") % 3 == 0, "BELOW-COVERAGE-FLOOR (x)").otherwise("").alias("flags"),
    )


_VINTAGE = """SELECT s_suppkey AS key, s_nationkey AS connector, CASE WHEN s_suppkey % 9 <> 4 THEN 2026 - y END AS staleness, coalesce(n % 3 = 0, FALSE) AS below_floor, s_suppkey % 9 = 4 OR y IS NULL AS gap_row
  FROM supplier LEFT JOIN (SELECT l_suppkey, max(extract(year FROM l_shipdate)) AS y, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1) ON l_suppkey = s_suppkey"""


@query("vintage_report", _VINTAGE)
def vintage_report(spark, sf):
    out = D.vintages(_vintage_register(spark, sf), F.lit("2026-06-01").cast("date"))
    return out.select("key", "connector", "staleness", "below_floor", "gap_row")


@query(
    "vintage_rollup",
    f"""SELECT connector, count(*) FILTER (WHERE NOT gap_row) AS n_series, count(*) FILTER (WHERE gap_row) AS n_gaps, count(*) FILTER (WHERE NOT gap_row AND below_floor) AS n_below,
      max(staleness) FILTER (WHERE NOT gap_row) AS stalest FROM ({_VINTAGE}) GROUP BY 1""",
)
def vintage_rollup(spark, sf):
    return D.vintage_rollup(D.vintages(_vintage_register(spark, sf), F.lit("2026-06-01").cast("date")), ["connector"])


@query(
    "alternate_coverage",
    X.sql("obs uni", "SELECT series, count(DISTINCT key) AS n_keys FROM obs WHERE key IN (SELECT key FROM uni) GROUP BY 1 UNION ALL SELECT 'refund', NULL UNION ALL SELECT 'chargeback', NULL"),
)
def alternate_coverage(spark, sf):
    notes = config_table(spark, [("refund",), ("chargeback",)], "series string")
    return D.alternate_coverage(X.observations(spark, sf), X.universe(spark, sf), notes)


@query(
    "phase_reconciliation",
    X.sql("dom phase", """SELECT phase, count(*) AS n, round(max(abs(shown - m.mean)), 6) AS max_diff, max(abs(shown - m.mean)) <= 1e-4 AS within
      FROM (SELECT *, CASE WHEN phase = 'E' AND key % 5 = 2 THEN score + 0.001 ELSE score END AS shown FROM phase) p JOIN (SELECT key, phase, avg(score) AS mean FROM dom WHERE score IS NOT NULL GROUP BY 1, 2) m
      USING (key, phase) WHERE p.score IS NOT NULL GROUP BY 1"""),
)
def phase_reconciliation(spark, sf):
    domains = cut_lineage(X.domain_scores(spark, sf))
    phases = C.phase_scores(domains, X.TOTALS)
    # one phase is published a little too high for every fifth key
    shown = F.when((F.col("phase") == "E") & (F.col("key") % 5 == 2), F.col("score") + 0.001).otherwise(F.col("score"))
    out = D.reconciliation(domains, phases.withColumn("score", shown))
    return out.select("phase", "n", F.round("max_diff", 6).alias("max_diff"), "within")


@query(
    "zero_scores",
    X.sql("comp", "SELECT key FROM (SELECT key, CASE WHEN key % 10 = 0 AND composite IS NOT NULL THEN 0 ELSE composite END AS composite FROM comp) WHERE composite = 0"),
)
def zero_scores(spark, sf):
    """Composites of exactly 0; every tenth scored key was zeroed to be found."""
    rows = X.composite(spark, sf).withColumn("composite", F.when((F.col("key") % 10 == 0) & F.col("composite").isNotNull(), 0.0).otherwise(F.col("composite")))
    return D.zero_scores(rows).select("key")


@query(
    "coverage_ledger",
    X.sql("dom comp", """SELECT 'composite' AS item, count(composite) AS n_scored FROM comp UNION ALL SELECT 'phase R', count(R) FROM comp UNION ALL SELECT 'phase E', count(E) FROM comp
      UNION ALL SELECT 'domain ' || domain, count(*) FILTER (WHERE scored) FROM dom GROUP BY domain"""),
)
def coverage_ledger(spark, sf):
    domains = cut_lineage(X.domain_scores(spark, sf))
    composites = C.composite(C.phase_scores(domains, X.TOTALS).where("in_composite"), list(X.PHASES))
    return D.coverage_ledger(domains, composites, list(X.PHASES))


@query("score_summary", X.sql("comp", "SELECT count(*) AS n_universe, count(composite) AS n_scored, round(min(composite), 8) AS lowest, round(max(composite), 8) AS highest FROM comp"))
def score_summary(spark, sf):
    return D.score_summary(X.composite(spark, sf), "composite").select("n_universe", "n_scored", r8("lowest"), r8("highest"))


# --- published tables ------------------------------------------------------------------


@query(
    "domains_table",
    X.sql("sig xw slots uni", """SELECT key, domain, n_present, scored, round(score, 8) AS score, low_conf OR inside AS low_conf, inside AS modeled_input, CASE WHEN inside THEN round(score - down / n_present, 8) END AS interval_lo,
        CASE WHEN inside THEN round(score + up / n_present, 8) END AS interval_hi FROM (SELECT *, scored AND k > 0 AS inside, CASE WHEN sc THEN raw END AS score, scored AND (confidence <> 'ok' OR (n_total = 1 AND n_present = 1)) AS low_conf
        FROM (SELECT *, sc AS scored FROM (SELECT *, (n_present >= 2 AND n_present >= 0.5 * n_total) OR (n_total = 1 AND n_present = 1) AS sc FROM (SELECT u.key, s.domain, s.confidence, s.n_total, count(a.value) AS n_present,
          avg(a.value) AS raw, count(*) FILTER (WHERE a.modeled) AS k, coalesce(sum(a.value - a.lo) FILTER (WHERE a.modeled), 0) AS down, coalesce(sum(a.hi - a.value) FILTER (WHERE a.modeled), 0) AS up
          FROM uni u CROSS JOIN slots s LEFT JOIN a ON a.key = u.key AND a.domain = s.domain GROUP BY u.key, s.domain, s.confidence, s.n_total)))) WHERE n_present > 0""",
      {"m": "SELECT key, 'view' AS tbl, 'h2' AS col, value, value - 0.05 AS lo, value + 0.1 AS hi FROM sig WHERE tbl = 'click' AND col = 'h2' AND (key) NOT IN (SELECT key FROM sig WHERE tbl = 'view' AND col = 'h2')",
       "a": "SELECT sig.key, xw.domain, sig.value, NULL AS lo, NULL AS hi, FALSE AS modeled FROM sig JOIN xw USING (tbl, col) UNION ALL SELECT m.key, xw.domain, m.value, m.lo, m.hi, TRUE FROM m JOIN xw USING (tbl, col)"}),
)
def domains_table(spark, sf):
    """Domain scores with fenced modeled inputs and their intervals."""
    signals = cut_lineage(X.signals(spark, sf))
    modeled = signals.where((F.col("tbl") == "click") & (F.col("col") == "h2")).select(
        "key", F.lit("view").alias("tbl"), F.lit("h2").alias("col"), "value", (F.col("value") - 0.05).alias("lo"), (F.col("value") + 0.1).alias("hi")
    )
    out = P.domains_table(signals, modeled, X.crosswalk(spark), X.DESIGN, X.universe(spark, sf)).where(F.col("n_present") > 0)
    return out.select("key", "domain", "n_present", "scored", r8("score"), "low_conf", "modeled_input", r8("interval_lo"), r8("interval_hi"))


_ENTERED = {
    "given": "SELECT key, tbl, col, value, NULL AS lo, NULL AS hi, 0 AS rk, 1 AS turn FROM sig WHERE value IS NOT NULL UNION ALL SELECT key, 'error', 'h2', (key % 10) / 10.0, NULL, NULL, 1, 0 FROM uni WHERE key % 7 = 0 "
             "UNION ALL SELECT key, 'view', 'h2', value, value - 0.05, value + 0.1, 2, 2 FROM sig WHERE tbl = 'click' AND col = 'h2'",
    "entered": "SELECT * FROM given QUALIFY row_number() OVER (PARTITION BY key, tbl, col ORDER BY turn) = 1",
}


@query(
    "indicators_table",
    X.sql("sig xw uni", """SELECT key, number, domain, tbl, col, round(CASE WHEN rk = 0 AND tbl = 'error' AND col = 'h2' AND value < 0.2 THEN value * value / 0.2 ELSE value END, 8) AS value,
      rk = 1 AS overridden, rk = 2 AS modeled, round(lo, 8) AS lo, round(hi, 8) AS hi FROM entered JOIN (SELECT domain, tbl, col, dense_rank() OVER (ORDER BY phase)
      || '.' || dense_rank() OVER (PARTITION BY phase ORDER BY domain) || '.' || row_number() OVER (PARTITION BY domain ORDER BY pos) AS number FROM xw JOIN slots USING (domain)) USING (tbl, col)""",
      {"slots": X.CTES["slots"][1], **_ENTERED}),
)
def indicators_table(spark, sf):
    phases = config_table(spark, [(d, p) for d, p, *_ in X.DESIGN], "domain string, phase string")
    design = X.crosswalk(spark).join(phases, "domain").withColumn("domain_pos", F.col("domain"))
    signals = cut_lineage(X.signals(spark, sf))
    over, guess = _overrides_and_modeled(spark, sf, signals)
    out = P.indicators_table(signals, design, [("error", "h2")], over, guess)
    return out.select("key", "number", "domain", "tbl", "col", r8("value"), "overridden", "modeled", r8("lo"), r8("hi"))


def _overrides_and_modeled(spark, sf, signals):
    """Every seventh key's error signal is entered by hand, and absent view signals are estimated from clicks."""
    keys = X.universe(spark, sf)
    over = keys.where(F.col("key") % 7 == 0).select("key", F.lit("error").alias("tbl"), F.lit("h2").alias("col"), ((F.col("key") % 10) / 10.0).alias("value"))
    clicks = signals.where((F.col("tbl") == "click") & (F.col("col") == "h2"))
    guess = clicks.select("key", F.lit("view").alias("tbl"), "col", "value", (F.col("value") - 0.05).alias("lo"), (F.col("value") + 0.1).alias("hi"))
    return over, guess


@query(
    "modeled_list",
    X.sql("sig xw uni", "SELECT DISTINCT key, tbl, col, round(value, 8) AS value, round(lo, 8) AS lo, round(hi, 8) AS hi FROM entered JOIN xw USING (tbl, col) WHERE rk = 2", _ENTERED),
)
def modeled_list(spark, sf):
    phases = config_table(spark, [(d, p) for d, p, *_ in X.DESIGN], "domain string, phase string")
    design = X.crosswalk(spark).join(phases, "domain").withColumn("domain_pos", F.col("domain"))
    signals = cut_lineage(X.signals(spark, sf))
    out = P.modeled_list(P.indicators_table(signals, design, [], *_overrides_and_modeled(spark, sf, signals)))
    return out.select("key", "tbl", "col", r8("value"), r8("lo"), r8("hi"))


def _units(spark, sf):
    """Customers as units of nations; the risk is the composite where it is scored, else a share of the balance."""
    share = F.when(F.col("c_acctbal") > 0, S.clamp(F.col("c_acctbal") / 10000.0))
    return X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("group"), F.col("c_custkey").alias("unit"), share.alias("risk"))


_UNITS = "SELECT c_nationkey AS grp, c_custkey AS unit, CASE WHEN c_acctbal > 0 THEN least(1.0, greatest(0.0, c_acctbal / 10000.0)) END AS risk FROM customer"
_GROUP_RANK = "SELECT s_nationkey AS grp, row_number() OVER (ORDER BY avg(s_acctbal) DESC, s_nationkey) AS rank FROM supplier GROUP BY 1"


def _group_ranks(spark, sf):
    means = X.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("group")).agg(F.avg("s_acctbal").alias("score"))
    return R.rank_scored(means, "score", ["group"]).select("group", "rank", "score")


@query(
    "ecdf_divergence",
    f"""WITH u AS (SELECT * FROM ({_UNITS}) WHERE risk IS NOT NULL), r AS ({_GROUP_RANK}), n AS (SELECT count(*) AS n FROM r),
      w AS (SELECT grp, unit, risk FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY risk DESC, unit) AS rn FROM u) WHERE rn = 1),
      p AS (SELECT grp, count(*) AS n_units, avg(risk) AS risk_mean, quantile_cont(risk, 0.9) AS risk_p90, max(risk) - min(risk) AS within_range FROM u GROUP BY 1)
    SELECT p.grp AS "group", coalesce(h.n_hot, 0) AS n_hot, h.grp IS NOT NULL AS in_layer, round((SELECT count(*) FILTER (WHERE u.risk <= risk_p90) / count(*) FROM u), 8) AS p90_pctile, r.rank, round(1 - (r.rank - 1) / (n.n - 1), 8) AS national_pctile, n_units, round(risk_mean, 8) AS risk_mean, round(risk_p90, 8) AS risk_p90, w.unit AS worst_unit, round(w.risk, 8) AS worst_risk,
      round(e.ec, 8) AS corridor_pctile, round(e.ec - (1 - (r.rank - 1) / (n.n - 1)), 8) AS divergence, round(within_range, 8) AS within_range, w.risk >= (SELECT quantile_cont(risk, 0.9) FROM u) AS top_decile,
      coalesce(w.risk >= (SELECT quantile_cont(risk, 0.9) FROM u) AND r.rank > (SELECT count(*) FROM nation) * 0.25, FALSE) AS headline
    FROM p JOIN w USING (grp) LEFT JOIN r USING (grp) LEFT JOIN (SELECT c_nationkey AS grp, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS n_hot FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey % 5 <> 2 GROUP BY 1) h USING (grp), n, LATERAL (SELECT count(*) FILTER (WHERE u.risk <= w.risk) / count(*) AS ec FROM u) e""",
)
def ecdf_divergence(spark, sf):
    size = X.table(spark, sf, "nation").agg(F.count(F.lit(1))).scalar()
    orders = X.table(spark, sf, "orders").join(X.table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).where(F.col("c_nationkey") % 5 != 2)
    hot = F.when(F.col("o_orderpriority") == "1-URGENT", "99%").when(F.col("o_orderpriority") == "2-HIGH", "95%").otherwise("ns")
    events = orders.select(F.col("c_nationkey").alias("group"), hot.alias("hot"))
    out = P.divergence_table(_units(spark, sf), cut_lineage(_group_ranks(spark, sf).select("group", "rank")), size, events=events)
    rounded = ("p90_pctile", "national_pctile", "risk_mean", "risk_p90", "worst_risk", "corridor_pctile", "divergence", "within_range")
    return out.select("group", "rank", "n_units", "worst_unit", "top_decile", "headline", "n_hot", "in_layer", *[r8(c) for c in rounded])


def _surface_units(spark, sf):
    """Per customer: three signals, the number of orders as events, nation as group."""
    sig = X.signals(spark, sf)
    pick = lambda t, c, n: F.max(F.when((F.col("tbl") == t) & (F.col("col") == c), F.col("value"))).alias(n)
    wide = sig.groupBy("key").agg(pick("view", "h0", "a"), pick("click", "h1", "b"), pick("error", "h2", "c"))
    orders = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.count(F.lit(1)).alias("events"))
    people = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_nationkey").alias("group"), "c_acctbal")
    rows = people.join(wide, "key", "left").join(orders, "key", "left")
    # one signal counts only where the group's comparability limit allows it
    return rows.withColumn("c", F.when(F.col("group") <= 12, F.col("c")))


_SURF = {
    "w": "SELECT key, max(value) FILTER (WHERE tbl = 'view' AND col = 'h0') AS a, max(value) FILTER (WHERE tbl = 'click' AND col = 'h1') AS b, max(value) FILTER (WHERE tbl = 'error' AND col = 'h2') AS c FROM sig GROUP BY key",
    "o": "SELECT o_custkey AS key, count(*) AS events FROM orders GROUP BY 1",
    "s0": "SELECT c_custkey AS key, c_nationkey AS grp, a, b, CASE WHEN c_nationkey <= 12 THEN c END AS c, coalesce(events, 0) AS events FROM customer LEFT JOIN w ON w.key = c_custkey LEFT JOIN o ON o.key = c_custkey",
    "s1": "SELECT *, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n, ln(1 + events) / ln(1 + (SELECT max(events) FROM s0)) AS shock FROM s0",
    "s2": "SELECT *, CASE WHEN n >= 2 THEN (coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0)) / n END AS idx FROM s1",
}


def _surface(spark, sf):
    return P.surface(_surface_units(spark, sf), ["a", "b", "c"], "events")


@query("subnational_surface", X.sql("sig", "SELECT key, n AS n_signals, round(idx, 8) AS idx, round(shock, 8) AS shock, round(CAST(0.7 AS DOUBLE) * idx + CAST(0.3 AS DOUBLE) * shock, 8) AS risk FROM s2", _SURF))
def subnational_surface(spark, sf):
    return _surface(spark, sf).select("key", "n_signals", r8("index", "idx"), r8("shock_index", "shock"), r8("risk"))


@query(
    "surface_weight_sweep",
    X.sql("sig", """SELECT w_index, w_shock, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM (SELECT w_index, w_shock, rank() OVER (PARTITION BY w_index ORDER BY worst) + (count(*) OVER (PARTITION BY w_index, worst) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY w_index ORDER BY base) + (count(*) OVER (PARTITION BY w_index, base) - 1) / 2.0 AS ry FROM (SELECT v.*, b.worst AS base FROM v JOIN v b ON b.grp = v.grp AND b.w_index = 0.7)) GROUP BY 1, 2""",
      {**_SURF, "v": "SELECT grp, w.w_index, w.w_shock, max(w.w_index * idx + w.w_shock * shock) AS worst FROM s2, (VALUES (CAST(1.0 AS DOUBLE), CAST(0.0 AS DOUBLE)), (0.85, 0.15), (0.7, 0.3), (0.5, 0.5), (0.3, 0.7)) w(w_index, w_shock) "
                     "WHERE idx IS NOT NULL GROUP BY ALL"}),
)
def surface_weight_sweep(spark, sf):
    sweep = P.surface_sweep(_surface(spark, sf), "group")
    return P.surface_sweep_agreement(sweep, "group").select("w_index", "w_shock", "n", r8("rho"))


@query(
    "worst_corridors",
    X.sql("sig", "SELECT key AS unit, grp AS \"group\", round(CAST(0.7 AS DOUBLE) * idx + CAST(0.3 AS DOUBLE) * shock, 8) AS risk FROM s2 WHERE idx IS NOT NULL ORDER BY CAST(0.7 AS DOUBLE) * idx + CAST(0.3 AS DOUBLE) * shock DESC, key LIMIT 25", _SURF),
)
def worst_corridors(spark, sf):
    return P.corridors(_surface(spark, sf).withColumnRenamed("key", "unit")).select("unit", "group", r8("risk"))


@query(
    "within_group_spread",
    X.sql("sig", f"""SELECT p.grp AS "group", n, round(mean, 8) AS mean, round(p90, 8) AS p90, round(mx, 8) AS max, round(mn, 8) AS min, round(mx - mn, 8) AS range, tier, coalesce(tier = 'mid' AND p90 >= (SELECT quantile_cont(risk, 0.75) FROM u), FALSE) AS hidden
      FROM (SELECT grp, count(*) AS n, avg(risk) AS mean, quantile_cont(risk, 0.9) AS p90, max(risk) AS mx, min(risk) AS mn FROM u GROUP BY 1) p LEFT JOIN (SELECT grp, CASE WHEN score >= (SELECT quantile_cont(score, 0.66) FROM g) THEN 'high'
        WHEN score <= (SELECT quantile_cont(score, 0.33) FROM g) THEN 'low' ELSE 'mid' END AS tier FROM g) t USING (grp)""",
      {**_SURF, "u": "SELECT grp, key, CAST(0.7 AS DOUBLE) * idx + CAST(0.3 AS DOUBLE) * shock AS risk FROM s2 WHERE idx IS NOT NULL", "g": "SELECT s_nationkey AS grp, avg(s_acctbal) AS score FROM supplier GROUP BY 1"}),
)
def within_group_spread(spark, sf):
    scores = X.table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("group")).agg(F.avg("s_acctbal").alias("score"))
    out = P.spread_table(_surface(spark, sf), scores)
    return out.select("group", "n", *[r8(c) for c in ("mean", "p90", "max", "min", "range")], "tier", "hidden")


@query(
    "surface_variance_share",
    X.sql("sig", """SELECT CAST(sum(k) AS BIGINT) AS n, count(*) AS n_groups, round(sum(k * (m - g) * (m - g)) / any_value(tot), 8) AS eta2, round(1 - sum(k * (m - g) * (m - g)) / any_value(tot), 8) AS within_share FROM
      (SELECT grp, count(*) AS k, avg(risk) AS m FROM u GROUP BY 1), (SELECT avg(risk) AS g, var_pop(risk) * count(*) AS tot FROM u)""",
      {**_SURF, "u": "SELECT grp, CAST(0.7 AS DOUBLE) * idx + CAST(0.3 AS DOUBLE) * shock AS risk FROM s2 WHERE idx IS NOT NULL"}),
)
def surface_variance_share(spark, sf):
    return T.eta_squared(_surface(spark, sf), [], "risk", "group").select("n", "n_groups", r8("eta2"), r8("within_share"))


@query(
    "polygon_surface_join",
    X.sql("pts", """SELECT lpad(CAST(n_nationkey AS VARCHAR), 6, '0') AS id, CASE WHEN n_nationkey % 3 = 0 THEN 2 ELSE 1 END AS n_rings, round(m, 6) AS risk FROM nation JOIN (SELECT nation, avg(x) AS m FROM pts GROUP BY 1) ON nation = n_nationkey"""),
)
def polygon_surface_join(spark, sf):
    """Polygon features joined to the surface table on the padded id, as slim GeoJSON properties."""
    from compindex.functions.cleaning import unit_id
    from compindex.workload.spatial import points, polygons

    shapes = polygons(spark, sf).select(unit_id(F.col("id")).alias("id"), "rings")
    means = points(spark, sf).groupBy(unit_id(F.col("nation")).alias("id")).agg(F.avg("x").alias("risk"))
    joined = shapes.join(means, "id")
    features = Y.geojson_features(joined.withColumn("risk", F.round("risk", 6)), Y.polygon_coordinates(F.col("rings")), "Polygon", ["id", "risk"])
    shape = "geometry struct<coordinates: array<array<array<double>>>>, properties struct<id: string, risk: double>"
    parsed = features.select(F.from_json("value", shape).alias("f"))
    return parsed.select("f.properties.id", F.size("f.geometry.coordinates").alias("n_rings"), "f.properties.risk")


@query(
    "overlay_corridors",
    X.sql("comp sig pts", """SELECT c.key, round(o, 8) AS outbound, round(i, 8) AS inbound, round(composite, 8) AS composite, CASE WHEN coalesce(o >= 0.5, FALSE) AND (i IS NULL OR i < 0.4) THEN 'outbound-source'
        WHEN coalesce(i >= 0.5, FALSE) AND (o IS NULL OR o < 0.4) THEN 'inbound-demand' WHEN coalesce(o >= 0.4 AND i >= 0.4, FALSE) THEN 'dual' ELSE 'neither' END AS role, round(p.lon, 3) AS lon, round(p.lat, 3) AS lat, round(q.ratio, 8) AS ratio
      FROM comp c LEFT JOIN (SELECT key, max(value) FILTER (WHERE tbl = 'view' AND col = 'h0') AS o, max(value) FILTER (WHERE tbl = 'click' AND col = 'h1') AS i FROM sig GROUP BY key) s USING (key) LEFT JOIN pts p USING (key)
      LEFT JOIN (SELECT o_custkey AS key, sum(o_totalprice) / any_value(c_acctbal) AS ratio FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal <> 0 GROUP BY 1) q USING (key)"""),
)
def overlay_corridors(spark, sf):
    sig = X.signals(spark, sf)
    side = lambda t, c, n: sig.where((F.col("tbl") == t) & (F.col("col") == c)).select("key", F.col("value").alias(n))
    centres = X.located(X.universe(spark, sf))
    amounts = X.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("key")).agg(F.sum("o_totalprice").alias("amount"))
    bases = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("base"))
    out = P.overlay_corridors(X.composite(spark, sf).select("key", "composite"), side("view", "h0", "outbound"), side("click", "h1", "inbound"), centres, P.ratio_of(amounts, bases))
    return out.select("key", r8("outbound"), r8("inbound"), r8("composite"), "role", F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat"), r8("ratio"))


@query(
    "registry_document",
    X.sql("xw", """SELECT s.phase, x.domain, x.pos, x.tbl || '.' || x.col AS indicator, CASE WHEN x.col = 'h7' THEN 'late' ELSE x.col END AS register_key,
      CASE WHEN x.domain = 'click_night' AND x.tbl = 'view' THEN 'circular-flagged' WHEN x.domain = 'signup_day' THEN 'defeater' ELSE 'generating' END AS role,
      CASE WHEN x.tbl <> 'purchase' THEN 'events' END AS source, CASE WHEN x.tbl <> 'purchase' THEN r.y END AS year_max,
      CASE WHEN x.tbl = 'purchase' OR r.y IS NULL THEN 'no register row' END AS note FROM xw x JOIN slots s USING (domain)
      LEFT JOIN (SELECT event_type AS tbl, 'h' || CAST(CAST(floor(extract(hour FROM ts) / 3) AS INTEGER) AS VARCHAR) AS col, CAST(max(extract(year FROM ts)) AS INTEGER) AS y FROM events GROUP BY 1, 2) r USING (tbl, col)""",
      {"slots": X.CTES["slots"][1]}),
)
def registry_document(spark, sf):
    """Nested registry document, opened again to its indicator rows."""
    phases = config_table(spark, [(d, p) for d, p, *_ in X.DESIGN], "domain string, phase string")
    slot = F.concat(F.lit("h"), F.floor(F.hour("ts") / 3).cast("string"))
    events = X.table(spark, sf, "events").where(F.col("event_type") != "purchase")
    named = F.when(slot == "h7", "late").otherwise(slot)
    register = events.groupBy(F.col("event_type").alias("tbl"), named.alias("register_key")).agg(F.max(F.year("ts")).alias("year_max"))
    aliases = config_table(spark, [("h7", "late")], "col string, register_key string")
    circular = config_table(spark, [("click_night", "view", "h0")], "domain string, tbl string, col string")
    labels = config_table(spark, [("view_day", "Views by day")], "domain string, label string")
    doc = P.registry_document(X.crosswalk(spark).join(phases, "domain"), register.withColumn("source", F.lit("events")), labels, aliases, circular, ("signup_day",))
    rows = doc.select("phase", F.inline("domains")).select("phase", "domain", F.inline("indicators"))
    return rows.select("phase", "domain", "pos", "indicator", "register_key", "role", "source", "year_max", "note")
