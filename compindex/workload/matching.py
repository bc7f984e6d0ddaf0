"""Keys, joins, fills, labels and text rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from compindex.config import config_table, values_sql
from compindex.functions import cleaning as K
from compindex.functions import labels as B
from compindex.operators import compose as C
from compindex.operators import filters as P
from compindex.operators import keys as J
from compindex.operators import latest as L
from compindex.operators import ranking as R
from compindex.operators import scale as N
from compindex.plans import publish as Q
from compindex.session import cut_lineage
from compindex.workload import fixtures as X
from compindex.workload.core import r8
from compindex.workload.registry import query

# Names only this source uses, and renamed forms.
SOURCE_ALIASES = [("land seven", 7), ("land nine", 9)]
OVERRIDES = [("former nation 3", 3), ("nation twelve, republic of", 12)]


def alias_layers(spark, sf):
    nation = X.table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name"))
    local = config_table(spark, SOURCE_ALIASES, "name string, key bigint")
    codes = nation.select(F.concat(F.lit("n"), F.col("key").cast("string")).alias("name"), "key")
    overrides = config_table(spark, OVERRIDES, "name string, key bigint")
    named = nation.select("name", "key")
    pick = lambda df: df.select("name", "key")
    return J.alias_table(pick(local), pick(codes), pick(overrides), named)


def raw_names(spark, sf):
    """Customers with their nation written in many ways."""
    n, k = F.col("n_name"), F.col("c_custkey") % 9
    raw = (
        F.when(k == 0, F.concat(F.lit("  "), F.lower(n), F.lit(" ")))
        .when(k == 1, F.concat(F.lit("N"), F.col("c_nationkey").cast("string")))
        .when(k == 2, "Land Seven").when(k == 3, "Former Nation 3").when(k == 4, F.concat(n, F.lit("x")))
        .when(k == 5, "World").when(k == 6, F.lit(None)).otherwise(n)
    )
    rows = X.table(spark, sf, "customer").join(X.table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), raw.alias("raw"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("code"), k.alias("form"))


_RESOLVED = """SELECT c_custkey AS id, CASE c_custkey % 9 WHEN 2 THEN 7 WHEN 3 THEN 3 WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE c_nationkey END AS key FROM customer"""


@query("resolve_names", _RESOLVED)
def resolve_names(spark, sf):
    """Source layer, short codes, overrides, names, then the closest name; unknown stays null."""
    return J.resolve(raw_names(spark, sf), "raw", alias_layers(spark, sf)).select("id", "key")


@query("resolve_code_then_name", """SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN c_nationkey ELSE CASE c_custkey % 9 WHEN 2 THEN 7 WHEN 3 THEN 3 WHEN 5 THEN NULL
   WHEN 6 THEN NULL ELSE c_nationkey END END AS key FROM customer""")
def resolve_code_then_name(spark, sf):
    rows = raw_names(spark, sf).withColumn("code", F.when(F.col("id") % 4 == 0, F.col("code")).otherwise("-"))
    return J.resolve_two(rows, "code", "raw", alias_layers(spark, sf)).select("id", "key")


@query(
    "code_lookup",
    """SELECT s_suppkey AS id, lpad(CAST(s_nationkey AS VARCHAR), 3, '0') AS code, CAST(s_nationkey AS BIGINT) AS key FROM supplier WHERE s_suppkey % 5 <> 0""",
)
def code_lookup(spark, sf):
    """Numeric codes with decoration, padded to three digits; aggregate codes have no key and drop out."""
    raw = F.when(F.col("s_suppkey") % 5 == 0, F.lit("W-999")).otherwise(F.concat(F.lit("C "), F.col("s_nationkey").cast("string")))
    rows = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), raw.alias("raw"))
    codes = X.table(spark, sf, "nation").select(F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("code"), F.col("n_nationkey").cast("long").alias("key"))
    return J.by_code(rows, "raw", codes, 3).select("id", "code", "key")


@query(
    "match_report",
    f"""WITH r AS (SELECT c.c_custkey AS id, CASE c_custkey % 9 WHEN 0 THEN '  ' || lower(n_name) || ' ' WHEN 1 THEN 'N' || c_nationkey WHEN 2 THEN 'Land Seven' WHEN 3 THEN 'Former Nation 3'
        WHEN 4 THEN n_name || 'x' WHEN 5 THEN 'World' WHEN 6 THEN NULL ELSE n_name END AS raw, key FROM customer c JOIN nation ON n_nationkey = c_nationkey JOIN ({_RESOLVED}) k ON k.id = c_custkey),
      u AS (SELECT n_nationkey AS key FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 999)
    SELECT 'unmatched' AS kind, raw AS item, count(*) AS rows FROM r WHERE key IS NULL GROUP BY raw
    UNION ALL SELECT 'out_of_scope', CAST(key AS VARCHAR), count(*) FROM r WHERE key IS NOT NULL AND key NOT IN (SELECT key FROM u) GROUP BY key
    UNION ALL SELECT 'no_data', CAST(key AS VARCHAR), 0 FROM u WHERE key NOT IN (SELECT key FROM r WHERE key IS NOT NULL)""",
)
def match_report(spark, sf):
    resolved = J.resolve(raw_names(spark, sf), "raw", alias_layers(spark, sf))
    scope = X.table(spark, sf, "nation").where(F.col("n_regionkey") != 2).select(F.col("n_nationkey").cast("long").alias("key"))
    scope = scope.unionByName(scope.agg(F.lit(999).cast("long").alias("key")))
    return J.match_report(resolved, "raw", scope)


@query("semi_join_scope", "SELECT o_orderkey AS id, o_custkey AS key FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_join_scope(spark, sf):
    scope = X.table(spark, sf, "customer").where(F.col("c_mktsegment") == "BUILDING").select(F.col("c_custkey").alias("key"))
    rows = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("key"))
    return rows.join(scope, "key", "left_semi").select("id", "key")


@query(
    "attribute_joins",
    X.sql("comp ref", """SELECT c.key, round(composite, 8) AS composite, round(g, 8) AS g, c_mktsegment AS segment, n_name AS nation, r_name AS region FROM comp c LEFT JOIN ref ON ref.key = c.key
      LEFT JOIN customer ON c_custkey = c.key LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey"""),
)
def attribute_joins(spark, sf):
    people = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), "c_nationkey")
    nation = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"), "n_regionkey")
    region = X.table(spark, sf, "region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("region"))
    out = X.composite(spark, sf).join(X.modulator(spark, sf), "key", "left").join(people, "key", "left")
    out = out.join(nation, "c_nationkey", "left").join(region, "n_regionkey", "left")
    return out.select("key", r8("composite"), r8("g"), "segment", "nation", "region")


@query(
    "ratio_over_shared_keys",
    """SELECT key, round(amount / base, 8) AS ratio FROM (SELECT l_suppkey AS key, sum(l_quantity) AS amount FROM lineitem GROUP BY 1)
      JOIN (SELECT s_suppkey AS key, s_acctbal AS base FROM supplier) USING (key) WHERE base <> 0""",
)
def ratio_over_shared_keys(spark, sf):
    amounts = X.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum("l_quantity").alias("amount"))
    bases = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("base"))
    return Q.ratio_of(amounts, bases).select("key", r8("ratio"))


@query(
    "gap_over_shared_keys",
    X.sql("lat", "SELECT a.key, round(a.value - b.value, 8) AS gap FROM lat a JOIN lat b USING (key) WHERE a.series = 'view' AND b.series = 'click'"),
)
def gap_over_shared_keys(spark, sf):
    latest = L.latest_value(X.observations(spark, sf), ["key", "series"])
    a = latest.where(F.col("series") == "view").select("key", F.col("value").alias("a"))
    b = latest.where(F.col("series") == "click").select("key", F.col("value").alias("b"))
    return a.join(b, "key").select("key", F.round(F.col("a") - F.col("b"), 8).alias("gap"))


@query("crosswalk_bridge", X.sql("sig xw", "SELECT key, domain, tbl, col, round(value, 8) AS value FROM sig JOIN xw USING (tbl, col)"))
def crosswalk_bridge(spark, sf):
    bridged = X.signals(spark, sf).join(X.crosswalk(spark).select("tbl", "col", "domain"), ["tbl", "col"])
    return bridged.select("key", "domain", "tbl", "col", r8("value"))


@query(
    "modeled_fill",
    X.sql("uni sig", """SELECT u.key, round(coalesce(s.value, m.value), 8) AS value, s.value IS NULL AND m.value IS NOT NULL AS is_modeled FROM uni u LEFT JOIN
      (SELECT key, value FROM sig WHERE tbl = 'view' AND col = 'h0') s USING (key) LEFT JOIN (SELECT key, value FROM sig WHERE tbl = 'view' AND col = 'h1') m USING (key)"""),
)
def modeled_fill(spark, sf):
    sig = X.signals(spark, sf).where(F.col("tbl") == "view")
    observed = N.densify(X.universe(spark, sf), sig.where(F.col("col") == "h0").select("key", "value"))
    out = C.fill_missing(observed, sig.where(F.col("col") == "h1").select("key", "value"), ["key"])
    return out.select("key", r8("value"), "is_modeled")


@query(
    "override_first",
    X.sql("sig", """SELECT key, round(coalesce(o.value, b.value), 8) AS value FROM (SELECT key, value FROM sig WHERE tbl = 'view' AND col = 'h0') b LEFT JOIN
      (SELECT key, value FROM sig WHERE tbl = 'view' AND col = 'h2') o USING (key)"""),
)
def override_first(spark, sf):
    sig = X.signals(spark, sf).where(F.col("tbl") == "view")
    out = C.override_first(sig.where(F.col("col") == "h0").select("key", "value"), sig.where(F.col("col") == "h2").select("key", "value"), ["key"])
    return out.select("key", r8("value"))


@query(
    "key_repair_join",
    """SELECT s_suppkey AS id, n_name AS name FROM supplier JOIN nation ON n_nationkey = s_nationkey""",
)
def key_repair_join(spark, sf):
    """A sentinel key is replaced by the alternate column before the join."""
    key = F.col("s_nationkey").cast("string")
    rows = X.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 3 == 0, "-99").otherwise(key).alias("k"), key.alias("alt")
    )
    nation = X.table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("name"))
    return rows.withColumn("k", K.repaired_key(F.col("k"), F.col("alt"))).join(nation, "k").select("id", "name")


@query(
    "centre_with_fallback",
    X.sql("pts", """SELECT n_nationkey AS key, round(coalesce(e.lon, f.lon), 6) AS lon, round(coalesce(e.lat, f.lat), 6) AS lat FROM nation LEFT JOIN (SELECT nation, avg(lon) AS lon, avg(lat) AS lat FROM pts
      WHERE x > 9500 GROUP BY 1) e ON e.nation = n_nationkey LEFT JOIN (SELECT nation, avg(lon) AS lon, avg(lat) AS lat FROM pts GROUP BY 1) f ON f.nation = n_nationkey"""),
)
def centre_with_fallback(spark, sf):
    """Group centres from selected points, else from all points."""
    from compindex.workload.spatial import points

    rows = points(spark, sf)
    mean = lambda df: df.groupBy(F.col("nation").alias("key")).agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"))
    nations = X.table(spark, sf, "nation").select(F.col("n_nationkey").alias("key"))
    out = J.first_known(nations, "key", mean(rows.where(F.col("x") > 9500)), mean(rows), columns=["lon", "lat"])
    return out.select("key", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


@query(
    "snapshots_in_interval",
    """SELECT o_orderkey AS id, y.y AS snapshot FROM orders, (SELECT unnest([1994, 1996, 1998]) AS y) y WHERE y.y BETWEEN extract(year FROM o_orderdate) AND extract(year FROM o_orderdate) + 2""",
)
def snapshots_in_interval(spark, sf):
    rows = X.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.year("o_orderdate").alias("y"))
    out = P.snapshots_in_interval(rows, F.col("y"), F.col("y") + 2, [1994, 1996, 1998], "snapshot")
    return out.select("id", "snapshot")


@query("name_search", "SELECT c_custkey AS key, c_name AS name FROM customer WHERE contains(lower(c_name), '012') OR contains(lower(c_mktsegment), '012')")
def name_search(spark, sf):
    rows = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "c_mktsegment")
    return P.search(rows, " 012 ", ["name", "c_mktsegment"]).orderBy("name", "key").select("key", "name")


@query(
    "binary_flag",
    """SELECT c_custkey AS key, CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END AS DOUBLE) END AS flag FROM customer""",
)
def binary_flag(spark, sf):
    """1 for a listed known key, a true 0 for a known unlisted one, null for an unknown one."""
    from compindex.functions.scaling import either_flag

    known = X.table(spark, sf, "supplier").select(F.col("s_nationkey").alias("c_nationkey")).distinct().withColumn("known", F.lit(True))
    rows = X.table(spark, sf, "customer").join(known, "c_nationkey", "left")
    flag = either_flag(F.coalesce("known", F.lit(False)), F.col("c_mktsegment") == "BUILDING", F.col("c_mktsegment") == "MACHINERY")
    return rows.select(F.col("c_custkey").alias("key"), flag.alias("flag"))


_SHOWN = X.sql(
    "comp sig",
    """SELECT c.key, CASE WHEN composite >= 0.402 THEN 'high' WHEN composite >= 0.281 THEN 'mid' WHEN composite IS NOT NULL THEN 'low' END AS tier,
      CASE WHEN E - R > 0.06 THEN 'second' WHEN E - R < -0.06 THEN 'first' WHEN E IS NOT NULL AND R IS NOT NULL THEN 'balanced' END AS balance,
      CASE WHEN coalesce(o >= 0.5, FALSE) AND (i IS NULL OR i < 0.4) THEN 'outbound-source' WHEN coalesce(i >= 0.5, FALSE) AND (o IS NULL OR o < 0.4) THEN 'inbound-demand'
        WHEN coalesce(o >= 0.4 AND i >= 0.4, FALSE) THEN 'dual' ELSE 'neither' END AS role FROM comp c LEFT JOIN (SELECT key, max(value) FILTER (WHERE tbl = 'view' AND col = 'h0') AS o,
      max(value) FILTER (WHERE tbl = 'click' AND col = 'h1') AS i FROM sig GROUP BY key) s ON s.key = c.key""",
)


@query("score_labels", _SHOWN)
def score_labels(spark, sf):
    """Tier, balance of the halves and corridor role."""
    sig = X.signals(spark, sf)
    pick = lambda t, c, n: F.max(F.when((F.col("tbl") == t) & (F.col("col") == c), F.col("value"))).alias(n)
    sides = sig.groupBy("key").agg(pick("view", "h0", "o"), pick("click", "h1", "i"))
    rows = X.composite(spark, sf).join(sides, "key", "left")
    return rows.select(
        "key", B.tier(F.col("composite")).alias("tier"), B.balance(F.col("R"), F.col("E")).alias("balance"),
        B.corridor_role(F.col("o"), F.col("i")).alias("role"),
    )


@query(
    "lens_labels",
    X.sql("dom", """SELECT key, round(a, 8) AS first, round(b, 8) AS second, round(lens, 8) AS lens, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN a >= 0.66 AND b >= 0.66 THEN 'both high' WHEN a - b > 0.12 THEN 'first stronger'
        WHEN b - a > 0.12 THEN 'second stronger' WHEN a < 0.45 AND b < 0.45 THEN 'neither' ELSE 'both moderate' END WHEN a IS NOT NULL THEN CASE WHEN a >= 0.66 THEN 'first only, high' ELSE 'first only' END ELSE 'second only' END AS reading,
      row_number() OVER (ORDER BY lens DESC, key) <= 12 AS labelled FROM (SELECT *, coalesce((a + b) / 2, a, b) AS lens FROM (SELECT key, max(score) FILTER (WHERE domain = 'signup_night') AS a,
        max(score) FILTER (WHERE domain = 'error_single') AS b FROM dom GROUP BY key)) WHERE lens IS NOT NULL"""),
)
def lens_labels(spark, sf):
    out = Q.lens_table(X.domain_scores(spark, sf), "signup_night", "error_single")
    return out.select("key", r8("first"), r8("second"), r8("lens"), "reading", "labelled")


@query(
    "threshold_top_k",
    X.sql("sig", "SELECT key, round(value, 8) AS value, row_number() OVER (ORDER BY value DESC, key) <= 12 AS labelled FROM sig WHERE tbl = 'view' AND col = 'h0' AND value >= 0.15"),
)
def threshold_top_k(spark, sf):
    """Rows over a cut, the twelve largest labelled."""
    rows = cut_lineage(X.signals(spark, sf).where((F.col("tbl") == "view") & (F.col("col") == "h0") & (F.col("value") >= 0.15)).select("key", "value"))
    top = rows.orderBy(F.col("value").desc(), "key").limit(12).select("key", F.lit(True).alias("_top"))
    return rows.join(top, "key", "left").select("key", r8("value"), F.coalesce("_top", F.lit(False)).alias("labelled"))


@query(
    "rank_neighbours",
    X.sql("scored", f"""SELECT key, rank, above, below, coalesce(ta = t, FALSE) OR coalesce(tb = t, FALSE) AS same_tier FROM (SELECT *, lag(key) OVER (ORDER BY rank) AS above, lead(key) OVER (ORDER BY rank) AS below,
      lag(t) OVER (ORDER BY rank) AS ta, lead(t) OVER (ORDER BY rank) AS tb FROM (SELECT key, row_number() OVER (ORDER BY composite DESC, key) AS rank,
      CASE WHEN composite >= 0.402 THEN 'high' WHEN composite >= 0.281 THEN 'mid' ELSE 'low' END AS t FROM scored))"""),
)
def rank_neighbours(spark, sf):
    ranked = cut_lineage(R.rank_scored(X.scored(spark, sf), "composite", ["key"]).withColumn("tier", B.tier(F.col("composite"))).select("key", "rank", "tier"))
    out = R.neighbours(ranked, "key", ["tier"])
    same = F.coalesce(F.col("above_tier") == F.col("tier"), F.lit(False)) | F.coalesce(F.col("below_tier") == F.col("tier"), F.lit(False))
    return out.select("key", "rank", "above", "below", same.alias("same_tier"))


@query(
    "top_and_bottom",
    X.sql("scored", "(SELECT key, 'top' AS side FROM scored ORDER BY composite DESC, key LIMIT 10) UNION ALL (SELECT key, 'bottom' FROM scored ORDER BY composite, key LIMIT 10)"),
)
def top_and_bottom(spark, sf):
    rows = X.scored(spark, sf)
    return R.both_ends(rows, [F.col("composite").desc(), F.col("key")], [F.col("composite"), F.col("key")], 10).select("key", "side")


@query(
    "percentile_from_rank",
    X.sql("scored", "SELECT key, round(1 - (row_number() OVER (ORDER BY composite DESC, key) - 1) / ((SELECT count(*) FROM scored) - 1), 8) AS pct FROM scored"),
)
def percentile_from_rank(spark, sf):
    ranked = cut_lineage(R.rank_scored(X.scored(spark, sf), "composite", ["key"]).select("key", "rank"))
    n = ranked.agg(F.count(F.lit(1))).scalar()
    return ranked.select("key", F.round(R.percentile_from_rank(F.col("rank"), n), 8).alias("pct"))


@query(
    "rounded_rank",
    X.sql("scored", "SELECT key, round(composite, 2) AS shown, row_number() OVER (ORDER BY round(composite, 2) DESC, key) AS rank FROM scored"),
)
def rounded_rank(spark, sf):
    out = R.rank_rounded(X.scored(spark, sf), "composite", ["key"], 2)
    return out.select("key", F.round("composite", 2).alias("shown"), "rank")


@query(
    "domain_display_order",
    X.sql("dom", "SELECT key, domain, place FROM (SELECT key, domain, row_number() OVER (PARTITION BY key ORDER BY score DESC NULLS LAST, domain) AS place FROM dom)"),
)
def domain_display_order(spark, sf):
    """Highest domain first, unscored last, within each key's fixed domain list."""
    rows = X.domain_scores(spark, sf).select("key", "domain", F.round("score", 12).alias("score"))
    out = R.top_by_group(rows, ["key"], [F.col("score").desc_nulls_last(), F.col("domain")], len(X.DESIGN))
    return out.select("key", "domain", "place")


@query(
    "positional_numbers",
    X.sql("sig xw", """SELECT n.number, n.domain, n.tbl, n.col, count(s.key) AS n_keys FROM (SELECT domain, tbl, col, dense_rank() OVER (ORDER BY phase) || '.' || dense_rank() OVER (PARTITION BY phase ORDER BY domain) || '.' ||
      row_number() OVER (PARTITION BY domain ORDER BY pos) AS number FROM xw JOIN slots USING (domain)) n LEFT JOIN sig s USING (tbl, col) GROUP BY ALL""",
      {"slots": X.CTES["slots"][1]}),
)
def positional_numbers(spark, sf):
    phases = config_table(spark, [(d, p) for d, p, *_ in X.DESIGN], "domain string, phase string")
    numbered = R.positional_numbers(X.crosswalk(spark).join(phases, "domain"), "phase", "domain", "pos")
    counts = X.signals(spark, sf).groupBy("tbl", "col").agg(F.count("key").alias("n_keys"))
    return numbered.join(counts, ["tbl", "col"], "left").select("number", "domain", "tbl", "col", F.coalesce("n_keys", F.lit(0)).alias("n_keys"))


@query(
    "key_sets",
    X.sql("scored", """SELECT count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS n_left, count(*) FILTER (WHERE b AND NOT a) AS n_entered,
      round(count(*) FILTER (WHERE a AND b) / count(*) FILTER (WHERE a OR b), 8) AS jaccard FROM (SELECT key, ra <= 40 AS a, rb <= 40 AS b FROM (SELECT key, row_number() OVER (ORDER BY R DESC, key) AS ra,
      row_number() OVER (ORDER BY E DESC, key) AS rb FROM scored)) WHERE a OR b"""),
)
def key_sets(spark, sf):
    """Overlap, leavers and entrants of two top sets."""
    rows = cut_lineage(X.scored(spark, sf))
    top = lambda c: rows.orderBy(F.col(c).desc(), "key").limit(40).select("key")
    return R.jaccard(R.key_set_report(top("R"), top("E"), ["key"])).select("n_both", "n_left", "n_entered", r8("jaccard"))


@query(
    "category_counts",
    "SELECT c_mktsegment AS item, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, item LIMIT 3",
)
def category_counts(spark, sf):
    counts = X.table(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("item")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.col("n").desc(), "item").limit(3)


# --- text ------------------------------------------------------------------------------

# Ordered note rules of this workload.
NOTE_RULES = [(r"(?i)\bring\b", "loop"), (r"(?i)\(see [^)]*\.txt\)", ""), (r"(?i)\bwidget\b", "part")]


@query(
    "note_sanitiser",
    r"""SELECT p_partkey AS key, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(p_name || '  (see notes.txt) ; ring .', '\bring\b', 'loop', 'gi'), '\(see [^)]*\.txt\)', '', 'gi'),
      '\bwidget\b', 'part', 'gi'), '\s+([.;,)])', '\1', 'g'), '\s{2,}', ' ', 'g')) AS note FROM part""",
)
def note_sanitiser(spark, sf):
    text = F.concat(F.col("p_name"), F.lit("  (see notes.txt) ; ring ."))
    return X.table(spark, sf, "part").select(F.col("p_partkey").alias("key"), K.sanitised(text, NOTE_RULES).alias("note"))


@query(
    "text_cells",
    """SELECT c_custkey AS key, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN c_acctbal WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE NULL END AS number,
      CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 3 THEN 'twelve' WHEN 2 THEN CAST(c_acctbal AS VARCHAR) WHEN 4 THEN 'NaN' ELSE '-' END AS cleaned,
      CASE WHEN c_custkey % 6 <> 5 THEN 'k' END AS usable, lpad(CAST(c_nationkey AS VARCHAR), 6, '0') AS unit, CAST(c_custkey AS VARCHAR) AS tail,
      concat_ws('; ', CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_nationkey = 3 THEN 'third' END) AS flags FROM customer""",
)
def text_cells(spark, sf):
    """Cell rules: numbers from text, blank markers, keys, padded ids, id suffixes and flag lists."""
    k = F.col("c_custkey") % 6
    balance = F.col("c_acctbal").cast("string")
    cell = F.when(k == 0, "  ").when(k == 1, "n/a (none)").when(k == 2, balance).when(k == 3, "twelve").when(k == 4, "NaN").otherwise("-")
    rows = X.table(spark, sf, "customer").withColumn("cell", cell)
    return rows.select(
        F.col("c_custkey").alias("key"), K.to_double(F.col("cell")).alias("number"), K.blank_marker_to_null(F.col("cell")).alias("cleaned"),
        K.usable_key(F.when(k == 5, "-").otherwise(" k ")).alias("usable"),
        K.unit_id(F.concat(F.col("c_nationkey").cast("string"), F.lit(".0"))).alias("unit"),
        K.last_part(F.concat(F.lit("2010-x-"), F.col("c_custkey").cast("string"))).alias("tail"),
        K.joined_flags(F.when(F.col("c_acctbal") < 0, "negative"), F.lit(" "), F.when(F.col("c_nationkey") == 3, "third")).alias("flags"),
    )


@query(
    "suffix_event_counts",
    """WITH e AS (SELECT CASE l_returnflag WHEN 'A' THEN 'AAA' WHEN 'N' THEN 'NNN' ELSE 'RRR' END AS grp, l_quantity FROM lineitem),
      g AS (SELECT * FROM (VALUES ('AAA'), ('NNN'), ('RRR'), ('ZZZ')) t(grp))
    SELECT g.grp, count(*) FILTER (WHERE e.l_quantity >= 45) AS n_hot, count(e.grp) > 0 AS in_layer FROM g LEFT JOIN e USING (grp) GROUP BY 1""",
)
def suffix_event_counts(spark, sf):
    """Significant events per key taken from an id suffix; a malformed key would fail the job."""
    disno = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.repeat(F.col("l_returnflag"), 3))
    grp = K.require_clean_key(K.last_part(disno))
    events = X.table(spark, sf, "lineitem").select(grp.alias("grp"), F.when(F.col("l_quantity") >= 45, "95%").otherwise("ns").alias("hot"))
    groups = config_table(spark, [("AAA",), ("NNN",), ("RRR",), ("ZZZ",)], "grp string")
    return Q.event_marks(groups, events, "grp")


# Labels of the phases.
PHASE_LABELS = [("R", "Recruitment"), ("E", "Exploitation")]


@query(
    "label_lookup",
    X.sql("phase", "SELECT key, coalesce(l.label, phase) AS label, round(score, 8) AS score FROM phase LEFT JOIN " + values_sql(PHASE_LABELS, ["p", "label"], "l") + " ON l.p = phase"),
)
def label_lookup(spark, sf):
    labels = config_table(spark, PHASE_LABELS, "phase string, label string")
    rows = C.phase_scores(X.domain_scores(spark, sf), X.TOTALS).join(labels, "phase", "left")
    return rows.select("key", F.coalesce("label", F.col("phase")).alias("label"), r8("score"))
