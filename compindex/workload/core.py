"""Latest values, scaling, domains, phases, composite and ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from compindex.config import config_table, values_sql
from compindex.functions import cleaning as K
from compindex.functions import labels as B
from compindex.functions import scaling as S
from compindex.operators import compose as C
from compindex.operators import latest as L
from compindex.operators import order as O
from compindex.operators import ranking as R
from compindex.operators import scale as N
from compindex.workload import fixtures as X
from compindex.workload.registry import query


def r8(name: str, alias: str | None = None):
    return F.round(F.col(name), 8).alias(alias or name)


# --- latest observations ---------------------------------------------------------------


@query("latest_value", X.sql("lat", "SELECT key, series, year, seq, value FROM lat"))
def latest_value(spark, sf):
    return L.latest_value(X.observations(spark, sf), ["key", "series"])


@query(
    "latest_value_span",
    X.sql("lat", "SELECT series, count(*) AS n, min(year) AS year_min, max(year) AS year_max FROM lat GROUP BY series"),
)
def latest_value_span(spark, sf):
    return L.winner_span(L.latest_value(X.observations(spark, sf), ["key", "series"]), ["series"])


@query(
    "latest_in_slice",
    X.sql(
        "",
        """SELECT key, year, seq, value FROM (SELECT l_suppkey AS key, CAST(extract(year FROM l_shipdate) AS INTEGER) AS year,
        l_orderkey * 10 + l_linenumber AS seq, l_extendedprice AS value, row_number() OVER (PARTITION BY l_suppkey
        ORDER BY extract(year FROM l_shipdate) DESC, l_orderkey * 10 + l_linenumber, l_extendedprice DESC) AS rn FROM lineitem
        WHERE l_returnflag = 'A' AND l_linestatus = 'O') WHERE rn = 1""",
    ),
)
def latest_in_slice(spark, sf):
    """Dimension filters by configuration (an absent column or null value is skipped), then the latest row."""
    from compindex.operators.filters import dimension_filter

    wanted = {"l_returnflag": "A", "l_linestatus": "O", "l_channel": "web", "l_tax": None}
    rows = dimension_filter(X.table(spark, sf, "lineitem"), wanted)
    rows = rows.select(
        F.col("l_suppkey").alias("key"), F.year("l_shipdate").alias("year"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.col("l_extendedprice").alias("value"),
    )
    return L.latest_value(rows, ["key"])


@query(
    "latest_last_wins",
    X.sql(
        "obs",
        """SELECT key, series, year, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key, series
        ORDER BY year DESC, seq DESC) AS rn FROM obs WHERE value IS NOT NULL) WHERE rn = 1""",
    ),
)
def latest_last_wins(spark, sf):
    return L.latest_value(X.observations(spark, sf), ["key", "series"], last_wins=True)


_PREFERRED = """SELECT key, series, year, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key, series
    ORDER BY (year = 27) DESC, year DESC, seq) AS rn FROM obs WHERE value IS NOT NULL) WHERE rn = 1"""


@query("latest_preferred_wave", X.sql("obs", _PREFERRED))
def latest_preferred_wave(spark, sf):
    return L.latest_value(X.observations(spark, sf), ["key", "series"], preferred=27)


@query(
    "stale_wave_count",
    X.sql("obs", f"SELECT series, count(*) FILTER (WHERE year <> 27) AS n_stale, count(*) AS n FROM ({_PREFERRED}) GROUP BY 1"),
)
def stale_wave_count(spark, sf):
    return L.stale_count(latest_preferred_wave(spark, sf), ["series"], 27)


@query(
    "latest_stock_span",
    X.sql(
        "obs lat",
        """SELECT l.key, l.series, l.value, l.year, s.scan_min, s.scan_max FROM lat l JOIN (SELECT key, series,
        min(year) AS scan_min, max(year) AS scan_max FROM obs GROUP BY 1, 2) s USING (key, series)""",
    ),
)
def latest_stock_span(spark, sf):
    return L.latest_stock(X.observations(spark, sf), ["key", "series"])


@query(
    "latest_of_columns",
    X.sql(
        "",
        """SELECT key, variable, year, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key, variable
        ORDER BY year DESC, seq) AS rn FROM (
          SELECT o_custkey AS key, CAST(extract(year FROM o_orderdate) AS INTEGER) AS year, o_orderkey AS seq,
            unnest(['price', 'open_price']) AS variable,
            unnest([o_totalprice, CASE WHEN o_orderstatus = 'O' THEN o_totalprice END]) AS value
          FROM orders) WHERE value IS NOT NULL AND year >= 1996) WHERE rn = 1""",
    ),
)
def latest_of_columns(spark, sf):
    rows = X.table(spark, sf, "orders").select(
        F.col("o_custkey").alias("key"), F.year("o_orderdate").alias("year"), F.col("o_orderkey").alias("seq"),
        F.col("o_totalprice").alias("price"),
        F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).alias("open_price"),
    )
    return L.latest_of_columns(rows, ["key"], ["price", "open_price"], "year", "seq", least_time=1996)


@query(
    "volatility",
    X.sql(
        "",
        """SELECT key, count(*) AS n, round(stddev_pop(value), 8) AS volatility FROM (SELECT user_id AS key, value,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value IS NOT NULL)
        WHERE rn <= 15 GROUP BY key HAVING count(*) >= 5""",
    ),
)
def volatility(spark, sf):
    rows = X.table(spark, sf, "events").select(F.col("user_id").alias("key"), "ts", "event_id", "value")
    out = L.volatility(rows, ["key"], [F.col("ts").desc(), F.col("event_id").desc()])
    return out.select("key", "n", r8("volatility"))


@query(
    "event_exposure",
    X.sql(
        "",
        """SELECT s.s_suppkey AS key, round(coalesce(e.amount, 0.0), 2) AS amount,
        CASE WHEN s.s_acctbal > 0 THEN round(coalesce(e.amount, 0.0) / s.s_acctbal * 100000, 4) END AS rate
        FROM supplier s LEFT JOIN (SELECT l_suppkey, sum(l_quantity) AS amount FROM lineitem
          WHERE extract(year FROM l_shipdate) BETWEEN 1994 AND 1996 AND l_returnflag IN ('R', 'N')
            AND NOT coalesce(regexp_matches(l_linestatus, '(?i)f'), FALSE) GROUP BY 1) e ON e.l_suppkey = s.s_suppkey""",
    ),
)
def event_exposure(spark, sf):
    """Year range, category set and excluded pattern, then events per exposure unit with true zeros."""
    rows = X.table(spark, sf, "lineitem").where(
        F.year("l_shipdate").between(1994, 1996)
        & F.col("l_returnflag").isin("R", "N")
        & K.lacks_pattern(F.col("l_linestatus"), "f")
    )
    events = rows.select(F.col("l_suppkey").alias("key"), F.col("l_quantity").alias("quantity"))
    people = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("pop"))
    out = L.event_exposure(events, people, ["key"], "quantity", "pop")
    return out.select("key", F.round("amount", 2).alias("amount"), F.round("rate", 4).alias("rate"))


@query(
    "category_weighted_sum",
    X.sql(
        "",
        """SELECT o_custkey AS key, round(sum(CASE o_orderstatus WHEN 'O' THEN 1.0 WHEN 'P' THEN 0.5 ELSE 0.0 END
        * o_totalprice), 4) AS weighted_size FROM orders
        WHERE o_orderdate <= TIMESTAMP '1997-07-01' AND o_orderdate + INTERVAL 730 DAY >= TIMESTAMP '1997-07-01' GROUP BY 1""",
    ),
)
def category_weighted_sum(spark, sf):
    """Intervals that contain a snapshot date, then a category-weighted sum with real zeros."""
    from compindex.operators.filters import stabbed_by

    when = F.lit("1997-07-01").cast("timestamp_ntz")
    rows = X.table(spark, sf, "orders").withColumn("until", F.expr("o_orderdate + INTERVAL 730 DAY"))
    rows = rows.where(stabbed_by(F.col("o_orderdate"), F.col("until"), when))
    rows = rows.select(F.col("o_custkey").alias("key"), "o_orderstatus", "o_totalprice")
    out = L.category_weighted_sum(rows, ["key"], "o_orderstatus", "o_totalprice", {"O": 1.0, "P": 0.5})
    return out.select("key", F.round("weighted_size", 4).alias("weighted_size"))


_CELLS = """SELECT area, grp, sector, value FROM (SELECT l_suppkey AS area, l_linestatus AS grp,
  CASE WHEN l_linenumber = 7 THEN 'total' ELSE 's' || CAST(l_linenumber AS VARCHAR) END AS sector, l_extendedprice AS value,
  row_number() OVER (PARTITION BY l_suppkey, l_linestatus, l_linenumber
    ORDER BY extract(year FROM l_shipdate) DESC, l_orderkey, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1"""


_SHARES = f"""WITH c AS ({_CELLS}), w AS (SELECT area,
      max(value) FILTER (WHERE grp = 'O' AND sector = 'total') AS ot, max(value) FILTER (WHERE grp = 'O' AND sector = 's1') AS o1,
      max(value) FILTER (WHERE grp = 'O' AND sector = 's2') AS o2, max(value) FILTER (WHERE grp = 'O' AND sector = 's3') AS o3,
      max(value) FILTER (WHERE grp = 'F' AND sector = 'total') AS ft, max(value) FILTER (WHERE grp = 'F' AND sector = 's1') AS f1,
      max(value) FILTER (WHERE grp = 'F' AND sector = 's4') AS f4 FROM c GROUP BY area),
    s AS (SELECT area, CASE WHEN ot > 0 THEN (o1 + o2 + o3) / ot END AS a,
      CASE WHEN ft > 0 THEN (f1 + coalesce(f4, 0.0)) / ft END AS b FROM w)
"""


@query(
    "channel_share",
    _SHARES + """SELECT area, round(least(1.0, greatest(a, b)), 8) AS share FROM s WHERE greatest(a, b) IS NOT NULL""",
)
def channel_share(spark, sf):
    return _channel_share(_sector_rows(spark, sf)).select("area", r8("share"))


def _sector_rows(spark, sf):
    return X.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("area"), F.col("l_linestatus").alias("grp"),
        F.when(F.col("l_linenumber") == 7, "total").otherwise(F.concat(F.lit("s"), F.col("l_linenumber"))).alias("sector"),
        F.year("l_shipdate").alias("year"), F.col("l_orderkey").alias("seq"), F.col("l_extendedprice").alias("value"),
    )


def _channel_share(rows):
    cells = L.latest_value(rows, ["area", "grp", "sector"])
    channels = {"O": {"required": ["s1", "s2", "s3"]}, "F": {"required": ["s1"], "optional": ["s4"]}}
    return L.channel_share(cells, "area", "grp", "sector", "value", channels, "total")


@query(
    "channel_share_by_key",
    _SHARES + "SELECT CAST(s_nationkey AS INTEGER) AS key, max(round(least(1.0, greatest(a, b)), 8)) AS share FROM s JOIN supplier ON s_suppkey = area WHERE greatest(a, b) IS NOT NULL AND s_nationkey % 4 <> 1 GROUP BY 1",
)
def channel_share_by_key(spark, sf):
    """Areas as keys: several areas map to one key, some to none."""
    areas = X.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("area"), F.when(F.col("s_nationkey") % 4 != 1, F.col("s_nationkey")).cast("int").alias("key")
    )
    return L.largest_per_key(_channel_share(_sector_rows(spark, sf)), areas, "area").select("key", r8("share"))


# --- scaling ---------------------------------------------------------------------------

_SCORE = (
    "CASE WHEN series IN ('purchase', 'signup') THEN 1.0 - least(1.0, greatest(0.0, value / 150.0)) "
    "ELSE least(1.0, greatest(0.0, value / 150.0)) END"
)


@query(
    "anchor_scale",
    X.sql("uni lat", f"SELECT u.key, l.series, CASE WHEN l.value IS NOT NULL THEN round({_SCORE}, 8) END AS score "
          "FROM uni u LEFT JOIN lat l ON l.key = u.key"),
)
def anchor_scale(spark, sf):
    """Latest values, scaled against anchors and densified to the universe (missing stays null)."""
    latest = L.latest_value(X.observations(spark, sf), ["key", "series"])
    scaled = N.anchor_scale(latest, X.spec(spark)).select("key", "series", r8("score"))
    return N.densify(X.universe(spark, sf), scaled)


@query(
    "coverage_meta",
    X.sql(
        "uni lat",
        """SELECT series, n_present, n_total, coverage_pct, below_floor, CASE WHEN below_floor THEN
          'BELOW-COVERAGE-FLOOR (' || n_present || '/' || n_total || '; floor 50%/min 2) -- low-confidence' ELSE '' END AS flags
        FROM (SELECT series, n_present, n_total, round(100.0 * n_present / n_total, 8) AS coverage_pct,
                     n_present / n_total < 0.5 OR n_present < 2 AS below_floor
              FROM (SELECT series, count(value) AS n_present, (SELECT count(*) FROM uni) AS n_total FROM lat GROUP BY series))""",
    ),
)
def coverage_meta(spark, sf):
    latest = L.latest_value(X.observations(spark, sf), ["key", "series"])
    scaled = N.anchor_scale(latest, X.spec(spark))
    meta = N.coverage_meta(scaled, X.universe_size(spark, sf), X.spec(spark))
    return meta.select("series", "n_present", "n_total", r8("coverage_pct"), "below_floor", "flags")


@query(
    "winsor_minmax",
    X.sql(
        "lat",
        """SELECT l.key, l.series, round(least(1.0, greatest(0.0, (l.value - q.lo) / CASE WHEN q.hi - q.lo = 0 THEN 1.0
          ELSE q.hi - q.lo END)), 8) AS score FROM lat l JOIN (SELECT series, quantile_cont(value, 0.05) AS lo,
          quantile_cont(value, 0.95) AS hi FROM lat GROUP BY series) q USING (series)""",
    ),
)
def winsor_minmax(spark, sf):
    latest = L.latest_value(X.observations(spark, sf), ["key", "series"])
    return N.winsor_minmax(latest, ["series"]).select("key", "series", r8("score"))


@query(
    "relative_scale_meta",
    X.sql("uni lat", """SELECT series, CASE WHEN series IN ('purchase', 'signup') THEN 'low_risk' ELSE 'high_risk' END AS direction, 'relative:winsor_minmax' AS method, round(pct, 8) AS coverage_pct, n_present, n_total, below AS below_floor,
      'RELATIVE-FALLBACK (winsor_minmax) -- no absolute anchor; not comparable across refreshes' || CASE WHEN below THEN '|BELOW-COVERAGE-FLOOR (' || n_present || '/' || n_total || ' = ' || printf('%.0f', pct) || '%) -- low-confidence' ELSE '' END AS flags
      FROM (SELECT *, 100.0 * n_present / n_total AS pct, n_present / n_total < 0.5 OR n_present < 2 AS below FROM (SELECT series, count(value) AS n_present, (SELECT count(*) FROM uni) AS n_total FROM lat WHERE key % 3 = 0 OR series <> 'view' GROUP BY series))"""),
)
def relative_scale_meta(spark, sf):
    """Coverage of the relative scale; one series lost most of its keys, so that both flags occur."""
    latest = L.latest_value(X.observations(spark, sf), ["key", "series"]).where((F.col("key") % 3 == 0) | (F.col("series") != "view"))
    scaled = N.winsor_minmax(latest, ["series"])
    meta = N.relative_meta(scaled, X.universe_size(spark, sf), X.spec(spark), "winsor_minmax")
    return meta.withColumn("flags", F.array_join("flags", "|")).withColumn("coverage_pct", F.round("coverage_pct", 8))


@query(
    "percentile_scale",
    X.sql("lat", "SELECT key, series, round(percent_rank() OVER (PARTITION BY series ORDER BY value), 8) AS score FROM lat"),
)
def percentile_scale(spark, sf):
    latest = L.latest_value(X.observations(spark, sf), ["key", "series"])
    return N.percentile_scale(latest, ["series"]).select("key", "series", r8("score"))


@query(
    "minmax_inverted",
    X.sql(
        "lat",
        """SELECT key, series, round(1.0 - (value - lo) / CASE WHEN hi = lo THEN 1.0 ELSE hi - lo END, 8) AS score
        FROM lat JOIN (SELECT series, min(value) AS lo, max(value) AS hi FROM lat GROUP BY 1) USING (series)""",
    ),
)
def minmax_inverted(spark, sf):
    latest = L.latest_value(X.observations(spark, sf), ["key", "series"])
    return N.minmax(latest, ["series"], inverted=True).select("key", "series", r8("score"))


@query(
    "scalar_transforms",
    X.sql(
        "",
        """SELECT c_custkey AS key, round(CASE WHEN s < 0.2 THEN s * s / 0.2 ELSE s END, 8) AS ramp,
          round(CASE WHEN s <= 0.7 THEN s ELSE 0.7 - (s - 0.7) / (1.0 - 0.7) * (0.5 * 0.7) END, 8) AS humped, s AS gate_off,
          round(1.0 - s, 8) AS complement, round(s + coalesce(t, 0.0), 8) AS plus_optional,
          CASE WHEN s IS NOT NULL THEN least(1.0, greatest(0.0, c_acctbal / 5000.0)) END AS clipped,
          round(1.0 + log10(1.0 + greatest(coalesce(c_acctbal, 0.0), 0.0)), 8) AS severity
        FROM (SELECT *, round(CASE WHEN c_acctbal >= 0 THEN least(1.0, c_acctbal / 10000.0) END, 8) AS s,
          CASE WHEN c_mktsegment = 'BUILDING' THEN 0.25 END AS t FROM customer)""",
    ),
)
def scalar_transforms(spark, sf):
    rows = X.table(spark, sf, "customer")
    share = F.round(F.when(F.col("c_acctbal") >= 0, F.least(F.lit(1.0), F.col("c_acctbal") / 10000.0)), 8)
    rows = rows.withColumn("s", share).withColumn("t", F.when(F.col("c_mktsegment") == "BUILDING", 0.25))
    s = F.col("s")
    return rows.select(
        F.col("c_custkey").alias("key"),
        F.round(S.materiality_ramp(s), 8).alias("ramp"),
        F.round(S.hump(s, True), 8).alias("humped"),
        S.hump(s, False).alias("gate_off"),
        F.round(S.complement(s), 8).alias("complement"),
        F.round(S.plus_optional(s, F.col("t")), 8).alias("plus_optional"),
        F.when(s.isNotNull(), S.clamp(F.col("c_acctbal") / 5000.0)).alias("clipped"),
        F.round(S.severity_weight(F.col("c_acctbal")), 8).alias("severity"),
    )


@query(
    "log_index",
    """WITH e AS (SELECT l_suppkey AS key, count(*) AS n FROM lineitem GROUP BY 1)
    SELECT key, n, round(ln(1 + n) / ln(1 + (SELECT max(n) FROM e)), 8) AS idx FROM e""",
)
def log_index(spark, sf):
    counts = X.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return N.log_index(counts, "n", "idx").select("key", "n", r8("idx"))


@query(
    "per_capita_scale",
    """SELECT key, round(value, 4) AS value, CASE WHEN pop > 0 THEN round(least(1.0, greatest(0.0, value / pop / 500.0)), 8) END AS score,
      'absolute' AS method FROM (SELECT s_suppkey AS key, s_acctbal AS pop,
      (SELECT sum(l_quantity) FROM lineitem WHERE l_suppkey = s_suppkey) AS value FROM supplier) WHERE value IS NOT NULL""",
)
def per_capita_scale(spark, sf):
    values = X.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum("l_quantity").alias("value"))
    people = X.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("population"))
    out = N.per_capita_or_relative(values, people, "key", {"floor": 0.0, "ceiling": 500.0})
    return out.select("key", F.round("value", 4).alias("value"), r8("score"), "method")


@query(
    "relative_fallback_scale",
    """WITH v AS (SELECT l_suppkey AS key, sum(l_quantity) AS value FROM lineitem GROUP BY 1),
    q AS (SELECT quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM v)
    SELECT key, round(value, 4) AS value, round(1 - least(1.0, greatest(0.0, (value - lo) / (hi - lo))), 8) AS score,
      'relative:winsor_minmax' AS method, 'no per-capita base: relative scale of raw counts' AS flag FROM v, q""",
)
def relative_fallback_scale(spark, sf):
    values = X.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("key")).agg(F.sum("l_quantity").alias("value"))
    out = N.per_capita_or_relative(values, None, "key", {"direction": "low_risk"})
    return out.select("key", F.round("value", 4).alias("value"), r8("score"), "method", "flag")


@query(
    "row_drop_and_average",
    X.sql(
        "sig uni",
        """SELECT key, n, round(CASE WHEN n > 0 THEN total / n END, 8) AS mean, round(100.0 * n / 3, 8) AS pct,
          n < 2 OR n / 3 < 0.5 AS below, CASE WHEN n >= 2 THEN round(total / n, 8) END AS idx
        FROM (SELECT key, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS n,
          coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0) AS total FROM (SELECT u.key,
          max(value) FILTER (WHERE tbl = 'view' AND col = 'h0') AS a, max(value) FILTER (WHERE tbl = 'click' AND col = 'h1') AS b,
          max(value) FILTER (WHERE tbl = 'error' AND col = 'h2') AS c FROM uni u LEFT JOIN sig ON sig.key = u.key GROUP BY u.key))""",
    ),
)
def row_drop_and_average(spark, sf):
    sig = X.signals(spark, sf)
    pick = lambda t, c, n: F.max(F.when((F.col("tbl") == t) & (F.col("col") == c), F.col("value"))).alias(n)
    wide = sig.groupBy("key").agg(pick("view", "h0", "a"), pick("click", "h1", "b"), pick("error", "h2", "c"))
    rows = N.densify(X.universe(spark, sf), wide)
    values = [F.col("a"), F.col("b"), F.col("c")]
    n, mean = S.present_count(values), S.present_mean(values)
    return rows.select(
        "key", n.alias("n"), F.round(mean, 8).alias("mean"), F.round(S.coverage_percent(n, F.lit(3)), 8).alias("pct"),
        S.below_coverage(n, F.lit(3)).alias("below"), F.when(n >= 2, F.round(mean, 8)).alias("idx"),
    )


# --- domains, phases, composite --------------------------------------------------------


@query(
    "domain_mean",
    X.sql("dom", "SELECT key, domain, phase, n_present, n_total, round(raw, 8) AS raw, scored, round(score, 8) AS score, "
          "coverage_flag FROM dom"),
)
def domain_mean(spark, sf):
    out = X.domain_scores(spark, sf)
    return out.select("key", "domain", "phase", "n_present", "n_total", r8("raw"), "scored", r8("score"), "coverage_flag")


@query(
    "attenuated_domains",
    X.sql("dom ref", "SELECT d.key, d.domain, g IS NOT NULL AS attenuated, round(d.score * CASE WHEN g IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, g)) END, 8)"
          " AS score FROM dom d LEFT JOIN ref ON ref.key = d.key"),
)
def attenuated_domains(spark, sf):
    out = C.attenuate(X.domain_scores(spark, sf), X.modulator(spark, sf))
    return out.select("key", "domain", "attenuated", r8("score"))


@query(
    "phase_mean",
    X.sql("phase", "SELECT key, phase, n_domains_scored, n_domains_total, round(score, 8) AS score FROM phase"),
)
def phase_mean(spark, sf):
    out = C.phase_scores(X.domain_scores(spark, sf), X.TOTALS)
    return out.select("key", "phase", "n_domains_scored", "n_domains_total", r8("score"))


@query(
    "composite_rank",
    X.sql("comp", "SELECT key, round(R, 8) AS R, round(E, 8) AS E, round(composite, 8) AS composite, "
          "row_number() OVER (ORDER BY composite DESC, key) AS rank FROM comp WHERE composite IS NOT NULL"),
)
def composite_rank(spark, sf):
    out = R.rank_scored(X.composite(spark, sf), "composite", ["key"])
    return out.select("key", r8("R"), r8("E"), r8("composite"), "rank")


@query(
    "locked_composite_rank",
    X.sql(
        "dom ref",
        """SELECT key, round(composite, 8) AS composite, row_number() OVER (ORDER BY composite DESC, key) AS rank FROM c
        WHERE composite IS NOT NULL""",
        {
            "att": "SELECT d.key, d.phase, d.score * CASE WHEN g IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, g)) END AS score FROM dom d "
                   "LEFT JOIN ref ON ref.key = d.key WHERE d.in_composite",
            "ph": "SELECT key, phase, CASE WHEN count(score) >= 2 AND count(score) >= 0.5 * count(*) THEN avg(score) END AS score "
                  "FROM att GROUP BY 1, 2",
            "c": "SELECT key, sqrt(max(score) FILTER (WHERE phase = 'R') * max(score) FILTER (WHERE phase = 'E')) AS composite "
                 "FROM ph GROUP BY key",
        },
    ),
)
def locked_composite_rank(spark, sf):
    domains = C.attenuate(X.domain_scores(spark, sf), X.modulator(spark, sf))
    out = C.composite(C.phase_scores(domains, X.TOTALS).where("in_composite"), list(X.PHASES))
    return R.rank_scored(out, "composite", ["key"]).select("key", r8("composite"), "rank")


@query(
    "flag_rollup",
    X.sql(
        "dom",
        """SELECT key, array_to_string(list_sort(list(domain) FILTER (WHERE scored AND coverage_flag IN ('low_confidence',
        'insufficient_data'))), ',') AS low_conf, array_to_string(list_sort(list(domain) FILTER (WHERE NOT scored)), ',') AS not_scored,
        count(*) FILTER (WHERE scored AND coverage_flag IN ('low_confidence', 'insufficient_data')) AS domains_low_conf,
        count(*) FILTER (WHERE NOT scored) AS domains_not_scored, count(*) FILTER (WHERE NOT scored) >= 2 AS low_confidence
        FROM dom WHERE in_composite GROUP BY key""",
    ),
)
def flag_rollup(spark, sf):
    out = C.flag_rollup(X.domain_scores(spark, sf))
    listed = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return out.select(
        "key", listed("low_conf").alias("low_conf"), listed("not_scored_domains").alias("not_scored"),
        "domains_low_conf", "domains_not_scored", B.low_confidence(F.col("domains_not_scored")).alias("low_confidence"),
    )
