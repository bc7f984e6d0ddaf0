"""How the given tables play the roles of an indicator build, in Spark and in SQL.

Observations come from ``events``: user = key, event type = series, day = year, event id =
read order. The universe is every customer; most have no events, so missingness is real.
Signals are the latest value per user, event type and three-hour slot of the day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from compindex.config import config_table, values_sql
from compindex.operators import compose as C
from compindex.operators import latest as L
from compindex.operators import scale as N

TYPES = ("click", "error", "purchase", "signup", "view")
SLOTS = 8
CEILING = 150.0
LOW_RISK = ("purchase", "signup")
REFERENCE = ("signup", "h3")
PHASES = ("R", "E")

# Domain, phase, in composite, confidence, signals.
DESIGN = [
    ("view_day", "R", True, "ok", [("view", f"h{i}") for i in (2, 3, 4, 5)]),
    ("view_night", "R", True, "ok", [("view", f"h{i}") for i in (0, 1, 6)]),
    ("click_day", "R", True, "ok", [("click", f"h{i}") for i in (2, 3, 4, 5)]),
    ("click_night", "R", True, "low_confidence", [("click", f"h{i}") for i in (0, 1, 6)] + [("view", "h0")]),
    ("signup_day", "R", True, "ok", [("signup", f"h{i}") for i in (2, 3, 4, 5)]),
    ("view_single", "R", True, "low_confidence", [("view", "h7")]),
    ("error_day", "E", True, "ok", [("error", f"h{i}") for i in (2, 3, 4, 5)]),
    ("error_night", "E", True, "insufficient_data", [("error", f"h{i}") for i in (0, 1, 6)]),
    ("purchase_day", "E", True, "ok", [("purchase", f"h{i}") for i in (2, 3, 4, 5)]),
    ("purchase_pair", "E", True, "ok", [("purchase", "h0"), ("purchase", "h1")]),
    ("click_single", "E", True, "low_confidence", [("click", "h7")]),
    ("signup_night", "M", False, "ok", [("signup", f"h{i}") for i in (0, 1, 6, 7)]),
    ("error_single", "M", False, "low_confidence", [("error", "h7")]),
]
CROSSWALK = [
    (domain, pos, tbl, col)
    for domain, _, _, _, signals in DESIGN
    for pos, (tbl, col) in enumerate(signals)
]
TOTALS = C.phase_totals(DESIGN)
SLOT_ROWS = [(domain, phase, conf, len(sig), inside) for domain, phase, inside, conf, sig in DESIGN]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def observations(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date"))
    return table(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("series"), day.alias("year"),
        F.col("event_id").alias("seq"), "value",
    )


def universe(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("key"))


def universe_size(spark: SparkSession, sf: str) -> DataFrame:
    return universe(spark, sf).agg(F.count(F.lit(1)).alias("n_total"))


def spec(spark: SparkSession) -> DataFrame:
    return N.anchor_spec(
        spark,
        [
            {
                "series": t, "floor": 0.0, "ceiling": CEILING,
                "direction": "low_risk" if t in LOW_RISK else "high_risk", "unit": "value per event",
            }
            for t in TYPES
        ],
    )


def signals(spark: SparkSession, sf: str) -> DataFrame:
    """(key, tbl, col, value): the scaled signal table."""
    slot = F.concat(F.lit("h"), F.floor(F.hour("ts") / 3).cast("string"))
    raw = table(spark, sf, "events").select(
        F.col("user_id").alias("key"), F.col("event_type").alias("tbl"), slot.alias("col"), "ts",
        F.col("event_id").alias("seq"), "value",
    )
    latest = L.latest_value(raw, ["key", "tbl", "col"], time="ts")
    scaled = N.anchor_scale(latest, spec(spark), series="tbl")
    return scaled.select("key", "tbl", "col", F.col("score").alias("value"))


def crosswalk(spark: SparkSession) -> DataFrame:
    return config_table(spark, CROSSWALK, "domain string, pos int, tbl string, col string")


def modulator(spark: SparkSession, sf: str) -> DataFrame:
    ref = signals(spark, sf).where((F.col("tbl") == REFERENCE[0]) & (F.col("col") == REFERENCE[1]))
    return ref.select("key", F.col("value").alias("g"))


def domain_scores(spark: SparkSession, sf: str) -> DataFrame:
    return C.domain_scores(signals(spark, sf), DESIGN, universe(spark, sf))


def composite(spark: SparkSession, sf: str) -> DataFrame:
    """key, R, E, composite for the whole universe."""
    phases = C.phase_scores(domain_scores(spark, sf), TOTALS).where("in_composite")
    return C.composite(phases, list(PHASES))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    return composite(spark, sf).where(F.col("composite").isNotNull())


def located(df: DataFrame, key: str = "key") -> DataFrame:
    """Longitude and latitude spread over the map by key."""
    lon = ((F.col(key) * 137) % 3600).cast("double") / 10.0 - 180.0
    lat = ((F.col(key) * 71) % 1400).cast("double") / 10.0 - 70.0
    return df.select("*", lon.alias("lon"), lat.alias("lat"))


# --- the same roles as SQL -------------------------------------------------------------

_slots = [(d, p, c, t, i) for d, p, c, t, i in SLOT_ROWS]
_SCALED = (
    "CASE WHEN tbl IN ('purchase', 'signup') THEN 1.0 - least(1.0, greatest(0.0, value / 150.0)) "
    "ELSE least(1.0, greatest(0.0, value / 150.0)) END"
)

CTES: dict[str, tuple[list[str], str]] = {
    "obs": (
        [],
        "SELECT user_id AS key, event_type AS series, CAST(date_diff('day', TIMESTAMP '2024-01-01', ts) AS INTEGER)"
        " AS year, event_id AS seq, value FROM events",
    ),
    "uni": ([], "SELECT c_custkey AS key FROM customer"),
    "lat": (
        ["obs"],
        "SELECT key, series, year, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY key, series "
        "ORDER BY year DESC, seq) AS rn FROM obs WHERE value IS NOT NULL) WHERE rn = 1",
    ),
    "sig": (
        [],
        f"SELECT key, tbl, col, {_SCALED} AS value FROM (SELECT user_id AS key, event_type AS tbl, "
        "'h' || CAST(CAST(floor(extract(hour FROM ts) / 3) AS INTEGER) AS VARCHAR) AS col, value, row_number() OVER "
        "(PARTITION BY user_id, event_type, floor(extract(hour FROM ts) / 3) ORDER BY ts DESC, event_id) AS rn "
        "FROM events WHERE value IS NOT NULL) WHERE rn = 1",
    ),
    "xw": ([], "SELECT * FROM " + values_sql(CROSSWALK, ["domain", "pos", "tbl", "col"])),
    "slots": (
        [],
        "SELECT * FROM " + values_sql(_slots, ["domain", "phase", "confidence", "n_total", "in_composite"]),
    ),
    "dom": (
        ["sig", "xw", "slots", "uni"],
        """SELECT key, domain, phase, in_composite, confidence, n_present, n_total, raw, scored,
          CASE WHEN scored THEN raw END AS score,
          CASE WHEN NOT scored THEN 'not_scored_coverage'
               WHEN confidence = 'insufficient_data' THEN 'insufficient_data'
               WHEN confidence = 'low_confidence' OR (n_total = 1 AND n_present = 1)
                 OR NOT (n_present >= 2 AND n_present >= greatest(2, 0.5 * n_total)) THEN 'low_confidence'
               ELSE 'ok' END AS coverage_flag
        FROM (SELECT *, (n_present >= 2 AND n_present >= greatest(2, 0.5 * n_total))
                     OR (n_total = 1 AND n_present = 1) AS scored
              FROM (SELECT u.key, s.domain, s.phase, s.in_composite, s.confidence, s.n_total,
                           count(g.value) AS n_present, avg(g.value) AS raw
                    FROM uni u CROSS JOIN slots s
                    LEFT JOIN (SELECT sig.key, xw.domain, sig.value FROM sig JOIN xw USING (tbl, col)) g
                      ON g.key = u.key AND g.domain = s.domain
                    GROUP BY ALL))""",
    ),
    "phase": (
        ["dom"],
        """SELECT key, phase, in_composite, n_domains_scored, n_domains_total,
          CASE WHEN n_domains_scored >= 2 AND n_domains_scored >= greatest(2, 0.5 * n_domains_total) THEN mean END AS score
        FROM (SELECT key, phase, in_composite, count(score) AS n_domains_scored, count(*) AS n_domains_total,
                     avg(score) AS mean FROM dom GROUP BY ALL)""",
    ),
    "comp": (
        ["phase"],
        """SELECT key, R, E, CASE WHEN R IS NOT NULL AND E IS NOT NULL THEN sqrt(greatest(R, 0.0) * greatest(E, 0.0)) END
          AS composite
        FROM (SELECT key, max(CASE WHEN phase = 'R' THEN score END) AS R, max(CASE WHEN phase = 'E' THEN score END) AS E
              FROM phase WHERE in_composite GROUP BY key)""",
    ),
    "scored": (["comp"], "SELECT * FROM comp WHERE composite IS NOT NULL"),
    "ref": (["sig"], "SELECT key, value AS g FROM sig WHERE tbl = 'signup' AND col = 'h3'"),
    "pts": (
        [],
        "SELECT c_custkey AS key, c_nationkey AS nation, c_acctbal AS x, "
        "CAST((c_custkey * 137) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon, "
        "CAST((c_custkey * 71) % 1400 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(70 AS DOUBLE) AS lat FROM customer",
    ),
}


def sql(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` under a WITH clause that holds the named roles, in order of dependence."""
    chosen: list[str] = []

    def visit(name: str) -> None:
        for parent in CTES[name][0]:
            visit(parent)
        if name not in chosen:
            chosen.append(name)

    for name in names.split():
        visit(name)
    parts = [f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in chosen]
    parts += [f"{n} AS MATERIALIZED ({text})" for n, text in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def haversine_sql(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    half = "CAST(2 AS DOUBLE)"
    a = f"sin(radians({lat2} - {lat1}) / {half})"
    b = f"sin(radians({lon2} - {lon1}) / {half})"
    return (
        f"(CAST(12742 AS DOUBLE) * asin(sqrt({a} * {a} + cos(radians({lat1})) * cos(radians({lat2})) * {b} * {b})))"
    )
