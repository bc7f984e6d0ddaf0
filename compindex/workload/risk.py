"""The real index over the event table: 13 domains, anchors per signal, attenuation, phases and rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from compindex.config import config_table, values_sql
from compindex.operators import compose as C
from compindex.operators import latest as L
from compindex.operators import scale as N
from compindex.plans import risk_design as D
from compindex.sources import readers as RD
from compindex.workload import fixtures as X
from compindex.workload.core import r8
from compindex.workload.registry import query

PAIRS = sorted({pair for row in D.DESIGN for pair in row[4]} | {D.MODULATOR})
# One cell per event type and hour; cells go round the signals, so that each gets two or three.
CELLS = [(kind, hour, *PAIRS[(i * 24 + hour) % len(PAIRS)]) for i, kind in enumerate(X.TYPES) for hour in range(24)]
_ANCHORED = {name: (low, high, way) for name, low, high, way in D.ANCHORS}
# Signals without an anchor of their own use the event scale. One entry is not confirmed and must not count.
ENTRIES = {
    col: dict(zip(("floor", "ceiling", "direction"), _ANCHORED.get(col, (0.0, X.CEILING, "high_risk"))), code=col, confirmed=True)
    for _, col in PAIRS
} | {"unconfirmed": {"code": "x", "confirmed": False, "floor": 0.0, "ceiling": 0.0}}


def signals(spark, sf):
    """(key, tbl, col, value): the latest event of each signal, on the signal's own scale and then anchored."""
    cells = config_table(spark, CELLS, "event_type string, hour int, tbl string, col string")
    events = X.table(spark, sf, "events").withColumn("hour", F.hour("ts")).join(cells, ["event_type", "hour"])
    raw = events.select(F.col("user_id").alias("key"), "tbl", "col", "ts", F.col("event_id").alias("seq"), "value")
    spec = N.anchor_spec(spark, RD.confirmed_specs(ENTRIES))
    latest = L.latest_value(raw, ["key", "tbl", "col"], time="ts").join(spec.select(F.col("series").alias("col"), "floor", "ceiling"), "col")
    natural = F.col("floor") + F.col("value") / X.CEILING * (F.col("ceiling") - F.col("floor"))
    scaled = N.anchor_scale(latest.withColumn("value", natural).drop("floor", "ceiling"), spec, series="col")
    return scaled.select("key", "tbl", "col", F.col("score").alias("value"))


_CELL_SQL = values_sql([(*c, e["floor"], e["ceiling"], e["direction"] == "low_risk") for c in CELLS for e in [ENTRIES[c[3]]]], ["kind", "hr", "tbl", "col", "lo", "hi", "inv"])
_CTES = {
    "rsig": f"""SELECT key, tbl, col, CASE WHEN inv THEN 1 - s ELSE s END AS value FROM (SELECT *, least(1.0, greatest(0.0, (lo + value / 150.0 * (hi - lo) - lo) / (hi - lo))) AS s FROM
      (SELECT user_id AS key, tbl, col, lo, hi, inv, value, row_number() OVER (PARTITION BY user_id, tbl, col ORDER BY ts DESC, event_id) AS rn
       FROM events JOIN {_CELL_SQL} ON event_type = kind AND extract(hour FROM ts) = hr WHERE value IS NOT NULL) WHERE rn = 1)""",
    "rxw": "SELECT * FROM " + values_sql([(row[0], t, c) for row in D.DESIGN for t, c in row[4]], ["domain", "tbl", "col"]),
    "rslots": "SELECT * FROM " + values_sql([(d, p, c, len(s), i) for d, p, i, c, s in D.DESIGN], ["domain", "phase", "confidence", "n_total", "in_composite"]),
    "rdom": X.CTES["dom"][1].replace("FROM sig JOIN xw USING", "FROM rsig sig JOIN rxw xw USING").replace("CROSS JOIN slots s", "CROSS JOIN rslots s"),
    "att": f"""SELECT d.key, phase, d.score * CASE WHEN m.value IS NULL THEN 1.0 ELSE least(1.0, greatest(0.0, m.value)) END AS score FROM rdom d LEFT JOIN rsig m
      ON m.key = d.key AND m.tbl = '{D.MODULATOR[0]}' AND m.col = '{D.MODULATOR[1]}' WHERE in_composite""",
    "ph": "SELECT key, phase, CASE WHEN count(score) >= 2 AND count(score) >= 0.5 * count(*) THEN avg(score) END AS score FROM att GROUP BY 1, 2",
    "c": "SELECT key, max(score) FILTER (WHERE phase = 'recruitment') AS recruitment, max(score) FILTER (WHERE phase = 'exploitation') AS exploitation FROM ph GROUP BY key",
}


@query(
    "risk_index",
    X.sql("uni", """SELECT key, round(recruitment, 8) AS recruitment, round(exploitation, 8) AS exploitation, round(composite, 8) AS composite,
      CASE WHEN composite IS NOT NULL THEN row_number() OVER (ORDER BY composite DESC NULLS LAST, key) END AS rank FROM (SELECT *, sqrt(recruitment * exploitation) AS composite FROM c)""", _CTES),
)
def risk_index(spark, sf):
    """The locked build with attenuation over the whole universe."""
    out = D.locked_build(signals(spark, sf), X.universe(spark, sf).withColumn("ord", F.col("key")))
    return out.select("key", r8("recruitment"), r8("exploitation"), r8("composite"), "rank")


@query(
    "risk_index_domains",
    X.sql("uni", "SELECT key, domain, phase, n_present, n_total, round(score, 8) AS score, coverage_flag FROM rdom", _CTES),
)
def risk_index_domains(spark, sf):
    """All 13 domains of every key, the two monetization ones included."""
    out = C.domain_scores(signals(spark, sf), D.DESIGN, X.universe(spark, sf))
    return out.select("key", "domain", "phase", "n_present", "n_total", r8("score"), "coverage_flag")
