"""Queries over draws, on tables of their own in which a name belongs to two customers, and noise tests of fields beyond 50,000 keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compindex.functions import noise as Z
from compindex.operators import uncertainty as U
from compindex.workload import catalogue
from compindex.workload import fixtures as X


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """130 customers, two thirds of them with values in most slots."""
    rng, sf = np.random.default_rng(8), str(tmp_path_factory.mktemp("draws"))
    spark.createDataFrame([(k, f"name {k // 2}") for k in range(130)], "c_custkey long, c_name string").write.parquet(f"{sf}/customer.parquet")
    seen = [(k, kind, slot) for k in range(130) if k % 3 for kind in X.TYPES for slot in range(X.SLOTS) if rng.uniform() < 0.9]
    rows = [(i, 1_709_251_200 + 10_800 * slot + k, k, kind, float(rng.uniform(0, 150))) for i, (k, kind, slot) in enumerate(seen)]
    events = spark.createDataFrame(rows, "event_id long, s long, user_id long, event_type string, value double")
    events.withColumn("ts", F.timestamp_seconds("s")).drop("s").write.parquet(f"{sf}/events.parquet")
    return sf


def by_sql(name, sf):
    duckdb, compare = pytest.importorskip("duckdb"), pytest.importorskip("compare")
    con = duckdb.connect()
    for table in ("customer", "events"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf}/{table}.parquet/*.parquet')")
    told = con.execute(catalogue.ORACLES[name])
    return compare.normal([d[0] for d in told.description], told.fetchall()), compare.normal


@pytest.mark.parametrize("name", ["mc_rank_bands", "mc_rank_bands_named", "mc_summary", "score_invariants", "scores_table"])
def test_a_key_has_no_row_per_rank(spark, monkeypatch, tables, name):
    told, simulated = [], U.simulated
    monkeypatch.setattr(U, "simulated", lambda *a: told.append(simulated(*a)) or told[-1])
    out = catalogue.QUERIES[name](spark, tables)
    want, normal = by_sql(name, tables)
    assert normal(out.columns, [tuple(r) for r in out.collect()]) == want
    counts = told[0].histogram.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    assert counts.agg(F.max("rows")).first()[0] <= 2 * len(U.BANDS)
    assert counts.where(F.col("n") % U.DRAWS != 0).isEmpty() and counts.count() > 30


@pytest.mark.parametrize("levels, flags", [([0.02], None), ([0.02, 0.04], None), ([0.01, 0.02, 0.03], "domains_low_conf")])
def test_noise_of_a_large_field_is_ranked_in_tasks(spark, monkeypatch, levels, flags):
    """As the queries verdicts, noise_stability and noise_stability_by_flags have them."""
    monkeypatch.setattr(U, "_noise_by_slices", lambda *a: pytest.fail("a row per key and draw"))
    size, draws, top = 50_001, 3, 10
    field = spark.range(size).select(
        F.col("id").alias("key"), ((F.col("id") * 7919 % 50_021) / 50_021.0).alias("composite"), (F.col("id") % 4).cast("int").alias("domains_low_conf"),
    )
    got = {r["level"]: r for r in U.noise_stability(field, levels, draws, top, 7, flags).collect()}
    key = np.arange(size - 1, -1, -1)
    score, growth = key * 7919 % 50_021 / 50_021.0, 1.0 + (0.5 * (key % 4) if flags else 0.0)
    before = np.empty(size)
    before[np.argsort(-score, kind="stable")] = np.arange(1, size + 1)
    for level in levels:
        kept, ranks = [0, 0], []
        for draw in range(1, draws + 1):
            sim = np.clip(score + level * growth * Z.normal_array(draw, key, 7), 0.0, 1.0)
            place = np.empty(size)
            place[np.argsort(-sim, kind="stable")] = np.arange(1, size + 1)
            kept[0] += ((place <= top) & (before <= top)).sum()
            kept[1] += ((place > size - top) & (before > size - top)).sum()
            for edge in (0.0, 1.0):
                if (sim == edge).any():
                    place = np.where(sim == edge, place[sim == edge].mean(), place)
            ranks.append(place)
        low, high = np.quantile(np.array(ranks), U.ENDS, axis=0)
        want = kept[0] / (top * draws), kept[1] / (top * draws), (high - low).mean(), np.median(high - low)
        row = got[level]
        assert (row["top_retention"], row["bottom_retention"], row["mean_width"], row["median_width"]) == pytest.approx(want, abs=1e-6)
