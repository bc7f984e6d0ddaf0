"""Draws ranked in tasks: what moves between tasks, keys that repeat or are null, and keys of very many rows."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from compindex.functions import noise as Z
from compindex.operators import uncertainty as U

SCHEMA = "key string, R double, E double, domains_not_scored int, composite double"


def rows(names):
    rng = np.random.default_rng(11)
    return [(k, float(r), float(e), int(d), float(np.sqrt(r * e))) for k, r, e, d in zip(names, rng.uniform(0, 1, len(names)), rng.uniform(0, 1, len(names)), rng.integers(0, 4, len(names)))]


def numbered(data, draws):
    """Bands of every key from all its ranks, drawn one by one."""
    offset, field = U.SEED % 1000, sorted(data, key=lambda r: (r[0] is not None, r[0]))
    number = np.array([int.from_bytes(hashlib.sha256(r[0].encode()).digest()[:4], "big") for r in field])
    first, second = (np.array([r[i] for r in field]) for i in (1, 2))
    sd = np.array([U.SD_LOW_CONFIDENCE if r[3] >= 2 else U.SD_NORMAL for r in field])
    ranks = {}
    for draw in range(1, draws + 1):
        w = U.WEIGHT_LOW + (U.WEIGHT_HIGH - U.WEIGHT_LOW) * Z.uniform_array(draw, np.zeros(1, np.int64), offset + 4)[0]
        a, b = (np.clip(v + sd * Z.normal_array(draw, number, offset + s), U.FLOOR, 1.0) for v, s in ((first, 0), (second, 2)))
        for place, i in enumerate(np.argsort(-(a**w * b ** (1 - w)), kind="stable"), 1):
            ranks.setdefault(field[i][0], []).append(place)
    return {k: tuple(max(1, round(float(q))) for q in np.quantile(v, U.BANDS)) for k, v in ranks.items()}


def found(spark, data, draws):
    told = U.simulated(spark.createDataFrame(data, SCHEMA), draws)
    bands = {r["key"]: (r["rank_p5"], r["rank_p50"], r["rank_p95"]) for r in U.rank_bands(told.histogram).collect()}
    return told, bands


def test_what_moves_is_no_row_per_key_and_rank(spark):
    data = rows([f"k{i:03d}" for i in range(150)])
    told, bands = found(spark, data, 130)
    assert told.histogram.groupBy("key").count().agg(F.max("count")).first()[0] <= 2 * len(U.BANDS)
    assert told.histogram.groupBy("key").agg(F.sum("n").alias("n")).where("n <> 130").isEmpty()
    plan = U.rank_bands(told.histogram)._jdf.queryExecution().toString()
    assert "Join" not in plan and bands == numbered(data, 130)


@pytest.mark.parametrize("cells", [1 << 24, 700, 1])
def test_keys_that_repeat_share_their_bands(spark, monkeypatch, cells):
    monkeypatch.setattr(U, "CELLS", cells)
    data = rows([f"k{i:02d}" for i in range(40)] + ["hot"] * 30 + ["k07"] * 3)
    told, bands = found(spark, data, 90)
    assert bands == numbered(data, 90)
    assert {r["key"]: r["n"] for r in told.histogram.groupBy("key").agg((F.sum("n") / 90).cast("int").alias("n")).where("n > 1").collect()} == {"hot": 30, "k07": 4}


def test_a_null_key_has_bands(spark):
    data = rows([f"k{i:02d}" for i in range(20)] + [None, None])
    told, bands = found(spark, data, 30)
    assert len(bands) == 21 and told.histogram.where("key IS NULL").agg(F.sum("n")).first()[0] == 60
    assert told.agreement.agg(F.count("rho")).first()[0] == 30


def test_equal_values_keep_their_order():
    rng = np.random.default_rng(2)
    for sim in (np.round(rng.uniform(0, 1, 3000), 2), np.clip(rng.normal(0, 1, 3000), 0, 1), np.append(rng.uniform(0, 1, 50), [np.nan, 0.5, np.nan, 0.5]), np.ones(1)):
        want = np.empty(len(sim), int)
        want[np.argsort(-sim, kind="stable")] = np.arange(1, len(sim) + 1)
        assert (U.placed(sim) == want).all()


def test_packed_ranks_come_back_sorted():
    rng = np.random.default_rng(5)
    for ranks in (rng.integers(1, 90, (7, 12)), rng.integers(1, 2**31 - 1, (5, 3)), rng.integers(1, 99, (4, 1))):
        out = np.zeros((len(ranks), ranks.shape[1] + 2), np.int32)
        U.unpacked(U.packed(ranks.astype(np.int32)), out[:, 1:-1])
        assert (out[:, 1:-1] == np.sort(ranks, axis=1)).all() and not out[:, 0].any() and not out[:, -1].any()
