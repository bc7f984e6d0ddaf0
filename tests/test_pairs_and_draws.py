"""Pair statistics by cell tree against all pairs, and draws ranked at once against draws ranked by slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from compindex.operators import association as M
from compindex.operators import blocks as K
from compindex.operators import celltree as CT
from compindex.operators import keys as N
from compindex.operators import order as O
from compindex.operators import spatial as G
from compindex.operators import uncertainty as U
from compindex.operators import within as W
from compindex.plans import publish as P


def places(seed=1):
    """Scattered points, poles and date line, and half of all points in one spot, some of them a few metres apart."""
    rng = np.random.default_rng(seed)
    lon, lat = rng.uniform(-180, 180, 120), np.degrees(np.arcsin(rng.uniform(-1, 1, 120)))
    lon, lat = np.append(lon, [0, 90, 180, -180, 179.9, 12]), np.append(lat, [90, -90, 0, 0, 0.1, 90])
    near = np.column_stack([13 + rng.normal(0, 0.2, 80), 52 + rng.normal(0, 0.2, 80)])
    dense = np.column_stack([13 + rng.uniform(0, 2e-5, 60), 52 + rng.uniform(0, 2e-5, 60)])
    both = np.vstack([np.column_stack([lon, lat]), near, dense])
    return both, rng.integers(1, 4, len(both)).astype(float), rng.normal(0, 1, len(both))


def brute(both):
    return K.haversine_matrix(both[:, 0], both[:, 1], both[:, 0], both[:, 1])


@pytest.fixture(params=[512, 7])
def leaf(request, monkeypatch):
    monkeypatch.setattr(CT, "LEAF", request.param)
    return request.param


def frame(spark, both, w, z):
    rows = [(float(a), float(b), float(c), float(d)) for (a, b), c, d in zip(both, w, z)]
    return spark.createDataFrame(rows, "lon double, lat double, w double, z double").repartition(4)


def test_distance_bins_equal_all_pairs(spark, leaf):
    both, w, z = places()
    far, edges = brute(both), np.array(G.DISTANCE_EDGES, float)
    bins = np.searchsorted(edges, far, side="right") - 1
    upper = np.triu(np.ones_like(far, bool), 1)
    got = {r["bin"]: (r["pairs"], r["z"]) for r in CT.distance_bins(frame(spark, both, w, z), "w", ["z"], G.DISTANCE_EDGES).collect()}
    for b in range(len(edges) - 1):
        here = upper & (bins == b)
        want = np.outer(w, w)[here].sum(), np.outer(z, z)[here].sum()
        assert got.get(b, (0.0, 0.0)) == pytest.approx(want, abs=1e-6)


def test_band_totals_equal_all_pairs(spark, leaf):
    both, w, z = places(2)
    far = brute(both)
    for band in (0.0005, 500.0, 19_000.0):
        got = {(r["lon"], r["lat"]): (r["w"], r["z"]) for r in CT.band_totals(frame(spark, both, w, z), ["w", "z"], band).collect()}
        near = far <= band
        assert len(got) == len(both)
        for k, (lon, lat) in enumerate(both):
            assert got[float(lon), float(lat)] == pytest.approx((w[near[k]].sum(), z[near[k]].sum()), abs=1e-9)


def test_pairs_of_one_and_of_no_location(spark):
    one = spark.createDataFrame([(5.0, 5.0, 2.0, 1.0)], "lon double, lat double, w double, z double")
    assert [tuple(r) for r in CT.band_totals(one, ["w", "z"], 10.0).collect()] == [(5.0, 5.0, 2.0, 1.0)]
    assert CT.band_totals(one.where("false"), ["w", "z"], 10.0).count() == 0
    assert all(r["pairs"] in (None, 0.0) for r in CT.distance_bins(one, "w", ["z"], G.DISTANCE_EDGES).collect())


def field(spark, named):
    rng = np.random.default_rng(3)
    rows = [(f"k{i}" if named else i - 20, float(r), float(e), int(d), float(np.sqrt(r * e))) for i, (r, e, d) in enumerate(zip(rng.uniform(0, 1, 60), rng.uniform(0, 1, 60), rng.integers(0, 4, 60)))]
    rows += [("z" if named else 999, None, 0.5, 0, None), ("y" if named else 998, 1.0, 1.0, 0, 1.0), ("x" if named else 997, 1.0, 1.0, 0, 1.0)]
    return spark.createDataFrame(rows, f"key {'string' if named else 'long'}, R double, E double, domains_not_scored int, composite double")


@pytest.mark.parametrize("named", [False, True])
def test_draws_at_once_equal_draws_by_slices(spark, monkeypatch, named):
    scored, out = field(spark, named), []
    for limit in (50_000, 10):
        monkeypatch.setattr(U, "KEYS_AT_ONCE", limit)
        found = U.simulated(scored, 70)
        bands = sorted(map(tuple, U.rank_bands(found.histogram).collect()))
        summary = U.simulation_summary(found.agreement, U.rank_bands(found.histogram)).first()
        noise = sorted(tuple(round(v, 9) for v in r) for r in U.noise_stability(scored, [0.02, 0.3], 40, 5, 7, "domains_not_scored").collect())
        out.append((bands, {k: round(v, 9) for k, v in summary.asDict().items()}, noise))
    assert out[0] == out[1]
    assert len(out[0][0]) == 62 and out[0][1]["draws"] == 70 and out[0][1]["n"] == 62


def test_an_empty_field_has_no_bands(spark):
    scored = field(spark, False).where("false")
    found = U.simulated(scored, 5)
    assert U.rank_bands(found.histogram).count() == 0 and found.agreement.count() == 0


def star(rng, cx, cy, size, corners):
    """A slanted, mostly concave ring around a centre."""
    angle = np.sort(rng.uniform(0, 2 * np.pi, corners))
    reach = size * rng.uniform(0.2, 1.0, corners)
    ring = [(float(cx + r * np.cos(a)), float(cy + r * np.sin(a))) for a, r in zip(angle, reach)]
    return [*ring, ring[0]]


def parity(x, y, rings):
    inside = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) / (y2 - y1) * (x2 - x1):
                inside = not inside
    return inside


def test_points_in_slanted_and_many_part_polygons(spark, leaf):
    rng = np.random.default_rng(4)
    shapes = [(k, [star(rng, *rng.uniform(-50, 50, 2), 10.0 ** rng.uniform(-2, 1.7), 9) for _ in range(1 + k % 3)]) for k in range(40)]
    shapes += [(40, [star(rng, 500.0, 500.0, 5.0, 5)]), (41, [[(-99.0, -99.0), (99.0, -99.0), (99.0, 99.0), (-99.0, 99.0), (-99.0, -99.0)]])]
    places = [(k, float(x), float(y)) for k, (x, y) in enumerate(np.vstack([rng.uniform(-60, 60, (150, 2)), rng.normal(7, 0.01, (150, 2))]))]
    places += [(900, *places[3][1:]), (901, None, 1.0), (902, 1.0, None)] + [(1000 + k, *places[200][1:]) for k in range(100)]
    points = spark.createDataFrame(places, "k long, lon double, lat double").repartition(5)
    polygons = spark.createDataFrame(shapes, "id int, rings array<array<struct<x: double, y: double>>>")
    want = sorted((k, u) for k, x, y in places if x is not None and y is not None for u, rings in shapes if parity(x, y, rings))
    found = W.points_within(points, polygons)
    assert sorted((r["k"], r["unit"]) for r in found.collect()) == want and len(want) > 400
    assert W.points_within(points.where("false"), polygons).count() == 0 and W.points_within(points, polygons.where("false")).count() == 0


def test_permutations_counted_in_tasks_equal_those_of_tables(spark, monkeypatch):
    rng = np.random.default_rng(6)
    units = [(layer, i - 3, float(rng.normal())) for layer in "ab" for i in range(30)] + [("a", 99, 1.0), ("b", 98, None), ("b", 99, 2.0)]
    pairs = {(int(a) - 3, int(b) - 3) for a, b in rng.integers(0, 30, (70, 2)) if a != b} | {(-3, k) for k in range(0, 20)}
    edges = spark.createDataFrame([(a, b, 1.0) for a, b in pairs | {(b, a) for a, b in pairs}], "i long, j long, w double")
    table, out = spark.createDataFrame(units, "layer string, id long, y double"), []
    one = table.where("layer = 'a'").drop("layer")
    for limit in (50_000, 10):
        monkeypatch.setattr(M, "UNITS_AT_ONCE", limit)
        row = lambda r: tuple(round(v, 9) if isinstance(v, float) else v for v in r)
        local = M.local_moran(table, edges, ["layer"], 60, 5).select("layer", "id", "local_i", "z_sim", "p_raw", "p_fdr", "cluster_raw")
        star = M.local_gi_star(one, edges, [], 60, 5).select("id", "gistar_z", "gistar_p", "gistar_p_fdr")
        out.append([sorted(map(row, f.collect())) for f in (local, star, M.moran_permutations(one, edges, 60, 5))])
    assert out[0] == out[1] and len(out[0][0]) == 62


def test_rare_bigrams_lose_no_match(spark):
    import difflib

    rng = np.random.default_rng(9)
    letters = list("aaaabcde ")
    base = ["".join(rng.choice(letters, rng.integers(1, 14))).strip() or "a" for _ in range(120)]

    def typo(name):
        name = list(name)
        for _ in range(rng.integers(0, 3)):
            at = int(rng.integers(0, len(name) + 1))
            name[at : at + int(rng.integers(0, 2))] = rng.choice(letters, rng.integers(0, 2))
        return "".join(name)

    asked = sorted({typo(n) for n in base for _ in range(2)} - {""})
    to_frame = lambda names: spark.createDataFrame([(n,) for n in names], "norm string").repartition(3)
    found = {tuple(r) for r in N.fuzzy_candidates(to_frame(asked), to_frame(base)).collect()}
    want = {(a, b) for a in asked for b in set(base) if difflib.SequenceMatcher(None, b, a).ratio() >= N.FUZZY_CUTOFF}
    assert want <= found and len(want) > 100


def test_shares_of_values_that_do_not_occur(spark):
    steps = O.ladder(spark.createDataFrame([("a", v) for v in (1.0, 2.0, 2.0, 5.0)] + [("b", 3.0), ("b", None)], "g string, v double"), ["g"], "v")
    asked = [("a", v) for v in (0.5, 1.0, 1.5, 2.0, 4.9, 5.0, 9.0, None)] + [("b", 2.9), ("b", 3.0), ("c", 1.0)] + [("a", 1.5)] * 40
    got = O.share_at(spark.createDataFrame(asked, "g string, v double").repartition(3), steps, ["g"], "v", "share").collect()
    want = {("a", 0.5): 0.0, ("a", 1.0): 0.25, ("a", 1.5): 0.25, ("a", 2.0): 0.75, ("a", 4.9): 0.75, ("a", 5.0): 1.0, ("a", 9.0): 1.0, ("a", None): None, ("b", 2.9): 0.0, ("b", 3.0): 1.0, ("c", 1.0): None}
    assert len(got) == len(asked) and {(r["g"], r["v"]): r["share"] for r in got} == want


def test_overrides_go_first_and_modeled_values_only_fill(spark):
    rows = lambda data, more="": spark.createDataFrame(data, "key long, tbl string, col string, value double" + more)
    crosswalk = spark.createDataFrame([("d", "P", "d", 1, "t", "c"), ("d", "P", "d", 2, "t", "e")], "domain string, phase string, domain_pos string, pos int, tbl string, col string")
    signals = rows([(1, "t", "c", 0.1), (2, "t", "c", 0.1), (3, "t", "c", None), (1, "t", "e", 0.7)])
    over = rows([(2, "t", "c", 0.15), (4, "t", "c", 0.05)])
    guess = rows([(1, "t", "c", 0.9, 0.8, 1.0), (3, "t", "c", 0.3, 0.2, 0.4)], ", lo double, hi double")
    table = P.indicators_table(signals, crosswalk, [("t", "c")], over, guess)
    got = {(r["key"], r["col"]): (round(r["value"], 6), r["overridden"], r["modeled"], r["lo"]) for r in table.collect()}
    assert got == {
        (1, "c"): (0.05, False, False, None), (2, "c"): (0.15, True, False, None), (3, "c"): (0.3, False, True, 0.2), (4, "c"): (0.05, True, False, None), (1, "e"): (0.7, False, False, None),
    }
    assert [tuple(r) for r in P.modeled_list(table).collect()] == [(3, "t", "c", 0.3, 0.2, 0.4)]
    plain = P.indicators_table(signals, crosswalk, []).collect()
    assert sorted((r["key"], r["col"], r["value"]) for r in plain) == [(1, "c", 0.1), (1, "e", 0.7), (2, "c", 0.1)]
