import random

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from compindex.llm import graph, simhash


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(values, ids):
    return [(ids[i], ids[j]) for i in range(len(ids)) for j in range(i) if bin(values[i] ^ values[j]).count("1") <= 2]


@pytest.mark.parametrize("finish", [100_000, 20])
def test_components(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH_ROWS", finish)
    random.seed(3)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(random.randrange(200, 400), random.randrange(200, 400)) for _ in range(120)]
    nodes = {n for p in pairs for n in p}
    got = dict(map(tuple, graph.components(spark.createDataFrame([*pairs, (None, 3)], "a long, b long")).collect()))
    assert got == roots(pairs, nodes)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint_rules():
    assert simhash.fingerprint(None) == simhash.fingerprint(b" \t\n") == 0
    assert simhash.fingerprint("AÀ b".encode()) == xxh64_intdigest("aÀ b".encode(), 42)
    words = [f"w{i % 7}" for i in range(40)]
    hashes = [xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(38)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 38)
    assert simhash.fingerprint(" ".join(words).encode()) == want


def test_links_of_a_dense_cluster(spark):
    """Hundreds of fingerprints around one centre share every bucket; no link may be lost."""
    random.seed(5)
    base = random.getrandbits(64)
    values = {base}
    while len(values) < 400:
        v = base
        for b in random.sample(range(64), random.randint(1, 4)):
            v ^= 1 << b
        values.add(v)
    while len(values) < 700:
        values.add(random.getrandbits(64))
    values = sorted(values)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long")).collect()
    nodes = signed
    want, got = roots(near(values, signed), nodes), roots([tuple(r) for r in found], nodes)
    assert all((want[a] == want[b]) == (got[a] == got[b]) for a, b in zip(nodes, nodes[1:]))
    assert len(set(got.values())) == len(set(want.values()))


def test_allocation_fills_the_units_cheaply():
    cost, units = simhash.allocate([[0, 5, 50, 500], [0, 1, 20, 400], [0, 9, 90, 900]], 3)
    assert (cost, units) == (15, [1, 1, 1])
    assert simhash.allocate([[0, 100, 101], [0, 1, 2]], 2)[1] == [0, 2]


def test_every_plan_covers_the_distance():
    for groups, split in ((n, simhash.group_bits(10, np.full((64, 64), 3.0), n)) for n in range(1, 6)):
        assert len(split) == groups and sorted(b for g in split for b in g) == list(range(64))
    chosen = simhash.plan(1000, np.full((64, 64), 300.0) + np.diag([200.0] * 64))
    assert sum(t + 1 for _, t in chosen) == 3


def test_documents_with_nulls_copies_and_extra_columns(spark):
    rows = [(5, None), (6, ""), (3, "a b c d"), (9, "A b c d"), (9, "A b c d"), (None, "q r s"), (1, "word " * 5)]
    docs = spark.createDataFrame([(d, t, 7, "z") for d, t in rows], "doc_id long, text string, fp long, root string")
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).select("doc_id", "component_id", "copies").collect()), key=str)
    assert got == sorted([(5, 5, 2), (6, 5, 2), (3, 3, 3), (9, 3, 3), (9, 3, 3), (None, None, 1), (1, 1, 1)], key=str)
    assert simhash.near_duplicates(docs.where("false")).count() == 0
