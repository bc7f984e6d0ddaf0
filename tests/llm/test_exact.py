from collections import defaultdict

import pytest

from compindex.llm import exact


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[text or ""].append(doc_id)
    return sorted((d, max(groups[t or ""]), len(groups[t or ""]), d == max(groups[t or ""])) for d, t in rows)


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, h0 string, keep_id long")
    return sorted(tuple(r)[:4] for r in exact.duplicates(docs).collect())


def test_small_cases(spark):
    rows = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "a "), (6, "é" * 70_000), (7, "é" * 70_000), (8, "é" * 70_000 + "x"), (2, "a")]
    assert run(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_fingerprints_compose():
    data = bytes(range(256)) * 200
    for cut in (0, 4, 4096, 51_000):
        for index in range(3):
            left, right = exact.polynomial(data[:cut])[index], exact.polynomial(data[cut:])[index]
            assert exact.combine(left, right, len(exact.symbols(data[cut:])), index) == exact.polynomial(data)[index]


def test_fingerprint_is_the_polynomial():
    data = b"some text of odd length" * 999
    values = [int.from_bytes(data[i : i + 4].ljust(4, b"\0"), "little") for i in range(0, len(data), 4)]
    for index, (prime, base) in enumerate(zip(exact.PRIMES, exact.BASES)):
        total = 0
        for v in values:
            total = (total * base + v) % prime
        assert exact.polynomial(data)[index] == total


def test_collisions_are_split(spark, monkeypatch):
    """With a useless hash all texts of one length collide; the chunk comparison must still tell them apart."""
    monkeypatch.setattr(exact, "with_fingerprint", lambda docs, data, only=None: docs.selectExpr("*", "0L h0", "0L h1", "0L h2", f"cast(octet_length({data}) as long) n_bytes"))
    rows = [(1, "ab"), (2, "ba"), (3, "ab"), (4, "abc"), (5, None)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [15, 16])
def test_filter_holds_every_repeated_fingerprint(spark, bits):
    groups = spark.createDataFrame([(h, 2 if h % 3 else 1) for h in range(0, 200_000, 777)] , "h0 long, group_size long")
    bitmap = exact.bit_map(groups.where("group_size > 1"), "h0", bits)
    want = {h % (1 << bits) for h in range(0, 200_000, 777) if h % 3}
    assert set(bitmap.nonzero()[0]) == want
