import random

from pyspark.sql import functions as F

from compindex.llm import nearcopies, simhash, stages


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n)]


def groups(rows):
    """doc_id to the smallest doc_id of its component, by all pairs."""
    sets = {d: nearcopies.shingle_set((t or "").encode())[1] for d, t in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(set(sets[a].tolist()) & set(sets[b].tolist()))
            if a < b and both * 9 >= 4 * (len(sets[a]) + len(sets[b])):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in root}


def edited(base, changes, seed):
    rng, own = random.Random(seed), list(base)
    for at in rng.sample(range(len(own)), changes):
        own[at] = f"changed{seed}x{at}"
    return " ".join(own)


def rows():
    out = [(i, " ".join(words(200, i))) for i in range(20)]
    out += [(100 + i, edited(words(200, 500 + i // 2), i % 2 * 3, i)) for i in range(40)]  # pairs, 3 changed words of 200
    out += [(200 + i, edited(words(200, 900), i % 7, i)) for i in range(120)]  # one large group, also chains
    return out + [(400, None), (401, ""), (402, "two words"), (403, "Two  words"), (404, "other words")]


def test_near_copies_match_all_pairs(spark, monkeypatch):
    """Crowded buckets go another way than small ones; both must give the same components."""
    docs = spark.createDataFrame(rows(), "doc_id long, text string").repartition(5)
    want = groups(rows())
    for limit, block in ((64, 512), (4, 512), (1, 5)):
        monkeypatch.setattr(nearcopies, "PAIRWISE", limit)
        monkeypatch.setattr(nearcopies, "BLOCK_SETS", block)
        assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == want


def test_stage_drops_near_copies_that_fingerprints_tell_apart(spark):
    given = [r for r in rows() if 100 <= r[0] < 140]
    apart = [bin(simhash.fingerprint(a[1].encode()) ^ simhash.fingerprint(b[1].encode())).count("1") for a, b in zip(given[::2], given[1::2])]
    assert sum(d > 2 for d in apart) > 10
    left = stages.near_dedup(spark, spark.createDataFrame(given, "doc_id long, text string"), "").collect()
    assert {r["doc_id"] for r in left} == set(range(100, 140, 2))


def test_batches_without_a_candidate(spark):
    """Many partitions: in most of them no text, or no candidate."""
    given = rows()
    docs = spark.createDataFrame(given + given[20:23], "doc_id long, text string").repartition(40).sortWithinPartitions("doc_id")
    assert {r["doc_id"]: r["component_id"] for r in nearcopies.near_copies(docs).collect()} == groups(given)
    few = docs.where("doc_id < 20").repartition(30)
    assert nearcopies.near_copies(few).where("doc_id = component_id").count() == 20
    assert nearcopies.near_copies(docs.where("false")).count() == 0


def test_long_repeated_and_nameless_texts(spark):
    long = " ".join(words(60_000, 77))
    given = [(1, long), (2, long + " more"), (2, long + " more"), (None, long), (3, None), (4, " "), (5, "one")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in given], "doc_id long, text string, w int, key int")
    got = {(r["doc_id"], r["component_id"]) for r in nearcopies.near_copies(docs).collect()}
    assert got == {(1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (5, 5)}


def test_stages_keep_columns_of_any_name(spark):
    given = [(i, " ".join(words(80, i % 5)), "s", {"a": i % 2}) for i in range(10)]
    frame = "doc_id long, text string, source string, m map<string, int>"
    docs = spark.createDataFrame(given + given, frame)
    for name in ("_gone", "_id", "_copy", "gone", "id", "copy", "copies", "entries0_", "a.b", "w", "kept"):
        docs = docs.withColumn(name, docs.doc_id)
    for stage in (stages.quality_rules, stages.exact_dedup, stages.near_dedup, stages.mix_sources):
        out = stage(spark, docs, "")
        assert out.columns == docs.columns
        assert all(r["copy"] == r["doc_id"] == r["_gone"] == r["a.b"] for r in out.collect())
    assert stages.exact_dedup(spark, docs, "").count() == 5


def test_fingerprints_alone_find_candidates(spark):
    """Without any band: near copies within two bits are linked, and nothing below a Jaccard of 0.8."""
    given = [(i, edited(words(300, 700 + i // 2), i % 2, i)) for i in range(60)] + [(100, None), (101, "two words")]
    docs = spark.createDataFrame(given, "doc_id long, text string").repartition(3)
    nodes = nearcopies._marks(docs).dropDuplicates(["w"]).withColumn("keys", F.expr("cast(array() as array<bigint>)")).cache()
    prints = {r["doc_id"]: (r["w"], r["fp"]) for r in nodes.collect()}
    assert all(fp % 2**64 == simhash.fingerprint((dict(given)[d] or "").encode(), 5) for d, (_, fp) in prints.items())
    want = {frozenset((prints[i][0], prints[i + 1][0])) for i in range(0, 60, 2) if bin((prints[i][1] ^ prints[i + 1][1]) % 2**64).count("1") <= 2}
    got = {frozenset((r["a"], r["b"])) for r in nearcopies.links(docs, nodes).collect()}
    assert got == want and len(want) > 5
