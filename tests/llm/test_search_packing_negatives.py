"""Ranked search, packing and hard negatives: brute force, the library, edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from compindex.llm import negatives, packing, search
from compindex.llm.bpe import default_path

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LONG = "lorem ipsum Dolor, " * 120_000


def plain_search(docs, items, top=10):
    terms = [Counter(TERM.findall((t or "").translate(UPPER))) for _, t in docs]
    n_docs, n_terms = sum(bool(c) for c in terms), sum(sum(c.values()) for c in terms)
    df = Counter(t for c in terms for t in c)
    out = Counter()
    for item, text in set(items):
        found = []
        for (doc_id, _), c in zip(docs, terms):
            n, score = sum(c.values()), 0
            for t in set(TERM.findall((text or "").translate(UPPER))) & c.keys():
                m = 10 + 90 * n * n_docs // n_terms
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score:
                found.append((-score, -math.inf if doc_id is None else doc_id))
        for rank, (score, doc_id) in enumerate(sorted(found)[:top], 1):
            out[item, rank, None if doc_id == -math.inf else doc_id, -score] += 1
    return out


def ids_and_texts(spark, rows, name):
    return spark.createDataFrame([(*r, "x", 1.0) for r in rows], f"{name} long, text string, terms string, score double")


def test_search_matches_brute_force(spark):
    random.seed(4)
    words = [f"w{i}" for i in range(30)] + ["Éa", "éA", "Zz", "zZ", "a_b", "naïve"]
    docs = [(i, " ".join(random.choices(words, k=random.randint(0, 25)))) for i in range(120)]
    docs += [(5, docs[5][1]), (None, docs[7][1]), (None, None), (500, None), (501, ""), (502, " ,;\x00 "), (503, LONG), docs[9], docs[9]]
    items = [(i, " ".join(random.choices(words, k=random.randint(1, 12)))) for i in range(25)]
    items += [(3, items[3][1]), (3, "Éa other zz"), (None, "w1 w2 w3 Lorem"), (90, None), (91, "..."), (92, "absent"), (93, items[4][1])]
    got = Counter(map(tuple, search.search(ids_and_texts(spark, docs, "doc_id").repartition(7), ids_and_texts(spark, items, "item_id")).collect()))
    assert got == plain_search(docs, items)


def test_search_in_several_blocks_and_small_batches(spark, monkeypatch):
    random.seed(5)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(random.choices(words, k=9))) for i in range(60)]
    items = [(i, " ".join(random.choices(words, k=5))) for i in range(9)]
    monkeypatch.setattr(search, "BLOCK_TERMS", 12)
    got = Counter(map(tuple, search.search(ids_and_texts(spark, docs, "doc_id"), ids_and_texts(spark, items, "item_id")).collect()))
    assert got == plain_search(docs, items)
    block = search.Block([0, 1], [[b"a", b"b"], [b"b", b"c"]])
    block.weigh(3, 10, np.array([1, 2, 1]))
    assert block.scores(np.array([4]), np.array([0, 1]), np.array([0, 0]), np.array([2, 1])).shape == (2, 1)


def test_search_of_empty_tables(spark):
    docs, items = ids_and_texts(spark, [(1, "a b")], "doc_id"), ids_and_texts(spark, [(1, "a")], "item_id")
    assert search.search(docs.where("false"), items).count() == 0
    assert search.search(docs, items.where("false")).count() == 0


def test_shared_sums_add_up_to_the_items():
    random.seed(6)
    items = [set(random.sample(range(40), random.randint(1, 15))) for _ in range(60)]
    items += [items[0], items[0], {41, 42, 43}, set()]
    for paired in (300, 2):
        search.PAIRED, before = paired, search.PAIRED
        nodes, left = search.shared_sums(items, 44)
        search.PAIRED = before
        made = {t: Counter([t]) for t in range(44)}
        for at, children in enumerate(nodes, 44):
            made[at] = sum((made[c] for c in children), Counter())
        assert [sum((made[n] for n in item), Counter()) for item in left] == [Counter(item) for item in items]
        steps = sum(len(c) - 1 for c in nodes) + sum(max(len(i) - 1, 0) for i in left)
        assert steps < sum(max(len(i) - 1, 0) for i in items) + (paired == 2)


def brute_pieces(rows, capacity):
    from tokenizers import Tokenizer

    library, out = Tokenizer.from_file(default_path()), Counter()
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            out[doc_id, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def test_packing_matches_the_library_and_fits(spark):
    random.seed(7)
    base = "The quick brown ΟΔΟΣ fox's ñandú x<|endoftext|>y 1234 z\tá ́b".split(" ")
    rows = [(i, random.choice([" ", "\n", "  "]).join(random.choices(base, k=random.randint(1, 60)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, " \n "), (None, "no id"), (None, None), rows[3], rows[3], (403, LONG), (404, "x" * 20_000)]
    docs = spark.createDataFrame([(*r, 5, 7) for r in rows], "doc_id long, text string, length int, sequence_id int").repartition(5)
    for capacity in (64, 2048):
        found = packing.pieces(docs, default_path(), capacity).select("*", F.crc32("ids").alias("crc"), F.lit(1).alias("is_open"), F.lit(2).alias("offset"))
        placed = packing.packed(found, capacity)
        got = placed.select("doc_id", "piece", "start", "length", "crc", "sequence_id", "offset").collect()
        assert Counter(tuple(r)[:5] for r in got) == brute_pieces(rows, capacity)
        bins = defaultdict(list)
        for r in got:
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for members in bins.values():
            ends = 0
            for offset, length in sorted(members):
                assert offset == ends
                ends += length
            assert ends <= capacity
        assert len(bins) <= -(-sum(r["length"] for r in got) // capacity) + 4
    joined = packing.sequences(placed).collect()
    assert len(joined) == len(bins) and all(len(r["ids"]) == 4 * r["n_tokens"] <= 4 * 2048 for r in joined)
    assert packing.packed(found.where("false")).count() == 0


def test_exchanges_keep_pieces_and_empty_sequences():
    assert len(packing.improved([[0, 1], [2, 3], [4, 5]], [6, 4, 5, 4, 6, 5], 15)) == 2  # 10, 9 and 11 of 15
    random.seed(8)
    for low, high in ((1, 100), (20, 60), (30, 38)):
        lengths = [random.randint(low, high) for _ in range(400)]
        first = packing.best_fit(lengths, 100)
        better = packing.improved(first, lengths, 100)
        assert sorted(m for b in better for m in b) == list(range(400)) and max(sum(lengths[m] for m in b) for b in better) <= 100
        assert len(better) <= len(first)


def test_packing_in_chunks_and_rounds(spark, monkeypatch):
    random.seed(9)
    rows = [(i, random.randint(1, 100)) for i in range(900)]
    table = spark.createDataFrame(rows, "k long, length int").repartition(6)
    monkeypatch.setattr(packing, "CHUNK", 40)
    got = packing.packed(table, 100).collect()
    assert sorted((r["k"], r["length"]) for r in got) == rows
    fills = Counter()
    for r in got:
        fills[r["sequence_id"]] += r["length"]
    assert max(fills.values()) <= 100 and len(fills) <= 1.1 * sum(n for _, n in rows) / 100


def plain_negatives(rows):
    fit = [(i, label, [math.floor(256 * x) for x in v]) for i, label, v in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, last = Counter(), 1 << 70
    for a, label, v in fit:
        if a is None or a % 50:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), last if i is None else i, other) for i, other, w in fit if i != a)
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            inside = [s for s in scored if s[2] != label and 50 * -p <= 100 * -s[0] <= 95 * -p][:3]
            for rank, (n, i, _) in enumerate(inside, 1):
                out[a, None if positive == last else positive, rank, None if i == last else i, -p, -n] += 1
    return out


def test_negatives_match_brute_force(spark, monkeypatch):
    random.seed(10)
    rows = [(i, random.randint(0, 4), [random.gauss(0, 0.3) for _ in range(8)]) for i in range(1500)]
    same = rows[50][2]
    rows += [(2000 + i, i % 3, same) for i in range(200)] + [rows[50], rows[50], (50, 3, same), rows[7], rows[7]]
    rows += [(2300, None, same), (2350, 1, None), (2400, 1, [float("nan")] * 8), (2401, 1, [None] + same[1:]), (2402, 1, [float("inf")] + same[1:])]
    rows += [(None, 2, same), (None, 2, same), (2450, 2, same[:5]), (2500, 1, []), (2501, 2, []), (2550, 9, [0.0] * 8)]
    table = spark.createDataFrame([(*r, "x", 3) for r in rows], "vec_id long, label int, embedding array<float>, score string, rank int")
    rows = [(r["vec_id"], r["label"], r["embedding"]) for r in table.collect()]
    want = plain_negatives(rows)
    for wave, block in ((32_768, 2_048), (10, 7)):
        monkeypatch.setattr(negatives, "WAVE", wave)
        monkeypatch.setattr(negatives, "ANCHOR_BLOCK", block)
        got = Counter(map(tuple, negatives.hard_negatives(table.repartition(3), F.col("vec_id") % 50 == 0).collect()))
        assert got == want and len(want) > 200


def test_negatives_of_empty_tables(spark):
    table = spark.createDataFrame([(1, 1, [0.5])], "vec_id long, label int, embedding array<float>")
    assert negatives.hard_negatives(table, F.col("vec_id") % 50 == 0).count() == 0
    assert negatives.hard_negatives(table.where("false"), F.col("vec_id") % 50 == 0).count() == 0
