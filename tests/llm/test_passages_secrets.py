import random

import numpy as np

from compindex.llm import passages, secrets


def words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(3, 9))) for _ in range(n)]


def planted():
    """Documents with a shared run of 50 words at changing places, one edited, and clean ones."""
    run, rows = words(50, 1), []
    for i in range(12):
        body = words(150 + 10 * i, 100 + i)
        at = 7 * i
        rows.append((i, " ".join(body[:at] + (run if i < 8 else []) + body[at:])))
    long = words(120, 2)
    edited = long[:60] + ["changed"] + long[61:]
    rows += [(20, "Head. " + " ".join(long)), (21, " ".join(edited) + " tail")]
    rows += [(30, "for " * 400), (31, "x for " + "for " * 300), (32, None), (33, ""), (34, "short text"), (None, " ".join(run))]
    return rows


def test_repeats_are_found_and_clean_documents_left_alone(spark):
    docs = spark.createDataFrame([(d, t, 1) for d, t in planted()], "doc_id long, text string, start int").repartition(5)
    found = passages.repeated(docs).collect()
    assert {r["doc_id"] for r in found} == {*range(8), 20, 21, None}
    assert all(r["component_id"] in range(8) for r in found if r["doc_id"] in range(8))
    assert {r["component_id"] for r in found if r["doc_id"] in (20, 21)} == {20}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    assert passages.repeated(docs.where("false")).count() == 0


def test_every_shared_run_of_fifty_words_shares_a_paragraph():
    for seed in range(60):
        run = words(50, seed)
        made = []
        for side in (1, 2):
            rng = random.Random(seed * 7 + side)
            text = words(rng.randint(0, 200), seed * 31 + side) + run + words(rng.randint(0, 200), seed * 37 + side)
            starts, rows = passages.paragraphs(" ".join(text).encode())
            made.append(set(passages._ids(rows).tolist()))
        assert made[0] & made[1]


def test_links_match_brute_force_in_crowded_buckets(spark, monkeypatch):
    """Crowded buckets go another way than small ones; both must give the same components."""
    base = words(20, 5)
    rows = []
    for i in range(90):
        own = list(base)
        own[-1] = f"end{i}"  # differs in one shingle of 16: Jaccard 15 / 17
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1000, 10):
        monkeypatch.setattr(passages, "PAIRWISE", limit)
        got = passages.repeated(docs).collect()
        assert {r["doc_id"] for r in got} == set(range(90)) and {r["component_id"] for r in got} == {0}


def shared_windows(rows):
    """doc_id to the starts of its windows of 20 words that another document has too, place by place."""
    owners, out = {}, {}
    for d, t in rows:
        own = t.split()
        for i in range(len(own) - 19):
            owners.setdefault(tuple(own[i : i + 20]), set()).add(d)
    for d, t in rows:
        own = t.split()
        out[d] = {i for i in range(len(own) - 19) if len(owners[tuple(own[i : i + 20])]) > 1}
    return {d: places for d, places in out.items() if places}


def test_every_window_is_looked_at(spark):
    """Short runs at any place, refrains and lists, an edited paragraph: all windows that two documents share."""
    rows = []
    for i in range(40):
        run = words(20 + i % 25, 900 + i)
        rows += [(2 * i + side, " ".join(words(3 * i + 40 * side, 2000 + 2 * i + side) + run + words(90 - i, 3000 + 2 * i + side))) for side in (0, 1)]
    refrain, body = words(6, 11), words(70, 12)
    song = [w for k in range(0, 70, 8) for w in body[k : k + 8] + refrain]
    menu = words(4, 13) * 8
    paragraph = words(60, 14)
    changed = paragraph[:30] + ["other"] + paragraph[31:]
    for at, (a, b) in enumerate([(song, song), (menu, menu), (paragraph, changed)]):
        rows += [(100 + 2 * at + side, " ".join(words(60, 40 + 2 * at + side) + own + words(70, 50 + 2 * at + side))) for side, own in ((0, a), (1, b))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    want, got = shared_windows(rows), {}
    for r in passages.repeated(docs).collect():
        got.setdefault(r["doc_id"], set()).add(r["start"])
    assert set(want) == {d for d, _ in rows}
    assert got.keys() == want.keys() and all(want[d] <= got[d] for d in want)


def test_copies_are_worked_on_once(spark, monkeypatch):
    """Windows of copies come from stretches, not from rows of their own; what a copy shares with other texts joins their component."""
    run, long, noise = words(40, 60), words(300, 61), words(90, 62)
    copied = " ".join(long[:100] + run + long[100:] + ["so"] * 60 + noise + run[:30])
    rows = [(d, copied) for d in (7, 8, 9, 9)] + [(3, " ".join(words(30, 63) + run)), (20, " ".join(noise)), (21, " ".join(noise)), (30, " ".join(words(80, 64)))]
    written, places = [], passages._places
    monkeypatch.setattr(passages, "_places", lambda *a: written.append(places(*a)) or written[-1])
    for more in ([], [(8, " ".join(noise[:50])), (None, " ".join(long[5:50])), (None, copied)]):  # ids with two texts and without any
        given = rows + more
        docs = spark.createDataFrame(given, "doc_id long, text string").repartition(4)
        owners = {}
        for d, t in given:
            for at, w in [(at, tuple(t.split()[at : at + 20])) for at in range(len(t.split()) - 19)]:
                if len(set(w)) > 1:
                    owners.setdefault(w, set()).add(d)
        want = []
        for d, t in given:
            for at in range(len(t.split()) - 19):
                ids = owners.get(tuple(t.split()[at : at + 20]), set()) - {None}
                want += [(d, at, min(ids))] if len(ids) > 1 else []
        got = [(r["doc_id"], r["start"], r["component_id"]) for r in passages.repeated(docs).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        if not more:
            assert written[-1].where("kind = 1 OR kind = 3").count() < 300 < len(got)


def test_hashes_made_for_many_places_at_once_are_those_of_each_place(monkeypatch):
    """Runs hashed by doubling, band keys in pieces and bags sorted only where a shingle repeats equal the plain versions."""
    values = np.random.RandomState(5).randint(1, 1 << 62, size=90, dtype=np.uint64)
    plain = [(values[i : i + 16] * passages._weights(16)).sum(dtype=np.uint64) for i in range(75)]
    assert (passages._doubled(values, 16) == passages._mix(np.array(plain))).all()
    text = " ".join(words(60, 70) + words(3, 71) * 9 + ["so"] * 45 + words(70, 72)).encode()
    whole = [np.concatenate(part) for part in zip(*passages.windows(text))]
    monkeypatch.setattr(passages, "PIECE", 37)
    assert all((a == np.concatenate(part)).all() for a, part in zip(whole, zip(*passages.windows(text))))
    starts, rows = passages.paragraphs(text)
    assert len(starts) > 3 and (passages._ids(rows) == whole[1][np.searchsorted(whole[0], starts)]).all()
    rows = np.concatenate([rows, np.tile(rows[:, :4], (1, 4)), rows[:, :1] + np.zeros((1, 16), np.uint64)])
    keys = passages.band_keys(rows)
    monkeypatch.setattr(passages, "KEYED", 7)
    assert (passages.band_keys(rows) == keys).all() and (passages.band_keys(rows[5:6]) == keys[5]).all()
    for row, bag in zip(rows, passages.bags(rows)):
        again = [(row[:k] == v).sum() for k, v in enumerate(row)]
        assert len(set(bag)) == 16 and all((b == v) == (n == 0) for v, b, n in zip(row, bag, again))


def test_bands_recall_of_similar_paragraphs():
    rng = np.random.RandomState(3)
    met = 0
    for _ in range(400):
        a = rng.randint(1, 1 << 60, size=16, dtype=np.uint64)
        b = a.copy()
        b[0] = rng.randint(1, 1 << 60, dtype=np.uint64)
        met += bool((passages.band_keys(a[None]) == passages.band_keys(b[None])).any())
    assert met / 400 > 0.95


def test_secret_scan(spark):
    rng = random.Random(6)
    hexes = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    filler = " ".join(words(60, 9))
    rows = [(i, f'{filler} token = "{hexes(40)}" {filler}') for i in range(60)]
    rows += [(100 + i, f"{filler} name{i}.some{i}@mail{i}.example.com and {rng.randint(10**15, 10**16 - 1)} {filler}") for i in range(60)]
    rows += [(200, None), (201, ""), (202, "plain words only"), (203, f'password: {hexes(32)}'), (1, rows[1][1]), (None, rows[2][1])]
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    found = secrets.scan(docs).collect()
    secret = {r["doc_id"] for r in found if r["is_secret"]}
    assert secret == {*range(60), 203, None}
    assert sum(1 for r in found if r["doc_id"] == 1) == 2
    assert all(0 <= r["score"] <= 1 for r in found)
    assert not any("Python" in str(p) for p in [secrets.scan(docs)._jdf.queryExecution().executedPlan().toString()])
    assert secrets.scan(docs.where("false")).count() == 0
    assert {r["score"] for r in secrets.scan(docs.where("doc_id >= 100 AND doc_id < 200")).collect()} == {0.0}
