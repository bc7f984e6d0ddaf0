"""The pipeline against a plain version of every stage, over the smallest documents table."""

import hashlib
import math
import re
import sys
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline  # noqa: E402
from compindex import session  # noqa: E402
from compindex.llm import bpe, common, mixing, nearcopies, quality, stages  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    bare = [w.rstrip(".,") for w in words]
    plain = [w for w in bare if w.isalpha()]
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_lines": len(lines),
        "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered), "n_distinct_words": len(set(words)), "n_plain": len(plain),
        "n_small": sum(len(w) <= 3 and w.islower() for w in plain), "n_upper": len(re.findall("[A-Z]", text)), "n_lower": len(re.findall("[a-z]", text)),
        "n_marks": text.count("!"), "n_stops": text.count("."),
    }


def votes(c):
    n, letters = c["n_words"], c["n_upper"] + c["n_lower"]
    rules = [
        (c["n_plain"] * 10 < n * 7, c["n_plain"] * 20 > n * 17), (c["n_small"] * 20 < n, c["n_small"] * 10 > n), (c["n_stops"] * 50 < n, c["n_stops"] * 25 > n),
        (c["n_symbols"] * 5 > n, c["n_symbols"] * 50 < n), (c["n_upper"] * 2 > letters, c["n_upper"] * 5 < letters), (c["n_marks"] * 4 > n, c["n_marks"] * 50 <= n),
        (c["n_repeat_words"] * 10 > n * 3, c["n_repeat_words"] * 10 < n), (c["n_distinct_words"] * 4 < n, c["n_distinct_words"] * 5 > n * 2),
        (c["n_dup_lines"] * 10 > c["n_lines"] * 3, c["n_dup_lines"] == 0),
    ]
    return tuple(0 if bad else 2 if good else 1 for bad, good in rules)


def accepted(rows):
    measured = [counts(t) for _, t, _ in rows]
    found = Counter(map(votes, measured))
    patterns = sorted(found)
    m = quality.fit(np.array(patterns), np.array([float(found[p]) for p in patterns]))

    def keeps(c):
        score = math.log(m.prior / (1 - m.prior))
        for v, g, b in zip(votes(c), m.right_on_good, m.right_on_bad):
            score += math.log(g / (1 - b)) if v == 2 else math.log((1 - g) / b) if v == 0 else 0
        return c["n_words"] >= 50 and 2 * c["n_repeat_words"] <= c["n_words"] and score >= 0

    return [r for r, c in zip(rows, measured) if keeps(c)]


def shingles(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + 5]) for i in range(max(len(words) - 4, 1))}


def one_of_each(rows):
    """The document with the smallest id of each component of pairs with a Jaccard of 0.8 or more."""
    sets, parent = {d: shingles(t) for d, t, _ in rows}, {d: d for d, _, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [r for r in rows if find(r[0]) == r[0]]


def mixed(rows):
    sizes, out = defaultdict(list), []
    for d, t, s in rows:
        sizes[s].append((len(WORD.findall(t)), d, t))
    names = sorted(sizes)
    total = {s: sum(n for n, _, _ in sizes[s]) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    full = set()
    while True:
        left = 1.5 * sum(total.values()) - sum(2 * total[s] for s in full)
        level = left / sum(weight[s] for s in names if s not in full)
        over = {s for s in names if s not in full and weight[s] * level > 2 * total[s]}
        if not over:
            break
        full |= over
    for s in names:
        rate = (2 * total[s] if s in full else weight[s] * level) / total[s]
        start = int(hashlib.sha256(f"{mixing.SEED}:={s}".encode()).hexdigest()[:13], 16) / 2**52
        for i, (_, d, t) in enumerate(sorted(sizes[s])):
            out += [(d, t)] * (math.floor((i + 1) * rate + start) - math.floor(i * rate + start))
    return out


class Captured:
    """Stands for documents and hands out the function that their tasks would run."""

    def select(self, *columns):
        return self

    def mapInPandas(self, run, schema):
        self.run = run
        raise StopIteration

    mapInArrow = mapInPandas


def test_tasks_let_go_of_the_vocabulary_and_batches_stay_short(spark):
    """Stages that need no vocabulary free the one that encoding left in their worker; encoding gets short batches."""
    for operator in (quality.measured, nearcopies._marks):
        docs = Captured()
        try:
            operator(docs)
        except StopIteration:
            pass
        common.kept("bpe", 1, dict)
        assert list(docs.run(iter([]))) == [] and not common._KEPT
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = spark.createDataFrame([(i, f"some words {i}", "a") for i in range(3000)], "doc_id long, text string, source string").coalesce(1).cache()
    stages.encode(spark, docs, "").write.format("noop").mode("overwrite").save()
    sizes = docs.select("doc_id").mapInPandas(lambda batches: (pd.DataFrame({"rows": [len(b)]}) for b in batches), "rows long").collect()
    assert [r["rows"] for r in sizes] == [1000] * 3


def test_pipeline_matches_the_plain_version(spark, sf_dir):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    kept = accepted(rows)
    last = {}
    for row in sorted(kept):
        last[row[1]] = row
    want = Counter()
    for doc_id, text in mixed(one_of_each(list(last.values()))):
        ids = library.encode(text, add_special_tokens=False).ids
        want[doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()] += 1
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, sf_dir).collect())
    assert got == want and len(want) > 50


def test_lookups_with_hot_keys_do_not_add_tasks(spark):
    """F1 of round 3: every lookup of a crowded table added the partitions of its two branches, and files and tasks with them."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = [(0 if i % 2 else i, i) for i in range(3000)]
    df = session.cut_lineage(spark.createDataFrame(rows, "key long, n long").repartition(most))
    facts = spark.createDataFrame([(i, -i) for i in range(0, 2000)], "key long, fact long")
    hot = common.hot_keys(df, ["key"])
    assert hot.rdd.getNumPartitions() == 1 and [r["key"] for r in hot.collect()] == [0]
    for how in ("inner", "left"):
        found = common.lookup(df, facts, ["key"], how)
        assert found.rdd.getNumPartitions() <= most
        wanted = sorted((k, n, -k if k < 2000 else None) for k, n in rows if how == "left" or k < 2000)
        assert sorted(map(tuple, found.select("key", "n", "fact").collect())) == wanted


def test_near_copy_stage_leaves_few_shuffle_files(spark):
    """F1 of round 3: shuffle files stayed on disk until the driver happened to collect its garbage."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        return {p for folder in manager.localDirsString() for p in Path(folder).rglob("shuffle_*")}

    body = " ".join(f"word{k}" for k in range(80))
    rows = [(i, body if i % 5 == 0 else f"{body} more{i}" if i % 5 == 1 else " ".join(f"w{i}x{k}" for k in range(30))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before, setting = files(), spark.conf.get(session.FREE_SHUFFLES, None)
    kept = stages.near_dedup(spark, docs, "")
    deadline = time.time() + 20  # files go in the background
    while (left := files() - before) and time.time() < deadline:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get(session.FREE_SHUFFLES, None) == setting
    wanted = [i for i in range(300) if i % 5 > 1 or i == 0]
    for _ in range(2):
        assert sorted(r["doc_id"] for r in kept.collect()) == wanted
