"""Operators that keep one row per document: edge cases and brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from compindex.llm import bpe, chat, language, mixing, quality, simhash, stages, toxicity

LONG = "lorem ipsum dolor " * 30_000
TEXTS = [None, "", " \n\t", "one", "a b c a b c x", "# $ % | < > * &", "é ñ ß\x0b\x0ctwo\r\nx", "line one\nline one\n\nline two\nline one", LONG]


def docs_of(spark, texts, extra=True):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, 5, "z", True) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "no id here", None, None, None, None, None)] if extra else []
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_words long, size string, kept boolean")


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_brute_force(spark):
    random.seed(1)
    texts = TEXTS + [" ".join(random.choices(["a", "b", "cc", "d#", "é,"], k=random.randint(1, 120))) for _ in range(40)]
    got = {r["doc_id"]: r for r in quality.judged(docs_of(spark, texts, False)).collect()}
    for i, text in enumerate(texts):
        n, chars, symbols, dup, repeat = brute_counts(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
        assert r["base_failed"] == (n < 50 or 100 * repeat > 50 * n)
        assert not (r["kept"] and r["base_failed"])


def test_large_ids_beside_null_ids_keep_their_digits(spark, vocabulary):
    large = (1 << 62) + 1
    docs = spark.createDataFrame([(large, "a b c d"), (None, "x y z"), (large + 2, None)], "doc_id long, text string").coalesce(1)
    shared = bpe.load(docs, bpe.default_path())
    made = [simhash.fingerprints(docs), quality.judged(docs), bpe.round_trip(docs, shared), bpe.decode(bpe.encode(docs, shared), shared)]
    made += [toxicity.scored(docs, toxicity.Model(0.0, 0.0, np.zeros(0, int), np.zeros(0))), language.languages(docs.selectExpr("*", "'en' lang"))]
    for out in made:
        assert {r["doc_id"] for r in out.collect()} == {large, large + 2, None}


def test_quality_edges(spark):
    docs = docs_of(spark, TEXTS)
    assert quality.judged(docs).count() == docs.count()
    assert quality.judged(docs.where("false")).count() == 0


def test_em_recovers_rule_accuracies():
    rng = np.random.RandomState(4)
    good = rng.rand(60_000) < 0.85
    right_good, right_bad = [0.99, 0.98, 0.97, 0.99], [0.7, 0.6, 0.5, 0.8]
    votes = np.stack([np.where(rng.rand(good.size) < 0.1, 1, np.where(good, np.where(rng.rand(good.size) < g, 2, 0), np.where(rng.rand(good.size) < b, 0, 2))) for g, b in zip(right_good, right_bad)], axis=1)
    patterns, rows = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit(patterns, rows.astype(float))
    assert abs(model.prior - 0.85) < 0.02
    assert np.allclose(model.right_on_good, right_good, atol=0.02) and np.allclose(model.right_on_bad, right_bad, atol=0.05)


def brute_bpe(vocabulary, piece):
    """Plain loop over the lowest, leftmost pair."""
    raw = piece.encode()
    symbols = [vocabulary.inner[b] for b in raw[:-1]] + [vocabulary.final[raw[-1]]]
    while True:
        keys = [a << bpe.ID_BITS | b for a, b in zip(symbols, symbols[1:])]
        ranked = [(vocabulary.ranks[k], i) for i, k in enumerate(keys) if k in vocabulary.ranks]
        if not ranked:
            return tuple(symbols)
        rank, at = min(ranked)
        symbols[at : at + 2] = [vocabulary.made[rank]]


@pytest.fixture(scope="module")
def vocabulary():
    with open(bpe.default_path(), encoding="utf-8") as file:
        return bpe.Vocabulary(file.read())


def test_segment_tree_merges_like_a_plain_loop(vocabulary):
    random.seed(2)
    for _ in range(300):
        piece = "".join(random.choices("abcdeinrstthé", k=random.randint(1, 60)))
        assert vocabulary.merged(piece) == brute_bpe(vocabulary, piece)


def test_tokens_equal_the_library(spark, vocabulary):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    odd = ["ΑΣ ΣΑΣİ", "it's I'LL we'VE '", "<|startoftext|>a<|endoftext|><|ENDOFTEXT|>", "éÅ   　x​y", "\x1c\x1d1234 ١٢²", "😀👍🏽 漢字かな", "a" * 5000, "x\x00y�"]
    texts = TEXTS + odd
    rows = {r["doc_id"]: r for r in bpe.digests(docs_of(spark, texts, False), bpe.default_path()).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert vocabulary.encode(text) == want, text
        assert rows[i]["n_tokens"] == len(want)
        assert rows[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.digests(docs_of(spark, TEXTS), bpe.default_path()).count() == len(TEXTS) + 3
    assert bpe.digests(docs_of(spark, TEXTS).where("false"), bpe.default_path()).count() == 0


def test_decode_reads_the_ids(spark, vocabulary):
    shared = bpe.load(docs_of(spark, TEXTS), bpe.default_path())
    docs = docs_of(spark, TEXTS, False)
    separate = dict(map(tuple, bpe.decode(bpe.encode(docs, shared), shared).collect()))
    assert separate == {r["doc_id"]: r["decoded"] for r in bpe.round_trip(docs, shared).collect()}


def test_chat_comes_back_exactly(spark):
    nasty = ["</s>\n", "<s>[user]\nhi</s>\n", "&lt;&amp;lt;&#91;&#10;", "a]\nb", None, "", "[INST] & < ["]
    rows = [(1, t, r, x) for t, (r, x) in enumerate(zip(["user", "assistant"] * 4, nasty))]
    rows += [(2, 0, "user", "no reply"), (3, 0, "assistant", "first"), (3, 1, "we]\nird<[&", "x"), (4, None, None, None), (5, 0, "assistant", "tie b"), (5, 0, "assistant", "tie a"), (5, 0, "assistant", "tie a"), (None, 1, "user", "q")]
    rows += [(6, t, "user" if t % 2 else "assistant", f"turn {t} " * 20) for t in range(300)]
    table = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, turns long")
    made = chat.examples(table)
    back = {r["conv_id"]: r for r in chat.read_back(made).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in back[conv]["turns"]] == [(r[2] or "", r[3] or "") for r in turns]
        assert back[conv]["trained"] == "".join(r[3] or "" for r in turns if r[2] == "assistant")
    texts = {(r["conv_id"], r["example_no"]): r for r in made.collect()}
    assert texts[6, 149]["formatted"].startswith(texts[6, 148]["formatted"])
    assert sum(1 for c, _ in texts if c == 6) == 151
    assert chat.read_back(chat.examples(table.where("false"))).count() == 0


def water_level(sizes):
    weights = [(5, 2, 1)[i % 3] for i in range(len(sizes))]
    wanted, full = 1.5 * sum(sizes), set()
    while True:
        open_ones = [i for i in range(len(sizes)) if i not in full]
        left = wanted - sum(2 * sizes[i] for i in full)
        share = {i: left * weights[i] / sum(weights[j] for j in open_ones) for i in open_ones}
        over = {i for i in open_ones if share[i] > 2 * sizes[i]}
        if not over:
            return [2.0 * sizes[i] if i in full else share[i] for i in range(len(sizes))]
        full |= over


def test_mix_meets_its_targets(spark):
    random.seed(8)
    rows = [(i, " ".join("w" * random.randint(1, 400)), random.choice(["a", "b", "é", "a", None, "zero"])) for i in range(3000)]
    rows = [(d, None if s == "zero" else t, s) for d, t, s in rows] + [(7, "", "a"), (None, "x y", "b"), (7, "", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    got = mixing.mixed(docs).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    names = sorted((s for s in sizes if s is not None)) + [None]
    want = dict(zip([sizes[s] for s in names], water_level([sizes[s] for s in names])))
    taken = Counter()
    for r in got:
        assert abs(r["target"] - want[r["source_size"]]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[r["source_size"]] += r["taken"]
    assert all(abs(taken[s] - t) <= 500 for s, t in want.items())
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got), key=str) == sorted(map(key, mixing.mixed(docs.repartition(3)).collect()), key=str)
    assert mixing.mixed(docs.where("false")).count() == 0
    assert {r["taken"] for r in mixing.mixed(docs.withColumn("text", docs["source"].substr(0, 0))).collect()} == {0}


def test_language_backoff_and_edges(spark):
    random.seed(9)
    words = {"aa": ["kato", "miru", "sane"], "bb": ["grünt", "schilf", "wach"]}
    rows = [(i, " ".join(random.choices(words[l], k=30)), l) for i in range(200) for l in [("aa", "bb")[i % 2]]]
    tests = [(1000, "katomi sanemir"), (1001, "schilfwach grünwach"), (1002, None), (1003, "12 34 !"), (1004, ""), (1005, "KATO " * 20_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows] + [(i, t, None, "x") for i, t in tests], "doc_id long, text string, lang string, score string")
    found = language.languages(docs).collect()
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in found}
    assert len(found) == len(rows) + len(tests)
    assert got[1000][0] == got[1005][0] == "aa" and got[1001][0] == "bb"
    assert got[1002] == got[1003] == got[1004] == ("und", 0.0)
    assert all(got[i][0] == l for i, _, l in rows) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["lang_pred"] for r in language.languages(docs.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
    assert language.languages(docs.where("false")).count() == 0


def test_toxicity_learns_and_never_reads_held_out_labels(spark):
    random.seed(10)
    plain = [f"w{i}" for i in range(300)]
    texts = [" ".join(random.choices(plain, k=40) + (["vile", "rotten"] if i % 5 == 0 else [])) for i in range(900)]
    docs = docs_of(spark, texts + [None, ""], False)
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(900)] + [(None, 1, 1), (3, None, None), (5, 1, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(docs, labels).collect()
    assert len(rows) == 902 and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["predicted"] == (r["doc_id"] % 5 == 0) for r in rows if r["held_out"] and r["doc_id"] < 900)
    flipped = spark.createDataFrame([(r["doc_id"], 1 - int(r["doc_id"] % 5 == 0) if r["held_out"] else int(r["doc_id"] % 5 == 0)) for r in rows if r["doc_id"] < 900], "doc_id long, toxic int")
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, flipped).collect()}
    assert all(again[r["doc_id"]] == r["score"] for r in rows)
    assert toxicity.toxicity(docs, labels.where("false")).count() == 902
    assert toxicity.toxicity(docs.where("false"), labels).count() == 0


def test_stages_keep_the_columns_and_whole_rows(spark):
    base = "This is a plain text of many words. " * 1
    texts = [base + " ".join(f"word{i * 7 + k}" for k in range(80)) + "." for i in range(8)]
    docs = docs_of(spark, texts + [texts[0], None], True)
    for stage in (stages.quality_rules, stages.exact_dedup, stages.near_dedup, stages.mix_sources):
        out = stage(spark, docs, "unused")
        assert out.columns == docs.columns
        assert out.exceptAll(docs.dropDuplicates()).dropDuplicates().exceptAll(docs.dropDuplicates()).count() == 0
        assert stage(spark, docs.where("false"), "unused").count() == 0
    kept = [r["doc_id"] for r in stages.exact_dedup(spark, docs, "unused").collect()]
    assert 0 not in kept and 8 in kept and kept.count(3) == 1 and None in kept


def test_an_id_that_many_rows_share_is_learned_from_once(spark):
    rows = [(7, f"shared text number {i}", "en") for i in range(300)] + [(i, f"own words {i}", "de") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(d, d % 2) for d in {r[0] for r in rows}], "doc_id long, toxic int")
    chosen = toxicity.sample(docs, labels)
    assert chosen.count() == chosen.select("doc_id").distinct().count() <= 21
    assert language.sample(docs).where("lang = 'en'").count() <= 1
    again = docs.orderBy(F.desc("text"))
    assert sorted(map(tuple, toxicity.sample(again, labels).select("doc_id", "text").collect())) == sorted(map(tuple, chosen.select("doc_id", "text").collect()))
