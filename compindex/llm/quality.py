"""Quality by weak supervision: rules vote or abstain, and EM weighs them without labels.

Each rule reads counts of the whole text and votes good, bad or not at all. The votes of all documents are
counted by pattern (at most 3 ^ rules of them), expectation-maximisation estimates how often each rule is
right on good and on bad documents, and a document's posterior probability of being good follows from its
votes. Null and empty texts have no words; repeated rows are judged alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from compindex.llm.common import carried_id, let_go, returned, text_bytes
from compindex.session import cut_lineage

# The characters that count as symbols, and what separates words.
SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\x0c"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_plain", "n_small", "n_upper", "n_lower", "n_marks", "n_stops")
WINDOW = 3
MIN_WORDS = 50
ACCEPT = 0.5
BAD, ABSTAIN, GOOD = 0, 1, 2


def word_kinds(words: list[bytes]) -> tuple[int, int, int, int]:
    """Words inside 3-word windows that occur twice or more, distinct words, plain and small words.

    A plain word is letters with at most a stop or comma behind them; a small one is plain, lower case and of
    three letters at most, as most function words are.
    """
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    size, times = len(index), np.bincount(ids)
    bare = [w.decode("utf-8", "replace").rstrip(".,") for w in index]
    plain = np.fromiter((w.isalpha() for w in bare), bool, size)
    small = np.fromiter((len(w) <= 3 and w.islower() for w in bare), bool, size) & plain
    kinds = size, int(times[plain].sum()), int(times[small].sum())
    if len(ids) < WINDOW:
        return 0, *kinds
    # a pair's number is below size^2 and is renumbered first, so three words always fit into 64 bits
    _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
    _, slot, found = np.unique(pairs[:-1] * size + ids[2:], return_inverse=True, return_counts=True)
    again, covered = found[slot] > 1, np.zeros(len(ids), bool)
    for k in range(WINDOW):
        covered[k : len(ids) - WINDOW + 1 + k] |= again
    return int(covered.sum()), *kinds


def counts(data: bytes | None) -> tuple[int, ...]:
    """The counts named in ``COUNTS`` for one whole text."""
    data = data or b""
    words = data.split()
    repeated, distinct, plain, small = word_kinds(words)
    seen: set[bytes] = set()
    lines = dup_lines = 0
    for line in data.split(b"\n"):
        if line.strip(BLANKS):
            lines += 1
            dup_lines += line in seen
            seen.add(line)
    codes = np.frombuffer(data, np.uint8)
    upper, lower = int(((codes >= 65) & (codes <= 90)).sum()), int(((codes >= 97) & (codes <= 122)).sum())
    word_chars = len(data.translate(None, BLANKS).decode("utf-8", "replace"))
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    return len(words), word_chars, symbols, lines, dup_lines, repeated, distinct, plain, small, upper, lower, data.count(b"!"), data.count(b".")


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, counts ..) for every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            out = pd.DataFrame([counts(t) for t in batch["data"]], columns=list(COUNTS), dtype="int64")
            out.insert(0, "doc_id", batch["doc_id"].to_numpy())
            yield out

    found = docs.select(carried_id(), text_bytes().alias("data")).mapInPandas(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS))
    return returned(found)


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def default_rules() -> list[Column]:
    """One vote per property; a middling value is no evidence and abstains.

    The broad ones (plain words, small words, sentences) overlap with each narrow one, which ties the rules together.
    """
    c = F.col
    words, letters = c("n_words"), c("n_upper") + c("n_lower")
    return [
        vote(c("n_plain") * 10 < words * 7, c("n_plain") * 20 > words * 17),
        vote(c("n_small") * 20 < words, c("n_small") * 10 > words),
        vote(c("n_stops") * 50 < words, c("n_stops") * 25 > words),
        vote(c("n_symbols") * 5 > words, c("n_symbols") * 50 < words),
        vote(c("n_upper") * 2 > letters, c("n_upper") * 5 < letters),
        vote(c("n_marks") * 4 > words, c("n_marks") * 50 <= words),
        vote(c("n_repeat_words") * 10 > words * 3, c("n_repeat_words") * 10 < words),
        vote(c("n_distinct_words") * 4 < words, c("n_distinct_words") * 5 > words * 2),
        vote(c("n_dup_lines") * 10 > c("n_lines") * 3, c("n_dup_lines") == 0),
    ]


@dataclass(frozen=True)
class VoteModel:
    """Prior share of good documents; per rule the odds that a vote is right on good and on bad documents."""

    prior: float
    right_on_good: tuple[float, ...]
    right_on_bad: tuple[float, ...]

    def posterior(self, votes: list[Column]) -> Column:
        """Probability of being good, as a column of the votes."""
        total = F.lit(log(self.prior / (1 - self.prior)))
        for v, g, b in zip(votes, self.right_on_good, self.right_on_bad):
            total = total + F.when(v == GOOD, log(g / (1 - b))).when(v == BAD, log((1 - g) / b)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(patterns: np.ndarray, rows: np.ndarray, rounds: int = 200, tolerance: float = 1e-10) -> VoteModel:
    """EM over vote patterns (one row each) with their numbers of documents.

    A rule catches some kinds of fault and passes all others, so a bad vote is rare and trusted at first: the first
    guess is even odds after one bad vote and bad after two. A few pseudo-votes keep every rate away from 0 and 1.
    """
    good, bad = patterns == GOOD, patterns == BAD
    voted, p = good | bad, rows * np.array([0.95, 0.5, 0.05])[np.minimum(bad.sum(axis=1), 2)]
    before = None
    for _ in range(rounds):
        q = rows - p
        prior = (p.sum() + 4) / (rows.sum() + 5)
        g = (p @ good + 9.5) / (p @ voted + 10)
        b = (q @ bad + 1) / (q @ voted + 4)
        now = np.concatenate([[prior], g, b])
        if before is not None and np.abs(now - before).max() < tolerance:
            break
        before = now
        p = rows / (1 + np.exp(-(np.log(prior / (1 - prior)) + good @ np.log(g / (1 - b)) + bad @ np.log((1 - g) / b))))
    return VoteModel(float(prior), tuple(map(float, g)), tuple(map(float, b)))


def learned(votes: DataFrame, names: list[str]) -> VoteModel:
    """The model of all rows of ``votes``; at most 3 ^ rules patterns reach the driver."""
    found = votes.groupBy(*names).agg(F.count(F.lit(1)).alias("_rows")).orderBy(*names).collect()
    if not found:
        return VoteModel(0.8, (0.95,) * len(names), (0.25,) * len(names))
    table = np.array([tuple(r) for r in found], np.int64)
    return fit(table[:, :-1], table[:, -1].astype(float))


def judged(docs: DataFrame, rules: list[Column] | None = None, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, counts .., base_failed, quality, kept) for every row of ``docs`` (doc_id, text)."""
    rules = default_rules() if rules is None else rules
    names = [f"_v{k}" for k in range(len(rules))]
    votes = cut_lineage(measured(docs).select("*", *[r.alias(n) for r, n in zip(rules, names)]))
    model = learned(votes, names)
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    quality = model.posterior([F.col(n) for n in names])
    return votes.select(
        "doc_id", *COUNTS, failed.alias("base_failed"), quality.alias("quality"), (~failed & (quality >= accept)).alias("kept")
    )
