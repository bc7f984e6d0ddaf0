"""Language of a text, word first with backoff to character n-grams.

A word the model knows scores by its log frequency in each language. Any other word falls back to its longest
known n-grams, from ``LONGEST`` characters down to one, and scores by their mean. The text takes the language
with the largest sum; the score is its share of the likelihood. The model comes from at most ``LEARN_ROWS`` rows in
hash order and keeps the ``WORDS`` and ``GRAMS`` most frequent entries, so that its size is bounded; every row is predicted.
Null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be learned.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compindex.llm.common import carried_id, is_held_out, returned
from compindex.session import cut_lineage

LEARN_ROWS = 20_000
WORDS, GRAMS = 60_000, 60_000
LONGEST = 5
SMOOTH = 0.5
UNKNOWN = "und"
LETTERS = regex.compile(r"\p{L}+")
# Unseen words remembered per worker: bounds its memory, not the result.
REMEMBERED = 100_000


def grams(word: str) -> Iterator[str]:
    """All n-grams of the word between its edge marks, longest first."""
    edged = f"^{word}$"
    for size in range(min(LONGEST, len(edged)), 0, -1):
        for at in range(len(edged) - size + 1):
            yield edged[at : at + size]


def sample(docs: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """(lang, text) of the first ``rows`` usable ids in hash order; held-out rows and null languages are left out.

    An id that many rows share gives one of them, that of the smallest hash; every task picks its own first.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~is_held_out())
    chosen = usable.select("doc_id").distinct().withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    met = usable.select("doc_id", "lang", "text").join(F.broadcast(chosen.select("doc_id")), "doc_id")
    return met.groupBy("doc_id").agg(F.min_by(F.struct("lang", "text"), F.xxhash64("lang", "text")).alias("row")).select("row.lang", "row.text")


def _counted(chosen: DataFrame) -> DataFrame:
    """(lang, entry, is_word, n): words and n-grams of the sample, summed in each task first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, texts in batch.groupby("lang")["text"]:
                words: Counter[str] = Counter()
                for text in texts:
                    words.update(LETTERS.findall(text.lower()))
                parts: Counter[str] = Counter()
                for word, n in words.items():
                    for gram in grams(word):
                        parts[gram] += n
                for kind, found in ((True, words), (False, parts)):
                    yield pd.DataFrame({"lang": lang, "entry": list(found), "is_word": kind, "n": list(found.values())})

    pieces = chosen.mapInPandas(run, "lang string, entry string, is_word boolean, n long")
    return pieces.groupBy("lang", "entry", "is_word").agg(F.sum("n").alias("n"))


class Model:
    """Languages, and a row of log frequencies for each word and n-gram."""

    def __init__(self, langs: list[str], words: dict[str, int], parts: dict[str, int], table: np.ndarray) -> None:
        self.langs, self.words, self.parts, self.table = langs, words, parts, table

    def backoff(self, word: str) -> np.ndarray:
        """Mean row of the longest known n-grams of an unseen word."""
        edged = f"^{word}$"
        for size in range(min(LONGEST, len(edged)), 0, -1):
            rows = [r for at in range(len(edged) - size + 1) if (r := self.parts.get(edged[at : at + size])) is not None]
            if rows:
                return self.table[rows].mean(axis=0)
        return np.zeros(len(self.langs))

    def predict(self, text: str | None, met: dict[str, np.ndarray]) -> tuple[str, float]:
        counts = Counter(LETTERS.findall(text.lower())) if text else {}
        if not counts or not self.langs:
            return UNKNOWN, 0.0
        total, rows, times = np.zeros(len(self.langs)), [], []
        for word, n in counts.items():
            row = self.words.get(word)
            if row is not None:
                rows.append(row)
                times.append(n)
                continue
            own = met.get(word)
            if own is None:
                if len(met) >= REMEMBERED:
                    met.clear()
                own = met[word] = self.backoff(word)
            total += own * n
        if rows:
            total += np.array(times, float) @ self.table[rows]
        odds = np.exp(total - total.max())
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def train(chosen: DataFrame, words: int = WORDS, parts: int = GRAMS) -> Model:
    """A model from rows (lang, text); at most ``words`` + ``parts`` entries reach the driver."""
    counts = cut_lineage(_counted(chosen))
    totals = {(r["lang"], r["is_word"]): r["n"] for r in counts.groupBy("lang", "is_word").agg(F.sum("n").alias("n")).collect()}
    langs = sorted({lang for lang, _ in totals})
    index, kept, rows = {lang: k for k, lang in enumerate(langs)}, ({}, {}), []
    for kind, most in ((True, words), (False, parts)):
        per_entry = counts.where(F.col("is_word") == kind).groupBy("entry").agg(
            F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")
        )
        sums = np.array([totals.get((lang, kind), 0) for lang in langs], float)
        for row in per_entry.orderBy(F.desc("n"), "entry").limit(most).collect():
            own = np.zeros(len(langs))
            for lang, n in row["by"].items():
                own[index[lang]] = n
            kept[0 if kind else 1][row["entry"]] = len(rows)
            rows.append(np.log((own + SMOOTH) / (sums + SMOOTH * most)))
    return Model(langs, *kept, np.array(rows).reshape(len(rows), len(langs)))


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row; the prediction reads nothing but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, met = shared.value, {}
        for batch in batches:
            found = [m.predict(t, met) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    return returned(docs.select(carried_id(), "text").mapInPandas(run, "doc_id long, lang_pred string, score double"))


def languages(docs: DataFrame, rows: int = LEARN_ROWS, words: int = WORDS, parts: int = GRAMS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs``; the model keeps the most frequent ``words`` and ``parts``."""
    return identified(docs, train(sample(docs, rows), words, parts)).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")
