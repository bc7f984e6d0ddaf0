"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, neighbouring pairs and pairs with one word between, hashed to ``DIMENSIONS`` slots;
a feature counts once per text. FTRL keeps a rate per slot and its L1 term leaves most weights at exactly zero,
so the model is a short list. Slots met in fewer than ``INCLUDE`` texts of the sample do not enter it. It learns in order of a hash of doc_id from at most ``LEARN_ROWS`` labelled rows
(an online learner is sequential: one task holds the slots of the bounded sample and goes over them in passes). Scoring covers all
rows. Null and empty texts have no features and score as the bias does. Without labels the score is the prior.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compindex.llm.common import carried_id, is_held_out, returned
from compindex.session import cut_lineage

DIMENSIONS = 1 << 20
LEARN_ROWS = 20_000
PASSES = 6
INCLUDE = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 8.0, 1.0
THRESHOLD = 0.3
WORD = regex.compile(r"\w+")
# Fixed odd multipliers that make pairs and skip pairs different features.
FIRST, SECOND, SKIP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def features(text: str | None) -> np.ndarray:
    """Slots of all features of one whole text, repeats included."""
    words = [crc32(w.encode()) for w in WORD.findall(text.lower())] if text else []
    h = np.array(words, np.uint64)
    pairs, skips = h[:-1] * FIRST + h[1:] * SECOND, h[:-2] * FIRST + h[2:] * SKIP
    return (np.concatenate([h * FIRST, pairs, skips]) >> np.uint64(44)).astype(np.int32)


def sample(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS) -> DataFrame:
    """(doc_id, label, text, order) to learn from: the first ``rows`` labelled ids in hash order, held-out ids left out.

    An id that many rows share gives one text, that of the smallest hash; every task picks its own first.
    """
    usable = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out())
    one_each = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    chosen = one_each.withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(rows)
    # at most `rows` rows of three numbers
    met = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return met.groupBy("doc_id", "label", "order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2)
    return np.where(np.abs(z) <= L1, 0.0, w)


def learn(z: np.ndarray, n: np.ndarray, slots: np.ndarray, label: int, base: float) -> None:
    """One FTRL-proximal step, in place, on the distinct slots of a text. The last slot is the bias."""
    own = np.append(slots, DIMENSIONS)
    zi, ni = z[own], n[own]
    w = _weights(zi, ni)
    gradient = 1 / (1 + np.exp(-np.clip(base + w.sum(), -35, 35))) - label
    grown = np.sqrt(ni + gradient * gradient)
    z[own] = zi + gradient - (grown - np.sqrt(ni)) / ALPHA * w
    n[own] = ni + gradient * gradient


class Model:
    """Base log-odds, bias, and the slots whose weight is not zero."""

    def __init__(self, base: float, bias: float, slots: np.ndarray, weights: np.ndarray) -> None:
        self.base, self.bias, self.slots, self.weights = base, bias, slots, weights


def train(chosen: DataFrame, passes: int = PASSES) -> Model:
    """A model from rows (doc_id, label, text); their number is bounded by ``sample``."""

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"order": batch["order"], "doc_id": batch["doc_id"], "label": batch["label"], "slots": [np.unique(features(t)) for t in batch["text"]]})

    found = chosen.select("order", "doc_id", "label", "text").mapInPandas(extract, "order long, doc_id long, label int, slots array<int>")
    rows = cut_lineage(found.repartition(1).sortWithinPartitions("order", "doc_id"))
    seen = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("pos")).first()
    base = log((seen["pos"] + 1) / (seen["n"] - seen["pos"] + 19))
    if not seen["n"]:
        return Model(base, 0.0, np.zeros(0, int), np.zeros(0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        texts, met = [], np.zeros(DIMENSIONS, np.int32)
        for batch in batches:
            for label, slots in zip(batch["label"], batch["slots"]):
                texts.append((label, slots))
                met[slots] += 1
        included = met >= INCLUDE
        texts = [(label, slots[included[slots]]) for label, slots in texts]
        z, n = np.zeros((2, DIMENSIONS + 1))
        for _ in range(passes):
            for label, slots in texts:
                learn(z, n, slots, label, base)
        weights = _weights(z, n)
        used = np.append(np.flatnonzero(weights[:-1]), DIMENSIONS)
        yield pd.DataFrame({"slot": used, "weight": weights[used]})

    # one row per weight that is not zero: L1 leaves few, and there are no more than slots
    found = rows.mapInPandas(run, "slot int, weight double").orderBy("slot").collect()
    slots, weights = np.array([r["slot"] for r in found], int), np.array([r["weight"] for r in found])
    return Model(base, float(weights[-1]), slots[:-1], weights[:-1])


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row; the score reads nothing but the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, dense = shared.value, np.zeros(DIMENSIONS)
        dense[m.slots] = m.weights
        for batch in batches:
            scores = []
            for text in batch["text"]:
                slots = features(text)
                hit = np.unique(slots[dense[slots] != 0])
                scores.append(1 / (1 + np.exp(-np.clip(m.base + m.bias + dense[hit].sum(), -35, 35))))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": np.array(scores, float)})

    return returned(docs.select(carried_id(), "text").mapInPandas(run, "doc_id long, score double"))


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = LEARN_ROWS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    model = train(sample(docs, labels, rows))
    return scored(docs, model).select("doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
