"""Hard-negative mining by slots of scores.

For every anchor the best rows of its own label are its positives, and each positive asks for the best rows of other
labels whose score lies in a window below its own. The windows of one anchor overlap, but their upper limits, in
falling order, split the scores into disjoint slots: window i is what slots i, i + 1, .. hold above its lower limit.
So every task keeps the best ``per_positive`` rows of each slot, the same is done once more when the tasks' rows meet, and
the answer of window i is the front of the slots from i on, set side by side, cut at the lower limit. No pair is
met once per window, and nothing but the fronts of slots leaves a task.

Anchors are taken in waves of ``WAVE``, each broadcast as packed integers (a few MB, whatever the table); all rows
pass each wave where they are read, in blocks. Equal vectors of one label are compared once a block, by as many of their ids
as could ever be returned.

Defined cases: a row without label or vector, or with a null or non-finite component, takes no part; a shorter vector
counts as filled up with zeros; repeated rows count as rows of their own, but rows that share an anchor's id are
never its positives or negatives; a null id is never an anchor, comes last among ties and is returned as null. An empty
table gives no rows. Extra columns are ignored. Scores are exact up to 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from compindex.llm.best import Best, run_places
from compindex.session import cut_lineage

# Anchors broadcast at once: with 64 components of four bytes, 8 MB.
WAVE = 32_768
# Rows and anchors of one product: their scores stay below 32 MB.
ROW_BLOCK, ANCHOR_BLOCK = 2_048, 2_048
# Rows of the first products of a task, before it has bounds to compare with.
FIRST_BLOCK = 128
# Stands for a null id inside tasks.
LAST_ID = (1 << 63) - 1
SCALE = 256


def whole(vectors: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, matrix): the places of vectors that take part, and their components as floor(256 x), filled up with zeros."""
    values = vectors.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    sizes = np.diff(vectors.offsets.to_numpy())
    present = vectors.is_valid().to_numpy(zero_copy_only=False)
    sizes = np.where(present, sizes, 0)
    row = np.repeat(np.arange(len(sizes)), sizes)
    good = present.copy()
    good[row[~np.isfinite(values)]] = False
    matrix = np.zeros((len(sizes), int(sizes.max(initial=0))))
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    used = good[row]
    matrix[row[used], place[used]] = np.floor(SCALE * values[used])
    rows = np.flatnonzero(good)
    return rows, matrix[rows].astype(np.int64)


def products(rows: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """Exact inner products, in the narrowest type that holds every partial sum."""
    width = min(rows.shape[1], anchors.shape[1])
    rows, anchors = rows[:, :width], anchors[:, :width]
    most = width * float(np.abs(rows).max(initial=0)) * float(np.abs(anchors).max(initial=0))
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64
    return rows.astype(kind) @ anchors.astype(kind).T


def fewest(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, k: int) -> np.ndarray:
    """Places of the rows that can be among the best ``k`` of any anchor: of equal vectors and labels the first ids.

    Of one id ``k`` rows are enough, and 2 k rows of them hold k of another id than the anchor's.
    """
    if not len(ids):
        return np.empty(0, np.int64)
    parts = np.ascontiguousarray(np.column_stack([labels, matrix]))
    group = np.unique(parts.view(np.dtype((np.void, parts.shape[1] * parts.itemsize))).ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, group))
    same_id = np.append(False, (group[order][1:] == group[order][:-1]) & (ids[order][1:] == ids[order][:-1]))
    order = order[run_places(~same_id) < k]
    first = np.append(True, group[order][1:] != group[order][:-1])[: len(order)]
    return order[run_places(first) < 2 * k]


class Wave:
    """Some anchors, in the order of their labels, and once their positives are known the limits of their slots."""

    def __init__(self, number: int, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
        order = np.argsort(labels, kind="stable")
        self.number, self.ids, self.labels, self.matrix = number, ids[order], labels[order], matrix[order]
        self.upper = self.lower = None


def _rows(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, labels, matrix) of a batch's rows in the order of labels and ids, without needless repeats."""
    kept, matrix = whole(batch.column(2))
    ids = batch.column(0).fill_null(LAST_ID).to_numpy(zero_copy_only=False)[kept]
    labels = batch.column(1).to_numpy(zero_copy_only=False)[kept]
    few = fewest(ids, labels, matrix, k)
    few = few[np.lexsort((ids[few], labels[few]))]
    return ids[few], labels[few], matrix[few]


def _blocks(ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray, warm: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    at, step = 0, ROW_BLOCK if warm else FIRST_BLOCK
    while at < len(ids):
        yield ids[at : at + step], labels[at : at + step], matrix[at : at + step]
        at, step = at + step, min(2 * step, ROW_BLOCK)


def _stretches(labels: np.ndarray) -> dict[int, slice]:
    """Where each label lies in a sorted array."""
    if not len(labels):
        return {}
    starts = np.flatnonzero(np.append(True, labels[1:] != labels[:-1]))
    return {int(labels[a]): slice(a, b) for a, b in zip(starts, np.append(starts[1:], len(labels)))}


def own_label(wave: Wave, best: Best, some: slice, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
    """Adds a block's rows to the positives of those of the anchors ``some`` that have their label."""
    anchors, found = _stretches(wave.labels[some]), []
    for label, part in _stretches(labels).items():
        if label in anchors:
            at = anchors[label]
            scores = products(matrix[part], wave.matrix[some][at])
            r, a = np.nonzero(scores >= best.least[at].astype(_floating(scores)))
            found.append((a + at.start, scores[r, a], ids[part][r]))
    _add(wave, best, some, 1, found)


def other_labels(wave: Wave, best: Best, some: slice, ids: np.ndarray, labels: np.ndarray, matrix: np.ndarray) -> None:
    """Adds a block's rows to the slots of those of the anchors ``some`` that have other labels."""
    slots, own, found = wave.upper.shape[1], _stretches(labels), []
    scores = products(matrix, wave.matrix[some])
    scores = scores.astype(_floating(scores), copy=False)
    for label, part in _stretches(wave.labels[some]).items():
        if label in own:
            scores[own[label], part] = np.nan
    upper = wave.upper[some].astype(scores.dtype)
    lower = np.maximum(wave.lower[some], best.least.reshape(-1, slots)).astype(scores.dtype)
    for slot in range(slots):
        r, a = np.nonzero((scores <= upper[:, slot]) & (scores >= lower[:, slot]))
        found.append((a * slots + slot, scores[r, a], ids[r]))
    _add(wave, best, some, slots, found)


def _floating(scores: np.ndarray) -> type:
    return np.float32 if scores.dtype == np.float32 else np.float64


def _add(wave: Wave, best: Best, some: slice, slots: int, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
    """Hands on what was found, less an anchor's own id."""
    if found:
        key, score, ids = (np.concatenate(c) for c in zip(*found))
        other = ids != wave.ids[some][key // slots]
        best.add(key[other], score[other], ids[other])


def _best(rows: DataFrame, shared, find, k: int, slots: int, most: int) -> DataFrame:
    """(anchor, slot, rank, id, score): the best ``k`` of every anchor and slot, of each task first, then of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wave: Wave = shared.value
        parts = [slice(at, min(at + ANCHOR_BLOCK, len(wave.ids))) for at in range(0, len(wave.ids), ANCHOR_BLOCK)]
        bests, warm = [Best((p.stop - p.start) * slots, k) for p in parts], False
        for batch in batches:
            for block in _blocks(*_rows(batch, most), warm):
                for some, best in zip(parts, bests):
                    find(wave, best, some, *block)
            warm = True
        for some, best in zip(parts, bests):
            columns = [best.key // slots + some.start, (best.key % slots).astype(np.int32), best.id, best.score]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), ["anchor", "slot", "id", "score"])

    found = rows.mapInArrow(run, "anchor long, slot int, id long, score long")
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id"))
    return cut_lineage(found.withColumn("rank", place).where(F.col("rank") <= k))


def _packed(rows: DataFrame) -> DataFrame:
    """Rows of (ids, labels, width, components) as bytes, one per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, matrix = whole(batch.column(2))
            if len(kept):
                ids, labels = (batch.column(c).to_numpy(zero_copy_only=False)[kept].astype(np.int64) for c in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.tobytes()]), pa.array([labels.tobytes()]), pa.array([matrix.shape[1]]), pa.array([matrix.tobytes()])], ["ids", "labels", "width", "matrix"]
                )

    return rows.mapInArrow(run, "ids binary, labels binary, width long, matrix binary")


def _waves(packed: DataFrame) -> Iterator[Wave]:
    """The anchors in waves; the driver holds one wave and one partition's anchors at a time."""
    ids, labels, width, matrix, number = np.empty(0, np.int64), np.empty(0, np.int64), 0, np.empty((0, 0), np.int64), 0
    for row in packed.toLocalIterator(prefetchPartitions=True):
        more = np.frombuffer(row["ids"], np.int64)
        added = np.frombuffer(row["matrix"], np.int64).reshape(len(more), row["width"])
        width = max(matrix.shape[1], added.shape[1])
        matrix = np.vstack([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (matrix, added)])
        ids, labels = np.append(ids, more), np.append(labels, np.frombuffer(row["labels"], np.int64))
        while len(ids) >= WAVE:
            yield Wave(number, ids[:WAVE], labels[:WAVE], matrix[:WAVE].astype(np.int32) if np.abs(matrix).max() < 1 << 31 else matrix[:WAVE])
            ids, labels, matrix, number = ids[WAVE:], labels[WAVE:], matrix[WAVE:], number + 1
    if len(ids):
        yield Wave(number, ids, labels, matrix.astype(np.int32) if np.abs(matrix).max(initial=0) < 1 << 31 else matrix)


def set_limits(wave: Wave, positives: pd.DataFrame, per_anchor: int, low: int, high: int) -> None:
    """Upper and lower limits of every slot from the positives (anchor, rank, score) of the wave.

    Slot i ends at positive i's upper limit and begins above the next one's; the last slots begin at the lowest
    lower limit of all. Positives below zero have empty windows, which a falling order puts at the end.
    """
    score = np.full((len(wave.ids), per_anchor), np.nan)
    score[positives["anchor"], positives["rank"] - 1] = positives["score"]
    score[score < 0] = np.nan
    wave.upper = np.floor(score * high / 100)
    floor = np.ceil(score * low / 100)
    bottom = np.nanmin(np.where(np.isnan(floor), np.inf, floor), axis=1, keepdims=True)
    below = np.append(wave.upper[:, 1:] + 1, np.full((len(score), 1), np.nan), axis=1)
    wave.lower = np.where(np.isnan(below), bottom, np.maximum(below, bottom))


def hard_negatives(
    rows: DataFrame, is_anchor: Column, id_column: str = "vec_id", label: str = "label", vector: str = "embedding",
    positives: int = 5, per_positive: int = 3, low: int = 50, high: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that ``is_anchor`` marks.

    The first ``positives`` rows of an anchor's label are its positives; of each, the first ``per_positive`` rows of other
    labels with low * positive <= 100 * negative <= high * positive are returned.
    """
    fit = rows.where(F.col(label).isNotNull() & F.col(vector).isNotNull())
    told = fit.select(F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector"))
    anchors = fit.where(is_anchor & F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).alias("vector")
    )
    most, sc, out = max(positives, per_positive), rows.sparkSession.sparkContext, None
    for wave in _waves(cut_lineage(_packed(anchors))):
        shared = sc.broadcast(wave)
        own = _best(told, shared, own_label, positives, 1, most)
        shared.unpersist()
        set_limits(wave, own.select("anchor", "rank", "score").toPandas(), positives, low, high)
        shared = sc.broadcast(wave)
        others = _best(told, shared, other_labels, per_positive, positives, most)
        shared.unpersist()
        names = rows.sparkSession.createDataFrame(pd.DataFrame({"anchor": np.arange(len(wave.ids)), "anchor_id": wave.ids}), "anchor long, anchor_id long")
        part = _windows(own, others, per_positive, low, high).join(names, "anchor")
        part = part.select(
            "anchor_id", F.nullif("positive_id", F.lit(LAST_ID)).alias("positive_id"), "rank", F.nullif("negative_id", F.lit(LAST_ID)).alias("negative_id"),
            "positive_score", "negative_score",
        )
        part = cut_lineage(part)
        out = part if out is None else out.unionByName(part)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return rows.sparkSession.createDataFrame([], empty) if out is None else out


def _windows(own: DataFrame, others: DataFrame, per_positive: int, low: int, high: int) -> DataFrame:
    """The answer of every positive: the slots from its own on in falling order, up to its lower limit."""
    fronts = others.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "rank", "id", "score"))).alias("front"))
    asked = own.select("anchor", (F.col("rank") - 1).alias("from"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    inside = F.filter("front", lambda n: (n["slot"] >= F.col("from")) & (n["score"] * 100 >= F.col("positive_score") * low) & (n["score"] * 100 <= F.col("positive_score") * high))
    met = asked.join(fronts, "anchor").select("anchor", "positive_id", "positive_score", F.posexplode(F.slice(inside, 1, per_positive)).alias("at", "found"))
    return met.select(
        "anchor", "positive_id", (F.col("at") + 1).alias("rank"), F.col("found.id").alias("negative_id"), "positive_score", F.col("found.score").alias("negative_score")
    )
