"""Ranked lexical search of many items at once: what items share is evaluated once.

The items of a block become a graph of sums. Terms that occur in exactly the same items are one node; then, as long as
two nodes stand together in several items, the pair that most items share becomes a node of its own and takes their
place (``shared_sums``). A task keeps one accumulator per node for a small batch of documents: the leaves are the weights of
the terms the documents hold, an inner node adds its children once for all items above it, and an item adds the few
nodes that are left to it. Sums are 64-bit integers, so their order changes nothing.

Documents are read once per block of items: their length and the block's terms in them are written as short rows, from which
the corpus statistics are counted and then the scores. Every task returns its best ``top`` per item.

Defined cases: null and empty texts hold no term, count for nothing and are found by nothing; an item without terms has no
rows; equal (item_id, text) rows are one item, different texts of one item_id are ranked each for itself. Repeated documents
count and rank each for itself; null doc_ids come first among ties. Very long texts are read in pieces, but count whole. An
item's distinct terms are held by every task. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from compindex.llm.best import Best
from compindex.llm.common import NO_ID, carried_id, text_bytes
from compindex.session import cut_lineage

# Term bytes are ASCII letters and digits, and whatever is not ASCII.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
# Terms (summed over items) of a block: bounds what is broadcast and one task's accumulators.
BLOCK_TERMS = 100_000
# Nodes of one item up to which its pairs are counted; a larger one is summed node by node.
PAIRED = 300
# Accumulators of one batch of documents: 32 MB.
CELLS = 4_000_000
# Bytes of a text that are split into terms at once.
PIECE = 1_000_000


def term_counts(data: bytes | None) -> tuple[int, Counter]:
    """Number of terms of a text, and how often each occurs."""
    n, counts, at = 0, Counter(), 0
    text = (data or b"").translate(TERM_BYTES)
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        terms = text[at:end].split()
        n, at = n + len(terms), end
        counts.update(terms)
    return n, counts


def shared_sums(items: list[set[int]], terms: int) -> tuple[list[list[int]], list[list[int]]]:
    """(nodes, items): children of the inner nodes, numbered from ``terms`` on, and the nodes that each item adds up."""
    holders: dict[int, list[int]] = {}
    for at, item in enumerate(items):
        for term in item:
            holders.setdefault(term, []).append(at)
    classes: dict[tuple[int, ...], list[int]] = {}
    for term in sorted(holders):
        classes.setdefault(tuple(holders[term]), []).append(term)
    nodes: list[list[int]] = []
    left: list[set[int]] = [set() for _ in items]
    above: dict[int, set[int]] = {}
    for users, members in classes.items():
        node = members[0]
        if len(members) > 1:
            node = terms + len(nodes)
            nodes.append(members)
        above[node] = set(users)
        for at in users:
            left[at].add(node)
    counts: Counter = Counter()
    for item in left:
        several = sorted(n for n in item if len(above[n]) > 1)
        if len(several) <= PAIRED:
            counts.update((a, b) for i, a in enumerate(several) for b in several[i + 1 :])
    heap = [(-n, pair) for pair, n in counts.items() if n > 1]
    heapq.heapify(heap)
    while heap:
        n, (a, b) = heapq.heappop(heap)
        users = above[a] & above[b]
        if len(users) < 2:
            continue
        if len(users) < -n:
            heapq.heappush(heap, (-len(users), (a, b)))
            continue
        node = terms + len(nodes)
        nodes.append([a, b])
        above[node], beside = users, Counter()
        above[a], above[b] = above[a] - users, above[b] - users
        for at in users:
            left[at] -= {a, b}
            if len(left[at]) <= PAIRED:
                beside.update(left[at])
            left[at].add(node)
        for other, together in beside.items():
            if together > 1:
                heapq.heappush(heap, (-together, (other, node)))
    return nodes, [sorted(item) for item in left]


class Block:
    """Some items: their ids, terms, and the graph of their sums."""

    def __init__(self, ids: list[int | None], items: list[list[bytes]]) -> None:
        self.ids = ids
        self.places = {term: at for at, term in enumerate(dict.fromkeys(t for item in items for t in item))}
        self.nodes, self.items = shared_sums([{self.places[t] for t in item} for item in items], len(self.places))
        self.weights = np.zeros(len(self.places), np.int64)
        self.documents = self.words = 0

    def weigh(self, documents: int, words: int, held: np.ndarray) -> None:
        """Fixes the corpus statistics: ``held`` is the number of documents of each term."""
        self.documents, self.words = documents, words
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in held], np.int64)

    def scores(self, sizes: np.ndarray, term: np.ndarray, document: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Scores of a few documents (their number of terms), a row per item, from their (term, document, times)."""
        total = np.zeros((len(self.places) + len(self.nodes), len(sizes)), np.int64)
        length = 100 - 90 + (90 * sizes * self.documents) // self.words
        total[term, document] = self.weights[term] * (1_000_000_000 * times // (1000 * times + 8 * length[document]))
        for at, children in enumerate(self.nodes, len(self.places)):
            if len(children) == 2:
                np.add(total[children[0]], total[children[1]], out=total[at])
            else:
                total[children].sum(axis=0, out=total[at])
        return np.array([total[item].sum(axis=0) for item in self.items])


def _terms_of(items: DataFrame, id_column: str) -> DataFrame:
    """(id, terms): the distinct terms of every distinct item, joined by spaces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "terms": [b" ".join(sorted(term_counts(t)[1])) for t in batch["data"]]})

    told = items.select(F.coalesce(F.col(id_column).cast("long"), F.lit(NO_ID)).alias("id"), text_bytes().alias("data")).distinct()
    return told.mapInPandas(run, "id long, terms binary").where(F.length("terms") > 0)


def _blocks(terms: DataFrame) -> Iterator[Block]:
    ids, items, size = [], [], 0
    for row in terms.toLocalIterator():
        found = bytes(row["terms"]).split()
        if items and size + len(found) > BLOCK_TERMS:
            yield Block(ids, items)
            ids, items, size = [], [], 0
        ids.append(row["id"])
        items.append(found)
        size += len(found)
    if items:
        yield Block(ids, items)


def _marks(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, times) of every document with a term: its number of terms, and the block's terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = shared.value
        known = places.keys()
        for batch in batches:
            ids, sizes, terms, times, ends = [], [], [], [], [0]
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                n, counts = term_counts(data.as_py())
                if n:
                    found = counts.keys() & known
                    terms.extend([places[t] for t in found])
                    times.extend([counts[t] for t in found])
                    ids.append(doc_id)
                    sizes.append(n)
                    ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, pa.int32())) for v in (terms, times)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "times"])

    return docs.select(carried_id(), text_bytes().alias("data")).mapInArrow(run, "doc_id long, n long, terms array<int>, times array<int>")


def _statistics(marks: DataFrame, block: Block) -> None:
    """Counts documents, terms, and documents per term over all documents; one row per term comes to the driver."""
    width = len(block.places)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(width + 2, np.int64)
        for batch in batches:
            held[:width] += np.bincount(batch.column(1).flatten().to_numpy(), minlength=width)
            held[width] += batch.num_rows
            held[width + 1] += batch.column(0).to_numpy().sum()
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some])], ["term", "n"])

    found = marks.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros(width + 2, np.int64)
    held[found["term"]] = found["n"]
    block.weigh(int(held[width]), int(held[width + 1]), held[:width])


def _ranked(marks: DataFrame, shared, top: int) -> DataFrame:
    """(item, doc_id, score): every task's best ``top`` documents of each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = shared.value
        best = Best(len(block.items), top)
        step = max(16, CELLS // (len(block.places) + len(block.nodes)))
        for batch in batches:
            ids, sizes = (batch.column(c).to_numpy() for c in (0, 1))
            ends = batch.column(2).offsets.to_numpy()
            ends = ends - ends[0]
            terms, times = (batch.column(c).flatten().to_numpy().astype(np.int64) for c in (2, 3))
            for at in range(0, len(ids), step):
                some = slice(at, min(at + step, len(ids)))
                low, high = ends[some.start], ends[some.stop]
                document = np.repeat(np.arange(some.stop - at), np.diff(ends[at : some.stop + 1]))
                scores = block.scores(sizes[some], terms[low:high], document, times[low:high])
                item, doc = np.nonzero((scores > 0) & (scores >= best.least[:, None]))
                best.add(item, scores[item, doc], ids[some][doc])
        yield pa.RecordBatch.from_arrays([pa.array(best.key), pa.array(best.id), pa.array(best.score)], ["item", "doc_id", "score"])

    return marks.mapInArrow(run, "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, id_column: str = "item_id", top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): of every item (``id_column``, text) the ``top`` documents (doc_id, text) that score best."""
    spark, out = docs.sparkSession, None
    for block in _blocks(cut_lineage(_terms_of(items, id_column))):
        places = spark.sparkContext.broadcast(block.places)
        marks = cut_lineage(_marks(docs, places))
        _statistics(marks, block)
        shared = spark.sparkContext.broadcast(block)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "doc_id"))
        best = _ranked(marks, shared, top).withColumn("rank", place).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(block.ids)), "item long, id long")
        named = best.join(names, "item").select(
            F.nullif("id", F.lit(NO_ID)).alias("item_id"), "rank", F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "score"
        )
        part = cut_lineage(named)
        out = part if out is None else out.unionByName(part)
        places.unpersist()
        shared.unpersist()
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out
