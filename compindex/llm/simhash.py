"""SimHash near-duplicates by the generalised pigeonhole principle.

Two 64-bit fingerprints within ``distance`` bits differ by at most t_i bits in some group i of bits whenever
the t_i + 1 sum to distance + 1. Correlated bits are put into the same group, and dynamic programming gives
each group its own threshold (or leaves it out), whichever costs the fewest probes and candidates.

Nulls and texts without words have fingerprint 0 and are linked like all others. Repeated rows and equal
texts share a fingerprint; they are one node of the graph.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from compindex.llm.common import carried_id, lookup, returned, text_bytes
from compindex.llm.graph import components
from compindex.session import cut_lineage

BITS = 64
SHINGLE = 3
SEED = 42
DISTANCE = 2
# Shingles hashed at once: bounds a task's memory for very long texts.
PIECE = 200_000
# Entries of a bucket up to which all its pairs are compared; members of larger ones are probed bit by bit.
PAIRWISE = 64


def fingerprint(data: bytes | None, width: int = SHINGLE) -> int:
    """Unsigned fingerprint of one text: a bit is set if it is set in over half of the shingles' XXH64."""
    words = data.lower().split() if data else []
    if not words:
        return 0
    if len(words) <= width:
        return xxh64_intdigest(b" ".join(words), SEED)
    shingles, ones = len(words) - width + 1, np.zeros(BITS, np.int64)
    for start in range(0, shingles, PIECE):
        stop = min(start + PIECE, shingles)
        windows = zip(*(words[start + k : stop + k] for k in range(width)))
        hashes = np.fromiter(map(xxh64_intdigest, map(b" ".join, windows), itertools.repeat(SEED)), np.uint64, stop - start)
        ones += _bit_matrix(hashes).sum(axis=0, dtype=np.int64)
    return int("".join("1" if 2 * n > shingles else "0" for n in ones), 2)


def _bit_matrix(values: np.ndarray) -> np.ndarray:
    """One row of 64 zeros and ones per value, highest bit first."""
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text, as a signed long."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values = np.fromiter((fingerprint(t) for t in batch["data"]), np.uint64, len(batch))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "fp": values.view(np.int64)})

    return returned(docs.select(carried_id(), text_bytes().alias("data")).mapInPandas(hashed, "doc_id long, fp long"))


def _joint_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 table of how often two bits are set together, over all rows."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        together, rows = np.zeros((BITS, BITS)), 0
        for batch in batches:
            m = _bit_matrix(batch["fp"].to_numpy(np.int64).view(np.uint64)).astype(np.float32)
            together += m.T @ m
            rows += len(m)
        cells = np.append(together.ravel(), rows)
        yield pd.DataFrame({"cell": np.arange(cells.size), "n": cells.astype(np.int64)})

    sums = prints.select("fp").mapInPandas(counted, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    flat = np.zeros(BITS * BITS + 1)
    for row in sums.collect():  # 64 x 64 + 1 cells, whatever the input
        flat[row["cell"]] = row["n"]
    return int(flat[-1]), flat[:-1].reshape(BITS, BITS)


def group_bits(rows: int, together: np.ndarray, groups: int) -> list[list[int]]:
    """Bits in ``groups`` nearly equal groups; each grows by the free bit that correlates most with it."""
    share = together / max(rows, 1)
    p = np.diag(share)
    spread = np.sqrt(np.outer(p * (1 - p), p * (1 - p)))
    tie = np.abs(np.divide(share - np.outer(p, p), spread, out=np.zeros_like(share), where=spread > 0))
    free, out = set(range(BITS)), []
    for k in range(groups):
        size = (BITS - sum(map(len, out)) + groups - k - 1) // (groups - k)
        chosen = [max(sorted(free), key=lambda b: sum(tie[b, c] for c in free if c != b))]
        free.remove(chosen[0])
        while len(chosen) < size:
            best = max(sorted(free), key=lambda b: tie[b, chosen].sum())
            chosen.append(best)
            free.remove(best)
        out.append(chosen)
    return out


def distance_odds(rows: int, together: np.ndarray, bits: list[int], most: int) -> np.ndarray:
    """Estimated odds that two rows differ in at most 0, 1, .. ``most`` of ``bits``; neighbours in ``bits`` are paired."""
    share = together / max(rows, 1)
    odds = np.array([1.0])
    for k in range(0, len(bits), 2):
        a, both = bits[k], bits[k : k + 2]
        if len(both) == 1:
            step = np.array([1 - 2 * share[a, a] * (1 - share[a, a]), 2 * share[a, a] * (1 - share[a, a])])
        else:
            b = both[1]
            p11, p10, p01 = share[a, b], share[a, a] - share[a, b], share[b, b] - share[a, b]
            p00 = 1 - p11 - p10 - p01
            same, opposite = p11**2 + p10**2 + p01**2 + p00**2, 2 * (p11 * p00 + p10 * p01)
            step = np.array([same, max(0.0, 1 - same - opposite), opposite])
        odds = np.convolve(odds, step)
    return np.cumsum(odds)[: most + 1]


def allocate(costs: list[list[float]], units: int) -> tuple[float, list[int]]:
    """Cheapest split of ``units`` over the groups; costs[i][u] is the cost of u units (threshold u - 1) in group i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        best = {
            total: min((best[total - u][0] + own[u], best[total - u][1] + [u]) for u in range(min(total, len(own) - 1) + 1) if total - u in best)
            for total in range(units + 1)
        }
    return best[units]


def plan(rows: int, together: np.ndarray, distance: int = DISTANCE) -> list[tuple[list[int], int]]:
    """(bits, threshold) per probed group, at the least estimated number of probes and candidates."""
    choices = []
    for groups in range(1, distance + 4):
        split = group_bits(rows, together, groups)
        costs = []
        for bits in split:
            odds = distance_odds(rows, together, bits, distance)
            probes = np.cumsum([comb(len(bits), k) for k in range(len(odds))])
            costs.append([0.0] + [rows * float(n) + rows * (rows - 1) / 2 * float(o) for n, o in zip(probes, odds)])
        cost, units = allocate(costs, distance + 1)
        choices.append((cost, groups, [(bits, u - 1) for bits, u in zip(split, units) if u]))
    return min(choices)[2]


def _signed(value: int) -> int:
    return value - (1 << BITS) if value >> (BITS - 1) else value


def _flips(bits: list[int], most: int) -> Column:
    """Array of masks that flip up to ``most`` of ``bits``; bit 0 is the highest."""
    masks = [sum(1 << (BITS - 1 - b) for b in c) for k in range(most + 1) for c in itertools.combinations(bits, k)]
    return F.array(*[F.lit(_signed(m)).cast("long") for m in masks])


def _probe(number: int, mask: int) -> Callable[[Column], Column]:
    """(part, key, exact) of group ``number`` for a flip: the fingerprint's bits of the group with the flip's turned over."""
    key = lambda flip: F.col("fp").bitwiseXOR(flip).bitwiseAND(F.lit(mask))
    return lambda flip: F.struct(F.lit(number).alias("part"), key(flip).alias("key"), (flip == 0).alias("exact"))


def links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) between distinct fingerprints that joins up exactly those within ``distance`` bits.

    Entries meet in the buckets of the planned groups. In a small bucket all pairs are compared. Members of a
    larger one (a dense cluster) each probe all values one bit away: at most 65 fingerprints lie within one bit
    of a value, any two of them within two bits, so each such set becomes a star. That is linear in the bucket.
    """
    if distance != 2:
        raise ValueError("probing of dense buckets is worked out for two bits")
    prints = cut_lineage(prints.select("fp").distinct())
    rows, together = _joint_counts(prints)
    # the probes of all groups in one pass: a union has the tasks and files of every group
    probes = []
    for number, (bits, threshold) in enumerate(plan(rows, together, distance)):
        mask = _signed(sum(1 << (BITS - 1 - b) for b in bits))
        probes.append(F.transform(_flips(bits, threshold), _probe(number, mask)))
    entries = cut_lineage(prints.select("fp", F.explode(F.concat(*probes)).alias("probe")).select("fp", "probe.*"))
    sizes = entries.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sized = cut_lineage(lookup(entries, sizes, ["part", "key"]))
    light = sized.where(F.col("n") <= PAIRWISE)
    near = F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= distance
    pairs = light.where("exact").alias("l").join(
        light.alias("r"), (F.col("l.part") == F.col("r.part")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") != F.col("r.fp")) & near
    ).select(F.least("l.fp", "r.fp").alias("a"), F.greatest("l.fp", "r.fp").alias("b"))
    crowded = sized.where(F.col("n") > PAIRWISE).select("fp").distinct()
    around = crowded.select("fp", F.explode(_flips(list(range(BITS)), 1)).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    balls = around.groupBy("value").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    stars = balls.select(F.array_min("members").alias("a"), F.explode("members").alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(doc_id, fp, component_id, copies) for every row: the smallest doc_id reachable and the size of its class.

    Only distinct fingerprints are compared; a class of any size is one node per fingerprint.
    """
    marked = cut_lineage(fingerprints(docs))
    prints = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("rows")))
    found = components(links(prints, distance)).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    named = cut_lineage(prints.join(found, "fp", "left").select("fp", "first", "rows", F.coalesce("root", "fp").alias("root")))
    classes = named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("rows").alias("copies"))
    facts = cut_lineage(lookup(named.select("fp", "root"), classes, ["root"]).select("fp", "component_id", "copies"))
    return lookup(marked, facts, ["fp"]).select("doc_id", "fp", "component_id", "copies")


def hex_digits(column: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))
