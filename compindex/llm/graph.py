"""Connected components by hooking to the smallest neighbour and contracting."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compindex.llm.common import lookup
from compindex.session import cut_lineage

# Links left at which one task finishes: two numbers each, a few MB.
FINISH_ROWS = 100_000


def _roots(parent: DataFrame) -> DataFrame:
    """Pointer jumping: every node's pointer is replaced by its pointer's pointer until none moves."""
    while True:
        above = parent.select(F.col("node").alias("up"), F.col("up").alias("root"))
        moved = (F.col("root") != F.col("up")).alias("_moved")
        jumped = cut_lineage(lookup(parent, above, ["up"]).select("node", F.col("root").alias("up"), moved))
        parent = jumped.select("node", "up")
        if jumped.where("_moved").isEmpty():
            return parent


def _finish(links: DataFrame) -> DataFrame:
    """(node, up) of at most ``FINISH_ROWS`` links, by union and find in one task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist()):
                parent.setdefault(a, a)
                parent.setdefault(b, b)
                a, b = find(a), find(b)
                parent[max(a, b)] = min(a, b)
        yield pd.DataFrame({"node": list(parent), "up": [find(x) for x in parent]}, dtype="int64")

    return links.repartition(1).mapInPandas(run, "node long, up long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (columns a and b); component is the smallest node reached.

    In each round every node points to its smallest neighbour (or itself), pointers are followed to their
    roots, and the links between different roots form the next, at most half as large graph. Minima combine
    on the map side and pointers of hot roots are looked up by broadcast, so a star of any size is no hot task.
    Once ``FINISH_ROWS`` links or fewer are left, one task joins them. Links of a node to itself make it a
    component; nulls are ignored; no links give no rows.
    """
    links = cut_lineage(links.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b"))
    found = None
    while links.count() > FINISH_ROWS:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("up"))
        roots = _roots(cut_lineage(nearest))
        found = _merged(found, roots)
        half = cut_lineage(lookup(links, roots.select(F.col("node").alias("a"), F.col("up").alias("ra")), ["a"]).select("ra", "b"))
        whole = lookup(half, roots.select(F.col("node").alias("b"), F.col("up").alias("rb")), ["b"]).where("ra <> rb")
        links = cut_lineage(whole.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    return _merged(found, cut_lineage(_finish(links))).select("node", F.col("up").alias("component"))


def _merged(found: DataFrame | None, roots: DataFrame) -> DataFrame:
    """Pointers of earlier rounds, taken on to the roots of the next one."""
    if found is None:
        return roots
    further = roots.select(F.col("node").alias("up"), F.col("up").alias("root"))
    return cut_lineage(lookup(found, further, ["up"], "left").select("node", F.coalesce("root", "up").alias("up")))
