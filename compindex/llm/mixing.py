"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Sources get shares of the wanted words by weight; a source stops at ``MOST`` times its own words and what it
leaves is shared again by weight. Within a source every document expects the same number of copies, target
over size. Documents are lined up by size, their expected copies are summed along the line, one offset per
source is added, and a document is emitted once for each integer its stretch crosses. Lining up by size keeps
the words taken within about one longest document of the target.

Null texts have size 0 and null sources are a source of their own, last in order. Equal rows are interchangeable,
so ties do not change the result. The offset is a hash of source and seed: reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from compindex.llm.common import lookup, word_count
from compindex.session import cut_lineage

WEIGHTS = (5, 2, 1)
SHARE = (3, 2)  # wanted words: three halves of all words
MOST = 2
SEED = 20240229


def _key(source: Column) -> Column:
    """A non-null key that sorts as the source does, null last."""
    return F.when(source.isNull(), F.lit("~")).otherwise(F.concat(F.lit("="), source))


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, target) from one row per source (key, source_size).

    Sources in order of the level at which they fill up; one is full if the level that all earlier ones leave
    reaches it. The level after the last full source serves the rest.
    """
    numbered = Window.orderBy("key")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(numbered) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    weighed = sizes.withColumn("weight", weight.cast("double")).withColumn("cap", F.col("source_size").cast("double") * MOST)
    level = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, everything = level.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    wanted = F.sum("source_size").over(everything).cast("double") * SHARE[0] / SHARE[1]
    ahead = weighed.select(
        "*",
        wanted.alias("wanted"),
        F.sum("weight").over(everything).alias("weights"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("weight_before"),
    )
    full = F.col("cap") * (F.col("weights") - F.col("weight_before")) <= F.col("weight") * (F.col("wanted") - F.col("cap_before"))
    marked = ahead.withColumn("full", full)
    left = F.col("wanted") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(everything)
    open_weight = F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everything)
    return marked.select(
        "key", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(F.col("weight") * left / open_weight).alias("target")
    )


def _positions(rows: DataFrame) -> DataFrame:
    """``rows`` with ``before``: how many rows of the same key precede in order of size, then doc_id.

    The table is range-partitioned and sorted, so a source of any size is spread; each partition numbers its own
    rows and one row per (partition, key) carries the counts over. Materialised once, so that a lost executor
    cannot cut the ranges elsewhere.
    """
    placed = cut_lineage(
        rows.orderBy("key", "size", "doc_id").select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at"))
    )
    earlier = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_part", "key").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = starts.select("_part", "key", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(starts, ["_part", "key"]).withColumn("before", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


def offset(key: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) per source."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(1 << 52)


def mixed(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, text, source)."""
    sized = cut_lineage(docs.select("doc_id", _key(F.col("source")).alias("key"), word_count().alias("size")))
    per_source = targets(sized.groupBy("key").agg(F.sum("size").alias("source_size")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = cut_lineage(per_source.select("*", rate.alias("rate"), offset(F.col("key"), seed).alias("offset")))
    lined = lookup(cut_lineage(_positions(sized)), plan, ["key"])
    crossed = F.floor((F.col("before") + 1) * F.col("rate") + F.col("offset")) - F.floor(F.col("before") * F.col("rate") + F.col("offset"))
    copies = F.least(crossed, F.lit(MOST))
    return lined.select("doc_id", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
