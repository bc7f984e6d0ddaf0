"""Shared pieces: table access, word rules, and joins that split hot keys."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from compindex.session import cut_lineage

# Fixed value: a word is a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
# The smallest long stands for a null id inside pandas.
NO_ID = -(1 << 63)
# A key with more than one in HOT_SHARE of all rows counts as hot, so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 500
# What this worker process keeps for its next tasks: a key and the object, by kind.
_KEPT: dict[str, tuple[int, object]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(kind: str, key: int, make: Callable[[], object]) -> object:
    """What ``make`` returns, kept by the worker process until ``let_go`` or another key of its kind."""
    if kind not in _KEPT or _KEPT[kind][0] != key:
        _KEPT[kind] = key, make()
    return _KEPT[kind][1]


def let_go() -> None:
    """Free what earlier tasks left in this worker process, for tasks that need none of it: Spark uses workers again for hours."""
    _KEPT.clear()
    pa.default_memory_pool().release_unused()


def text_bytes(column: str = "text") -> Column:
    """The whole text as UTF-8 bytes; null stays null."""
    return F.col(column).cast("binary")


def carried_id() -> Column:
    """doc_id on its way through pandas, where a null would turn a whole batch of ids into floats."""
    return F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id")


def returned(df: DataFrame) -> DataFrame:
    """``df`` with null ids back in place."""
    return df.withColumn("doc_id", F.nullif(F.col("doc_id"), F.lit(NO_ID)))


def word_count(column: str = "text") -> Column:
    """Number of words of the whole text, null counts as empty."""
    return F.coalesce(F.regexp_count(F.col(column), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def is_held_out() -> Column:
    """Rows whose labels no classifier may learn from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def hot_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that hold more than one in ``HOT_SHARE`` rows of ``df``: fewer than ``HOT_SHARE`` rows by arithmetic."""
    total = df.count()
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    return cut_lineage(counts.where(F.col("_rows") * HOT_SHARE > total).select(*keys).repartition(1))


def together(left: DataFrame, right: DataFrame) -> DataFrame:
    """The rows of both, in no more tasks than a shuffle has: unions of unions would double tasks and files every time."""
    return left.unionByName(right).coalesce(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def lookup(df: DataFrame, facts: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``df`` joined with ``facts`` (one row per key, short fixed-width columns) without a hot task.

    Rows of hot keys meet their few facts by broadcast where they are, all others by shuffle. ``df`` is read
    several times, so it should be materialised. Null keys match nothing; ``how`` is inner or left.
    """
    hot = hot_keys(df, keys)
    if hot.isEmpty():
        return df.join(facts, keys, how)
    few = facts.join(F.broadcast(hot), keys, "left_semi")
    spread = df.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how)
    rest = df.join(F.broadcast(hot), keys, "left_anti").join(facts, keys, how)
    return together(spread, rest)
