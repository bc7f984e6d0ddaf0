"""Resolution of raw identifiers to keys, and reports about what did not match."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from compindex.functions import cleaning as K
from compindex.operators import order as O
from compindex.operators import ranking as R
from compindex.session import cut_lineage

# Fixed value: similarity a fuzzy match must reach.
FUZZY_CUTOFF = 0.85


def alias_table(*layers: DataFrame) -> DataFrame:
    """Alias layers in order of precedence, as (norm, key, priority).

    Each layer is (name, key). A source's own layer goes first, then exact keys, short codes,
    overrides, the alias map and official names.
    """
    parts = [
        layer.select(K.folded(F.col("name")).alias("norm"), F.col("key"), F.lit(i).alias("priority"))
        for i, layer in enumerate(layers)
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.where(F.col("norm").isNotNull() & (F.col("norm") != "") & F.col("key").isNotNull())


@F.pandas_udf(DoubleType())
def similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    """Matching-blocks ratio of two short names; it sees only candidate pairs."""
    return pd.Series([difflib.SequenceMatcher(None, b, a).ratio() for a, b in zip(first, second)], dtype="float64")


def _bigrams(text: Column) -> Column:
    spots = F.sequence(F.lit(1), F.greatest(F.length(text) - 1, F.lit(1)))
    return F.array_distinct(F.transform(spots, lambda i: F.substring(text, i, F.lit(2))))


def prefix_bigrams(names: DataFrame, counts: DataFrame, cutoff: float) -> DataFrame:
    """(norm, _g): of every name its rarest bigrams, as many as a match at the cutoff needs to share one.

    Two names of la and lb letters that reach the cutoff c differ by da and db unmatched letters with
    da + db <= (1 - c)(la + lb). That destroys at most 2 da + db of a's bigrams, which is largest for the shortest possible b and then
    stays below ``lost`` times la. So all but that many of its bigrams occur in b, and the same holds the other way; in one common order
    the first lost + 1 of both therefore meet. Rare ones come first, so a frequent bigram is a key only for names that have no other.
    """
    shortest = cutoff / (2.0 - cutoff)
    lost = 1.5 * (1.0 - cutoff) * (1.0 + shortest) + 0.5 * (1.0 - shortest)
    grams = names.select("norm", F.explode(_bigrams(F.col("norm"))).alias("_g"))
    ordered = O.attach(grams, counts, ["_g"]).groupBy("norm").agg(F.sort_array(F.collect_list(F.struct("_n", "_g"))).alias("_all"))
    most = (F.floor(F.length("norm") * lost + 1e-9) + 1).cast("int")
    return ordered.select("norm", F.explode(F.slice("_all", F.lit(1), most)).alias("_one")).select("norm", F.col("_one._g").alias("_g"))


def fuzzy_candidates(left: DataFrame, aliases: DataFrame, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Pairs of names that can reach the cutoff: they share one of their rarest bigrams, and lengths and edits allow it."""
    asked, known = cut_lineage(left.select("norm").distinct()), cut_lineage(aliases.select("norm").distinct())
    grams = asked.unionByName(known).select(F.explode(_bigrams(F.col("norm"))).alias("_g"))
    counts = cut_lineage(grams.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")))
    a, b = prefix_bigrams(asked, counts, cutoff), prefix_bigrams(known, counts, cutoff).withColumnRenamed("norm", "alias")
    la, lb = F.length("norm"), F.length("alias")
    near = F.abs(la - lb) <= (la + lb) * F.lit(1.0 - cutoff) + 1e-9
    pairs = a.join(b, "_g").where(near).select("norm", "alias").distinct()
    # edits bound the ratio from above: matched letters <= (la + lb - edits) / 2
    return pairs.where(F.levenshtein("norm", "alias") <= (la + lb) * F.lit(1.0 - cutoff) + 1e-9)


def resolve(raw: DataFrame, column: str, aliases: DataFrame, fuzzy: bool = True, cutoff: float = FUZZY_CUTOFF) -> DataFrame:
    """Raw values with their ``key``; each distinct value is resolved once.

    Aliases by priority first, then the closest alias above the cutoff, else null. Three upper-case letters are a
    code: they match exactly or not at all. A spelling that occurs both ways is resolved for either shape.
    """
    shaped = lambda df, *more: df.select(*more, K.folded(F.col(column)).alias("norm"), F.coalesce(F.trim(F.col(column)).rlike("^[A-Z]{3}$"), F.lit(False)).alias("_code"))
    shapes = cut_lineage(shaped(raw).where(F.col("norm").isNotNull()).distinct())
    names = shapes.select("norm").distinct()
    direct = R.first_wins(names.join(aliases, "norm"), ["norm"], [F.col("priority"), F.col("key")]).select("norm", "key")
    found = direct
    if fuzzy:
        direct = cut_lineage(direct)
        rest = shapes.where(~F.col("_code")).select("norm").join(direct, "norm", "left_anti")
        scored = fuzzy_candidates(rest, aliases, cutoff).withColumn("_ratio", similarity("norm", "alias"))
        best = R.first_wins(
            scored.where(F.col("_ratio") >= cutoff), ["norm"], [F.col("_ratio").desc(), F.col("alias").desc()]
        )
        by_alias = R.first_wins(aliases, ["norm"], [F.col("priority"), F.col("key")])
        close = best.select(F.col("norm").alias("_raw"), F.col("alias").alias("norm")).join(by_alias, "norm")
        close = close.select(F.col("_raw").alias("norm"), "key").withColumn("_code", F.lit(False))
        found = direct.join(shapes, "norm").unionByName(close)
    else:
        found = direct.join(shapes, "norm")
    # few names, many rows each: a shuffle by name would be skewed
    return O.attach(shaped(raw, "*"), found, ["norm", "_code"], "left").drop("norm", "_code")


def resolve_two(raw: DataFrame, code: str, name: str, aliases: DataFrame) -> DataFrame:
    """Code first, name as a fallback."""
    by_code = resolve(raw, code, aliases, fuzzy=False).withColumnRenamed("key", "_by_code")
    both = resolve(by_code, name, aliases).withColumnRenamed("key", "_by_name")
    return both.withColumn("key", F.coalesce("_by_code", "_by_name")).drop("_by_code", "_by_name")


def by_code(raw: DataFrame, column: str, codes: DataFrame, width: int) -> DataFrame:
    """Numeric code, padded to its width, to a key; unknown codes such as aggregates drop out."""
    padded = raw.withColumn("code", K.padded_code(F.col(column).cast("string"), width))
    return padded.join(codes.select("code", "key"), "code")


def match_report(resolved: DataFrame, column: str, universe: DataFrame) -> DataFrame:
    """What did not match: raw values without a key, keys outside the universe, keys without data."""
    resolved = cut_lineage(resolved.select(F.col(column).alias("item"), F.col("key").cast("string").alias("key")))
    keys = universe.select(F.col("key").cast("string").alias("key"))
    counted = lambda df, label: df.groupBy("item").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(label).alias("kind"), "item", "rows")
    unmatched = counted(resolved.where(F.col("key").isNull()), "unmatched")
    known = resolved.where(F.col("key").isNotNull()).select(F.col("key").alias("item"), "key")
    outside = counted(known.join(keys, "key", "left_anti"), "out_of_scope")
    empty = keys.join(known.select("key").distinct(), "key", "left_anti")
    empty = empty.select(F.lit("no_data").alias("kind"), F.col("key").alias("item"), F.lit(0).cast("long").alias("rows"))
    return unmatched.unionByName(outside).unionByName(empty)


def first_known(df: DataFrame, key: str, *lookups: DataFrame, columns: list[str]) -> DataFrame:
    """Columns from the first lookup that knows the key (a table, then its fallbacks)."""
    for i, lookup in enumerate(lookups):
        df = df.join(lookup.select(key, *[F.col(c).alias(f"_{i}_{c}") for c in columns]), key, "left")
    chosen = [F.coalesce(*[F.col(f"_{i}_{c}") for i in range(len(lookups))]).alias(c) for c in columns]
    dropped = [f"_{i}_{c}" for i in range(len(lookups)) for c in columns]
    return df.select("*", *chosen).drop(*dropped)
