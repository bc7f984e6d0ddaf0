"""Monte-Carlo rank bands and noise stability. Noise depends only on (draw, key), never on task layout.

A field of up to ``KEYS_AT_ONCE`` keys (its size is counted) goes to every task as a few numbers per key. A task ranks its share of the
draws and packs the ranks of blocks of keys, so what moves is about two bytes per key and draw, and no row. A larger field is ranked slice
by slice of the score range in one distributed sort, where a draw is a column, and added up to a histogram of ranks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from compindex.functions import labels as B
from compindex.functions import noise as Z
from compindex.functions import scaling as S
from compindex.operators import order as O
from compindex.operators.association import number_of
from compindex.operators.stats import correlation
from compindex.session import compute_tasks, cut_lineage

# Noise model of the published bands.
DRAWS = 10_000
SEED = 20260602
SD_NORMAL, SD_LOW_CONFIDENCE = 0.04, 0.07
WEIGHT_LOW, WEIGHT_HIGH = 0.40, 0.60
FLOOR = 1e-4
# Keys of a field that every task holds, at about 50 bytes each. Larger fields are ranked slice by slice.
KEYS_AT_ONCE = 1_000_000
# Draws whose ranks a task packs at once, and ranks that a task holds: 64 MB.
DRAWS_AT_ONCE, CELLS = 64, 1 << 24
# Shares of a key's ranks that the bands and the noise test read.
BANDS, ENDS = (0.05, 0.5, 0.95), (0.025, 0.975)
# Retention is taken on every twentieth draw.
EVERY = 20


class Simulated(NamedTuple):
    """Ranks per key as (key, rank, n, kept), good for the shares of ``BANDS``, and per draw (draw, n, rho, top_10, top_decile)."""

    histogram: DataFrame
    agreement: DataFrame


def expanded(df: DataFrame, draws: int) -> DataFrame:
    """Every row once per draw, without a join. Rows spread over tasks before they multiply."""
    return df.repartition(compute_tasks(df), "key").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))


def ranked_base(scored: DataFrame) -> DataFrame:
    """Keys with both halves, their combined score and its rank."""
    base = scored.where(F.col("R").isNotNull() & F.col("E").isNotNull()).withColumn("_base", F.sqrt(F.col("R") * F.col("E")))
    return cut_lineage(O.ranked(base, [], [F.col("_base").desc(), F.col("key")], "base_rank"))


def _deviation() -> Column:
    return F.when(B.low_confidence(F.col("domains_not_scored")), SD_LOW_CONFIDENCE).otherwise(SD_NORMAL)


def draw_ranks(base: DataFrame, draws: int = DRAWS, seed: int = SEED) -> DataFrame:
    """(key, draw, base_rank, rank, in_tier) of a field of any size: ``base`` as ``ranked_base`` returns it."""
    rows, sd = expanded(base, draws), _deviation()
    offset, number = seed % 1000, number_of(base, "key")
    noisy = lambda c, stream: S.clamp(F.col(c) + sd * Z.normal(F.col("draw"), number, offset + stream), FLOOR, 1.0)
    weight = WEIGHT_LOW + (WEIGHT_HIGH - WEIGHT_LOW) * Z.uniform(F.col("draw"), F.lit(0), offset + 4)
    rows = rows.select(
        "key", "draw", "base_rank", B.tier(F.col("_base")).alias("_tier"),
        (F.pow(noisy("R", 0), weight) * F.pow(noisy("E", 2), 1.0 - weight)).alias("sim"),
    )
    ranked = ranked_in_draws(rows, ["draw"], "sim", F.col("key"), "rank")
    return ranked.select("key", "draw", "base_rank", "rank", (B.tier(F.col("sim")) == F.col("_tier")).alias("in_tier"))


# Slices of the score range; a draw's keys are ranked slice by slice, so that no task holds a whole draw.
SLICES = 64


def ranked_in_draws(rows: DataFrame, draws: list[str], score: str, tie: Column, name: str) -> DataFrame:
    """``row_number`` by descending score (0 to 1) within each draw, ties by ``tie``, without materialising the draws.

    Noise is a function of draw and key, so the rows can be made twice: once to count a draw's slices, once to
    rank within them. The count table has draws x ``SLICES`` rows, whatever the number of keys.
    """
    rows = rows.withColumn("_slice", F.floor(F.col(score) * SLICES))
    above = Window.partitionBy(*draws).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*draws, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = counts.select(*draws, "_slice", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_above"))
    inside = Window.partitionBy(*draws, "_slice").orderBy(F.col(score).desc(), tie)
    placed = rows.withColumn(name, F.row_number().over(inside)).join(starts, [*draws, "_slice"])
    return placed.withColumn(name, F.col(name) + F.col("_above")).drop("_slice", "_above")


def collected(base: DataFrame, order: list[Column], columns: list[str]) -> pa.Table:
    """A field of at most ``KEYS_AT_ONCE`` rows on the driver, in the order in which ties are ranked."""
    return base.orderBy(*order).select("key", *columns).toArrow()


def placed(sim: np.ndarray) -> np.ndarray:
    """Rank 1 for the highest value; equal values keep their order."""
    order = np.argsort(-sim)
    down = sim[order]
    if np.isnan(down[-1]):
        order = np.argsort(-sim, kind="stable")
    elif (same := down[1:] == down[:-1]).any():
        # the faster sort swaps equal values, which are put in order here
        tied = np.flatnonzero(np.append(False, same) | np.append(same, False))
        run = np.cumsum(np.append(True, ~same))[tied]
        order[tied] = order[tied][np.lexsort((order[tied], run))]
    rank = np.empty(len(sim), np.int32)
    rank[order] = np.arange(1, len(sim) + 1, dtype=np.int32)
    return rank


def packed(ranks: np.ndarray) -> bytes:
    """Ranks of some rows (row x draw), whatever the order of draws: the lowest of every row, and the steps between the sorted ones byte by byte."""
    ranks = np.sort(np.ascontiguousarray(ranks), axis=1)
    steps = np.diff(ranks, axis=1)
    kind = np.dtype("<u2" if steps.max(initial=0) < 1 << 16 else "<u4")
    return ranks[:, 0].astype("<u4").tobytes() + steps.astype(kind, order="C").view(np.uint8).reshape(-1, kind.itemsize).T.tobytes()


def unpacked(data: bytes, out: np.ndarray) -> None:
    """Fills ``out`` (row x draw) with what ``packed`` made of it."""
    rows, width = out.shape
    out[:, 0] = np.frombuffer(data, "<u4", rows)
    if width > 1:
        size = (len(data) - 4 * rows) // (rows * (width - 1))
        steps = np.ascontiguousarray(np.frombuffer(data, np.uint8, offset=4 * rows).reshape(size, -1).T).view(f"<u{size}")
        out[:, 1:] = steps.reshape(rows, width - 1)
        np.cumsum(out, axis=1, out=out)


def tallied(ranks: np.ndarray) -> bytes:
    """Ranks of a key of very many rows: every rank once, then how often each occurs."""
    return np.concatenate(np.unique(ranks, return_counts=True)).astype("<u4").tobytes()


def read_at(total: int, shares: tuple[float, ...]) -> np.ndarray:
    """Positions among ``total`` sorted values that the interpolated ``shares`` read."""
    spots = [(total - 1) * share for share in shares]
    return np.unique([f(x) for x in spots for f in (math.floor, math.ceil)])


def in_draws(
    spark: SparkSession, levels: int, draws: int, handle: Callable[[int], list[tuple[np.ndarray, np.ndarray | None, tuple]]], keys: pa.Array, kind: str,
    shares: tuple[float, ...], tasks: int,
) -> DataFrame:
    """Runs ``handle(draw)`` for every draw and brings all ranks of a key together.

    It returns for every level the rank of each row of the field, whether the row counts as kept, and three numbers of the draw. Rows of
    one of the ``keys`` (of SQL type ``kind``) lie together. A task packs the ranks that each row has in its draws, about two bytes each;
    these meet in one task for a block of keys, which looks up what ``shares`` read. Rows of draw 0 are counts of (level, key, rank):
    a rank that no share reads is counted at the next one that is read. The others are one per level and draw.
    """
    size = len(keys)
    code = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    ends = np.append(starts[1:], size)
    rows, at_once = max(1, CELLS // draws), max(1, min(DRAWS_AT_ONCE, CELLS // (size * levels)))
    # a block has about so many rows; a key of more rows is a block of its own
    often, cuts = ends - starts > rows, np.searchsorted(starts, np.arange(0, size, rows))
    bounds = np.unique(np.concatenate([starts[cuts[cuts < len(starts)]], starts[often], ends[often], [size]]))
    alone = np.isin(bounds[:-1], starts[often])
    moved = "level int, block int, width int, ranks binary, kept binary, draw long, p double, q double, r double"
    found = f"level int, key {kind}, rank long, n long, kept long, draw long, p double, q double, r double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), at_once):
                some = batch["id"].iloc[start : start + at_once].tolist()
                ranks, kept, told = np.empty((levels, len(some), size), np.int32), np.zeros((levels, size), "<u2"), []
                for k, draw in enumerate(some):
                    for level, (rank, stays, numbers) in enumerate(handle(draw)):
                        ranks[level, k] = rank
                        if stays is not None:
                            kept[level] += stays
                        told.append((level, -1, 0, b"", b"", draw, *numbers))
                yield pd.DataFrame(told, columns=["level", "block", "width", "ranks", "kept", "draw", *"pqr"])
                for level in range(levels):
                    parts = [(b, slice(bounds[b], bounds[b + 1])) for b in range(len(alone))]
                    yield pd.DataFrame({
                        "level": level, "block": range(len(alone)), "width": len(some),
                        "ranks": [(tallied if alone[b] else packed)(ranks[level, :, part].T) for b, part in parts],
                        "kept": [kept[level, part].tobytes() for _, part in parts], "draw": 0, **dict.fromkeys("pqr", 0.0),
                    })

    def gather(group: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        level, block = group
        if block < 0:
            return rows.assign(key=None, rank=0, n=0, kept=0)[["level", "key", "rank", "n", "kept", "draw", *"pqr"]]
        low, high = bounds[block], bounds[block + 1]
        kept, out = sum(np.frombuffer(k, "<u2").astype(np.int64) for k in rows["kept"]), []
        if alone[block]:
            n = np.zeros(0, np.int64)
            for data in rows["ranks"]:
                rank, times = np.frombuffer(data, "<u4").reshape(2, -1)
                n = np.pad(n, (0, max(0, int(rank[-1]) + 1 - len(n))))
                n[rank] += times
            upto, of = np.cumsum(n), [low]
            look = lambda a, b, at: np.searchsorted(upto, at, side="right")
        else:
            ranks, at, of = np.empty((high - low, draws), np.int32), 0, starts[(starts >= low) & (starts < high)]
            for data, width in zip(rows["ranks"], rows["width"]):
                unpacked(data, ranks[:, at : at + width])
                at += width
            look = lambda a, b, at: np.sort(ranks[a:b], axis=None)[at]
        for a, b in zip(of, [*of[1:], high]):
            at = read_at((b - a) * draws, shares)
            n = np.diff(at, prepend=-1)
            n[-1] += (b - a) * draws - 1 - at[-1]
            out.append((np.full(len(at), a), look(a - low, b - low, at), n, np.append(kept[a - low : b - low].sum(), np.zeros(len(at) - 1, np.int64))))
        i, rank, n, kept = (np.concatenate(c) for c in zip(*out))
        return pd.DataFrame({"level": level, "key": pd.Series(keys.take(pa.array(i)).to_pylist(), dtype=object), "rank": rank, "n": n, "kept": kept, "draw": 0, **dict.fromkeys("pqr", 0.0)})

    dealt = spark.range(1, draws + 1, 1, min(tasks, -(-draws // DRAWS_AT_ONCE))).mapInPandas(run, moved)
    return cut_lineage(dealt.groupBy("level", "block").applyInPandas(gather, found))


def simulated(scored: DataFrame, draws: int = DRAWS, seed: int = SEED) -> Simulated:
    """The field (key, R, E, domains_not_scored) re-ranked under noise in every draw.

    Both halves get noise, wider where the evidence is thin; the weight between them is drawn once per draw.
    """
    base = ranked_base(scored)
    size = base.count()
    decile = max(1, round(size / 10))
    if not 0 < size <= KEYS_AT_ONCE:
        ranks = draw_ranks(base, draws, seed)
        top = lambda k: F.count_if((F.col("rank") <= k) & (F.col("base_rank") <= k)) / F.lit(float(k))
        agreement = ranks.groupBy("draw").agg(
            F.count(F.lit(1)).alias("n"), correlation(F.col("rank").cast("double"), F.col("base_rank").cast("double")).alias("rho"),
            top(10).alias("top_10"), top(decile).alias("top_decile"),
        )
        return Simulated(ranks.groupBy("key", "rank").agg(F.count(F.lit(1)).alias("n"), F.count_if("in_tier").alias("kept")), agreement)
    told = collected(base.select("*", number_of(base, "key").cast("long").alias("_no"), _deviation().alias("_sd")), [F.col("key")], ["_no", "_sd", "R", "E", "_base", "base_rank"])
    number, sd, first, second, before, place = (told[c].to_numpy() for c in ("_no", "_sd", "R", "E", "_base", "base_rank"))
    keys, kind = told["key"].combine_chunks(), base.schema["key"].dataType.simpleString()
    offset, tier_of, low, high = seed % 1000, lambda v: np.searchsorted(B.TIER_CUTS, v, side="right"), FLOOR, 1.0
    tier, centred = tier_of(before), place - place.mean()

    def handle(draw: int) -> list[tuple[np.ndarray, np.ndarray, tuple]]:
        weight = WEIGHT_LOW + (WEIGHT_HIGH - WEIGHT_LOW) * Z.uniform_array(draw, np.zeros(1, np.int64), offset + 4)[0]
        halves = [np.clip(v + sd * Z.normal_array(draw, number, offset + s), low, high) for v, s in ((first, 0), (second, 2))]
        sim = halves[0] ** weight * halves[1] ** (1.0 - weight)
        rank = placed(sim)
        moved = rank - rank.mean()
        spread = np.sqrt((moved * moved).sum() * (centred * centred).sum())
        rho = float((moved * centred).sum() / spread) if spread > 0 else float("nan")
        return [(rank, tier_of(sim) == tier, (rho, *[float(((rank <= k) & (place <= k)).sum() / k) for k in (10, decile)]))]

    rows = in_draws(scored.sparkSession, 1, draws, handle, keys, kind, BANDS, compute_tasks(scored))
    histogram = rows.where("draw = 0").select("key", F.col("rank").cast("int").alias("rank"), "n", "kept")
    rho = F.when(~F.isnan("p"), F.col("p"))
    return Simulated(histogram, rows.where("draw > 0").select("draw", F.lit(size).alias("n"), rho.alias("rho"), F.col("q").alias("top_10"), F.col("r").alias("top_decile")))


def rank_bands(histogram: DataFrame) -> DataFrame:
    """5th, 50th and 95th percentile of each key's rank, and how often it stays in its tier."""
    cuts = F.percentile("rank", F.array(*map(F.lit, BANDS)), F.col("n"))
    agg = histogram.groupBy("key").agg(cuts.alias("_p"), (F.sum("kept") / F.sum("n")).alias("tier_stability"))
    whole = lambda i: F.greatest(F.lit(1), F.bround(F.col("_p")[i], 0).cast("int"))
    return agg.select(
        "key", whole(0).alias("rank_p5"), whole(1).alias("rank_p50"), whole(2).alias("rank_p95"), "tier_stability",
        (F.col("_p")[2] - F.col("_p")[0]).alias("band_width"),
    )


def simulation_summary(draws: DataFrame, bands: DataFrame) -> DataFrame:
    """Agreement with the baseline per draw, retention of the top 10 and of the top decile (at least one key) on every
    twentieth draw, and the width of the bands."""
    picked = lambda c: F.avg(F.when(F.col("draw") % EVERY == 1, F.col(c)))
    summary = draws.agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("draws"), F.percentile("rho", F.lit(0.5)).alias("rho_median"),
        F.percentile("rho", F.lit(0.05)).alias("rho_p5"), picked("top_10").alias("top_retention"), picked("top_decile").alias("top_decile_retention"),
    )
    bands = cut_lineage(bands)
    widths = O.quantiles(bands, [], "band_width", {"median_band_width": 0.5}).scalar()
    share = bands.agg(
        F.struct(
            F.avg("tier_stability").alias("stability"), F.avg((F.col("band_width") <= 10).cast("double")).alias("narrow")
        )
    ).scalar()
    return summary.select(
        "*", widths.alias("median_band_width"), share["stability"].alias("tier_stability_mean"),
        share["narrow"].alias("share_within_10"),
    )


def noise_stability(
    scored: DataFrame, levels: list[float], draws: int, top: int, seed: int, flags: str | None = None
) -> DataFrame:
    """Rank interval width and retention of both ends at several noise levels.

    The deviation is the level itself, or grows by half of it per flag with ``flags``.
    """
    base = scored.where(F.col("composite").isNotNull())
    base = O.ranked(base, [], [F.col("composite").desc(), F.col("key").desc()], "base_rank")
    base = cut_lineage(base)
    size = base.count()
    spark, growth = scored.sparkSession, F.lit(1.0) if flags is None else 1.0 + 0.5 * F.col(flags)
    if 0 < size <= KEYS_AT_ONCE:
        told = collected(base.select("*", number_of(base, "key").cast("long").alias("_no"), growth.alias("_growth")), [F.col("key").desc()], ["_no", "_growth", "composite", "base_rank"])
        number, growth_of, score, before = (told[c].to_numpy() for c in ("_no", "_growth", "composite", "base_rank"))

        def at_level(level: float, noise: np.ndarray) -> tuple[np.ndarray, None, tuple]:
            sim = np.clip(score + level * growth_of * noise, 0.0, 1.0)
            place = placed(sim)
            twice = 2 * place
            for edge in (0.0, 1.0):  # only clipped values can tie; they share the mean of their places
                tied = sim == edge
                if tied.any():
                    twice[tied] = place[tied].min() + place[tied].max()
            kept = ((place <= top) & (before <= top)).sum(), ((place > size - top) & (before > size - top)).sum()
            return twice, None, (*map(float, kept), 0.0)

        def handle(draw: int) -> list[tuple[np.ndarray, None, tuple]]:
            noise = Z.normal_array(draw, number, seed)
            return [at_level(level, noise) for level in levels]

        rows = in_draws(spark, len(levels), draws, handle, pa.array(range(size), pa.int64()), "long", ENDS, compute_tasks(scored))
        named = F.array(*[F.lit(float(v)) for v in levels])[F.col("level")]
        histogram = rows.where("draw = 0").select(named.alias("level"), "key", (F.col("rank") / 2.0).alias("rank"), "n")
        ends = rows.where("draw > 0").groupBy(named.alias("level")).agg(F.sum("p").alias("_top"), F.sum("q").alias("_bottom"))
    else:
        histogram, ends = _noise_by_slices(base, size, levels, growth, draws, top, seed)
    kept = ends.select("level", (F.col("_top") / (top * draws)).alias("top_retention"), (F.col("_bottom") / (top * draws)).alias("bottom_retention"))
    cuts = F.percentile("rank", F.array(*map(F.lit, ENDS)), F.col("n"))
    widths = histogram.groupBy("level", "key").agg(cuts.alias("_p")).select("level", (F.col("_p")[1] - F.col("_p")[0]).alias("width"))
    widths = cut_lineage(widths)
    middle = O.quantiles(widths, ["level"], "width", {"median_width": 0.5})
    mean = widths.groupBy("level").agg(F.avg("width").alias("mean_width"))
    return kept.join(mean, "level").join(middle, "level")


def _noise_by_slices(base: DataFrame, size: int, levels: list[float], growth: Column, draws: int, top: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(level, key, rank, n) and (level, _top, _bottom) of a field of any size."""
    rows = expanded(base, draws).withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels])))
    noise = F.col("level") * growth * Z.normal(F.col("draw"), number_of(base, "key"), seed)
    rows = rows.select("key", "draw", "level", "base_rank", S.clamp(F.col("composite") + noise).alias("sim"))
    ranked = cut_lineage(ranked_in_draws(rows, ["level", "draw"], "sim", F.col("key").desc(), "place"))
    # only clipped values can tie; they share the mean of their places
    ties = ranked.where(F.col("sim").isin(0.0, 1.0)).groupBy("level", "draw", "sim").agg(F.avg("place").alias("_mean"))
    ranked = O.attach(ranked, ties, ["level", "draw", "sim"], "left")
    ranked = ranked.withColumn("rank", F.coalesce(F.col("_mean"), F.col("place").cast("double")))
    ends = ranked.groupBy("level").agg(
        F.count_if((F.col("place") <= top) & (F.col("base_rank") <= top)).alias("_top"),
        F.count_if((F.col("place") > size - top) & (F.col("base_rank") > size - top)).alias("_bottom"),
    )
    return ranked.groupBy("level", "key", "rank").agg(F.count(F.lit(1)).alias("n")), ends
