"""Near copies of whole documents: Jaccard of 0.8 or more on five-word shingles, SimHash and MinHash bands for candidates.

A text is the set of its lower-case five-word shingles (the whole text if it is shorter; texts without words are all
equal). Texts whose SimHash fingerprints of five-word shingles join up by ``simhash.links`` (pigeonhole probes, two bits) are candidates.
Many texts with a Jaccard of 0.8 lie farther apart (4 to 14 bits), where probes cost too much; so texts that share a key of ``BANDS`` bands of
``ROWS`` MinHashes are candidates as well: at Jaccard 0.8 a pair misses all of them with odds of (1 - 0.8^4)^20, 3 in 100,000. A component of
fingerprints is a bucket like that of a band. Candidates are compared by exact Jaccard of the whole sets.

Texts of equal words are one node. Every member of a bucket is first compared with that one of it which shares most buckets with
others, so a group of edited copies of one text costs one comparison a member. What that does not join up into one component is compared
across components: pair by pair in buckets of up to ``PAIRWISE`` members, in larger ones by blocks of sets, where only links become
rows. Before the sets of a pair are fetched, the two must agree in size and in a sketch of two bits of each MinHash: of ``SKETCH_BITS``
bits a pair with a Jaccard of 0.8 differs in 16 on average and in more than ``SKETCH_MOST`` with odds of 5 in a million. Unlike texts in
one crowded bucket cost the square of their number in comparisons, spread over tasks of two blocks each.

Defined cases: null and empty texts and those of white space are equal to each other; repeated rows are one node, as are equal
texts; a null id names no component unless all of its ids are null; texts of any length are read whole; an empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from compindex.llm import simhash
from compindex.llm.common import carried_id, hot_keys, let_go, lookup, returned, text_bytes, together
from compindex.llm.exact import bit_map, in_map
from compindex.llm.graph import components
from compindex.session import cut_lineage

SHINGLE = 5
BANDS, ROWS = 20, 4
# Bits of a sketch, and by how many of them candidates may differ.
SKETCH_BITS, SKETCH_MOST = 2 * BANDS * ROWS, 38
SKETCH = ("s0", "s1", "s2")
# Texts whose sets a task holds at once.
ROWS_AT_ONCE = 500
# Members of a bucket up to which its pairs are compared one by one.
PAIRWISE = 64
# Sets and shingles of a block of a bucket.
BLOCK_SETS, BLOCK_SHINGLES = 512, 500_000
# Tasks that share the pairs of a hot node.
SALTS = 32
# Shingles hashed at once, against all MinHash functions.
PIECE = 2_000
FILTER_BITS = 26
_RANDOM = np.random.RandomState(11)
_FACTORS = _RANDOM.randint(1, 1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.randint(1, 1 << 62, size=SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return values ^ (values >> np.uint64(27))


def shingle_set(data: bytes | None) -> tuple[int, np.ndarray]:
    """A text's node (a hash of its words in order), and its distinct shingles as sorted 64-bit hashes."""
    words = data.lower().split() if data else []
    node = xxh64_intdigest(b" ".join(words), 5)
    if len(words) <= SHINGLE:
        return node, np.array([node], np.uint64)
    h = np.fromiter(map(xxh64_intdigest, words, repeat(3)), np.uint64, len(words))
    shingles = np.zeros(len(h) - SHINGLE + 1, np.uint64)
    for k in range(SHINGLE):
        shingles += h[k : len(h) - SHINGLE + 1 + k] * _PLACES[k]
    return node, np.unique(_mix(shingles))


def band_keys(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, sketch): the keys of all bands, and two bits of every MinHash in three numbers."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), PIECE):
        low = np.minimum(low, _mix(shingles[at : at + PIECE, None] * _FACTORS).min(axis=0))
    keys = (low.reshape(BANDS, ROWS) * _PLACES[:ROWS]).sum(axis=1, dtype=np.uint64)
    bits = np.zeros(64 * len(SKETCH), np.uint8)
    bits[: BANDS * ROWS], bits[BANDS * ROWS : SKETCH_BITS] = low & np.uint64(1), low >> np.uint64(1) & np.uint64(1)
    return _mix(keys + np.arange(1, BANDS + 1, dtype=np.uint64)), np.packbits(bits).view(np.uint64)


def _marks(docs: DataFrame) -> DataFrame:
    """(doc_id, w, fp, n, keys, s0, s1, s2): every row's node, fingerprint, number of shingles, band keys and sketch."""

    schema = "doc_id long, w long, fp long, n long, keys array<long>, " + ", ".join(f"{name} long" for name in SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in _parts(batches):
            ids, nodes, prints, sizes, keys, sketches = part.column(0), [], [], [], [], []
            for data in part.column(1):
                node, shingles = shingle_set(data.as_py())
                prints.append(simhash.fingerprint(data.as_py(), SHINGLE))
                own, sketch = band_keys(shingles)
                nodes.append(node)
                sizes.append(len(shingles))
                keys.append(own)
                sketches.append(sketch)
            ends = np.arange(0, BANDS * len(keys) + 1, BANDS, dtype=np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(keys).view(np.int64))
            sketch = np.stack(sketches).view(np.int64)
            columns = [ids, *(np.array(c, np.uint64).view(np.int64) for c in (nodes, prints)), np.array(sizes), lists, *(np.ascontiguousarray(sketch[:, k]) for k in range(len(SKETCH)))]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "w", "fp", "n", "keys", *SKETCH])

    return returned(docs.select(carried_id(), text_bytes().alias("data")).mapInArrow(run, schema))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut into ``ROWS_AT_ONCE`` rows, so that what is made of one part stays small; empty ones are left out."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _sets(docs: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(w, shingles) of the nodes in the bit map, materialised."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        for part in _parts(batches):
            found = [shingle_set(data.as_py()) for data in part.column(0)]
            hits = in_map(shared.value, np.array([f[0] for f in found], np.uint64))
            found = [f for f, hit in zip(found, hits) if hit]
            if found:
                ends = np.cumsum([0, *(len(f[1]) for f in found)], dtype=np.int32)
                sets = pa.ListArray.from_arrays(ends, np.concatenate([f[1] for f in found]).view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64)), sets], ["w", "shingles"])

    found = cut_lineage(docs.select(text_bytes().alias("data")).mapInArrow(run, "w long, shingles array<long>").dropDuplicates(["w"]))
    shared.destroy()  # else a copy of the map stays on every executor's disk
    return found


def _alike(l: str, r: str) -> Column:
    """Whether two nodes can reach a Jaccard of 0.8 by the sizes of their sets, and are likely to by their sketches."""
    sizes = F.least(f"{l}n", f"{r}n") * 5 >= F.greatest(f"{l}n", f"{r}n") * 4
    return sizes & (sum((F.bit_count(F.col(f"{l}{s}").bitwiseXOR(F.col(f"{r}{s}"))) for s in SKETCH), F.lit(0)) <= SKETCH_MOST)


def _with_set(pairs: DataFrame, sets: DataFrame, side: str, hot: DataFrame) -> DataFrame:
    """``pairs`` with the set of one side. The sets of ``hot`` nodes go to ``SALTS`` tasks each; no set is broadcast."""
    hot = F.broadcast(hot.select(side, F.lit(True).alias("hot")))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("a", "b"), F.lit(SALTS))).otherwise(0)
    spread = pairs.join(hot, side, "left").withColumn("salt", salt.cast("int")).drop("hot")
    named = sets.select(F.col("w").alias(side), F.col("shingles").alias(f"s{side}")).join(hot, side, "left")
    copies = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return spread.join(named.withColumn("salt", F.explode(copies)).drop("hot"), [side, "salt"]).drop("salt")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) with an exact Jaccard of 0.8 or more."""
    pairs = cut_lineage(pairs.distinct())
    nodes = together(pairs.select(F.col("a").alias("w")), pairs.select(F.col("b").alias("w"))).distinct()
    sets = _sets(docs, bit_map(nodes, "w", FILTER_BITS))
    # hot nodes are told from the bare pairs: every node has its set, and the join with the first sets is made once
    both = _with_set(_with_set(pairs, sets, "a", hot_keys(pairs, ["a"])), sets, "b", hot_keys(pairs, ["b"]))
    shared = F.size(F.array_intersect("sa", "sb"))
    return cut_lineage(both.where(shared * 9 >= (F.size("sa") + F.size("sb")) * 4).select("a", "b"))


def _fingerprint_keys(nodes: DataFrame) -> DataFrame:
    """``nodes`` with a key for each component of fingerprints (column fp) that ``simhash.links`` joins up."""
    found = cut_lineage(components(simhash.links(nodes)).select(F.col("node").alias("fp"), F.col("component").alias("root")))
    return lookup(nodes, found, ["fp"], "left").withColumn("key", F.xxhash64(F.lit("fingerprint"), F.coalesce("root", "fp")))


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) between nodes (w, fp, n, keys, sketch) of ``docs`` that joins up exactly the candidates with a Jaccard of 0.8 or more."""
    facts = ["w", "n", *SKETCH]
    banded = nodes.select("w", F.explode("keys").alias("key"))
    entries = cut_lineage(together(banded, _fingerprint_keys(nodes.select("w", "fp")).select("w", "key")))
    sizes = cut_lineage(entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1"))
    shared = cut_lineage(lookup(entries, sizes, ["key"]))
    # what other texts were edited from meets most of them: the member of the largest buckets is compared first
    crowd = shared.groupBy("w").agg(F.sum("size").alias("crowd")).join(nodes.select(*facts), "w")
    ranked = cut_lineage(shared.join(crowd, "w"))
    centres = ranked.groupBy("key").agg(F.max(F.struct("crowd", *facts)).alias("c"))
    centres = cut_lineage(centres.select("key", *[F.col(f"c.{f}").alias(f"c{f}") for f in facts]))
    sized = cut_lineage(lookup(ranked.drop("crowd"), centres, ["key"]))
    near = _verified(docs, sized.where((F.col("cw") != F.col("w")) & _alike("c", "")).select(F.col("cw").alias("a"), F.col("w").alias("b")))
    found = cut_lineage(components(near).select(F.col("node").alias("w"), F.col("component").alias("class")))
    classed = lookup(sized.select("key", "size", *facts, (F.col("w") == F.col("cw")).alias("is_centre")), found, ["w"], "left")
    classed = cut_lineage(classed.withColumn("class", F.coalesce("class", "w")))
    split = classed.groupBy("key").agg(F.min("class").alias("one"), F.max("class").alias("other")).where("one <> other").select("key")
    open_ones = cut_lineage(lookup(classed.drop("is_centre"), cut_lineage(split), ["key"]))
    side = lambda s: open_ones.where(F.col("size") <= PAIRWISE).select("key", *[F.col(f).alias(f"{s}{f}") for f in (*facts, "class")])
    few = side("l").join(side("r"), "key").where((F.col("lclass") < F.col("rclass")) & _alike("l", "r"))
    found = together(near, _verified(docs, few.select(F.least("lw", "rw").alias("a"), F.greatest("lw", "rw").alias("b"))))
    crowded = open_ones.where(F.col("size") > PAIRWISE)
    return found if crowded.isEmpty() else together(found, _across(docs, crowded.select("key", "w", "n", "class")))


def _across(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b): links with a Jaccard of 0.8 or more between members (key, w, n, class) of one bucket and of different classes.

    The sets of a bucket's members meet in blocks of up to about ``BLOCK_SETS`` sets or ``BLOCK_SHINGLES`` shingles, every block with every
    other, so a task holds two blocks and only links become rows.
    """
    members = cut_lineage(members)
    sizes = members.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    sized = cut_lineage(lookup(members, cut_lineage(sizes), ["key"]))
    sets = _sets(docs, bit_map(members.select("w").distinct(), "w", FILTER_BITS))
    own = F.pmod(F.xxhash64("w"), F.col("parts")).cast("int")
    other = F.sequence(F.lit(0), F.col("parts") - 1)
    # a block meets itself and every other block once: as the lower or as the higher of the two
    pair = F.transform(other, lambda o: F.struct(F.least("own", o).alias("low"), F.greatest("own", o).alias("high")))
    dealt = sized.withColumn("own", own).withColumn("blocks", F.explode(pair)).select("key", "w", "class", "own", "blocks.low", "blocks.high")
    rows = dealt.join(sets, "w")
    return cut_lineage(rows.groupBy("key", "low", "high").applyInPandas(_linked, "a long, b long")).distinct()


def _linked(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the sets of two blocks (or within one), each row against all at once."""
    w, kind, own = rows["w"].to_numpy(), rows["class"].to_numpy(), rows["own"].to_numpy()
    sizes = np.array([len(s) for s in rows["shingles"]])
    found_a, found_b = [], []
    if len(w) > 1 and (kind != kind[0]).any():
        values, flat = np.unique(np.concatenate(rows["shingles"].to_list()), return_inverse=True)
        starts, inside = np.cumsum(sizes) - sizes, np.zeros(len(values), np.int64)
        within = rows["low"].iloc[0] == rows["high"].iloc[0]
        for i in range(len(w)):
            mine = flat[starts[i] : starts[i] + sizes[i]]
            inside[mine] = 1
            shared = np.add.reduceat(inside[flat], starts)
            inside[mine] = 0
            near = (shared * 9 >= (sizes + sizes[i]) * 4) & (kind != kind[i]) & (w > w[i] if within else own != own[i])
            found_a += [int(w[i])] * int(near.sum())
            found_b += w[near].tolist()
    ends = np.array([found_a, found_b], np.int64).reshape(2, -1)
    return pd.DataFrame({"a": ends.min(axis=0), "b": ends.max(axis=0)})


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) for every row: the smallest doc_id of its component of near copies."""
    marked = cut_lineage(_marks(docs))
    nodes = cut_lineage(marked.groupBy("w").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("fp", "n", "keys", *SKETCH)]))
    found = components(links(docs, nodes)).select(F.col("node").alias("w"), F.col("component").alias("root"))
    named = cut_lineage(nodes.join(found, "w", "left").select("w", "first", F.coalesce("root", "w").alias("root")))
    classes = cut_lineage(named.groupBy("root").agg(F.min("first").alias("component_id")))
    facts = cut_lineage(lookup(named.select("w", "root"), classes, ["root"]).select("w", "component_id"))
    return lookup(marked.select("doc_id", "w"), facts, ["w"]).select("doc_id", "component_id")
