"""Passages that repeat across documents: every window of words, and content-cut paragraphs by MinHash banding and components.

Shared passages start in the middle of lines, so line breaks cannot name them. A passage is a run of ``WINDOW`` = 20 words or more.
The windows of 20 words at all places of all texts are looked at, so equal passages are found wherever they lie. Most windows meet no
other: a window's seed is the smallest hash of its runs of ``SEED`` words, equal windows have equal seeds, neighbours mostly share one,
and only windows whose seed occurs in two documents become rows.

Beside them, paragraphs of 20 words start where the text itself says so: of every ``SPAN`` successive starts the one with the smallest
shingle hash. Those that collide in a band of MinHashes are compared by exact Jaccard on bags of five-word shingles (a shingle's second
occurrence is another one): all pairs of a small bucket; in a crowded one every paragraph is keyed by its shingles less one, and those that
share a key form a star (16 shingles each: Jaccard of 0.8 is reached exactly by 15 shared ones). A longer passage that changed words
leave at a Jaccard of 0.8 keeps a run of 20 unchanged words, which the windows find.

Equal windows are one node. Components of equal and similar ones that occur in two documents or more are reported. Windows are told apart
by a 64-bit hash.

Of equal texts one row is worked on (a bit map may let a few more through); the windows of all its copies become rows at the very end.
What a copied text shares with no other text is all it has less the stretches that are shared, so it is never a row for each window.

Null, empty and shorter texts have no windows, and one word 20 times over is none; repeated rows of one doc_id are one document; rows
without a doc_id are reported but do not count as a second document.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from compindex.llm.common import HOT_SHARE, NO_ID, carried_id, lookup, text_bytes
from compindex.llm.exact import bit_map, in_map
from compindex.llm.graph import components
from compindex.session import cut_lineage, scratch_path

SHINGLE, WINDOW, SPAN, SEED = 5, 20, 31, 8
SHINGLES = WINDOW - SHINGLE + 1
SHARED = 15  # least number of equal shingles of two sets of 16 with a Jaccard of 0.8
# Bands of ROWS MinHashes each: at Jaccard 0.8, 1 - (1 - 0.8^2)^3 = 95 % of pairs meet in a band, each on its own.
BANDS, ROWS = 3, 2
PAIRWISE = 64
# Paragraphs worked on at once, those whose band keys are made at once, windows of a text, pairs.
BLOCK, KEYED, PIECE, PAIRS = 200_000, 2_000, 100_000, 20_000
# Bits of a bit map for each key, and the powers of two between which its size lies: 128 KB to 128 MB.
FILTER_SHARE, FILTER_BITS = 64, (20, 30)
# Kinds of places: where a copied text's stretch of windows opens, its windows, where the stretch has closed; windows of other texts.
OPEN, COPIED, CLOSED, SOLE = range(4)
_RANDOM = np.random.RandomState(7)
_FACTORS = _RANDOM.randint(1, 1 << 62, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACES = _RANDOM.randint(1, 1 << 62, size=WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return values ^ (values >> np.uint64(27))


def _sliding(values: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every window of ``width`` values, by doubling."""
    reach = 1
    while 2 * reach <= width:
        values = best(values[:-reach], values[reach:])
        reach *= 2
    rest = width - reach
    return best(values[:-rest], values[rest:]) if rest else values


def _hashes(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's words, and of its shingles; none of texts that are shorter than a window."""
    words = data.lower().split() if data else []
    if len(words) < WINDOW:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    h = np.frombuffer(b"".join(map(xxh64_digest, words, repeat(3))), ">u8").astype(np.uint64)
    return h, _runs(h, SHINGLE)


def _runs(h: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` words."""
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out += h[k : len(h) - width + 1 + k] * _PLACES[k]
    return _mix(out)


def _doubled(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of every run of ``width`` values (a power of two), by doubling: ``_weights`` says what each value counts."""
    for k in range(width.bit_length() - 1):
        values = values[: -(1 << k)] + values[1 << k :] * _PLACES[k]
    return _mix(values)


def _weights(width: int) -> np.ndarray:
    """The factors of a run's values in ``_doubled``."""
    out = np.ones(1, np.uint64)
    for k in range(width.bit_length() - 1):
        out = np.concatenate([out, out * _PLACES[k]])
    return out


def _seeds(h: np.ndarray) -> np.ndarray:
    """The smallest hash of a window's runs of ``SEED`` words; odd."""
    return _sliding(_doubled(h, SEED), WINDOW - SEED + 1, np.minimum) | np.uint64(1)


def _varied(h: np.ndarray) -> np.ndarray:
    """Whether a window is more than one word over and over."""
    changed = h[1:] != h[:-1]
    if len(changed) - np.count_nonzero(changed) < WINDOW - 1:
        return np.ones(len(h) - WINDOW + 1, bool)
    changes = np.concatenate([[0], np.cumsum(changed)])
    return changes[WINDOW - 1 :] > changes[: len(h) - WINDOW + 1]


def _cut(h: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(h):
        return np.zeros(0, np.int64), np.zeros((0, SHINGLES), np.uint64)
    heads = shingles[: len(h) - WINDOW + 1]
    span = min(SPAN, len(heads))
    # a start is chosen if it holds the minimum of some run of `span` starts: the largest of its runs' minima is its own
    lowest = _sliding(heads, span, np.minimum)
    padded = np.concatenate([np.zeros(span - 1, np.uint64), lowest, np.zeros(span - 1, np.uint64)])
    starts = np.flatnonzero((_sliding(padded, span, np.maximum) == heads) & _varied(h))
    return starts, shingles[starts[:, None] + np.arange(SHINGLES)]


def paragraphs(data: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """Starts (in words) of a text's content-cut paragraphs, and a row of shingle hashes for each."""
    return _cut(*_hashes(data))


def windows(data: bytes | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(starts, hashes, seeds) of all windows of a text, about ``PIECE`` at once."""
    yield from _windows(*_hashes(data))


def _windows(h: np.ndarray, shingles: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    if not len(h):
        return
    seeds, varied = _seeds(h), _varied(h)
    for at in range(0, len(seeds), PIECE):
        starts = np.flatnonzero(varied[at : at + PIECE])
        ids = _doubled(shingles[at : at + PIECE + SHINGLES - 1], SHINGLES)
        yield at + starts, ids[starts], seeds[at + starts]


def bags(rows: np.ndarray) -> np.ndarray:
    """Rows of shingle hashes in which a shingle's second, third, .. occurrence is another one."""
    ordered = np.sort(rows, axis=1)
    twice = np.flatnonzero((ordered[:, 1:] == ordered[:, :-1]).any(axis=1))
    if len(twice):
        rows = rows.copy()
        rows[twice] = _told_apart(rows[twice])
    return rows


def _told_apart(rows: np.ndarray) -> np.ndarray:
    order = np.argsort(rows, axis=1, kind="stable")
    ordered = np.take_along_axis(rows, order, axis=1)
    again = np.zeros(rows.shape, np.uint64)
    for k in range(1, rows.shape[1]):
        again[:, k] = np.where(ordered[:, k] == ordered[:, k - 1], again[:, k - 1] + np.uint64(1), np.uint64(0))
    out = np.empty_like(rows)
    np.put_along_axis(out, order, np.where(again > 0, _mix(ordered + again * _PLACES[0]), ordered), axis=1)
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One row of band keys per paragraph."""
    keys = np.empty((len(rows), BANDS), np.uint64)
    for at in range(0, len(rows), KEYED):
        columns = np.ascontiguousarray(rows[at : at + KEYED].T)  # minima run along whole columns
        low = np.stack([_mix(columns * f).min(axis=0) for f in _FACTORS], axis=1).reshape(-1, BANDS, ROWS)
        keys[at : at + KEYED] = low[:, :, 0] * _PLACES[0] + low[:, :, 1] * _PLACES[1] + np.arange(1, BANDS + 1, dtype=np.uint64)
    return _mix(keys)


def _ids(rows: np.ndarray) -> np.ndarray:
    """A paragraph's hash, which depends on the order of its shingles."""
    return _mix((rows * _weights(SHINGLES)).sum(axis=1, dtype=np.uint64))


def _texts(docs: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """(doc_id, t) of all rows with a text, (t, low, high, n, name) of the texts, and whether a text's ``name`` is its hash ``t``.

    It is the smallest doc_id of its rows, unless a doc_id has two texts or a text no doc_id.
    """
    marks = cut_lineage(docs.where("text IS NOT NULL").select("doc_id", F.xxhash64(text_bytes()).alias("t")))
    texts = cut_lineage(marks.groupBy("t").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n")))
    many = marks.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b")
    by_hash = not (many.isEmpty() and texts.where("low IS NULL").isEmpty())
    return marks, texts.withColumn("name", F.col("t" if by_hash else "low")), by_hash


def _first_rows(docs: DataFrame, texts: DataFrame, by_hash: bool) -> tuple[DataFrame, np.ndarray]:
    """(name, t, row, data) of all rows with a text, and a bit map of ``row`` for one of the rows of each text."""
    rows = docs.where("text IS NOT NULL").select(carried_id(), text_bytes().alias("data"), F.xxhash64(text_bytes()).alias("t"))
    rows = rows.select(F.col("t" if by_hash else "doc_id").alias("name"), "t", F.xxhash64("doc_id", "t").alias("row"), "data")
    return rows, _map(texts.select(F.xxhash64(F.coalesce("low", F.lit(NO_ID)), "t").alias("row")), "row")


def _only(batches: Iterator[pd.DataFrame], first: np.ndarray) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield batch[in_map(first, batch["row"].to_numpy().view(np.uint64))]


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, bags of shingle hashes) of the paragraphs of many texts at once, about ``BLOCK`` rows each."""
    held, rows = [], 0
    for batch in batches:
        for data in batch["data"]:
            found = paragraphs(data)[1]
            if len(found):
                held.append(found)
                rows += len(found)
            if rows >= BLOCK:
                yield _joined(held)
                held, rows = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.concatenate(held)
    return _ids(rows), bags(rows)


def _meetings(rows: DataFrame, first: np.ndarray) -> DataFrame:
    """(key, v): the band keys of paragraphs (even) with 32 bits of their hash, and the seeds of windows (odd) with their text's name.

    A key with two values stands for different paragraphs, or for texts that may share a window.
    """
    shared = rows.sparkSession.sparkContext.broadcast(first)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, seeds, rows = [], [], 0
        for batch in _only(batches, shared.value):
            for name, data in zip(batch["name"], batch["data"]):
                h, shingles = _hashes(data)
                held.append(_cut(h, shingles)[1])
                if len(h):
                    seeds.append((name, successive(_seeds(h)[_varied(h)])))
                rows += len(held[-1])
                if rows >= BLOCK:
                    yield found(held, seeds)
                    held, seeds, rows = [], [], 0
        if held:
            yield found(held, seeds)

    def successive(own: np.ndarray) -> np.ndarray:
        new = np.ones(len(own), bool)
        new[1:] = own[1:] != own[:-1]
        return own[new]

    def found(held: list[np.ndarray], seeds: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        w, sets = _joined(held)
        keys, values = (band_keys(sets) & ~np.uint64(1)).T.ravel(), np.tile((w >> np.uint64(32)).astype(np.int64), BANDS)
        bands = pd.DataFrame({"key": keys.view(np.int64), "v": values}).drop_duplicates()
        names = np.repeat(np.array([name for name, _ in seeds], np.int64), [len(own) for _, own in seeds])
        keys = np.concatenate([bands["key"].to_numpy(), *(own.view(np.int64) for _, own in seeds)])
        return pd.DataFrame({"key": keys, "v": np.concatenate([bands["v"].to_numpy(), names])})

    return rows.mapInPandas(run, "key long, v long")


def _candidates(rows: DataFrame, first: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(key, w, shingles) of paragraphs whose band key is in the bit map; shingles are cut to 32 bits each."""
    shared = rows.sparkSession.sparkContext.broadcast((first, wanted))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, wanted = shared.value
        for ids, rows in _blocks(_only(batches, first)):
            keys = band_keys(rows) & ~np.uint64(1)
            at, band = np.nonzero(in_map(wanted, keys))
            short = (rows[at] >> np.uint64(32)).astype("<u4")
            found = pd.DataFrame({"key": keys[at, band].view(np.int64), "w": ids[at].view(np.int64), "shingles": [r.tobytes() for r in short]})
            yield found.drop_duplicates(["key", "w"])

    return rows.mapInPandas(run, "key long, w long, shingles binary")


def _places(rows: DataFrame, first: np.ndarray, copied: np.ndarray | None, seeds: np.ndarray, linked: np.ndarray) -> DataFrame:
    """(name, start, w, kind) of the windows whose seed or hash is in a bit map, and of the ends of all stretches of copied texts' windows.

    Texts whose hash is in the bit map ``copied`` count as copied, all without one.
    """
    shared = rows.sparkSession.sparkContext.broadcast((first, copied, seeds, linked))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, copied, met, similar_ones = shared.value
        held, rows = [], 0
        for batch in _only(batches, first):
            several = np.ones(len(batch), bool) if copied is None else in_map(copied, batch["t"].to_numpy().view(np.uint64))
            for name, again, data in zip(batch["name"], several, batch["data"]):
                h, shingles = _hashes(data)
                found = [(starts, ids, COPIED if again else SOLE) for starts, ids in hits(h, shingles, met, similar_ones)]
                if again and len(h):
                    ends = np.flatnonzero(np.diff(np.concatenate([[False], _varied(h), [False]]).astype(np.int8)))
                    found += [(ends[::2], np.zeros(len(ends) // 2, np.uint64), OPEN), (ends[1::2], np.zeros(len(ends) // 2, np.uint64), CLOSED)]
                for starts, ids, kind in found:
                    held.append((np.full(len(starts), name, np.int64), starts, ids.view(np.int64), np.full(len(starts), kind, np.int8)))
                    rows += len(starts)
                if rows >= BLOCK:
                    yield joined(held)
                    held, rows = [], 0
        if rows:
            yield joined(held)

    def hits(h: np.ndarray, shingles: np.ndarray, met: np.ndarray, similar_ones: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for starts, ids, own in _windows(h, shingles):
            hit = in_map(met, own) | in_map(similar_ones, ids)
            if hit.any():
                yield starts[hit], ids[hit]

    def joined(held: list[tuple[np.ndarray, ...]]) -> pd.DataFrame:
        return pd.DataFrame({column: np.concatenate(part) for column, part in zip(("name", "start", "w", "kind"), zip(*held))})

    return rows.mapInPandas(run, "name long, start long, w long, kind byte")


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links of small buckets, and the members of crowded ones, from rows sorted by (key, w).

    A batch's last bucket may run on: up to ``PAIRWISE`` rows wait for the next batch, whatever a bucket's size.
    """
    held, crowded = None, None
    for batch in batches:
        rows = (batch["key"].to_numpy(), batch["w"].to_numpy(), batch["shingles"].to_numpy())
        if crowded is not None:
            more = int(np.searchsorted(rows[0], crowded, "right"))
            yield _members(rows[1][:more], rows[2][:more])
            rows = tuple(r[more:] for r in rows)
        if held is not None:
            rows, held = tuple(np.concatenate(pair) for pair in zip(held, rows)), None
        if not len(rows[0]):
            continue
        last = int(np.searchsorted(rows[0], rows[0][-1], "left"))
        tail, crowded = tuple(r[last:] for r in rows), None
        if len(tail[0]) > PAIRWISE:
            crowded = tail[0][0]
            yield _members(tail[1], tail[2])
        else:
            held = tail
        yield from _buckets(*(r[:last] for r in rows))
    if held is not None:
        yield from _buckets(*held)


def _members(w: np.ndarray, shingles: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": w, "b": pd.array([None] * len(w), "Int64"), "shingles": shingles})


def _buckets(keys: np.ndarray, w: np.ndarray, shingles: np.ndarray) -> Iterator[pd.DataFrame]:
    """Whole buckets: pairs with a Jaccard of 0.8 or more (``SHARED`` equal shingles), or the members of crowded ones."""
    if not len(keys):
        return
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(starts, len(keys)))
    big = np.repeat(sizes > PAIRWISE, sizes)
    if big.any():
        yield _members(w[big], shingles[big])
    sets = np.frombuffer(b"".join(shingles), "<u4").reshape(-1, SHINGLES)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= PAIRWISE)]):
        own, (i, j) = starts[sizes == size], np.triu_indices(size, 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(own), step):
            base = own[at : at + step, None]
            first, second = (base + i).ravel(), (base + j).ravel()
            left, right = sets[first], sets[second]
            shared = np.zeros(len(first), np.int16)
            for k in range(SHINGLES):
                shared += (left[:, k, None] == right).any(axis=1)
            near = shared >= SHARED
            if near.any():
                yield pd.DataFrame({"a": w[first[near]], "b": pd.array(w[second[near]], "Int64"), "shingles": None})


def similar(rows: DataFrame, first: np.ndarray, wanted: np.ndarray) -> DataFrame:
    """(a, b): links between different paragraphs with a Jaccard of 0.8 or more that meet in a band of the bit map."""
    found = _candidates(rows, first, wanted).repartition("key").dropDuplicates(["key", "w"])
    compared = cut_lineage(found.sortWithinPartitions("key", "w").mapInPandas(_compared, "a long, b long, shingles binary"))
    members = compared.where("b IS NULL").dropDuplicates(["a"])
    less_one = cut_lineage(members.mapInPandas(_less_one, "w long, part long"))
    centres = cut_lineage(less_one.groupBy("part").agg(F.min("w").alias("low"), F.max("w").alias("high")).where("low <> high").select("part", "low"))
    stars = lookup(less_one, centres, ["part"]).where("low <> w").select(F.col("low").alias("a"), F.col("w").alias("b"))
    return compared.where("b IS NOT NULL").select("a", "b").unionByName(stars).distinct()


def _less_one(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Every paragraph once per shingle, keyed by the set of its other shingles."""
    for batch in batches:
        if len(batch):
            sets = _mix(np.stack([np.frombuffer(s, "<u4") for s in batch["shingles"]]).astype(np.uint64) + _PLACES[0])
            parts = sets.sum(axis=1, dtype=np.uint64)[:, None] - sets
            yield pd.DataFrame({"w": np.repeat(batch["a"].to_numpy(), SHINGLES), "part": parts.ravel().view(np.int64)})


def _map(keys: DataFrame, column: str) -> np.ndarray:
    """Bit map with ``FILTER_SHARE`` bits or more for each key, so that few others hit it."""
    low, high = FILTER_BITS
    return bit_map(keys, column, min(max((FILTER_SHARE * keys.count()).bit_length(), low), high))


def _runs_of_places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Successive windows of a text with one component become (name, start, last, component_id, kind), from rows sorted by (name, start)."""
    before = None
    for batch in batches:
        name, start, component = (batch[c].to_numpy() for c in ("name", "start", "component_id"))
        new = np.ones(len(name), bool)
        new[1:] = (name[1:] != name[:-1]) | (start[1:] != start[:-1])
        if len(name):
            new[0] = before != (name[0], start[0])
            before = name[-1], start[-1]
        name, start, component = name[new], start[new], component[new]
        if len(name):
            own = np.flatnonzero(np.concatenate([[True], (name[1:] != name[:-1]) | (start[1:] != start[:-1] + 1) | (component[1:] != component[:-1])]))
            last = start[np.append(own[1:], len(name)) - 1]
            yield pd.DataFrame({"name": name[own], "start": start[own], "last": last, "component_id": component[own], "kind": np.full(len(own), COPIED, np.int8)})


def _stretches(found: DataFrame, places: DataFrame, texts: DataFrame) -> DataFrame:
    """(name, start, last, component_id): all stretches of copied texts' windows, those that no other text has among them."""
    schema = "name long, start long, last long, component_id long, kind byte"
    shared = cut_lineage(found.repartition("name").sortWithinPartitions("name", "start").mapInPandas(_runs_of_places, schema))
    ends = places.where(F.col("kind").isin(OPEN, CLOSED)).distinct()
    ends = ends.select("name", "start", (F.col("start") - 1).alias("last"), F.lit(None).cast("long").alias("component_id"), "kind")
    copies = texts.where("low < high").select("name", "low")
    along = ends.unionByName(shared).join(copies, "name").withColumn("next", F.lag("last").over(Window.partitionBy("name").orderBy("start", "kind")) + 1)
    rest = along.where((F.col("kind") != OPEN) & (F.col("next") < F.col("start")))
    rest = rest.select("name", F.col("next").alias("start"), (F.col("start") - 1).alias("last"), F.col("low").alias("component_id"))
    return shared.select(rest.columns).unionByName(rest)


def _written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet in the shared folder, which takes less disk than a checkpoint."""
    path = scratch_path(df.sparkSession, "passages")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def repeated(docs: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, component_id, kept) of every window that also occurs, or has a similar one, in another document.

    ``component_id`` is the smallest doc_id that has a window of the component; that document keeps it.
    """
    marks, texts, by_hash = _texts(docs)
    rows, first = _first_rows(docs, texts, by_hash)
    met = _meetings(rows, first).groupBy("key").agg(F.min("v").alias("low"), F.max("v").alias("high")).where("low <> high").select("key")
    met = cut_lineage(met)
    links = similar(rows, first, _map(met.where("key % 2 = 0"), "key"))
    linked = cut_lineage(components(links).select(F.col("node").alias("w"), F.col("component").alias("class")))
    copied = None if by_hash else _map(texts.where("n > 1"), "t")
    written = _written(_places(rows, first, copied, _map(met.where("key % 2 <> 0"), "key"), _map(linked, "w")))
    places = written.where(F.col("kind").isin(COPIED, SOLE))
    # a text stands for all its documents; one that is named by its smallest doc_id shares a window with another if their names differ
    owned = lookup(places, texts.select("name", "low", "high"), ["name"]) if by_hash else places.withColumns({"low": F.col("name"), "high": F.col("name")})
    spread = owned.groupBy("w").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count(F.lit(1)).alias("n"))
    named = _written(spread.join(linked, "w", "left").where("low < high OR class IS NOT NULL"))
    similar_ones = named.where("class IS NOT NULL")
    classes = similar_ones.groupBy("class").agg(F.min("low").alias("component_id"), F.max("high").alias("last")).where("component_id < last")
    facts = lookup(similar_ones.select("w", "n", "class"), cut_lineage(classes), ["class"]).select("w", "n", "component_id")
    facts = facts.unionByName(named.where("class IS NULL").select("w", "n", F.col("low").alias("component_id")))
    # the windows of hot hashes meet their facts by broadcast; how often a hash occurs is known, so it is not counted again
    crowded = F.col("n") * HOT_SHARE > places.count()
    few, rest = F.broadcast(facts.where(crowded).drop("n")), facts.where(~crowded).drop("n")

    def found(kind: int) -> DataFrame:
        own = places.where(F.col("kind") == kind).drop("kind")
        return own.join(few, "w").unionByName(own.join(few, "w", "left_anti").join(rest, "w")).select("name", "start", "component_id")

    members = cut_lineage(marks.join(texts.select("t", "name"), "t").select("doc_id", "name"))
    stretches = lookup(members, cut_lineage(_stretches(found(COPIED), written, texts)), ["name"])
    copies = stretches.select("doc_id", F.explode(F.sequence("start", "last")).alias("start"), "component_id")
    out = found(SOLE).withColumnRenamed("name", "doc_id").unionByName(copies)
    return out.select("doc_id", "start", F.lit(WINDOW).cast("long").alias("n_words"), "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))
