"""Best-fit packing of documents into sequences of a fixed number of tokens, improved by exchanges.

``pieces`` encodes every text with the tokenizers library, closes it with an end id and cuts only what is longer than a
sequence. ``packed`` gives every piece a sequence and a place. Pieces are packed where they lie, in chunks of ``CHUNK``: longest
first, each into the fullest sequence with room. Then the emptiest sequence gives its pieces away: one piece moves into a gap,
or changes places with one or two shorter ones of another sequence, or two of its pieces change places with one. Each
such step adds to the sum of squared fills, so gaps gather in fewer sequences until these are empty, the count has reached
total / capacity, or no step is left. Sequences that still have a gap of more than one in ``OPEN_SHARE`` are opened again and
packed with those of other chunks, in at most ``ROUNDS`` rounds; full ones never move. ``sequences`` joins the ids.

Defined cases: null and empty texts are the end id alone; repeated rows and null ids are packed each for itself; texts of any
length are read in parts; an empty table gives no rows. Pieces of no length take a place without filling it. ``packed`` carries extra columns along,
but replaces sequence_id and offset.
"""

from __future__ import annotations

import os
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from struct import Struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from compindex.llm.bpe import load
from compindex.session import cut_lineage

CAPACITY = 2048
END_ID = 0
# Pieces packed together: bounds a task's memory.
CHUNK = 100_000
ROUNDS = 3
OPEN_SHARE = 100
# Effort of the exchanges of one chunk: steps, and other sequences that one step looks at.
STEPS, LOOKED_AT = 2_000, 1_000
# Words remembered per worker, twice: bounds its memory, not the result.
REMEMBERED = 800_000
# Characters split into words at once.
PART = 1_000_000
# Bytes of ids in one batch of pieces.
BATCH_BYTES = 8_000_000


class Encoder:
    """The library's tokenizer, asked once per word: no token of it crosses a space or a line feed."""

    def __init__(self, content: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.packer = lru_cache(1_000)(lambda n: Struct(f"<{n}I"))
        self.recent: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _word(self, word: str) -> bytes:
        found = self.recent.get(word)
        if found is None:
            found = self.older.get(word)
            if found is None:
                found = self.packer(len(ids := self.tokenizer.encode(word, add_special_tokens=False).ids)).pack(*ids)
            if len(word) <= 100:
                if len(self.recent) >= REMEMBERED:
                    self.older, self.recent = self.recent, {}
                self.recent[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit numbers."""
        parts, at, text = [], 0, (text or "").replace("\n", " ")
        while at < len(text):
            end = text.find(" ", at + PART)
            end = len(text) if end < 0 else end
            words = text[at:end].split(" ")
            found = list(map(self.recent.get, words))
            for place in [k for k, ids in enumerate(found) if ids is None]:
                found[place] = self._word(words[place])
            parts.append(b"".join(found))
            at = end
        return b"".join(parts)


_LOADED: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """Built once per worker process."""
    key = hash(shared.value)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Encoder(shared.value)
    return _LOADED[key]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every row of ``docs`` (doc_id, text); ids are little-endian unsigned 32-bit numbers."""
    shared = load(docs, path)
    end_id = END_ID.to_bytes(4, "little")
    names = ["doc_id", "piece", "start", "length", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

        for batch in batches:
            rows, size = [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end_id
                for start in range(0, len(ids), 4 * capacity):
                    part = ids[start : start + 4 * capacity]
                    rows.append((doc_id, start // (4 * capacity), start // 4, len(part) // 4, part))
                    size += len(part)
                    if size > BATCH_BYTES:
                        yield batch_of(rows)
                        rows, size = [], 0
            if rows:
                yield batch_of(rows)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Places of ``lengths`` by sequence: longest first, each into the fullest sequence that has room."""
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for at in np.argsort(-np.array(lengths, np.int64), kind="stable").tolist():
        length = lengths[at]
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            chosen = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[chosen].append(at)
        else:
            room, chosen = capacity, len(bins)
            bins.append([at])
        room -= length
        by_room[room].append(chosen)
        rooms |= 1 << room
    return bins


class Sequence:
    """Pieces of one sequence in the order of their lengths."""

    def __init__(self, members: list[int], lengths: list[int]) -> None:
        self.members = sorted(members, key=lengths.__getitem__)
        self.sizes = [lengths[m] for m in self.members]
        self.fill = sum(self.sizes)

    def take(self, at: int) -> tuple[int, int]:
        size = self.sizes.pop(at)
        self.fill -= size
        return self.members.pop(at), size

    def put(self, member: int, size: int) -> None:
        at = bisect_left(self.sizes, size)
        self.sizes.insert(at, size)
        self.members.insert(at, member)
        self.fill += size


def two_at_least(sizes: list[int], least: int, below: int) -> tuple[int, int, int] | None:
    """(sum, i, j) of the two sizes with the smallest sum from ``least`` on, if it is smaller than ``below``."""
    i, j, best = 0, len(sizes) - 1, None
    while i < j:
        both = sizes[i] + sizes[j]
        if both < least:
            i += 1
        else:
            if both < below and (best is None or both < best[0]):
                best = both, i, j
            j -= 1
    return best


def exchange(donor: Sequence, others: list[Sequence], capacity: int) -> bool:
    """The step that fills another sequence most: a move, or an exchange of one for one, one for two or two for one.

    The donor is the emptiest sequence, so whatever moves to another adds to the sum of squared fills.
    """
    best: tuple[int, Sequence, tuple[int, ...], tuple[int, ...]] | None = None
    for other in others:
        room = capacity - other.fill
        options = []
        at = bisect_left(donor.sizes, room + 1) - 1
        if at >= 0 and donor.sizes[at] > 0:
            options.append((donor.sizes[at], (at,), ()))
        for i, size in enumerate(donor.sizes):
            k = bisect_left(other.sizes, size - room)
            if k < len(other.sizes) and other.sizes[k] < size:
                options.append((size - other.sizes[k], (i,), (k,)))
            two = two_at_least(other.sizes, size - room, size)
            if two:
                options.append((size - two[0], (i,), two[1:]))
        for k, size in enumerate(other.sizes):
            two = two_at_most(donor.sizes, size + room, size)
            if two:
                options.append((two[0] - size, two[1:], (k,)))
        for gain, given, taken in options:
            if best is None or gain > best[0]:
                best = gain, other, given, taken
        if best and best[0] == room:
            break
    if best is None:
        return False
    _, other, given, taken = best
    out = [donor.take(at) for at in sorted(given, reverse=True)]
    back = [other.take(at) for at in sorted(taken, reverse=True)]
    for member, size in out:
        other.put(member, size)
    for member, size in back:
        donor.put(member, size)
    return True


def two_at_most(sizes: list[int], most: int, above: int) -> tuple[int, int, int] | None:
    """(sum, i, j) of the two sizes with the largest sum up to ``most``, if it is larger than ``above``."""
    i, j, best = 0, len(sizes) - 1, None
    while i < j:
        both = sizes[i] + sizes[j]
        if both > most:
            j -= 1
        else:
            if both > above and (best is None or both > best[0]):
                best = both, i, j
            i += 1
    return best


def improved(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """``bins`` after exchanges between the sequences that are not full."""
    least = -(-sum(lengths) // capacity)
    made = [Sequence(b, lengths) for b in bins]
    full = [s for s in made if s.fill == capacity]
    gaps = sorted((s for s in made if s.fill < capacity), key=lambda s: s.fill)
    stuck: set[int] = set()
    for _ in range(STEPS):
        donor = next((s for s in gaps if id(s) not in stuck), None)
        if donor is None or len(gaps) < 2 or (stuck and len(full) + len(gaps) <= least):
            break
        if not exchange(donor, [s for s in gaps if s is not donor and s.fill >= donor.fill][-LOOKED_AT:][::-1], capacity):
            stuck.add(id(donor))
            continue
        full += [s for s in gaps if s.fill == capacity]
        if not donor.sizes:
            stuck.clear()
        gaps = sorted((s for s in gaps if s.fill < capacity and s.sizes), key=lambda s: s.fill)
    return [s.members for s in full + gaps]


def packed(table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``table`` (a column ``length`` of at most ``capacity``, and any others) with sequence_id and offset."""
    names = [c for c in table.columns if c not in ("sequence_id", "offset")]
    table, out = cut_lineage(table.select(names)), None
    is_open = "is_open" + "_" * sum(map(len, names))  # no column has this name
    schema = T.StructType([*table.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()), T.StructField(is_open, T.BooleanType())])
    for round_no in range(ROUNDS):
        last = round_no == ROUNDS - 1
        if round_no:
            rows = table.count()
            if not rows:
                break
            chunks = -(-rows // CHUNK)
            last = last or chunks == 1
            table = table.repartition(chunks)
        done = cut_lineage(table.mapInArrow(_packer(round_no, last, capacity, names.index("length"), is_open), schema))
        kept = done.where(~F.col(is_open)).drop(is_open)
        out = kept if out is None else out.unionByName(kept)
        if last:
            break
        table = done.where(F.col(is_open)).select(names)
    return out


def _packer(round_no: int, last: bool, capacity: int, length_at: int, is_open: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = (round_no << 56) + (TaskContext.get().partitionId() << 32)
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                if waiting and sum(b.num_rows for b in waiting) + part.num_rows > CHUNK:
                    done, first = _chunk(waiting, first, last, capacity, length_at, is_open)
                    yield from done
                    waiting = []
                waiting.append(part)
        if waiting:
            yield from _chunk(waiting, first, last, capacity, length_at, is_open)[0]

    return run


def _chunk(batches: list[pa.RecordBatch], first: int, last: bool, capacity: int, length_at: int, flag: str) -> tuple[list[pa.RecordBatch], int]:
    """The rows of a chunk with sequence, place and whether the sequence is open; the next free sequence number."""
    lengths = [n for b in batches for n in b.column(length_at).to_pylist()]
    bins = improved(best_fit(lengths, capacity), lengths, capacity)
    sequence, offset, is_open = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), bool)
    for number, members in enumerate(bins, first):
        at = 0
        for m in members:
            sequence[m], offset[m] = number, at
            at += lengths[m]
        is_open[members] = not last and (capacity - at) * OPEN_SHARE > capacity
    out, at = [], 0
    for b in batches:
        part = slice(at, at + b.num_rows)
        columns = [*b.columns, pa.array(sequence[part]), pa.array(offset[part]), pa.array(is_open[part])]
        out.append(pa.RecordBatch.from_arrays(columns, [*b.schema.names, "sequence_id", "offset", flag]))
        at += b.num_rows
    return out, first + len(bins)


def sequences(placed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the joined ids of every sequence of ``placed`` (sequence_id, offset, length, ids)."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate("parts", F.lit("").cast("binary"), lambda a, p: F.concat(a, p["ids"]))
    return placed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", (F.length(joined) / 4).cast("long").alias("n_tokens"), joined.alias("ids"))
