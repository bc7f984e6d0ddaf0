"""Byte-pair encoding with a segment tree over the ranks of adjacent pairs, and decoding.

A piece of text starts as one symbol per byte, the last one carrying the end-of-word mark. The leaves of the
tree are the merge ranks of neighbouring symbols, each above its place, and an inner node holds the smallest leaf
below it, so the root names the leftmost merge of lowest rank. A merge changes three leaves, each in logarithmic
time, until the root holds none.

The vocabulary file is read by the driver and broadcast (a few MB, whatever the corpus). Special tokens
in a text become their ids, as in the library. Null counts as empty: no ids, empty decoded text.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compindex.llm.common import carried_id, kept, returned

# Fixed values of the vocabulary's text rules: white space, and the pieces that the merges work on.
BLANK = r"\x09-\x0D\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{BLANK}\p{{L}}\p{{N}}]+"
END = "</w>"
ID_BITS = 20
# Pieces remembered per worker, twice: bounds its memory, not the result.
REMEMBERED = 250_000
# Characters or ids that are worked on at once.
PIECE = 1_000_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def build_tree(leaves: list[int], nothing: int) -> tuple[list[int], int]:
    """Segment tree of minima as a flat list (root at 1), and the place of the first leaf."""
    width = 1 << (len(leaves) - 1).bit_length() if leaves else 1
    low = [nothing] * width + leaves + [nothing] * (width - len(leaves))
    for k in range(width - 1, 0, -1):
        left, right = low[2 * k], low[2 * k + 1]
        low[k] = left if left < right else right
    return low, width


def put(low: list[int], k: int, leaf: int) -> None:
    """Point update: the path to the root, as far as its minima change."""
    if low[k] == leaf:
        return
    low[k] = leaf
    k >>= 1
    while k:
        left, right = low[2 * k], low[2 * k + 1]
        best = left if left < right else right
        if low[k] == best:
            return
        low[k] = best
        k >>= 1


class Vocabulary:
    """Ids, merges and special tokens of a tokenizer file, and the pieces met so far."""

    def __init__(self, content: str) -> None:
        spec = json.loads(content)
        self.ids: dict[str, int] = spec["model"]["vocab"]
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (self.ids | self.specials).items()}
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.ranks = {self.ids[a] << ID_BITS | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]
        letters = byte_letters()
        self.inner = [self.ids[c] for c in letters]
        self.final = [self.ids[c + END] for c in letters]
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.pieces = regex.compile(PIECES)
        self.recent: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def merged(self, piece: str) -> tuple[int, ...]:
        """Ids of one piece. A leaf holds a pair's rank above its place, so the root names the next merge in full."""
        raw, rank_of, made = piece.encode(), self.ranks.get, self.made
        symbols = [self.inner[b] for b in raw]
        symbols[-1] = self.final[raw[-1]]
        n = len(symbols)
        shift = n.bit_length()
        places, nothing, leaves, first = (1 << shift) - 1, len(made) << shift, [], symbols[0]
        for i in range(1, n):
            second = symbols[i]
            rank = rank_of(first << ID_BITS | second)
            leaves.append(nothing if rank is None else rank << shift | i - 1)
            first = second
        low, width = build_tree(leaves, nothing)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while (top := low[1]) < nothing:
            at = top & places
            gone = after[at]
            symbols[at] = new = made[top >> shift]
            symbols[gone] = -1
            after[at] = then = after[gone]
            rank = None
            if then < n:
                put(low, width + gone, nothing)
                before[then] = at
                rank = rank_of(new << ID_BITS | symbols[then])
            put(low, width + at, nothing if rank is None else rank << shift | at)
            left = before[at]
            if left >= 0:
                rank = rank_of(symbols[left] << ID_BITS | new)
                put(low, width + left, nothing if rank is None else rank << shift | left)
        return tuple([s for s in symbols if s >= 0])

    def _met(self, piece: str) -> tuple[int, ...]:
        """Ids of a piece that is not among the recent ones; the older half is kept until the next turn."""
        ids = self.older.get(piece) or self.merged(piece)
        if len(piece) <= 100:
            if len(self.recent) >= REMEMBERED:
                self.older, self.recent = self.recent, {}
            self.recent[piece] = ids
        return ids

    def _plain(self, text: str, out: list[int]) -> None:
        text = unicodedata.normalize("NFC", text)
        # letter by letter: the whole-text rule for a final sigma does not apply
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        cut, extend = self.pieces.findall, out.extend
        # no piece crosses a space or a line feed; most tokens are one piece, met before
        for token in text.replace("\n", " ").split(" "):
            ids = self.recent.get(token)
            if ids is None:
                for piece in cut(token):
                    extend(self.recent.get(piece) or self._met(piece))
            else:
                extend(ids)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.specials:
                out.append(self.specials[part])
            elif part:
                self._plain(part, out)
        return out

    def decode(self, ids) -> str:
        """The tokens, joined by spaces: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, ids))


def _vocabulary(shared) -> Vocabulary:
    """Parsed once per worker process, as long as its tasks are of this kind."""
    return kept("bpe", hash(shared.value), lambda: Vocabulary(shared.value))


def default_path(name: str = "word_bpe_49k.json") -> str:
    """Where the installed public vocabulary lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def load(docs: DataFrame, path: str):
    """The tokenizer file at ``path`` (on the driver), broadcast."""
    with open(path, encoding="utf-8") as file:
        return docs.sparkSession.sparkContext.broadcast(file.read())


def _in_pieces(batches: Iterator[pd.DataFrame], column: str) -> Iterator[pd.DataFrame]:
    """Batches cut so that what is made of one piece stays small: up to ``PIECE`` units, or one row."""
    for batch in batches:
        ends = batch[column].map(lambda v: 0 if v is None else len(v)).cumsum() // PIECE
        for _, piece in batch.groupby(ends.to_numpy(), sort=False):
            yield piece


def encode(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, ids) of every row of ``docs`` (doc_id, text)."""
    return round_trip(docs, shared).select("doc_id", "ids")


def decode(encoded: DataFrame, shared) -> DataFrame:
    """(doc_id, decoded): the text of the column ``ids``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _vocabulary(shared)
        for piece in _in_pieces(batches, "ids"):
            yield pd.DataFrame({"doc_id": piece["doc_id"], "decoded": [words.decode(ids) for ids in piece["ids"]]})

    return returned(encoded.select(carried_id(), "ids").mapInPandas(run, "doc_id long, decoded string"))


def round_trip(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs`` (doc_id, text): the ids, and the text decoded from them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = _vocabulary(shared)
        for piece in _in_pieces(batches, "text"):
            ids = [np.array(words.encode(t), np.int32) for t in piece["text"]]
            yield pd.DataFrame({"doc_id": piece["doc_id"], "ids": ids, "decoded": [words.decode(i.tolist()) for i in ids]})

    return returned(docs.select(carried_id(), "text").mapInPandas(run, "doc_id long, ids array<int>, decoded string"))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    return round_trip(docs, load(docs, path)).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
