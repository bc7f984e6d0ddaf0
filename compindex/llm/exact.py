"""Exact duplicates by composable polynomial fingerprints, confirmed chunk by chunk.

A text's bytes are read as 4-byte symbols and hashed as a polynomial modulo three primes. A chunk's hash is
independent of all other chunks, and hash(xy) = hash(x) * base^len(y) + hash(y), so the chunks of a huge
document are hashed side by side and combined afterwards. Texts with equal fingerprints and lengths are then
compared chunk by chunk: the distinct contents of each chunk number are counted, which collapses copies on
the map side, however large their group. Should two texts ever collide, their rows are grouped by whole text.

Null counts as the empty text. Of equal texts the row with the largest doc_id stays; of repeated doc_ids with
equal texts none is told from the others, so all carry kept = true when the id is the largest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from compindex.llm.common import let_go, lookup, text_bytes
from compindex.session import cut_lineage

# Primes below 2^31 and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1664525, 22695477)
SYMBOL = 4
CHUNK_SYMBOLS = 4096
COMPARE_BYTES = 1 << 16
FILTER_BITS = 23
KEY = ["h0", "h1", "h2", "n_bytes"]


def powers(base: int, prime: int, count: int) -> np.ndarray:
    """base^(count-1) .. base^0 modulo prime."""
    out = [1]
    for _ in range(count - 1):
        out.append(out[-1] * base % prime)
    return np.array(out[::-1], np.uint64)


_TABLES = [powers(b, p, CHUNK_SYMBOLS) for b, p in zip(BASES, PRIMES)]


def symbols(data: bytes) -> np.ndarray:
    """The bytes as 4-byte symbols, zero-padded at the end (the byte length tells padding from content)."""
    return np.frombuffer(data + b"\0" * (-len(data) % SYMBOL), "<u4").astype(np.uint64)


def chunk_hashes(values: np.ndarray, index: int) -> tuple[np.ndarray, int]:
    """Hashes of all full chunks at once, and of the shorter last one."""
    prime, table = np.uint64(PRIMES[index]), _TABLES[index]
    full = values[: len(values) // CHUNK_SYMBOLS * CHUNK_SYMBOLS].reshape(-1, CHUNK_SYMBOLS)
    tail = values[full.size :]
    # symbol (< 2^32) times power (< 2^31) stays below 2^63, and 4,096 remainders below 2^43
    hashes = (full * table % prime).sum(axis=1) % prime
    last = (tail * table[CHUNK_SYMBOLS - len(tail) :] % prime).sum() % prime if len(tail) else 0
    return hashes, int(last)


def combine(left: int, right: int, right_symbols: int, index: int) -> int:
    """Hash of a concatenation from the hashes of its parts: the left one is shifted by the right one's length."""
    prime = PRIMES[index]
    return (left * pow(BASES[index], right_symbols, prime) + right) % prime


def polynomial(data: bytes) -> tuple[int, ...]:
    """Fingerprint of one text modulo each prime."""
    values, out = symbols(data), []
    for index in range(len(PRIMES)):
        hashes, last = chunk_hashes(values, index)
        total = 0
        for h in hashes:
            total = combine(total, int(h), CHUNK_SYMBOLS, index)
        out.append(combine(total, last, len(values) % CHUNK_SYMBOLS, index))
    return tuple(out)


def with_fingerprint(docs: DataFrame, data: str, only: np.ndarray | None = None) -> DataFrame:
    """``docs`` with h0, h1, h2 and n_bytes of the binary column ``data``; the text itself stays in the JVM.

    With the bit map ``only``, texts whose h0 is not in it are left out.
    """
    shared = None if only is None else docs.sparkSession.sparkContext.broadcast(only)

    def hashed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            rows = pd.DataFrame([polynomial(d) for d in batch], columns=KEY[:3], dtype="int64")
            if shared is not None:
                rows.loc[~in_map(shared.value, rows["h0"].to_numpy(np.uint64)), "h0"] = -1
            yield rows

    udf = F.pandas_udf(hashed, "h0 long, h1 long, h2 long")
    out = docs.withColumn("_h", udf(F.col(data))).select("*", "_h.*", F.octet_length(data).cast("long").alias("n_bytes")).drop("_h")
    return out if only is None else out.where("h0 >= 0")


def collided(texts: DataFrame) -> DataFrame:
    """Fingerprints that stand for more than one text: their texts differ in some chunk.

    ``texts`` has the key and ``data``. Chunk k of all texts with one fingerprint is grouped by content; copies
    become one row per task before they move.
    """
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_bytes") - 1, F.lit(0)), F.lit(COMPARE_BYTES).cast("long"))
    pieces = texts.select(*KEY, "data", F.explode(starts).alias("at")).select(
        *KEY, "at", F.expr(f"substring(data, cast(at as int) + 1, {COMPARE_BYTES})").alias("piece")
    )
    contents = pieces.groupBy(*KEY, "at", "piece").agg(F.count(F.lit(1)).alias("n"))
    return contents.groupBy(*KEY, "at").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select(*KEY).distinct()


def bit_map(keys: DataFrame, column: str, bits: int) -> np.ndarray:
    """Bit map, eight bits a byte, of the values of a column modulo 2^bits: 2^bits bits whatever the input.

    It spares rows without a partner the way through the shuffle; a false hit costs time, nothing else.
    """
    slot = F.pmod(column, F.lit(1 << bits)) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bitmap"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in maps.collect():  # 2^bits / 32,768 rows of 4 KB at most
        own = np.frombuffer(bytes(row["bitmap"]), np.uint8)[: out.size]
        out[(row["bucket"] - 1) * own.size :][: own.size] = own
    return out


def in_map(bit_map: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether unsigned values are in a bit map; the map stays packed, as every task holds it."""
    slot = values % np.uint64(8 * bit_map.size)
    return bit_map[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & np.uint8(1) == 1


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row of ``docs`` (doc_id, text)."""
    texts = docs.select("doc_id", F.coalesce(text_bytes(), F.lit(b"")).alias("data"))
    marked = cut_lineage(with_fingerprint(texts.withColumn("text_sha256", F.sha2("data", 256)), "data").drop("data"))
    groups = cut_lineage(marked.groupBy(*KEY).agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    clashes = cut_lineage(collided(with_fingerprint(texts, "data", bit_map(groups.where("group_size > 1"), "h0", FILTER_BITS))))
    clean = lookup(marked, groups, KEY)
    if not clashes.isEmpty():
        whole = with_fingerprint(texts.withColumn("text_sha256", F.sha2("data", 256)), "data").join(clashes, KEY, "left_semi")
        exact = whole.groupBy("data").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        clean = clean.join(clashes, KEY, "left_anti").unionByName(whole.join(exact, "data").select(clean.columns))
    return clean.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256"
    )
