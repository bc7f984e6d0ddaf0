"""Seeded noise from integer arithmetic, so that any engine can repeat it.

Values depend only on (draw, key, stream): reruns, retries and partitioning cannot change them.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Modulus (2^31 - 1) and multipliers of the mixing rounds.
MODULUS = 2147483647
KEY_STEP, DRAW_STEP, STREAM_STEP = 7919, 104729, 15485863
MULTIPLIER, INCREMENT = 48271, 12345


def mixed(draw: Column, key: Column, stream: int) -> Column:
    """Integer in [0, 2^31 - 1): linear start, then two squaring rounds with linear steps between."""
    bigint = lambda c: c.cast("bigint")
    start = (bigint(key) % MODULUS * KEY_STEP + bigint(draw) * DRAW_STEP + stream * STREAM_STEP) % MODULUS
    first = (start * start + (stream + 1) * MULTIPLIER) % MODULUS
    second = (first * MULTIPLIER + bigint(draw) * INCREMENT + stream) % MODULUS
    third = (second * second + bigint(key) % MODULUS) % MODULUS
    return (third * MULTIPLIER + INCREMENT) % MODULUS


def text_number(key: Column) -> Column:
    """Integer of a text key: 32 bits of its SHA-256, which other engines can repeat."""
    return F.conv(F.substring(F.sha2(key.cast("string").cast("binary"), 256), 1, 8), 16, 10).cast("bigint")


def text_number_sql(key: str) -> str:
    return f"CAST('0x' || substr(sha256({key}), 1, 8) AS BIGINT)"


def uniform(draw: Column, key: Column, stream: int) -> Column:
    return (mixed(draw, key, stream).cast("double") + 0.5) / F.lit(float(MODULUS))


def normal(draw: Column, key: Column, stream: int) -> Column:
    """Standard normal by Box-Muller over two streams."""
    radius = F.sqrt(-2.0 * F.log(uniform(draw, key, stream)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(draw, key, stream + 1))


def mixed_array(draw: int, key: np.ndarray, stream: int) -> np.ndarray:
    """``mixed`` of many keys inside a task; remainders keep the sign of the dividend, as in SQL."""
    key = np.fmod(key.astype(np.int64), MODULUS)
    start = np.fmod(key * KEY_STEP + draw * DRAW_STEP + stream * STREAM_STEP, MODULUS)
    first = np.fmod(start * start + (stream + 1) * MULTIPLIER, MODULUS)
    second = np.fmod(first * MULTIPLIER + draw * INCREMENT + stream, MODULUS)
    third = np.fmod(second * second + key, MODULUS)
    return np.fmod(third * MULTIPLIER + INCREMENT, MODULUS)


def uniform_array(draw: int, key: np.ndarray, stream: int) -> np.ndarray:
    return (mixed_array(draw, key, stream).astype(float) + 0.5) / float(MODULUS)


def normal_array(draw: int, key: np.ndarray, stream: int) -> np.ndarray:
    return np.sqrt(-2.0 * np.log(uniform_array(draw, key, stream))) * np.cos(2.0 * math.pi * uniform_array(draw, key, stream + 1))


def mixed_sql(draw: str, key: str, stream: int) -> str:
    """The same integer as SQL text."""
    d, k = f"CAST({draw} AS BIGINT)", f"CAST({key} AS BIGINT)"
    start = f"(({k} % {MODULUS} * {KEY_STEP} + {d} * {DRAW_STEP} + {stream * STREAM_STEP}) % {MODULUS})"
    first = f"(({start} * {start} + {(stream + 1) * MULTIPLIER}) % {MODULUS})"
    second = f"(({first} * {MULTIPLIER} + {d} * {INCREMENT} + {stream}) % {MODULUS})"
    third = f"(({second} * {second} + {k} % {MODULUS}) % {MODULUS})"
    return f"(({third} * {MULTIPLIER} + {INCREMENT}) % {MODULUS})"


def uniform_sql(draw: str, key: str, stream: int) -> str:
    return f"((CAST({mixed_sql(draw, key, stream)} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({MODULUS} AS DOUBLE))"


def normal_sql(draw: str, key: str, stream: int) -> str:
    two_pi = repr(2.0 * math.pi)
    return (
        f"(sqrt(CAST(-2.0 AS DOUBLE) * ln({uniform_sql(draw, key, stream)}))"
        f" * cos(CAST({two_pi} AS DOUBLE) * {uniform_sql(draw, key, stream + 1)}))"
    )
