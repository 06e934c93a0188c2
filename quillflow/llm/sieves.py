"""Sieves: Bloom filters of a bounded size that are broadcast to tell most strangers from a set of keys.

A key has its bits in one 64-bit entry, so a look-up reads one entry. Keys are hashes.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bits of a sieve per key, and at most.
SIEVE_BITS, MAX_SIEVE_BITS = 16, 1 << 27
# Where a key's hash has the numbers of its bits; the entry's number lies between the first and the others.
_PLACES = (0, 28, 34, 40)


def sieve(keys: DataFrame) -> np.ndarray:
    """Bits by which ``passes`` tells most keys that aren't in ``keys`` (key); none of those in it."""
    wanted = SIEVE_BITS * keys.count()
    bits = min(max(64, 1 << max(0, wanted - 1).bit_length()), MAX_SIEVE_BITS)
    slot = F.col("key").bitwiseAND(F.lit(bits - 1))
    bit = F.expr(" | ".join(f"shiftleft(1L, cast(shiftright(key, {k}) & 63L AS int))" for k in _PLACES))
    rows = keys.select(F.shiftright(slot, 6).alias("at"), bit.alias("bit")).groupBy(
        "at").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows.column("at").to_numpy()] = rows.column("bits").to_numpy()
    return out


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    entry = bits[(keys & (len(bits) * 64 - 1)) >> 6]
    out = (entry >> (keys & 63)) & 1 == 1
    maybe = np.flatnonzero(out)
    for k in _PLACES[1:]:
        hit = (entry[maybe] >> ((keys[maybe] >> k) & 63)) & 1 == 1
        out[maybe[~hit]] = False
        maybe = maybe[hit]
    return out
