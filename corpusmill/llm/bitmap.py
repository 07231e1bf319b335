"""Sets of 64-bit keys as a broadcast bitmap of bounded size.

A key outside the set may be reported as in it, never the other way; beyond
MOST / 16 keys more are, and what follows must settle them exactly.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 128 KB and 64 MB.
LEAST, MOST = 1 << 20, 1 << 29
#: Bytes that bitmap_construct_agg makes for each of its buckets.
BUCKET = 4096


def bits_for(keys: int) -> int:
    """A power of two, 16 times the number of keys or more while that is not over MOST."""
    return min(MOST, max(LEAST, 1 << (16 * max(1, keys) - 1).bit_length()))


def bitmap(df: DataFrame, key: str, keys: int) -> bytes:
    """The bits of ``key`` modulo the size, which follows ``keys``, their number at most; gathered by bucket."""
    bits = bits_for(keys)
    bit = F.pmod(F.col(key), F.lit(bits)) + 1
    rows = df.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    whole = bytearray(bits // 8)
    for r in rows:
        whole[(r["k"] - 1) * BUCKET : r["k"] * BUCKET] = r["bits"]
    return bytes(whole)


def among(keys: np.ndarray, whole: bytes) -> np.ndarray:
    """Whether the bit of each int64 key is set."""
    at = np.asarray(keys, np.int64) % (len(whole) * 8)
    return (np.frombuffer(whole, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
