"""Tables of fixed size, built by all tasks, for testing rows during a scan.

A bitmap only lets too much through (a key that was not in it), never too
little, so what follows must be exact on its own.  Its size follows the counted
number of keys and ends at MAX_BITS; beyond that more rows pass, none is lost.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64 MB: the largest bitmap that is broadcast.
MAX_BITS = 1 << 29
MIN_BITS = 1 << 20
#: Bits for each key, so that one foreign key in a hundred passes.
BITS_PER_KEY = 128
_BLOCK = 1 << 15  # bits of one row of bitmap_construct_agg


class Bitmap:
    """Membership of 64-bit keys, by their low bits."""

    def __init__(self, packed: np.ndarray):
        self.packed = packed
        self.mask = np.uint64(len(packed) * 8 - 1)

    def test(self, keys: np.ndarray) -> np.ndarray:
        x = keys & self.mask
        return (self.packed[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 > 0


def bitmap(keys: DataFrame, col: str, n_keys: int | None = None) -> Broadcast:
    """A broadcast Bitmap of the (non-null) bigint column ``col``."""
    n = keys.count() if n_keys is None else n_keys
    bits = MIN_BITS
    while bits < min(MAX_BITS, BITS_PER_KEY * n):
        bits *= 2
    spot = F.col(col).bitwiseAND(F.lit(bits - 1)) + 1
    blocks = (keys.where(F.col(col).isNotNull())
              .groupBy(F.bitmap_bucket_number(spot).alias("b"))
              .agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m")))
    packed = np.zeros(bits // 8, np.uint8)
    size = _BLOCK // 8
    for r in blocks.toLocalIterator():
        at = (r["b"] - 1) * size
        packed[at : at + size] = np.frombuffer(bytes(r["m"]), np.uint8)[:size]
    return keys.sparkSession.sparkContext.broadcast(Bitmap(packed))


def signed(keys: np.ndarray) -> np.ndarray:
    """64-bit hashes as Spark's bigint."""
    return keys.view(np.int64)
