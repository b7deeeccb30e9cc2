"""A set of 64-bit hashes as a bitmap of fixed size, for passing over rows that can't match before they are shuffled."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: First bits of a hash that address the bitmap: 8 MB, however many hashes there are.
BITS = 26


class Bitmap:
    """Broadcast to all tasks; ``holds`` may be true for hashes that aren't in the set, and the more so the more there are, but never false for one that is."""

    def __init__(self, hashes: DataFrame):
        """``hashes`` has a column ``hash``; at most 2^BITS / 64 rows of 64 bits reach the driver."""
        place = F.shiftrightunsigned("hash", 64 - BITS)
        bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - BITS}) % 64 as int))")
        words = hashes.select((place / 64).cast("int").alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
        bits = np.zeros(1 << (BITS - 6), np.int64)
        bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
        self._bits = hashes.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes.view(np.uint64) >> np.uint64(64 - BITS)
        return (self._bits.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0
