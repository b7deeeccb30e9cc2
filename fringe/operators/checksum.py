"""Checksums of binary data: the ones' complement sum of 32-bit words, and its algebra.

A sum takes in 32-bit big-endian words; carries are added back in. Its parts may be summed apart and in any
order, wherever they are cut, if the place of each is known: a byte counts by its place modulo four. A part that
changes is taken off and its successor added, without reading the rest. Zero and all ones are the same sum;
all ones stands for it in what verifies.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

ONES = 0xFFFFFFFF


@F.arrow_udf(LongType())
def _sums(data: pa.Array, place: pa.Array) -> pa.Array:
    """Folded sums of binary values at their places."""
    out = []
    for block, at in zip(data, place.to_pylist(), strict=True):
        if not block.is_valid:
            out.append(None)
            continue
        before = at % 4
        bytes_ = b"\0" * before + block.as_buffer().to_pybytes()
        total = int(np.frombuffer(bytes_ + b"\0" * (-len(bytes_) % 4), ">u4").sum(dtype=np.uint64))
        while total > ONES:
            total = (total & ONES) + (total >> 32)
        out.append(total)
    return pa.array(out, pa.int64())


def block_sum(data: Column, place: Column | int = 0) -> Column:
    """A block's sum, folded to 32 bits, where its first byte is at ``place`` of the whole; null of a null."""
    return _sums(data, (place if isinstance(place, Column) else F.lit(place)).cast("long"))


def fold(total: Column) -> Column:
    """Carries above 32 bits added back in, until none is left."""
    for _ in range(3):
        total = total.bitwiseAND(F.lit(ONES)) + F.shiftrightunsigned(total, 32)
    return total


def add(a: Column, b: Column) -> Column:
    return fold(a + b)


def subtract(a: Column, b: Column) -> Column:
    """The sum without a part of it."""
    return fold(a + (F.lit(ONES) - b))


def same(a: Column, b: Column) -> Column:
    """Whether two sums are equal, zero and all ones being one."""
    return a % ONES == b % ONES


def checksum(blocks: DataFrame, data: str = "data", keys: Sequence[str] = (), place: str | None = None) -> DataFrame:
    """``keys, checksum`` of all blocks. Without ``place`` each block is whole words of its own, filled up with zero bytes."""
    total = fold(F.coalesce(F.sum(block_sum(F.col(data), F.col(place) if place else 0)), F.lit(0))).alias("checksum")
    return blocks.groupBy(*keys).agg(total) if keys else blocks.agg(total)


def updated(sums: DataFrame, changes: DataFrame, keys: Sequence[str], place: str = "place", old: str = "old", new: str = "new") -> DataFrame:
    """``sums`` (keys, checksum) after ``changes`` (keys, place, old, new): each takes off what was at a place and adds what is there now.

    A null ``old`` is a block that is added, a null ``new`` one that goes. Keys without changes keep their sum; changes of keys
    that have none begin at zero.
    """
    off = F.coalesce(block_sum(F.col(old), F.col(place)), F.lit(0))
    on = F.coalesce(block_sum(F.col(new), F.col(place)), F.lit(0))
    moved = changes.groupBy(*keys).agg(fold(F.sum(on)).alias("on"), fold(F.sum(off)).alias("off"))
    met = sums.join(moved, list(keys), "full")
    now = F.coalesce("checksum", F.lit(0))
    return met.select(*keys, F.when(F.col("on").isNull(), now).otherwise(subtract(add(now, F.coalesce("on", F.lit(0))), F.coalesce("off", F.lit(0)))).alias("checksum"))


def _quarters() -> str:
    """For each byte four letters or digits that add up to it and four times ``0``, without punctuation: each pair moves apart until neither is any."""
    out = []
    for byte in range(256):
        share = [byte // 4 + 48] * 4
        share[0] += byte % 4
        for a, b in ((0, 1), (2, 3)):
            while not (chr(share[a]).isalnum() and chr(share[b]).isalnum()):
                share[a], share[b] = share[a] + 1, share[b] - 1
        out.append("".join(map(chr, share)))
    return "".join(out)


def to_text(total: Column, complement: bool = True) -> Column:
    """Sixteen letters and digits that stand for a sum, or for its complement, which makes a sum with it all ones."""
    value = F.lit(ONES) - total if complement else total
    bytes_ = [F.shiftrightunsigned(value, 24 - 8 * i).bitwiseAND(F.lit(255)).cast("int") for i in range(4)]
    letters = [F.substring(F.lit(_quarters()), 4 * b + 1 + j, F.lit(1)) for j in range(4) for b in bytes_]
    return F.concat(letters[-1], *letters[:-1])


def from_text(text: Column, complement: bool = True) -> Column:
    """The sum that ``to_text`` has written; null of a text of another length."""
    turned = F.concat(F.substring(text, 2, 15), F.substring(text, 1, 1))
    words = [F.lit(0).cast("long")]
    for k in range(16):
        words.append((F.ascii(F.substring(turned, k + 1, 1)) - 48).cast("long") * 256 ** (3 - k % 4))
    total = words[0]
    for w in words[1:]:
        total = total + w
    total = fold(total)
    return F.when(F.length(text) == 16, F.lit(ONES) - total if complement else total)


def verified(blocks: DataFrame, keys: Sequence[str], data: str = "data", place: str = "place") -> DataFrame:
    """``keys, ok``: whether all blocks of a whole, its checksum's text among them, add up to all ones (or to nothing at all)."""
    return checksum(blocks, data, keys, place).select(*keys, (F.col("checksum") % ONES == 0).alias("ok"))
