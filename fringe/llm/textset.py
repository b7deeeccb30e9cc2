"""Word shingles of whole texts as sets of 64-bit hashes, for a batch of texts at once in numpy.

Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. In UTF-8 those separators are single bytes, so a
batch is one byte array and every step below is a pass over it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Characters of search terms: ASCII letters and digits, and every byte of a character beyond ASCII.
IS_TERM = np.array([i >= 128 or chr(i).isalnum() for i in range(256)])
_BYTE = _BYTE[_LOWER]
_TERM_BYTE = np.where(IS_TERM, _BYTE, np.uint64(0))
_BYTE[IS_SPACE] = 0
_BASE = np.uint64(0x9E3779B97F4A7C15)
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def lowered(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z as a-z."""
    return _LOWER[data]


_tables = [np.zeros(0, np.uint64)] * 2


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse by 2^64: a word's polynomial, whatever its place. One table serves all sizes."""
    if len(_tables[0]) < size:
        length, base = 1 << max(16, (size - 1).bit_length()), int(_BASE)
        _tables[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(length - 1, x, np.uint64)))) for x in (base, pow(base, -1, 2**64))]
    return _tables[0][:size], _tables[1][:size]


def span_hashes(data: np.ndarray, starts: np.ndarray, table: np.ndarray = _BYTE) -> np.ndarray:
    """A hash of the word at each start (its bytes up to a separator, whose value in ``table`` is 0, or the next start), ASCII upper case as lower."""
    power, inverse = _powers(len(data))
    return mix(np.add.reduceat(table[data] * power, starts) * inverse[starts])


def term_hashes(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """As ``word_hashes``, for maximal runs of ``IS_TERM`` bytes."""
    return word_hashes(texts, ~IS_TERM, _TERM_BYTE)


def word_hashes(texts: Sequence[str | None], separator: np.ndarray = IS_SPACE, table: np.ndarray = _BYTE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and where each text's words begin (len(texts) + 1 offsets)."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(parts) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(p) + 1 for p in parts]) if parts else np.zeros(0, np.int64)
    space = separator[data]
    starts = np.flatnonzero(~space & np.concatenate(([True], space[:-1])))
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(parts) + 1, np.int64)
    return span_hashes(data, starts, table), np.searchsorted(starts, np.concatenate(([0], ends)))


def shingle_sets(texts: Sequence[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles.

    A text of fewer words is one shingle of all its words; a null or wordless text has the empty set.
    """
    words, at = word_hashes(texts)
    if not len(words):
        return [np.zeros(0, np.uint64)] * len(texts)
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for j in range(width):
        rolled += words[j : j + len(rolled)] * _STEP[j]
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = words[a:b]
            out.append(mix(np.array([np.sum(short * _STEP[: len(short)], dtype=np.uint64) + np.uint64(b - a)])))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
