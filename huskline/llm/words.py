"""Words of whole texts as 64-bit hashes, made by array operations on the texts' bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, with A-Z lower-cased.  Its hash is a polynomial
over random 64-bit values of its bytes, then mixed; it does not depend on the process or the machine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at once; a longer text is handled alone.
STEP = 1 << 19
_rng = np.random.default_rng(20_240_229)
_BASE = int(_rng.integers(1 << 62, dtype=np.int64)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = _rng.integers(1 << 63, size=256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_VALUES[ord("A") : ord("Z") + 1] = _VALUES[ord("a") : ord("z") + 1]
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, STEP) + 1
        for i, b in enumerate((_BASE, _INVERSE)):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            _powers[i] = np.cumprod(factors)
    return _powers


def mixed(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashes(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Parts of the column, in order: first row, hashes of the rows' words, number of words of each row.

    texts: a string column without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        upto = max(row + 1, int(np.searchsorted(ends, ends[row] + STEP, "right")) - 1)
        yield row, *_part(raw[ends[row] : ends[upto]], ends[row : upto + 1] - ends[row])
        row = upto


def _part(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(ends) - 1, np.int64)
    inside = ~_BLANK[raw]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = ends[(ends > 0) & (ends < n)]
    before[edges], after[edges - 1] = False, False
    first, last = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after)
    power, back = _grown(n + 1)
    sums = np.cumsum(_VALUES[raw] * power[:n], dtype=np.uint64)
    total = sums[last] - np.where(first > 0, sums[np.maximum(first - 1, 0)], np.uint64(0))
    made = mixed(total * back[first] + (last - first).astype(np.uint64))
    return made, np.diff(np.searchsorted(first, ends))
