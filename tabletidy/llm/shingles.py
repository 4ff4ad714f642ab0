"""Word shingles of whole texts as 64-bit hashes, vectorised over a slice of rows.

Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case; a shingle is ``width``
consecutive words, and a text with fewer words has its whole word sequence as the only one.
Hashes are 64 bits wide: two different shingles agree with probability 2^-64.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64
#: Odd random constants (any would do; fixed so that all tasks agree).
_BYTE = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column (null as empty) and the offset of each, one more at the end."""
    column = pa.compute.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all rows, and the first word of each row (one more at the end).

    A word's hash is a polynomial in its letters: the difference of a running sum over the
    slice at its two ends, times the inverse power of its place, so it costs a few array
    operations a byte whatever the words.
    """
    data, offsets = text_bytes(column)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(column) + 1, np.int64)
    data = _LOWER[data]
    letter = ~_SPACE[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.concatenate([[False], letter[:-1]]) & ~cut[:-1]
    starts = np.flatnonzero(letter & ~before)
    after = np.concatenate([letter[1:], [False]]) & ~cut[1:]
    stops = np.flatnonzero(letter & ~after) + 1
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * _powers(len(data)), out=sums[1:])
    inverse = _U(pow(int(_BASE), -1, 1 << 64))
    back = np.full(len(data), inverse)
    back[0] = 1
    back = np.multiply.accumulate(back)
    words = mix((sums[stops] - sums[starts]) * back[starts] + (stops - starts).astype(np.uint64))
    return words, np.searchsorted(starts, offsets)


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct shingle hashes."""
    words, first = word_hashes(column)
    n = len(words)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    for k in range(width):
        rolled = mix(rolled + words[k : k + len(rolled)])
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for k in range(a, b):
                one = mix(one + words[k])
            out.append(mix(one + _U(b - a)))  # a short sequence is never a full shingle
        else:
            out.append(np.empty(0, np.uint64))
    return out
