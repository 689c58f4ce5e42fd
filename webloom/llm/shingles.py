"""Word shingles of whole texts as 64-bit hashes, computed with numpy over many texts at once.

A word is a run of bytes other than space and \\t..\\r; A-Z count as a-z. A text with fewer than k
words, but at least one, has its whole word sequence as its one shingle.
"""

from __future__ import annotations

import numpy as np

K = 5
_U = np.uint64
_BLOCK = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_COEF = _rng.integers(1, 2**63, 64, dtype=np.uint64) | _U(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_INV = pow(_BASE, -1, 2**64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: xor-shifts and odd multiplications."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(29))
    x = x * _U(0xA0761D6478BD642F)
    return x ^ (x >> _U(32))


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(_BLOCK, 1 << (n + 1).bit_length())
    if size not in _powers:
        out = []
        for base in (_BASE, _INV):
            p = np.full(size, base & (2**64 - 1), dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        if len(_powers) > 1:
            _powers.clear()
        _powers[size] = tuple(out)
    return _powers[size]


def word_hashes(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the words of a byte string, and a hash of each lower-cased word."""
    raw = np.frombuffer(joined, dtype=np.uint8)
    solid = np.empty(len(raw) + 2, dtype=np.int8)
    solid[0] = solid[-1] = 0
    solid[1:-1] = ~_SPACE[raw]
    edge = np.diff(solid)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    power, inverse = _pow(len(raw))
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[_LOWER[raw]] * power[: len(raw)], out=total[1:])
    return starts, mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def blocks(texts: list[bytes]):
    """(first, last) ranges of texts that make up about _BLOCK bytes, or one text alone."""
    first = size = 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > _BLOCK:
            yield first, i
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, len(texts)


def shingle_sets(texts: list[bytes], k: int = K):
    """For each text the sorted array of its distinct shingle hashes (uint64)."""
    for a, b in blocks(texts):
        part = texts[a:b]
        begin = np.cumsum([0] + [len(t) + 1 for t in part])
        starts, words = word_hashes(b"\n".join(part))
        first = np.searchsorted(starts, begin)
        n = len(words)
        every = np.zeros(max(0, n - k + 1), dtype=np.uint64)
        for j in range(k):
            every += words[j : n - k + 1 + j] * _COEF[j] if n >= k else every
        every = mix(every)
        for i in range(len(part)):
            x, y = first[i], first[i + 1]
            if y - x >= k:
                yield np.unique(every[x : y - k + 1])
            elif y > x:
                yield mix((words[x:y] * _COEF[8 : 8 + y - x]).sum(dtype=np.uint64, keepdims=True) + _U(y - x))
            else:
                yield np.empty(0, dtype=np.uint64)


def column_bytes(column) -> list[bytes]:
    """The UTF-8 bytes of each value of an Arrow string column; a null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]
