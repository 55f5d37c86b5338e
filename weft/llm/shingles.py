"""Vectorised word shingles of Arrow text columns.

Words are runs of bytes other than ASCII white space (0x20, 0x09-0x0D) with A-Z
lower-cased; both rules only touch ASCII bytes, so they can be applied to UTF-8
bytes directly. Each word gets a 64-bit polynomial hash over randomised byte
values, taken from a running sum, and a shingle hashes its word hashes.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
np.seterr(over="ignore")  # hashes wrap
_RNG = np.random.Generator(np.random.PCG64(20_240_607))
_VALUE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_VALUE[ord("A") : ord("Z") + 1] = _VALUE[ord("a") : ord("z") + 1]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = _U(0x9E3779B97F4A7C15)
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = (_U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9), _U(0x27D4EB2F165667C5))
#: Bytes of text hashed in one go; a longer document is still taken whole.
CHUNK = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so equal inputs and only those give equal outputs."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = max(n, CHUNK + 1)
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                out = np.full(size, base, np.uint64)
                out[0] = 1
                setattr(self, name, np.multiply.accumulate(out))
        return self.up, self.down


_POWERS = _Powers()


def _word_hashes(data: np.ndarray):
    """Start, end (byte offsets) and hash of every word in data."""
    solid = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _POWERS.get(len(data) + 1)
    run = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=run[1:])
    return start, end, mix((run[end] - run[start]) * down[start] + (end - start).astype(np.uint64))


def sets_of(column, k: int = 4):
    """Yield (row number, sorted distinct uint64 shingle hashes) for each row of an Arrow string column.

    A text of fewer than k words, but not none, has its whole word sequence as its
    only shingle; null and empty texts give an empty array.
    """
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if column.null_count == 0 else column.is_valid().to_numpy(zero_copy_only=False)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + CHUNK, side="right")) - 1
        to = min(n, max(to, at + 1))
        lo, hi = offsets[at], offsets[to]
        # a separator after each text keeps words of neighbours apart
        marks = offsets[at + 1 : to + 1] - lo
        part = np.insert(data[lo:hi], marks, 0x20)
        bounds = np.concatenate(([0], marks + np.arange(1, len(marks) + 1)))
        start, _, words = _word_hashes(part)
        first = np.searchsorted(start, bounds)
        rolled = None
        if len(words) >= k:
            rolled = words[: len(words) - k + 1].copy()
            for j in range(1, k):
                rolled = rolled * _STEP[j % 3] + words[j : len(words) - k + 1 + j]
            rolled = mix(rolled)
        for i in range(at, to):
            a, b = first[i - at], first[i - at + 1]
            if a == b or not valid[i]:
                yield i, np.zeros(0, np.uint64)
            elif b - a < k:
                h = _U(b - a)
                for w in words[a:b]:
                    h = mix(np.asarray([h * _STEP[0] + w], np.uint64))[0]
                yield i, np.asarray([h], np.uint64)
            else:
                s = np.sort(rolled[a : b - k + 1])
                yield i, s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s
        at = to
