"""Words of whole Arrow text columns as numpy arrays: bounds, owners and 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Text bytes worked on at once; a longer text makes a chunk of its own.
CHUNK = 512 << 10
_MUL = 0x9E3779B97F4A7C15
_INV = pow(_MUL, -1, 1 << 64)
_bytes = np.arange(256, dtype=np.uint8)
#: ASCII lower case, other bytes as they are.
LOWER = _bytes.copy()
LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, offsets from 0) for consecutive rows. A null text is an empty one."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    _, off, data = texts.buffers()
    off = np.frombuffer(off, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, to - at, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


def bounds(data: np.ndarray, off: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of word bytes; a run never crosses rows."""
    inside = is_word[data]
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[False], inside[:-1]])
    before[off[:-1][off[:-1] < len(data)]] = False
    after = np.concatenate([inside[1:], [False]])
    after[off[1:][off[1:] > 0] - 1] = False
    return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1


def owners(starts: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The row each run belongs to."""
    return np.searchsorted(off, starts, "right") - 1


def _power(base: int, n: int) -> np.ndarray:
    key = str(base)
    if key not in _powers or len(_powers[key]) < n:
        steps = np.full(max(n, CHUNK + 1), base, np.uint64)
        steps[0] = 1
        _powers[key] = np.cumprod(steps)
    return _powers[key][:n]


class Hasher:
    """64-bit hashes of any byte ranges of a chunk, from one running sum."""

    _salt = np.random.default_rng(20240229).integers(1, 1 << 63, 256).astype(np.uint64)

    def __init__(self, data: np.ndarray):
        n = len(data)
        self.sum = np.zeros(n + 1, np.uint64)
        salted = self._salt[data]
        salted *= _power(_MUL, n)
        np.cumsum(salted, out=self.sum[1:])
        self.inverse = _power(_INV, n + 1)

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sum[ends] - self.sum[starts]) * self.inverse[starts]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h
