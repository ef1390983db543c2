"""Anchors: content-chosen positions that equal windows of two texts agree on.

Among the ``k``-grams of a window of ``length`` units the one with the least hash (the last
of equal ones) is the window's anchor. It depends on the window's content alone, so equal
windows anywhere have equal anchors at equal distances. Consecutive windows mostly share
an anchor; such a run with its units is a segment, about half a window's reach long. Windows
without a twin are thus told apart from the rest by one row for each segment, not for each
position.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import process_memo

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPAN = 1 << 20  # positions a packed key can tell apart
_POSITION = np.uint64(_SPAN - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _M1)


class WordHashes(dict):
    """Memo of 64-bit word hashes."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = h
        return h


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = process_memo("word hashes", WordHashes)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def byte_hashes(raw: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(raw, np.uint8)]


def grams(units: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-grams, by doubling: a gram of 2m units from two of m."""
    out, have = None, 0
    power, m, step = units, 1, k
    while step:
        if step & 1:
            if out is None:
                out, have = power, m
            else:
                n = min(len(out), len(power) - have)
                out = out[:n] * _M3 + power[have : have + n]
                out ^= out >> np.uint64(32)
                have += m
        step >>= 1
        if step:
            n = len(power) - m
            power = power[:n] * _M2 + power[m : m + n]
            power ^= power >> np.uint64(29)
            m *= 2
    return mix(out * _M1)


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    rows = -(-n // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    block = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(block, axis=1).ravel()
    behind = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(units: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor position, first window, number of windows) of each segment."""
    n = len(units)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    h = grams(units, k)
    w = length - k + 1
    places = []
    for lo in range(0, n - length + 1, _SPAN - w):
        part = h[lo : min(lo + _SPAN, len(h))]
        keys = (part & ~_POSITION) | (_POSITION - np.arange(len(part), dtype=np.uint64))
        best = _sliding_min(keys, w)[: _SPAN - w]
        places.append(lo + (_POSITION - (best & _POSITION)).astype(np.int64))
    anchor = np.concatenate(places)[: n - length + 1]
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return h[anchor[first]], anchor[first], first, np.diff(np.append(first, len(anchor)))
