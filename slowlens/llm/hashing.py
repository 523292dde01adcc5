"""Words, shingles and signatures of whole texts as numpy arrays, for functions that run inside tasks."""

from __future__ import annotations

import numpy as np

_RANDOM = np.random.Generator(np.random.PCG64(20240501))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
CHUNK = 1 << 16
SHINGLE = 5


def _byte_table() -> np.ndarray:
    values = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    return values


_VALUE = _byte_table()
_IN_WORD = np.zeros(256, dtype=bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    _IN_WORD[_low : _high + 1] = True
_MULTIPLY = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


def _powers(base: int) -> np.ndarray:
    steps = np.full(CHUNK + 1, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


_UP, _DOWN = _powers(_BASE), _powers(_INVERSE)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _pieces(data: bytes):
    """``data`` in pieces of at most ``CHUNK`` bytes that end between words (a longer word is cut)."""
    at = 0
    while len(data) - at > CHUNK:
        piece = np.frombuffer(data, np.uint8, CHUNK, at)
        gaps = np.flatnonzero(~_IN_WORD[piece])
        end = int(gaps[-1]) + 1 if len(gaps) else CHUNK
        yield piece[:end]
        at += end
    yield np.frombuffer(data, np.uint8, len(data) - at, at)


def placed_words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word of a UTF-8 text, A-Z as a-z, and the byte where it begins."""
    found, places, at = [], [], 0
    for piece in _pieces(data):
        inside = np.concatenate(([False], _IN_WORD[piece], [False]))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(_VALUE[piece] * _UP[: len(piece)], out=sums[1:])
        found.append(mixed((sums[ends] - sums[starts]) * _DOWN[starts] + (ends - starts).astype(np.uint64)))
        places.append(at + starts)
        at += len(piece)
    return (found[0], places[0]) if len(found) == 1 else (np.concatenate(found), np.concatenate(places))


def word_hashes(data: bytes) -> np.ndarray:
    """The hashes of ``placed_words``."""
    return placed_words(data)[0]


def shingle_hashes(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of ``size`` consecutive words; one of all words if there are fewer, none without words."""
    size = min(size, len(words))
    if not size:
        return words
    total = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        total = total * np.uint64(_BASE) + words[i : len(words) - size + 1 + i]
    return mixed(total + np.uint64(size))


def shingle_set(data: bytes, size: int = SHINGLE) -> np.ndarray:
    return np.unique(shingle_hashes(word_hashes(data), size))


def minhashes(tokens: np.ndarray, n: int = 64) -> np.ndarray:
    """``n`` 32-bit MinHash values of a set of hashes."""
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(tokens), 2048):
        part = tokens[at : at + 2048, None] * _MULTIPLY[None, :n]
        np.minimum(least, part.min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def range_minhashes(tokens: np.ndarray, starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """A row of ``n`` MinHash values, as ``minhashes`` has them, for each range of ``tokens``; no range is empty."""
    least = np.empty((len(starts), n), np.uint32)
    order = np.argsort(starts, kind="stable")
    at = 0
    while at < len(order):
        lo, to = starts[order[at]], at
        while to < len(order) and ends[order[to]] <= lo + CHUNK // 4:
            to += 1
        if to == at:  # a range of many tokens by itself
            least[order[at]] = minhashes(tokens[lo : ends[order[at]]], n)
            at += 1
            continue
        rows = order[at:to]
        values = _MULTIPLY[:n, None] * np.append(tokens[lo : ends[rows].max()], np.uint64(0))[None, :]
        cuts = np.stack((starts[rows] - lo, ends[rows] - lo), axis=1).ravel()
        least[rows] = (np.minimum.reduceat(values, cuts, axis=1)[:, ::2] >> np.uint64(32)).T
        at = to
    return least
