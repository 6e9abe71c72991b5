"""64-bit keys of words, shingles and n-grams for whole batches of texts, with numpy.

Words are runs of anything but ASCII white space, A-Z in lower case. A word's
key is a polynomial over random values of its bytes, read off running sums,
then mixed; equal words have equal keys in every process.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_RNG = np.random.default_rng(20260101)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_TABLE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]
#: Odd factors for the words of a shingle or n-gram, by position.
FACTORS = _RNG.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Bytes of text that are worked on at once, so that they stay in cache; a longer text is worked on alone.
CHUNK = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(n, base, dtype=np.uint64)
            p[0] = 1
            _POWERS[i] = np.cumprod(p, dtype=np.uint64)
    return _POWERS[0][:n], _POWERS[1][:n]


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all words of all texts in a row, and where each text's words begin (with the end added)."""
    buf = b"\n".join(texts).lower() + b"\n"
    a = np.frombuffer(buf, np.uint8)
    up, down = _powers(len(a))
    space = _SPACE[a]
    total = np.cumsum(_TABLE[a] * up, dtype=np.uint64)
    flip = np.flatnonzero(space[1:] != space[:-1]) + 1
    if not space[0]:
        flip = np.concatenate([[0], flip])
    start, stop = flip[::2], flip[1::2]
    before = np.where(start > 0, total[start - 1], np.uint64(0))
    keys = mix((total[stop - 1] - before) * down[start])
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    at = np.searchsorted(start, np.cumsum(lens) - lens)
    return keys, np.concatenate([at, [len(start)]])


def chunks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` bytes together."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def grams(keys: np.ndarray, n: int) -> np.ndarray:
    """Keys of the n words from each position on, of ``len(keys) - n + 1`` positions."""
    m = len(keys) - n + 1
    out = np.zeros(max(m, 0), dtype=np.uint64)
    for i in range(n if m > 0 else 0):
        out += keys[i : i + m] * FACTORS[i]
    return mix(out + np.uint64(n))


def shingles(keys: np.ndarray, bounds: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """The distinct keys of each text's n-word shingles, sorted; of a shorter text, of all its words as one."""
    every = grams(keys, n)
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        if hi - lo >= n:
            yield np.unique(every[lo : hi - n + 1])
        elif hi > lo:
            yield grams(keys[lo:hi], int(hi - lo))
        else:
            yield np.zeros(0, dtype=np.uint64)
