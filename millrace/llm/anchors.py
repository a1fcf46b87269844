"""Content-defined anchors over a sequence of symbols (bytes, or word hashes).

Both repeat finders (`suffix_array`, `suffix_automata`) have to know, for every
window of `length` consecutive symbols, whether the same window starts earlier.
Shuffling every window is out of the question at corpus size, so windows are
grouped by the *anchor* they contain: the leftmost gram of `gram` symbols whose
hash is least among all grams of the window. Which gram that is depends only on
the window's own symbols, so equal windows, wherever they are, share an anchor
at the same relative place. One row per anchor stands for the run of windows
that chose it, about 2 rows per `length - gram + 1` symbols.
"""

from __future__ import annotations

import numpy as np

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SALT = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    """Powers of `base` modulo 2**64, kept between calls and grown by doubling."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length())
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[name] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words, so that high bits depend on all bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(_SALT)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_BASE)
    return x ^ (x >> np.uint64(32))


class Rolling:
    """Hashes of any substrings of one sequence of symbols, from one prefix sum."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        values = symbols.astype(np.uint64) + np.uint64(1)
        self.sums = np.empty(n + 1, dtype=np.uint64)
        self.sums[0] = 0
        np.cumsum(values * _power("down", _INVERSE, n), out=self.sums[1:])
        self.up = _power("up", _BASE, n + 1)

    def grams(self, k: int) -> np.ndarray:
        """Hash of every substring of k symbols."""
        return mix((self.sums[k:] - self.sums[:-k]) * self.up[: self.n - k + 1])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of each substring [start, end)."""
        return mix((self.sums[end] - self.sums[start]) * self.up[start] + end.astype(np.uint64) - start.astype(np.uint64))


def anchors(symbols: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(key, first, last, at) per anchor of a sequence; windows first..last chose the gram at `at`.

    key is the hash of the anchor's gram. Sequences shorter than `length` have
    no window.
    """
    n = len(symbols)
    if n < length:
        none = np.zeros(0, dtype=np.int64)
        return none.view(np.uint64), none, none, none
    hashes = Rolling(symbols).grams(gram)
    width, m = length - gram + 1, len(hashes)
    ranked = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    blocks = -(-m // width)
    padded = np.full(blocks * width, np.uint64(_MASK))
    padded[:m] = ranked
    padded = padded.reshape(blocks, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
    first = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    last = np.append(first[1:], windows) - 1
    place = (least[first] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return hashes[place], first, last, place
