"""Words of whole texts as 64-bit hashes, computed with numpy over many texts at once.

A word is a maximal run of letters, digits, apostrophes or characters beyond ASCII, in lower case.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = True
_WORD[128:] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: What each byte adds to a hash.
_BYTES = mix(np.arange(1, 257, dtype=np.uint64))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        full = [np.full(size, x, np.uint64) for x in (_BASE, _INVERSE)]
        for x in full:
            x[0] = 1
        _powers[:] = [np.multiply.accumulate(x) for x in full]
    return _powers[0][:n], _powers[1][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums that give the hash of any stretch of ``data`` (bytes) in two look-ups; see ``stretch``."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTES[data] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def stretch(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the stretches from start to end, equal for equal bytes wherever they stand."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def joined(items: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all items, each followed by one zero byte, and the place where each starts (one more at the end)."""
    data = np.frombuffer(b"\0".join(items) + b"\0", np.uint8)
    starts = np.zeros(len(items) + 1, np.int64)
    np.cumsum([len(x) + 1 for x in items], out=starts[1:])
    return data, starts


@dataclass
class Words:
    """hash: of each word; first: the place in ``hash`` of each text's first word (one more at the end);
    start, end: its bytes in ``data``; data: the bytes before lower-casing of ASCII."""

    hash: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words(texts: list[str]) -> Words:
    """The words of each text."""
    data, starts = joined([x.lower().encode("utf-8", "surrogatepass") for x in texts])
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    return Words(stretch(prefix_sums(data), start, end), np.searchsorted(start, starts), start, end, data)


def runs(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every ``n`` successive words and where each text's begin; a text with fewer words, but any, has one of them all."""
    count = np.diff(first)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    begin = np.zeros(len(made) + 1, np.int64)
    np.cumsum(made, out=begin[1:])
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], made)
    last = np.repeat(first[1:], made)
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = mix(out + np.where(at + k < last, padded[at + k], np.uint64(k + 1)))
    return out, begin
