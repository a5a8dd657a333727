"""Longest common extensions by difference covers: sort the suffixes at sampled places alone, and reach them by comparing few values.

A difference cover of v is a set of residues in which every difference modulo v occurs. So for any two places some shift
below v brings both to sampled places at once. Values are compared up to that shift; from there on, the least common
prefix of neighbours between the two ranks (a sparse table) gives the rest. Suffixes are compared within a segment only.
"""

from __future__ import annotations

import numpy as np

#: A perfect difference cover: 6 residues of 31.
PERIOD, COVER = 31, np.array([1, 5, 11, 24, 25, 27])
_FAR = np.int32(2**31 - 1)


def _shifts() -> np.ndarray:
    """For residues a, b the least shift that brings both into the cover."""
    inside = np.zeros(2 * PERIOD, bool)
    inside[np.concatenate([COVER, COVER + PERIOD])] = True
    out = np.full((PERIOD, PERIOD), -1)
    at = np.arange(PERIOD)
    for d in range(PERIOD - 1, -1, -1):
        both = inside[at + d][:, None] & inside[at + d][None, :]
        out[both] = d
    return out


SHIFT = _shifts()
_SLOT = np.full(PERIOD, -1)
_SLOT[COVER] = np.arange(len(COVER))


class Least:
    """Least value of any stretch of an array in two look-ups: a table of stretches whose lengths are powers of two."""

    def __init__(self, values: np.ndarray, longest: int):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= longest:
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[: max(len(last) - half, 0)], last[half:]))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Least of values[a:b], where a < b."""
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.levels[k][a[m]], self.levels[k][b[m] - (1 << int(k))])
        return out


class Extensions:
    """How far the values from two places of a segment agree.

    values: whole numbers from 0 on; segment: each place's segment, ascending. Every segment must end with a value that
    occurs nowhere else, so that no match leaves it.
    """

    def __init__(self, values: np.ndarray, segment: np.ndarray):
        top = int(values.max(initial=0)) + 1
        self.values = np.concatenate([values, np.full(2 * PERIOD, top)]).astype(np.int64)
        blocks = -(-(len(values) + 1) // PERIOD)
        where = (np.arange(blocks)[:, None] * PERIOD + COVER[None, :]).ravel()
        where = where[: int(np.searchsorted(where, len(values)))]
        self._sort(where, segment[where], top)

    def _sort(self, where: np.ndarray, segment: np.ndarray, top: int) -> None:
        n, v, per_block = len(where), self.values, len(COVER)
        first = np.concatenate([[True], segment[1:] != segment[:-1]]) if n else np.zeros(0, bool)
        starts = np.flatnonzero(first)
        longest = int(np.diff(np.append(starts, n)).max(initial=1))
        order = np.arange(n)
        rank = np.repeat(starts, np.diff(np.append(starts, n)))  # the first slot of the suffix's group
        lcp = np.full(n, _FAR, np.int32)  # of the suffixes in slots k - 1 and k
        lcp[starts] = 0
        bits = max(int(top).bit_length(), 1)
        at_once = max(1, 62 // bits)
        slots, depth = np.arange(n), 0
        while True:
            tied = np.zeros(n + 1, bool)
            tied[:n] = lcp == _FAR
            tied[:-1] |= tied[1:]
            slots = np.flatnonzero(tied[:n])
            if not len(slots):
                break
            item, table = order[slots], None
            if depth < PERIOD:
                step = min(at_once, PERIOD - depth)
                key = np.zeros(len(item), np.int64)
                for k in range(step):
                    key = (key << bits) | v[where[item] + depth + k]
            else:
                step, later = depth, item + depth // PERIOD * per_block
                key, table = rank[np.minimum(later, n - 1)], Least(lcp, longest)
            group = rank[item]
            by = np.lexsort((key, group))
            item, key, group = item[by], key[by], group[by]
            order[slots] = item
            fresh = np.flatnonzero((group[1:] == group[:-1]) & (key[1:] != key[:-1])) + 1
            if table is None:
                a, b = where[item[fresh - 1]] + depth, where[item[fresh]] + depth
                same, more = np.ones(len(fresh), bool), np.zeros(len(fresh), np.int64)
                for k in range(step):
                    same &= v[a + k] == v[b + k]
                    more += same
            else:
                a, b = key[fresh - 1], key[fresh]  # first slots of two groups that differ
                more = table.between(a + 1, b + 1)
            lcp[slots[fresh]] = depth + more
            begins = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
            rank[item] = slots[np.maximum.accumulate(np.where(begins, np.arange(len(item)), 0))]
            depth += step
        self.rank, self.least = rank, Least(lcp, longest)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The number of values that agree from a and from b on; a and b differ and lie in one segment."""
        v, shift = self.values, SHIFT[a % PERIOD, b % PERIOD]
        out, live = np.zeros(len(a), np.int64), np.arange(len(a))
        for k in range(PERIOD):
            live = live[shift[live] > k]
            if not len(live):
                break
            live = live[v[a[live] + k] == v[b[live] + k]]
            out[live] += 1
        deep = np.flatnonzero(out == shift)
        x, y = a[deep] + shift[deep], b[deep] + shift[deep]
        slot = lambda p: self.rank[p // PERIOD * len(COVER) + _SLOT[p % PERIOD]]
        i, j = slot(x), slot(y)
        out[deep] += self.least.between(np.minimum(i, j) + 1, np.maximum(i, j) + 1)
        return out
