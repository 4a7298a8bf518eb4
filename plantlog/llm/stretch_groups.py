"""Near stretches inside groups of rows that are aligned at a shared minimum, many groups at once.

A row is the shingles of some consecutive stretches of ``width`` shingles of one text; two stretches of a group are
compared where they start equally far from the minimum. Near is a Jaccard similarity of 4/5 or more of their sets.

1. Equal stretches are found by their hash: they cover each other and link their texts, in linear time.
2. Near stretches share 4/5 of the shingles of either. A stretch goes no further when fewer of its shingles are held
   by two texts of the group, nor where all stretches of its place are covered and their texts linked.
3. Two sets of a and b shingles that are near share one of the a - ceil(4a/5) + 1 rarest of the first and the
   b - ceil(4b/5) + 1 rarest of the second, in any one order of shingles (prefix filter; here rare ones first). So only stretches
   with such a shingle in common meet. Parities of hashed bits bound their difference from below; what is left is
   counted exactly. Lists are walked in doubling steps, so a list whose stretches are soon covered and linked ends there.

No near pair is lost: each step leaves out only pairs that cannot be near or whose answer is known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from plantlog.llm.common import _BASE, _INV, _powers, mix

_ODD, _NONE = np.uint64(0x9E3779B97F4A7C15), np.int32(2**31 - 1)
#: Stretches whose sets are held at once, pairs met and pairs counted at once.
SETS, PAIRS, COUNTED = 1 << 13, 1 << 17, 1 << 13


def coverage(first: np.ndarray, last: np.ndarray, n: int) -> np.ndarray:
    """How many of the ranges (inclusive) hold each of 0..n-1."""
    return np.cumsum(np.bincount(first, minlength=n + 1)[:n + 1] - np.bincount(last + 1, minlength=n + 1)[:n + 1])[:n]


def starts(keys: np.ndarray) -> np.ndarray:
    """Where a run of equal keys begins."""
    return np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``size`` numbers from each of ``first`` on."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def range_hashes(shingles: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the shingles of each range, end exclusive."""
    total = np.zeros(len(shingles) + 1, np.uint64)
    np.cumsum(mix(shingles) * _powers(_BASE, len(shingles)), out=total[1:])
    return mix((total[end] - total[first]) * _powers(_INV, len(total))[first])


def link(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """``label`` (the smallest linked text of each) once the texts ``a`` and ``b`` are linked too."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low != high
        if not apart.any():
            return
        a, b = a[apart], b[apart]
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label[:] = label[label]


def _numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of each key, the stable order of the keys, and where each number begins in it."""
    order = np.argsort(keys, kind="stable")
    begin = starts(keys[order])
    number = np.empty(len(keys), np.int64)
    number[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(keys))))
    return number, order, begin


class Groups:
    """Rows by group (numbered from 0, ascending): number of the text (ascending with its name), side (1 or 2; in a
    ``cross`` group only rows of two sides need to meet), stretches before the minimum's, and shingles end to end."""

    def __init__(self, group: np.ndarray, text: np.ndarray, side: np.ndarray, cross: np.ndarray, ahead: np.ndarray,
                 size: np.ndarray, shingles: np.ndarray, width: int):
        self.group, self.text, self.cross, self.shingles, self.width = group, text, cross, shingles, width
        self.label = np.arange(text.max() + 1)
        self.begin = np.cumsum(size) - size
        wide = size - width + 1
        #: Row and first shingle of every stretch; ``kind`` numbers those with equal shingles at one place of a group.
        self.row = np.repeat(np.arange(len(size)), wide)
        self.at = spread(self.begin, wide)
        place = (group[self.row] << 7) + self.at - self.begin[self.row] - ahead[self.row] + 64
        content = range_hashes(shingles, self.at, self.at + width)
        self.kind, order, first = _numbered(content + place.astype(np.uint64) * _ODD)
        one, own = order[first], text[self.row]
        low, high = np.minimum.reduceat(own[order], first), np.maximum.reduceat(own[order], first)
        #: Of each kind: its place, first shingle, a text, sides, and whether it is in two texts or near to another's.
        self.place, self.first, self.own, self.twice = place[one], self.at[one], low, low != high
        self.side = np.bitwise_or.reduceat(side[self.row[order]], first)
        self.found = self.twice.copy()
        more = self.twice[self.kind]
        link(self.label, own[more], low[self.kind[more]])
        self._meet(size)

    def covered(self) -> np.ndarray:
        """Of each stretch whether it is near to one of another text."""
        return self.found[self.kind]

    def _open(self, key: np.ndarray, kinds: np.ndarray, n: int) -> np.ndarray:
        """Of the ``n`` keys those of whose ``kinds`` one is not covered or two are not linked."""
        low, high = np.full(n, len(self.label)), np.full(n, -1)
        np.minimum.at(low, key, self.label[self.own[kinds]])
        np.maximum.at(high, key, self.label[self.own[kinds]])
        return (np.bincount(key, ~self.found[kinds], n) > 0) | (low < high)

    def _meet(self, size: np.ndarray) -> None:
        every, n = np.arange(len(self.place)), self.group[-1] + 1
        open_ = self._open(self.place >> 7, every, n)
        row = np.repeat(np.arange(len(size)), size)
        live = np.flatnonzero(open_[self.group[row]])
        if not len(live):
            return
        code, order, first = _numbered(mix(self.shingles[live] + self.group[row[live]].astype(np.uint64) * _ODD))
        often = np.diff(np.append(first, len(live)))
        holder, live_row = self.text[row[live[order]]], row[live[order]]
        shared = np.minimum.reduceat(holder, first) != np.maximum.reduceat(holder, first)
        # Numbers by how often a shingle is there; of equal shingles of a row the one before.
        self.rank, rare = np.full(len(self.shingles), -1, np.int32), np.argsort(often, kind="stable")
        number = np.empty(len(often), np.int64)
        number[rare] = np.arange(len(often))
        self.rank[live], self.shared = number[code], shared[rare]
        again = np.flatnonzero((code[order[1:]] == code[order[:-1]]) & (live_row[1:] == live_row[:-1]))
        self.before = np.full(len(self.shingles), -1)
        self.before[live[order[again + 1]]] = live[order[again]]
        # Shingle p counts for the stretches from ``since`` to p: those that hold it and no earlier copy.
        since = np.maximum(np.maximum(live - self.width, self.before[live]) + 1, self.begin[row[live]])
        held = shared[code]
        kinds = coverage(since, live, len(self.shingles))[self.first]
        common = coverage(since[held], live[held], len(self.shingles))[self.first]
        alive = np.flatnonzero(open_[self.place >> 7] & (5 * common >= 4 * kinds))
        alive = alive[np.argsort(self.place[alive], kind="stable")]
        begin = starts(self.place[alive])
        spot = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(alive))))
        keep = ((np.bincount(spot) > 1) & self._open(spot, alive, len(begin)))[spot] if len(alive) else alive
        alive, spot = alive[keep], spot[keep]
        begin = np.append(starts(spot), len(alive))
        lo = 0
        while lo < len(begin) - 1:
            hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + SETS, "right")) - 1)
            part = slice(begin[lo], begin[hi])
            self._near(alive[part], spot[part], kinds[alive[part]])
            lo = hi

    def _near(self, alive: np.ndarray, spot: np.ndarray, size: np.ndarray) -> None:
        """Meets the kinds ``alive``, ascending by place (``spot``), with ``size`` different shingles."""
        grid = self.first[alive][:, None] + np.arange(self.width)
        sets = self.rank[grid]
        if (size < self.width).any():
            sets[self.before[grid] >= self.first[alive][:, None]] = _NONE
        sets.sort(axis=1)
        self.bits = self._parities(sets)
        prefix = size - (4 * size + 4) // 5 + 1
        head = sets[:, :prefix.max()]
        who, column = np.nonzero((np.arange(head.shape[1]) < prefix[:, None]) & self.shared[np.minimum(head, len(self.shared) - 1)])
        key = spot[who] * np.int64(len(self.shared)) + head[who, column]
        order = np.argsort(key, kind="stable")
        who, begin = who[order], starts(key[order])
        for x, y in self._pairs(alive, who, begin, np.diff(np.append(begin, len(who))), size.astype(np.int16)):
            for lo in range(0, len(x), COUNTED):
                i, j = x[lo:lo + COUNTED], y[lo:lo + COUNTED]
                both = np.concatenate((sets[i], sets[j]), axis=1)
                both.sort(axis=1)
                same = np.count_nonzero((both[:, 1:] == both[:, :-1]) & (both[:, 1:] != _NONE), axis=1)
                near = 9 * same >= 4 * (size[i] + size[j])
                i, j = alive[i[near]], alive[j[near]]
                self.found[i] = self.found[j] = True
                link(self.label, self.own[i], self.own[j])

    def _parities(self, sets: np.ndarray) -> list[np.ndarray]:
        """128 bits of each set, each the parity of the shingles hashed to it: one shingle changes one bit."""
        number = np.arange(len(self.shared) + 1, dtype=np.uint64)
        hashed = mix(number * _ODD + np.uint64(1))
        bit, upper = np.uint64(1) << (hashed & np.uint64(63)), (hashed >> np.uint64(6) & np.uint64(1)).astype(bool)
        bit[-1] = 0
        at = np.minimum(sets, len(self.shared))
        return [np.bitwise_xor.reduce(np.where(half, bit, np.uint64(0))[at], axis=1) for half in (upper, ~upper)]

    def _pairs(self, alive: np.ndarray, who: np.ndarray, begin: np.ndarray, length: np.ndarray,
               size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of kinds to be counted, from the lists ``who[begin:begin + length]``: its first entry meets all others of
        a list, then the next two, the next four and so on."""
        upper, lower, sizes, step = self.bits[0][who], self.bits[1][who], size[who], 1
        kinds = alive[who]
        while True:
            several = length > 1
            begin, length = begin[several], length[several]
            if not len(begin):
                return
            todo = self._open(np.repeat(np.arange(len(begin)), length), kinds[spread(begin, length)], len(begin))
            begin, length = begin[todo], length[todo]
            taken = np.minimum(length - 1, step)
            x, end = spread(begin, taken), np.repeat(begin + length, taken)
            begin, length, step = begin + taken, length - taken, 2 * step
            others = end - 1 - x
            total, lo = np.cumsum(others), 0
            while lo < len(x):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + PAIRS, "right")))
                m = others[lo:hi]
                b = spread(x[lo:hi] + 1, m)
                most = (np.repeat(sizes[x[lo:hi]], m) + sizes[b]) // 9
                differ = np.bitwise_count(np.repeat(upper[x[lo:hi]], m) ^ upper[b])
                some = np.flatnonzero(differ <= most)
                a, b = np.repeat(x[lo:hi], m)[some], b[some]
                some = np.bitwise_count(lower[a] ^ lower[b]) + differ[some] <= most[some]
                i, j = who[a[some]], who[b[some]]
                p, q = alive[i], alive[j]
                todo = ~(self.found[p] & self.found[q]) | (self.label[self.own[p]] != self.label[self.own[q]])
                todo &= self.twice[p] | self.twice[q] | (self.own[p] != self.own[q])
                todo &= ~self.cross[self.place[p] >> 7] | (self.side[p] | self.side[q] == 3)
                # Lists ascend, so i < j.
                i, j = np.divmod(np.unique(i[todo] * np.int64(len(alive)) + j[todo]), len(alive))
                yield i, j
                lo = hi
