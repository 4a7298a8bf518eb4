"""Suffix arrays by induced sorting, and permuted longest common prefixes, for one shard.

``suffix_array`` classifies suffixes into S and L types, sorts the leftmost S substrings by inducing
from their first symbols, names them, sorts the string of names (by recursion while names repeat) and
induces all suffixes from the sorted leftmost ones. With a small alphabet a whole bucket is induced with
a few array operations; strings of names, whose buckets hold a few suffixes each, use plain loops.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
BUCKETS = 1024


def _types(s: np.ndarray) -> np.ndarray:
    """True for suffixes smaller than the one that follows; the last symbol is the unique smallest."""
    n = len(s)
    d = s[1:].astype(np.int64) - s[:-1]
    at = np.where(d != 0, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(at[::-1])[::-1]
    out = np.ones(n, bool)
    out[:-1] = d[np.minimum(nxt, n - 2)] > 0
    return out


def _deal(lists: list[list], symbols: np.ndarray, values: np.ndarray) -> None:
    """Appends values to the lists of their symbols, in order."""
    if not len(values):
        return
    order = np.argsort(symbols, kind="stable")
    symbols, values = symbols[order], values[order]
    cuts = np.flatnonzero(symbols[1:] != symbols[:-1]) + 1
    for part, c in zip(np.split(values, cuts), symbols[np.concatenate(([0], cuts))]):
        lists[c].append(part)


def _induce_arrays(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    left: list[list] = [[] for _ in range(k)]
    right: list[list] = [[] for _ in range(k)]
    given: list[list] = [[] for _ in range(k)]
    _deal(given, s[seeds], seeds)

    def before(x: np.ndarray, kind: bool) -> np.ndarray:
        x = x[x > 0] - 1
        return x[small[x] == kind]

    for c in range(k):
        i = 0
        while i < len(left[c]):
            prev = before(np.concatenate(left[c][i:]), False)
            i = len(left[c])
            _deal(left, s[prev], prev)
        for part in given[c]:
            prev = before(part, False)
            _deal(left, s[prev], prev)
    right[0].append(np.array([len(s) - 1]))
    for c in range(k - 1, -1, -1):
        i = 0
        while i < len(right[c]):
            prev = before(np.concatenate(right[c][i:]), True)
            i = len(right[c])
            _deal(right, s[prev], prev)
        if left[c]:
            prev = before(np.concatenate(left[c])[::-1], True)
            _deal(right, s[prev], prev)
    parts = []
    for c in range(k):
        parts += left[c]
        if right[c]:
            parts.append(np.concatenate(right[c])[::-1])
    return np.concatenate(parts)


def _induce_loops(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, k: int) -> np.ndarray:
    n, t = s.tolist(), small.tolist()
    size = np.bincount(s, minlength=k)
    ends = np.cumsum(size)
    head, tail = (ends - size).tolist(), ends.tolist()
    out = [-1] * len(n)
    for x in reversed(seeds.tolist()):
        c = n[x]
        tail[c] -= 1
        out[tail[c]] = x
    for x in out:
        if x > 0 and not t[x - 1]:
            c = n[x - 1]
            out[head[c]] = x - 1
            head[c] += 1
    tail = ends.tolist()
    # Leftmost S suffixes are placed again, by the suffixes that follow them.
    for i in range(len(out) - 1, -1, -1):
        x = out[i]
        if x > 0 and t[x - 1]:
            c = n[x - 1]
            tail[c] -= 1
            out[tail[c]] = x - 1
    out[0] = len(n) - 1
    return np.array(out)


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """Start positions of the sorted suffixes of ``s`` (symbols below ``k``), whose last symbol is 0
    and occurs only there."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    first = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    induce = _induce_arrays if k <= BUCKETS else _induce_loops
    is_first = np.zeros(len(s), bool)
    is_first[first] = True
    if len(first) > 1:
        order = induce(s, small, first, k)
        order = order[is_first[order]]
        # A substring ends with the first symbol of the next one.
        length = np.empty(len(s), np.int64)
        length[first] = np.append(np.diff(first), 0) + 1
        a, b = order[:-1], order[1:]
        new = length[a] != length[b]
        open_ = np.flatnonzero(~new)
        step = 0
        while len(open_):
            open_ = open_[length[a[open_]] > step]
            differ = s[a[open_] + step] != s[b[open_] + step]
            new[open_[differ]] = True
            open_ = open_[~differ]
            step += 1
        name = np.empty(len(s), np.int64)
        name[order] = np.concatenate(([0], np.cumsum(new)))
        names = name[first]
        count = int(names.max()) + 1
        ranks = np.argsort(names) if count == len(first) else suffix_array(names, count)
        first = first[ranks]
    return induce(s, small, first, k)


def permuted_lcp(s: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position, the common prefix with the suffix sorted right before it (0 for the first).
    Only positions whose value does not follow from the position before are compared."""
    n = len(s)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    follows = np.zeros(n, bool)
    follows[1:] = (phi[1:] > 0) & (phi[1:] == phi[:-1] + 1)
    follows[1:] &= s[:-1] == s[np.maximum(phi[1:] - 1, 0)]
    at = np.flatnonzero(~follows & (phi >= 0))
    padded = np.concatenate((s.astype(np.uint16), np.zeros(4, np.uint16)))
    words = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (n, 8), (2, 1))
    four = np.ascontiguousarray(words).view(np.uint64).ravel()
    value = np.zeros(n, np.int64)
    a, b, done = at, phi[at], np.zeros(len(at), np.int64)
    live = np.arange(len(at))
    while len(live):
        pa, pb = a[live] + done[live], b[live] + done[live]
        x = four[np.minimum(pa, n - 1)] ^ four[np.minimum(pb, n - 1)]
        same = (x == 0) & (pa < n) & (pb < n)
        stop = ~same
        low = x[stop] & (~x[stop] + np.uint64(1))
        more = np.where(low > 0, np.log2(np.maximum(low, 1).astype(np.float64)).astype(np.int64) // 16, 0)
        done[live[stop]] += more
        done[live[same]] += 4
        live = live[same]
    value[at] = done
    last = np.maximum.accumulate(np.where(~follows, np.arange(n), 0))
    return np.where(follows, value[last] - (np.arange(n) - last), value)
