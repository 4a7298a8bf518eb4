"""Near-duplicate passages from compact windows.

A text is the sequence of its five-word shingle hashes; a *stretch* is ``TOKENS`` consecutive ones
(``WORDS`` words). Two stretches are near when the Jaccard similarity of their shingle sets is at least
``THRESHOLD``; two texts are linked when they hold near stretches.

1. For each of ``FUNCTIONS`` hash functions the Cartesian tree over the hashed sequence gives the *compact
   windows* (l, c, r): every stretch inside l..r that holds c has its minimum at c. A window at least a
   stretch wide becomes a row: signature (function and minimum), text, interval of stretches. All stretches
   of all texts are covered by a few rows per ``TOKENS`` positions, and near stretches share a signature
   under each function with a chance of ``THRESHOLD`` or more.
2. Signatures are counted by an aggregation; only rows whose signature lies in two different texts go on.
   An interval join on the signature brings texts together, at the diagonal that aligns the two minima. All
   rows of a signature meet, in one of two ways; no group is cut.
3. Groups of up to ``SMALL`` rows become pairs of texts, once for all signatures they share. A pair with a
   single signature in common, anywhere in the two texts, goes no further. The others are verified on the texts:
   the exact similarity of all stretches of a diagonal is computed from the ranges in which each shingle is new
   to the sliding set. Pairs of one text are dealt into lanes, so a hot text has many tasks.
4. Larger groups never become pairs of rows: a row takes along the shingles of its interval, groups are dealt into
   chunks of ``CHUNK`` rows, and a task compares all rows of two chunks, many groups at once, at all stretches that
   two intervals share (``stretch_groups.py``): equal stretches by their hash, others by the rare shingles near ones
   must share, counted exactly. A task returns the covered stretches and, for each linked text, the smallest text of
   its class. A group of n rows is read n / CHUNK times. Places of one text with equal shingles are one row.

What can be missed: near stretches that share no signature of a large group, and their texts fewer than two in all:
at the threshold with probability 2e-3 (less for longer or closer passages; ``tests/llm`` measures recall against
all pairs). On a diagonal both stretches start equally far from the shared minimum: where words were put in or
left out, the closest alignment of a stretch may be one place off; its neighbours are found. Texts are told apart
by all 128 bits of their MD5; shingles are compared by 64-bit hashes.

Defined results: null, empty and shorter texts have no passage and are a class of their own; equal texts of
``WORDS`` words or more are one class, a passage as a whole; repeated rows are copies; rows without an id
are rows like others (a class named after them has a null id only if it has no other); an empty table gives
an empty table; only id and text are read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from plantlog.functions.sizing import broadcast_if_bounded
from plantlog.llm.common import CHUNK_BYTES, ByteTexts, chunks, forget, mix, saved
from plantlog.llm.components import components
from plantlog.llm.stretch_groups import Groups, coverage as _coverage, range_hashes, spread, starts

SHINGLE, WORDS, THRESHOLD = 5, 50, 0.8
TOKENS = WORDS - SHINGLE + 1
FUNCTIONS, SMALL, LANE, CHUNK = 6, 4, 256, 4096
_PLACE, _BLOCK = np.uint64((1 << 24) - 1), 1 << 22
_SEEDS = [np.uint64(0x9E3779B97F4A7C15 * (2 * k + 3) % (1 << 64)) for k in range(FUNCTIONS)]
_KEY, _PAIR = ["k1", "k2"], ["a1", "a2", "b1", "b2"]
# A row's place in one long: first stretch, stretches less one, distance of the minimum from the first.
_LO, _LEN, _AHEAD = 34, 28, 6
_ROW = "sig long, k1 long, k2 long, at long"


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v) - width + 1
    pad = np.full(-len(v) % width, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((v, pad)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest value of every run of ``width``; the left one of equals."""
    out = [np.zeros(0, np.int64)]
    for lo in range(0, len(keys) - width + 1, _BLOCK):
        part = keys[lo:lo + _BLOCK + width - 1]
        key = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        out.append((_sliding_min(key, width) & _PLACE).astype(np.int64) + lo)
    return np.concatenate(out)


def _trees(values: np.ndarray, spots: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends l and r of the Cartesian tree's nodes at ``spots`` (the minima of some stretch), for texts one
    after the other: node i belongs to the text at ``first[i]`` to ``last[i]``. A node wide enough is bounded
    by wide ones only, so the narrow ones are not needed."""
    key, i = values[spots] & ~_PLACE, np.arange(len(spots))
    left, right = np.where(first[i - 1] == first[i], i - 1, -1), np.where(first[(i + 1) % max(len(i), 1)] == first[i], i + 1, -1)
    left[:1], right[-1:] = -1, -1
    # What lies between a node and its bound so far is larger than the node, so the bound's own bound may follow.
    for bound, passed in ((left, np.greater), (right, np.greater_equal)):
        live = i
        while len(live):
            live = live[bound[live] >= 0]
            live = live[passed(key[bound[live]], key[live])]
            bound[live] = bound[bound[live]]
    return np.where(left < 0, first, spots[left] + 1), np.where(right < 0, last, spots[right] - 1)


def compact_windows(values: np.ndarray, width: int = TOKENS) -> list[tuple[int, int, int]]:
    """(l, c, r), ends inclusive, of the Cartesian tree's nodes at least ``width`` wide; of equal values
    the left one is smaller."""
    spots = np.unique(_lowest(values, width)) if len(values) >= width else np.zeros(0, np.int64)
    left, right = _trees(values, spots, np.zeros_like(spots), np.full_like(spots, len(values) - 1))
    return list(zip(left.tolist(), spots.tolist(), right.tolist()))


def intervals(tokens: np.ndarray, begin: np.ndarray, f: int) -> tuple[np.ndarray, ...]:
    """(text, signature, first stretch, last stretch, minimum) of the compact windows of function ``f`` over
    texts whose tokens begin at ``begin`` (and end at its last entry), by text and place; windows of equal
    minima with neighbouring stretches are one."""
    values = mix(tokens * _SEEDS[f])
    doc = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    low = _lowest(values, TOKENS) if len(values) >= TOKENS else np.zeros(0, np.int64)
    spots = low[doc[:len(low)] == doc[TOKENS - 1:]] if len(low) else low
    spots = spots[starts(spots)]
    own = doc[spots]
    left, right = _trees(values, spots, begin[own], begin[own + 1] - 1)
    lo, hi = np.maximum(left, spots - TOKENS + 1), np.minimum(spots, right - TOKENS + 1)
    # The low three bits name the function.
    sig = (mix(tokens[spots] * np.uint64(0x9FB21C651E98DF25) + np.uint64(f)) & ~np.uint64(7)) | np.uint64(f)
    order = np.argsort(lo, kind="stable")
    own, sig, lo, hi, spots = own[order], sig[order], lo[order], hi[order], spots[order]
    fresh = np.ones(len(lo), bool)
    fresh[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1]) | (lo[1:] != hi[:-1] + 1)
    start = np.flatnonzero(fresh)
    hi = hi[np.append(start[1:], len(hi)) - 1] if len(start) else hi
    base = begin[own[start]]
    return own[start], sig[start].view(np.int64), lo[start] - base, hi - base, spots[start] - base


def _tokens(t: ByteTexts) -> tuple[np.ndarray, np.ndarray]:
    first, h = t.windows(SHINGLE)
    return h, np.searchsorted(t.word_doc[first], np.arange(len(t) + 1))


def _packed(lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> np.ndarray:
    return lo << _LO | np.minimum(hi - lo, (1 << _LEN) - 1) << _AHEAD | (c - lo)


def _unpacked(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lo = at >> _LO
    return lo, lo + (at >> _AHEAD & (1 << _LEN) - 1), lo + (at & (1 << _AHEAD) - 1)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of all compact windows; copies within a task once."""
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        new = []
        for i, k in enumerate(zip(*(batch.column(c).to_pylist() for c in _KEY))):
            if k not in seen:
                seen.add(k)
                new.append(i)
        batch = batch.take(pa.array(new, pa.int64()))
        k1, k2 = (batch.column(c).to_numpy() for c in _KEY)
        for lo, _, t in chunks(batch.column("text")):
            h, begin = _tokens(t)
            for f in range(FUNCTIONS):
                own, sig, a, b, c = intervals(h, begin, f)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    sig, k1[lo + own], k2[lo + own], _packed(a, b, c))], ["sig", *_KEY, "at"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The number of words instead of the text."""
    for batch in batches:
        words = [np.diff(t.word_offsets) for _, _, t in chunks(batch.column("text"))]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", *_KEY)), pa.array(np.concatenate(
            [np.zeros(0, np.int64), *words]))], ["doc_id", *_KEY, "n_words"])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as they travel: compressed, since a text goes to each of its pairs."""
    codec = pa.Codec("zstd")
    for batch in batches:
        raw = [t.as_buffer() for t in batch.column("text").cast(pa.large_binary())]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in _KEY), pa.array([len(r) for r in raw], pa.int64()), pa.array(
            [codec.compress(r, asbytes=True) for r in raw], pa.binary())], [*_KEY, "size", "packed"])


def _token_chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, shingles, where each text begins) of consecutive rows."""
    codec, held, total, lo = pa.Codec("zstd"), [], 0, 0
    packed = batch.column("packed")
    for i, size in enumerate(batch.column("size").to_pylist()):
        held.append(codec.decompress(packed[i].as_buffer(), size, asbytes=True))
        total += size
        if total > CHUNK_BYTES or i == batch.num_rows - 1:
            yield lo, *_tokens(ByteTexts.of(held))
            held, total, lo = [], 0, i + 1


def _tokenised(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, h, begin in _token_chunks(batch):
        yield from (h[a:b] for a, b in zip(begin[:-1], begin[1:]))


class _Side:
    """A text of a pair, its shingles as numbers: where each is new to the sliding set."""

    def __init__(self, codes: np.ndarray):
        self.codes, n = codes, len(codes)
        order = np.argsort(codes, kind="stable")
        before = np.full(n, -1)
        same = codes[order[1:]] == codes[order[:-1]]
        before[order[1:][same]] = order[:-1][same]
        at = np.arange(n)
        # Shingle p counts for the stretches from ``first`` to p: those that hold it and no earlier copy.
        self.first, self.last = np.maximum(np.maximum(at - TOKENS, before) + 1, 0), at
        self.distinct = _coverage(self.first, self.last, n)
        self.least = int(self.distinct[:max(n - TOKENS + 1, 0)].min(initial=TOKENS))


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return [(int(a), int(b) - 1) for a, b in zip(edge[::2], edge[1::2])]


def near_stretches(a: np.ndarray, b: np.ndarray, shifts: list[int]) -> Iterator[tuple[int, int, int]]:
    """(shift, first, last) start in ``a`` of runs of stretches near to the one ``shift`` further in ``b``."""
    kinds, codes = np.unique(a, return_inverse=True)
    return _near(kinds, _Side(codes), b, shifts)


def _near(kinds: np.ndarray, x: _Side, b: np.ndarray, shifts: list[int]) -> Iterator[tuple[int, int, int]]:
    """``near_stretches`` of a text with the different shingles ``kinds``, which ``x`` numbers."""
    a = x.codes
    if min(len(a), len(b)) < TOKENS:
        return
    at = np.minimum(np.searchsorted(kinds, b), len(kinds) - 1)
    same, shared = kinds[at] == b, np.zeros(len(kinds), bool)
    shared[at[same]] = True
    # A stretch shares as many shingles as the texts do at most, and its union has its own at least.
    if shared.sum() < THRESHOLD * x.least - 1e-9:
        return
    y = _Side(b)
    if shared.sum() < THRESHOLD * y.least - 1e-9:
        return
    p, q = np.flatnonzero(shared[a]), np.flatnonzero(same)
    # Positions are counted in ``a``, from ``base`` on so that none is negative.
    base = len(a) + len(b)
    span = 2 * base + TOKENS
    for shift in shifts:
        lo, hi = max(0, -shift), min(len(a), len(b) - shift) - TOKENS
        if hi < lo or not len(p):
            continue
        # Ranges of one shingle are disjoint on each side, so two of them overlap where both sides hold it.
        begin = np.concatenate((a[p] * span + x.first[p], at[q] * span + y.first[q] - shift)) + base
        end = np.concatenate((a[p] * span + x.last[p], at[q] * span + y.last[q] - shift)) + base + 1
        # At one place ends come before beginnings.
        where = np.sort(np.concatenate((end << 1, begin << 1 | 1)))
        where, depth = where >> 1, np.cumsum(2 * (where & 1) - 1)
        two = np.flatnonzero(depth[:-1] == 2)
        first = where[two] % span - base
        last = np.minimum(first + where[two + 1] - where[two] - 1, hi)
        first = np.maximum(first, lo)
        live = last >= first
        hits = _coverage(first[live] - lo, last[live] - lo, hi - lo + 1)
        union = x.distinct[lo:hi + 1] + y.distinct[lo + shift:hi + shift + 1] - hits
        for s, e in _runs(hits >= THRESHOLD * union - 1e-9):
            yield shift, lo + s, lo + e


_FOUND = "k1 long, k2 long, o1 long, o2 long, first int, last int"


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by head and lane: the head's text, then those to compare with it."""
    head, kinds, side = None, None, None
    for batch in batches:
        rows: list[tuple] = []
        a1, a2, b1, b2 = (batch.column(c).to_pylist() for c in ("a1", "a2", "b1", "b2"))
        shifts = batch.column("shifts")
        for i, own in enumerate(_tokenised(batch)):
            if b1[i] is None:
                head, (kinds, codes) = (a1[i], a2[i]), np.unique(own, return_inverse=True)
                side = _Side(codes)
                continue
            if head != (a1[i], a2[i]):
                raise ValueError("a pair came before its head")
            for shift, s, e in _near(kinds, side, own, shifts[i].as_py()):
                rows.append((*head, b1[i], b2[i], s, e + WORDS))
                rows.append((b1[i], b2[i], *head, s + shift, e + shift + WORDS))
        if rows:
            columns = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if i < 4 else pa.int32()) for i, c in enumerate(
                columns)], ["k1", "k2", "o1", "o2", "first", "last"])


_PLACES = "sig long, k1 long, k2 long, ahead int, starts array<int>, shingles binary"


def _pieces(tokens: np.ndarray, lo: int, hi: int, c: int) -> Iterator[tuple[int, int, int]]:
    """(first stretch, last stretch, minimum) of a row: as many as its minimum has places."""
    if hi <= c:
        yield lo, hi, c
        return
    for p in (c + np.flatnonzero(tokens[c:hi + TOKENS] == tokens[c])).tolist():
        if lo > hi:
            return
        yield lo, min(p, hi), p
        lo = p + 1


def _places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of large groups with the shingles of their stretches; places of a text with equal ones once."""
    for batch in batches:
        rows, many = batch.column("rows").flatten(), pc.list_value_length(batch.column("rows")).to_numpy().astype(np.int64)
        sigs, ats = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("sig", "at"))
        k1, k2 = (batch.column(k).to_numpy() for k in _KEY)
        bound = np.append(0, np.cumsum(many))
        for top, h, begin in _token_chunks(batch):
            texts = len(begin) - 1
            part = slice(bound[top], bound[top + texts])
            text, sig, (lo, hi, c) = np.repeat(np.arange(texts), many[top:top + texts]), sigs[part], _unpacked(ats[part])
            cut = np.flatnonzero(hi > c)
            pieces = [(i, *x) for i in cut.tolist() for x in _pieces(h[begin[text[i]]:begin[text[i] + 1]], int(lo[i]), int(hi[i]), int(c[i]))]
            if pieces:
                i, *more = np.array(pieces, np.int64).T
                text, sig = (np.append(np.delete(x, cut), x[i]) for x in (text, sig))
                lo, hi, c = (np.append(np.delete(x, cut), y) for x, y in zip((lo, hi, c), more))
            first, size = begin[text] + lo, hi - lo + TOKENS
            key = range_hashes(h, first, first + size) + (size << 7 | c - lo).astype(np.uint64)
            key = mix(mix(key) + sig.view(np.uint64)) + text.astype(np.uint64) * np.uint64(_SEEDS[0])
            order = np.lexsort((lo, key))
            at = starts(key[order])
            # By text and place again: neighbours share shingles, which compresses.
            own = np.argsort(first[order[at]], kind="stable")
            count, at = np.diff(np.append(at, len(order)))[own], at[own]
            one = order[at]
            content = h[spread(first[one], size[one])]
            ends = np.append(0, np.cumsum(size[one] * 8)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(sig[one]), pa.array(k1[top + text[one]]), pa.array(k2[top + text[one]]), pa.array((c - lo)[one].astype(np.int32)),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pa.array(lo[order[spread(at, count)]].astype(
                    np.int32))),
                pa.Array.from_buffers(pa.binary(), len(one), [None, pa.py_buffer(ends), pa.py_buffer(content)])],
                ["sig", *_KEY, "ahead", "starts", "shingles"])


def _windowed(flags: np.ndarray) -> np.ndarray:
    """Sums of each ``TOKENS`` consecutive of 2 * TOKENS - 1 flags."""
    total = np.zeros((len(flags), 2 * TOKENS), np.int16)
    np.cumsum(flags, axis=1, out=total[:, 1:])
    return total[:, TOKENS:] - total[:, :TOKENS]


class _Block:
    """The comparison of one group row by row, which the query no longer uses: ``Groups`` does the same for many at once.
    Rows of one group, aligned at the shared minimum: column ``TOKENS`` - 1 of ``codes``. Stretch s of a row
    has the columns from s on; those of its interval are ``inside``."""

    def __init__(self, text: np.ndarray, ahead: np.ndarray, shingles: list[np.ndarray]):
        n, size = len(text), np.array([len(x) for x in shingles])
        self.shingles, self.ahead, self.text = shingles, ahead, text
        kinds, local = np.unique(np.concatenate(shingles), return_inverse=True)
        row = np.repeat(np.arange(n), size)
        column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + (TOKENS - 1 - ahead)[row]
        # One code more than there are, which no row holds.
        self.codes = np.full((n, 2 * TOKENS - 1), len(kinds), np.int32)
        self.codes[row, column] = local
        self.holds = np.zeros(len(kinds) + 1, bool)
        at = np.arange(TOKENS)
        first = TOKENS - 1 - ahead
        self.inside = (at >= first[:, None]) & (at <= (first + size - TOKENS)[:, None])
        self.distinct = np.full((n, TOKENS), TOKENS, np.int16)
        self.members = np.unique(local * n + row)
        self.repeats = np.bincount(self.members % n, minlength=n) < size
        # The stretches for which a column counts, in rows that repeat shingles: without an earlier equal one.
        self.since = np.full((n if self.repeats.any() else 0, 2 * TOKENS - 1), TOKENS, np.int16)
        self.until = np.minimum(np.arange(2 * TOKENS - 1), TOKENS - 1)
        for i in np.flatnonzero(self.repeats):
            side = _Side(np.searchsorted(kinds, shingles[i]))
            self.distinct[i, self.inside[i]] = side.distinct[:size[i] - TOKENS + 1]
            self.since[i, first[i]:first[i] + size[i]] = np.minimum(side.first + first[i], TOKENS)
        self.least = self.distinct.min(axis=1)
        self.partner = np.full((n, TOKENS), -1)
        self.label = text.copy()
        self.links: list[tuple[int, int, np.ndarray]] = []

    def candidates(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Pairs of rows (left, right) that have the shingles in common that near stretches need. Shingles held
        by the same rows count as one column."""
        code, row = np.divmod(self.members, len(self.text))
        starts = np.flatnonzero(np.concatenate(([True], np.diff(code) != 0)))
        held = np.diff(np.append(starts, len(code)))
        tag = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, len(self.text), dtype=np.uint64)
        pattern = np.add.reduceat(tag[row], starts)
        starts, held, pattern = (x[held > 1] for x in (starts, held, pattern))
        _, pick, weight = np.unique(pattern, return_index=True, return_counts=True)
        both = np.zeros((len(left), len(right)), np.float32)
        for lo in range(0, len(pick), 2048):
            begin, size = starts[pick[lo:lo + 2048]], held[pick[lo:lo + 2048]]
            holds = np.zeros((len(self.text), len(begin)), np.float32)
            holds[row[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())], np.repeat(np.arange(len(begin)), size)] = 1
            both += (holds[left] * weight[lo:lo + 2048].astype(np.float32)) @ holds[right].T
        return (9 * both >= 4 * (self.least[left][:, None] + self.least[right])) & (self.text[left][:, None] != self.text[right])

    def _kinds(self, flags: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Number of different shingles of each stretch of ``rows`` in the columns with ``flags``."""
        out = _windowed(flags)
        again = np.flatnonzero(self.repeats[rows])
        if len(again):
            k, column = np.nonzero(flags[again])
            at, most = k * (TOKENS + 1), len(again) * (TOKENS + 1)
            since, until = self.since[rows[again[k]], column], self.until[column]
            # A column beyond the last stretch, or with an equal one before in all of its own, counts for none.
            until = np.maximum(until, since - 1)
            ends = np.bincount(at + since, minlength=most) - np.bincount(at + until + 1, minlength=most)
            out[again] = np.cumsum(ends.reshape(len(again), -1), axis=1)[:, :TOKENS]
        return out

    def _found(self, i: int, others: np.ndarray, near: np.ndarray) -> None:
        """Stretches ``near`` (a row of flags for each of ``others``) of row i are near."""
        self.partner[others] = np.where(near & (self.partner[others] < 0), i, self.partner[others])
        new = near.any(axis=0) & (self.partner[i] < 0)
        self.partner[i, new] = others[near[:, new].argmax(axis=0)]
        for k in np.flatnonzero(self.label[others] != self.label[i]).tolist():
            j = others[k]
            if self.label[j] != self.label[i]:
                self.links.append((i, j, near[k]))
                self.label[self.label == self.label[j]] = self.label[i]

    def _open(self, i: int, others: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Of ``flags`` those where a stretch is not covered or the texts are not linked."""
        return flags & ((self.partner[i] < 0) | (self.partner[others] < 0) | (self.label[others] != self.label[i])[:, None])

    def compare(self, i: int, others: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Row i with ``others``; returns the pairs left to an exact comparison."""
        own = self.codes[i] < len(self.holds) - 1
        self.holds[self.codes[i, own]] = True
        held = self.holds[self.codes[others]]
        self.holds[self.codes[i, own]] = False
        size = 4 * (self.distinct[others] + self.distinct[i])
        may = self.inside[others] & self.inside[i] & (9 * self._kinds(held, others) >= size)
        some = np.flatnonzero(may.any(axis=1))
        if not len(some):
            return
        others, size, may = others[some], size[some], may[some]
        same = self._kinds((self.codes[others] == self.codes[i]) & own, np.full(len(others), i))
        near = may & (9 * same >= size)
        hit = near.any(axis=1)
        if hit.any():
            self._found(i, others[hit], near[hit])
        rest = self._open(i, others, may & ~near)
        for k in np.flatnonzero(rest.any(axis=1)):
            yield i, others[k], rest[k]

    def exact(self, i: int, j: int, flags: np.ndarray) -> None:
        if self._open(i, np.array([j]), flags[None]).any():
            near = np.zeros((1, TOKENS), bool)
            for _, s, e in near_stretches(self.shingles[i], self.shingles[j], [int(self.ahead[j] - self.ahead[i])]):
                near[0, s + TOKENS - 1 - self.ahead[i]:e + TOKENS - self.ahead[i]] = True
            if near.any():
                self._found(i, np.array([j]), near)

    def found(self) -> Iterator[tuple[int, int, int]]:
        """(row, first, last): runs of stretches that are near to another text's, counted from the row's first one."""
        flags = np.zeros((len(self.text), TOKENS + 2), np.int8)
        flags[:, 1:-1] = self.partner >= 0
        edge = np.diff(flags, axis=1)
        row, at = np.nonzero(edge > 0)
        base = TOKENS - 1 - self.ahead[row]
        return zip(row.tolist(), (at - base).tolist(), (np.nonzero(edge < 0)[1] - 1 - base).tolist())

    def stars(self) -> Iterator[tuple[int, int]]:
        """(row, row of the smallest text linked to it), once for each linked text."""
        order = np.lexsort((self.text, self.label))
        centre = None
        for i, k in zip(order.tolist(), [-1, *order.tolist()]):
            if k < 0 or self.label[i] != self.label[k]:
                centre = i
            elif self.text[i] != self.text[k]:
                yield i, centre


def _compared(rows: pa.RecordBatch) -> pa.RecordBatch:
    """Found rows of groups (each two chunks of a signature's rows, or one with itself)."""
    k1, k2, sig, chunk, ci, cj = (rows.column(c).to_numpy() for c in (*_KEY, "sig", "chunk", "ci", "cj"))
    order = np.lexsort((k2, k1))
    text, new = np.empty(len(k1), np.int64), np.ones(len(k1), bool)
    new[1:] = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
    text[order] = np.cumsum(new) - 1
    k1, k2 = k1[order][new], k2[order][new]
    new = np.ones(len(sig), bool)
    new[1:] = (np.diff(sig) != 0) | (np.diff(ci) != 0) | (np.diff(cj) != 0)
    group = np.cumsum(new) - 1
    shingles, lists = rows.column("shingles"), rows.column("starts")
    offsets = np.frombuffer(shingles.buffers()[1], np.int32)[shingles.offset:shingles.offset + len(shingles) + 1]
    block = Groups(group, text, np.where(chunk == ci, 1, 2), (ci != cj)[new], rows.column("ahead").to_numpy().astype(np.int64), np.diff(
        offsets).astype(np.int64) // 8, np.frombuffer(shingles.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.uint64), TOKENS)
    # Runs of covered stretches, at each place of the row; of one text as one range where they meet.
    covered, fresh = block.covered(), np.ones(len(block.row) + 1, bool)
    fresh[1:-1] = block.row[1:] != block.row[:-1]
    before, after = np.append(False, covered[:-1]) & ~fresh[:-1], np.append(covered[1:], False) & ~fresh[1:]
    first, last = np.flatnonzero(covered & ~before), np.flatnonzero(covered & ~after)
    row, first, last = block.row[first], *(block.at[x] - block.begin[block.row[x]] for x in (first, last))
    places = pc.list_value_length(lists).to_numpy().astype(np.int64)
    every = np.repeat(np.arange(len(row)), places[row])
    at = lists.flatten().to_numpy()[spread((np.cumsum(places) - places)[row], places[row])].astype(np.int64)
    first, last = text[row[every]] << 32 | at + first[every], text[row[every]] << 32 | at + last[every] + WORDS
    order = np.argsort(first, kind="stable")
    first, last = first[order], np.maximum.accumulate(last[order]) if len(order) else last
    new = np.ones(len(first), bool)
    new[1:] = first[1:] > last[:-1]
    first, last = first[new], last[np.append(np.flatnonzero(new)[1:], len(last)) - 1] if len(last) else last
    linked = np.flatnonzero(block.label != np.arange(len(block.label)))
    own, other = np.append(first >> 32, linked), block.label[linked]
    ends = [pa.array((x & (1 << 32) - 1).astype(np.int32)) for x in (first, last)]
    return pa.RecordBatch.from_arrays([pa.array(k1[own]), pa.array(k2[own]), *(pa.concat_arrays([pa.nulls(len(first), pa.int64()), pa.array(
        k[other])]) for k in (k1, k2)), *(pa.concat_arrays([x, pa.nulls(len(linked), pa.int32())]) for x in ends)], [*_KEY, "o1", "o2", "first", "last"])


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by group and chunks; whole groups are compared, up to ``CHUNK`` rows (or one group) at a time."""
    held: list[pa.RecordBatch] = []
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held += [batch] * (batch.num_rows > 0)
            if sum(b.num_rows for b in held) < CHUNK:
                continue
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        group = np.stack([rows.column(c).to_numpy() for c in ("sig", "ci", "cj")])
        edges = np.array([0, *(np.flatnonzero((np.diff(group) != 0).any(axis=0)) + 1).tolist(), rows.num_rows])
        end, i = len(edges) - 1 - (batch is not None), 0
        while i < end:
            j = min(max(i + 1, int(np.searchsorted(edges, edges[i] + CHUNK, "right")) - 1), end)
            yield _compared(rows.slice(edges[i], edges[j] - edges[i]))
            i = j
        held = [rows.slice(edges[end])] if batch is not None else []


def _differ(*columns: str) -> list[Column]:
    """Aggregates that tell whether a group holds two different texts."""
    return [g(c).alias(f"{n}_{c}") for c in columns for n, g in (("low", F.min), ("high", F.max))]


_DIFFERENT = "low_k1 != high_k1 OR low_k2 != high_k2"


def _middle(at: Column) -> Column:
    return (F.shiftright(at, _LO) + at.bitwiseAND(F.lit((1 << _AHEAD) - 1))).cast("int")


def _pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b: a < b) of texts that meet in small groups, with their diagonals."""
    side = lambda n: rows.select("sig", F.col("k1").alias(f"{n}1"), F.col("k2").alias(f"{n}2"), _middle(F.col("at")).alias(n))
    met = side("a").join(side("b"), "sig").where("a1 < b1 OR (a1 = b1 AND a2 < b2)")
    return saved(met.groupBy(*_PAIR).agg(F.collect_set(F.col("b") - F.col("a")).alias("shifts"), F.size(F.collect_set(
        "sig")).alias("shared")), "passage-pairs")


def _placed(rows: DataFrame, texts: DataFrame) -> DataFrame:
    lists = rows.groupBy(*_KEY).agg(F.collect_list(F.struct("sig", "at")).alias("rows"))
    return saved(lists.join(texts, _KEY).mapInArrow(_places, _PLACES), "passage-places")


def _grouped(places: DataFrame) -> DataFrame:
    """What is near in large groups."""
    many = saved(places.groupBy("sig").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("n")).where("n > 1"), "passage-many")
    own = F.pmod(F.xxhash64(*_KEY, "shingles"), F.col("n")).cast("int")
    dealt = places.join(broadcast_if_bounded(many), "sig", "left").withColumn("n", F.coalesce("n", F.lit(1))).withColumn(
        "chunk", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "sig", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"), "chunk", *_KEY, "ahead", "starts",
        "shingles")
    order = ["sig", "ci", "cj"]
    found = saved(dealt.repartition(*order).sortWithinPartitions(*order, *_KEY).mapInArrow(_compare, _FOUND), "passage-near")
    forget(places)
    return found


def _supported(pairs: DataFrame, entries: DataFrame) -> DataFrame:
    """Pairs with two signatures in common, be they of groups where the two were not compared."""
    weak = pairs.where("shared < 2")
    lists = saved(entries.groupBy(*_KEY).agg(F.collect_set("sig").alias("sigs")), "passage-lists")
    side = lambda n: lists.select(F.col("k1").alias(f"{n}1"), F.col("k2").alias(f"{n}2"), F.col("sigs").alias(n))
    kept = weak.join(side("a"), ["a1", "a2"]).join(side("b"), ["b1", "b2"]).where(F.size(F.array_intersect("a", "b")) > 1)
    kept = saved(pairs.where("shared >= 2").union(kept.select(*pairs.columns)).drop("shared"), "passage-candidates")
    forget(lists, pairs)
    return kept


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    heads = saved(pairs.groupBy("a1", "a2").agg(F.ceil(F.count("*") / LANE).cast("int").alias("lanes")), "passage-lanes")
    lane = F.pmod(F.xxhash64("b1"), F.col("lanes")).cast("int")
    laid = pairs.join(heads, ["a1", "a2"]).select("a1", "a2", lane.alias("lane"), "b1", "b2", "shifts").join(
        texts.withColumnsRenamed({"k1": "b1", "k2": "b2"}), ["b1", "b2"])
    first = heads.join(texts.withColumnsRenamed({"k1": "a1", "k2": "a2"}), ["a1", "a2"]).select(
        "a1", "a2", F.explode(F.sequence(F.lit(0), F.col("lanes") - 1)).alias("lane"), F.lit(None).cast("long").alias("b1"),
        F.lit(None).cast("long").alias("b2"), F.lit(None).cast("array<int>").alias("shifts"), "size", "packed")
    order = ["a1", "a2", "lane"]
    return saved(first.unionByName(laid).repartition(*order).sortWithinPartitions(*order, F.asc_nulls_first("b1")).mapInArrow(
        _verify, _FOUND), "passage-found")


def passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``class_id`` (the smallest id of the documents reachable over links),
    ``n_words``, ``n_dup_words``, ``n_passages`` and ``passages`` (start, end in words, end exclusive)."""
    body = F.coalesce(F.col(text), F.lit(""))
    half = lambda i: F.conv(F.substring(F.md5(body), 16 * i + 1, 16), 16, -10).cast("long").alias(_KEY[i])
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), half(0), half(1))
    signed = saved(rows.select(*_KEY, "text").mapInArrow(_sign, _ROW), "passage-signed")
    shared = saved(signed.groupBy("sig").agg(*_differ(*_KEY)).where(_DIFFERENT).select("sig"), "passage-shared")
    entries = saved(signed.join(shared, "sig").distinct(), "passage-entries")
    forget(signed, shared)

    schema = rows.select("doc_id", *_KEY, F.lit(0).cast("long").alias("n_words")).schema
    narrow = saved(rows.select("doc_id", *_KEY, "text").mapInArrow(_counted, schema), "passage-rows")
    copies = saved(narrow.groupBy(*_KEY).agg(F.count("*").alias("copies"), F.min("doc_id").alias("one")), "passage-copies")
    wanted = saved(entries.select(*_KEY).distinct().join(copies, _KEY).select(*_KEY, "one"), "passage-wanted")
    chosen = rows.join(broadcast_if_bounded(wanted), (rows.k1 == wanted.k1) & (rows.k2 == wanted.k2) & rows.doc_id.eqNullSafe(
        wanted.one), "left_semi")
    texts = saved(chosen.select(*_KEY, "text").mapInArrow(_pack, "k1 long, k2 long, size long, packed binary").dropDuplicates(_KEY),
                  "passage-texts")

    # A row with its minimum at several places meets others at several diagonals.
    one = F.shiftright("at", _AHEAD).bitwiseAND(F.lit((1 << _LEN) - 1)) <= F.col("at").bitwiseAND(F.lit((1 << _AHEAD) - 1))
    small = saved(entries.groupBy("sig").agg(F.count("*").alias("n"), F.min(one).alias("one")).where(
        (F.col("n") <= SMALL) & F.col("one")).select("sig"), "passage-small")
    pairs = _supported(_pairs(entries.join(small, "sig", "left_semi")), entries)
    found, places = _verified(pairs, texts), _placed(entries.join(small, "sig", "left_anti"), texts)
    forget(entries, texts, pairs, small)
    return _report(narrow, copies, found.union(_grouped(places)))


def _edges(found: DataFrame) -> DataFrame:
    """Links of texts. Large groups give them in rows of their own, as stars; a text has one centre for each call of
    ``_compared`` at most, and these are linked to the smallest, so that most texts give the same links."""
    node = lambda a, b: F.concat_ws(":", a, b)
    links = found.where("o1 IS NOT NULL").select(node("k1", "k2").alias("a"), node("o1", "o2").alias("b"), F.col("first").isNull().alias("star"))
    stars = links.where("star").groupBy("a").agg(F.collect_set("b").alias("centres")).withColumn("b", F.array_min("centres"))
    centred = stars.select(F.explode(F.concat(F.array("a"), F.array_remove("centres", F.col("b")))).alias("a"), "b")
    return links.where("NOT star").select("a", "b").union(centred).distinct()


def _report(narrow: DataFrame, copies: DataFrame, found: DataFrame) -> DataFrame:
    node = lambda a, b: F.concat_ws(":", a, b)
    labels = components(_edges(found))
    named = copies.withColumn("node", node("k1", "k2")).join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node"))
    classes = named.join(named.groupBy("label").agg(F.min("one").alias("class_id")), "label").select(*_KEY, "copies", "class_id")
    span = "struct<start:int,end:int>"
    grow = F.aggregate("spans", F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(None).cast(span).alias("open")),
                       lambda acc, s: F.when(acc["open"].isNotNull() & (acc["open"]["end"] >= s["first"]), F.struct(
                           acc["done"].alias("done"), F.struct(acc["open"]["start"].alias("start"), F.greatest(
                               acc["open"]["end"], s["last"]).alias("end")).alias("open"))).otherwise(F.struct(
                                   F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(
                                       acc["open"]))).alias("done"), F.struct(s["first"].alias("start"), s["last"].alias(
                                           "end")).alias("open"))),
                       lambda acc: F.concat(acc["done"], F.array(acc["open"])))
    # Ranges of one start keep the longest, so a text with many partners has one row per start at most.
    spans = found.where("first IS NOT NULL").groupBy(*_KEY, "first").agg(F.max("last").alias("last")).groupBy(*_KEY).agg(F.array_sort(F.collect_list(
        F.struct("first", "last"))).alias("spans")).select(*_KEY, grow.alias("spans"))
    whole = (F.col("copies") > 1) & (F.col("n_words") >= WORDS)
    all_ = F.array(F.struct(F.lit(0).alias("start"), F.col("n_words").cast("int").alias("end")))
    out = narrow.join(classes, _KEY).join(spans, _KEY, "left").select(
        "doc_id", F.when(F.col("n_words") >= WORDS, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), "n_words",
        F.when(whole, all_).otherwise(F.coalesce("spans", F.array().cast(f"array<{span}>"))).alias("passages"))
    covered = F.aggregate("passages", F.lit(0), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("doc_id", "class_id", "n_words", covered.cast("long").alias("n_dup_words"), F.size("passages").cast(
        "long").alias("n_passages"), "passages")
