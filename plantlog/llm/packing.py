"""Packing token streams into windows by minimum bin slack.

A document is its token ids and one end token. Every ``WINDOW`` ids of it fill a sequence alone; what is
left over, 1 to ``WINDOW - 1`` ids, is packed with the leftovers of other documents. Only the *number* of
leftovers per length matters for that, so the plan works on a table of at most ``WINDOW - 1`` counts,
whatever the size of the input:

1. The longest length opens a window. A subset-sum DP over the counts, on the bits of one integer (bit s:
   the sum s is reachable), finds the multiset that comes closest to the window; the stored bits are walked
   back to counts per length.
2. That pattern is repeated as often as the counts allow, so each pattern uses up a length.
3. Where no multiset fills the window, one more leftover is cut at the slack, and its rest goes back to
   the counts.
4. What does not fill a window any more goes into sequences of a power of two by the same steps, so
   no padding is left and only the documents of steps 3 and 4 are cut more than the window forces.

Scale: texts are read and tokenised once, ids are written with the number of earlier leftovers of equal
length in the partition; counts per (partition, length) are summed to places. The plan, a few rows per
pattern, is joined by length and place. No document is shuffled while the counts are small enough for
a checked broadcast, none ever meets another one, and sequences exist as numbers only.

Texts are cut where a non-space meets a space, which no token of the byte-level pattern spans, and each
distinct stretch of a batch is tokenised once; a worker remembers up to ``KNOWN`` of them, as arrays. The ids
are those of the whole text.

Defined results: null and empty texts are one end token; a document without id keeps its row, repeated rows
are packed each for itself; long texts are tokenised by stretches; an empty table gives an empty
table; only id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plantlog.functions.sizing import broadcast_if_bounded
from plantlog.llm.common import ByteTexts, chunks, saved

WINDOW, END = 1024, 0
TEXT_BYTES, JOINED_BYTES, KNOWN = 4 << 20, 1 << 15, 1_200_000
# Bytes after which a space starts a new stretch: no white space, nor the last byte of any.
_SOLID = np.zeros(256, bool)
_SOLID[0x21:0x7F] = _SOLID[0x80:] = True
_SOLID[[*range(0x80, 0x8B), 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = False
_CODED = "id {}, ids binary, tokens long, part int, length int, earlier long, windows long"
_PLAN = "length int, low long, high long, start int, size int, first long, per int, sequence long, at int, capacity int"


class Encoder:
    """Token ids of the texts of a batch, equal stretches once.

    A stretch that begins with a space and ends solid keeps its ids in any company of such stretches, so
    these are tokenised joined; the bytes of the tokens tell where each one ends."""

    def __init__(self, path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.kind = np.uint16 if max(vocabulary.values()) < 1 << 16 else np.uint32
        # Byte-level tokens are written with one character per byte.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(token) for token in vocabulary]
        # Hashes in order, the stretches as they came, their ids, and where each one's ids begin.
        none = np.zeros(0, np.int64)
        self.known = none.view(np.uint64), ByteTexts.of([]), np.zeros(0, self.kind), np.zeros(1, np.int64)
        self.order = none

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]

    def _flat(self, lists: list[list[int]]) -> np.ndarray:
        return np.fromiter((v for ids in lists for v in ids), self.kind, sum(map(len, lists)))

    def _stretches(self, t: ByteTexts) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of ``t``, one after the other, and where each text's begin."""
        size = np.diff(t.offsets)
        edges = t.data[np.minimum(t.offsets[:-1], len(t.data) - 1)], t.data[np.maximum(t.offsets[1:] - 1, 0)]
        joined = (size > 0) & (edges[0] == 32) & _SOLID[edges[1]]
        ends = np.cumsum(size[joined])
        company = t.data[np.repeat(joined, size)]
        cuts = ends[np.unique(np.searchsorted(ends, np.arange(JOINED_BYTES, len(company), JOINED_BYTES)))]
        cuts = np.unique(np.concatenate(([0], cuts, [len(company)])))
        together = self._flat(self._ids([company[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]))
        reached = np.concatenate(([0], np.cumsum(self.bytes[together])))
        at = np.searchsorted(reached, ends)
        if not np.array_equal(reached[np.minimum(at, len(reached) - 1)], ends):
            raise ValueError("a token spans two stretches: the tokenizer is not the byte-level kind")
        alone = self._ids([t.text(i) for i in np.flatnonzero(~joined).tolist()])
        many = np.zeros(len(size), np.int64)
        many[joined], many[~joined] = np.diff(at, prepend=0), [len(x) for x in alone]
        out, owner = np.zeros(many.sum(), self.kind), np.repeat(joined, many)
        out[owner], out[~owner] = together, self._flat(alone)
        return out, np.concatenate(([0], np.cumsum(many)))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        if not len(data):
            return [np.zeros(0, self.kind)] * (len(offsets) - 1)
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        cut[1:-1] |= (data[1:] == 32) & _SOLID[data[:-1]]
        at = np.flatnonzero(cut)
        size, start = np.diff(at), at[:-1]
        h, first, same = np.unique(ByteTexts(data, at).hashes(start, at[1:]), return_index=True, return_inverse=True)
        if not np.array_equal(size, size[first][same]) or not np.array_equal(
                data, data[_ranges(start[first][same], size)]):
            # Two stretches share a hash: each stands for itself.
            h, first, same = None, np.arange(len(size)), np.arange(len(size))
        flat, begin = self._remembered(h, _picked(data, start[first], size[first]))
        many = np.diff(begin)[same]
        ends = np.concatenate(([0], np.cumsum(many)))
        return np.split(flat[_ranges(begin[:-1][same], many)], ends[np.searchsorted(at, offsets[1:-1])])

    def _remembered(self, h: np.ndarray | None, t: ByteTexts) -> tuple[np.ndarray, np.ndarray]:
        """``_stretches`` of different texts with hashes ``h``, those of earlier calls without the tokenizer."""
        keys, texts, ids, begin = self.known
        if h is None or not len(keys):
            found, at = np.zeros(len(t), bool), np.zeros(len(t), np.int64)
        else:
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            at = np.where(keys[at] == h, self.order[at], 0)
            size = np.diff(t.offsets)
            found = (keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h) & (np.diff(texts.offsets)[at] == size)
            # Equal hashes are taken for equal texts only where the bytes are equal too.
            same = t.data[np.repeat(found, size)] == texts.data[_ranges(texts.offsets[at[found]], size[found])]
            if not same.all():
                found[:] = False
        new = _picked(t.data, t.offsets[:-1][~found], np.diff(t.offsets)[~found])
        fresh, cut = self._stretches(new)
        many = np.zeros(len(t), np.int64)
        many[found], many[~found] = np.diff(begin)[at[found]], np.diff(cut)
        out, owner = np.zeros(many.sum(), self.kind), np.repeat(found, many)
        out[owner], out[~owner] = ids[_ranges(begin[at[found]], many[found])], fresh
        if h is not None:
            self._remember(h[~found], new, fresh, cut)
        return out, np.concatenate(([0], np.cumsum(many)))

    def _remember(self, h: np.ndarray, t: ByteTexts, ids: np.ndarray, begin: np.ndarray) -> None:
        keys, texts, old, at = self.known
        if len(keys) + len(h) <= KNOWN and len(keys):
            h = np.concatenate((keys[np.argsort(self.order)], h))
            t = ByteTexts(np.concatenate((texts.data, t.data)), np.concatenate((texts.offsets, texts.offsets[-1] + t.offsets[1:])))
            ids, begin = np.concatenate((old, ids)), np.concatenate((at, at[-1] + begin[1:]))
        self.order = np.argsort(h, kind="stable")
        self.known = h[self.order], t, ids, begin


@cache
def _encoder(path: str) -> Encoder:
    """One per worker, with what it remembers."""
    return Encoder(path)


def _picked(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> ByteTexts:
    return ByteTexts(data[_ranges(start, size)], np.concatenate(([0], np.cumsum(size))))


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., ``size[0]`` numbers, then those of the next range."""
    before = np.cumsum(size) - size
    return np.arange(size.sum(), dtype=np.int32) + np.repeat((start - before).astype(np.int32), size)


def _encode(path: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        encoder, part, windows = _encoder(path), TaskContext.get().partitionId(), 0
        seen = np.zeros(window, np.int64)
        for batch in batches:
            for lo, hi, t in chunks(batch.column("text"), TEXT_BYTES):
                ids = [np.append(x, encoder.kind(END)) for x in encoder(t.data, t.offsets)]
                tokens = np.array([len(x) for x in ids], np.int64)
                length, full, earlier = tokens % window, tokens // window, np.zeros(hi - lo, np.int64)
                for i, n in enumerate(length.tolist()):
                    earlier[i] = seen[n]
                    seen[n] += 1
                before = windows + np.cumsum(full) - full
                windows += int(full.sum())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array([x.tobytes() for x in ids], pa.binary()),
                     pa.array(tokens), pa.array(np.full(hi - lo, part, np.int32)), pa.array(length.astype(np.int32)),
                     pa.array(earlier), pa.array(before)],
                    ["id", "ids", "tokens", "part", "length", "earlier", "windows"])
    return run


def closest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of ``counts`` with the largest sum up to ``room``, as counts per length; long
    lengths come first. Counts are split into doublings, so a length adds few steps whatever its count."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x in counts if x <= room and counts[x]), reverse=True):
        left, take = min(counts[length], room // length), 1
        while left:
            take = min(take, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        # A sum that was reachable without this step does not need it.
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


class Lots:
    """Leftovers by current length: runs of places of one original length, each from ``start`` on."""

    def __init__(self, counts: dict[int, int]):
        self.lots = {n: [(n, 0, c, 0)] for n, c in counts.items() if c}
        self.counts = {n: c for n, c in counts.items() if c}

    def add(self, length: int, lot: tuple[int, int, int, int]) -> None:
        if length:
            self.lots.setdefault(length, []).append(lot)
            self.counts[length] = self.counts.get(length, 0) + lot[2]

    def take(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        """(original length, first place, how many, start) of ``n`` leftovers."""
        self.counts[length] -= n
        if not self.counts[length]:
            del self.counts[length]
        out, lots = [], self.lots[length]
        while n:
            origin, low, have, start = lots.pop()
            k = min(n, have)
            out.append((origin, low, k, start))
            if k < have:
                lots.append((origin, low + k, have - k, start))
            n -= k
        return out


def slack_plan(counts: dict[int, int], window: int = WINDOW) -> list[tuple]:
    """Rows of ``_PLAN``: places ``low`` to ``high`` of the leftovers of ``length`` put ``size`` ids from
    ``start`` into sequences; the i-th of them, counted from ``first``, goes to sequence
    ``sequence + i // per`` at ``at + i % per * size``."""
    lots, plan, sequence, room = Lots(counts), [], 0, window
    total = sum(n * c for n, c in counts.items())
    while total:
        while room > total:
            room //= 2
        longest = max(lots.counts)
        if longest > room:
            # Only the tail has rooms below the window: a leftover longer than the room is cut to it.
            pattern, slack = {}, room
        else:
            pattern = closest({**lots.counts, longest: lots.counts[longest] - 1}, room - longest)
            pattern[longest] = pattern.get(longest, 0) + 1
            times = min(lots.counts[n] // k for n, k in pattern.items())
            slack = room - sum(n * k for n, k in pattern.items())
        if slack:
            # Everything that is left is longer than the slack; the longest is cut.
            torn = max(n for n, c in lots.counts.items() if c > pattern.get(n, 0))
            times = min(lots.counts[n] // (pattern.get(n, 0) + (n == torn)) for n in {*pattern, torn})
        at = 0
        for length, k in sorted(pattern.items(), reverse=True):
            first = 0
            for origin, low, n, start in lots.take(length, k * times):
                plan.append((origin, low, low + n, start, length, first, k, sequence, at, room))
                first += n
            at += length * k
        if slack:
            first = 0
            for origin, low, n, start in lots.take(torn, times):
                plan.append((origin, low, low + n, start, slack, first, 1, sequence, at, room))
                lots.add(torn - slack, (origin, low, n, start + slack))
                first += n
        sequence += times
        total -= room * times
    return plan


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            picks: list[int] = []
            for i, r in enumerate(batch.drop_columns(["id"]).to_pylist()):
                tokens = r["tokens"]
                kind = np.uint16 if len(r["ids"]) == 2 * tokens else np.uint32
                ids, full = np.frombuffer(r["ids"], kind).astype("<u4").tobytes(), tokens // window
                crc = lambda a, n: zlib.crc32(ids[4 * a:4 * (a + n)])
                here = []
                if not r["start"]:
                    here = [(w * window, window, crc(w * window, window), tokens, r["alone"] + w, 0) for w in range(full)]
                if r["start"] is not None:
                    a = full * window + r["start"]
                    here.append((a, r["size"], crc(a, r["size"]), tokens, r["sequence"], r["at"]))
                rows += here
                picks += [i] * len(here)
            columns = [pa.array(c, pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * 6
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(picks, pa.int64())), *columns], [
                "id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
    return run


def pack(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.
    ``tokenizer`` is the path of a tokenizer file that every executor can read."""
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    coded = saved(rows.mapInArrow(_encode(tokenizer, window), _CODED.format(kind)), "pack-ids")

    earlier = Window.partitionBy("length").orderBy("part")
    counts = saved(coded.groupBy("part", "length").count().select("part", "length", "count", (
        F.sum("count").over(earlier) - F.col("count")).alias("before")), "pack-counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    totals.pop(0, None)
    plan = slack_plan(totals, window)
    places = spark.createDataFrame(plan, _PLAN)
    used = max((p[7] + (p[5] + p[2] - p[1] - 1) // p[6] + 1 for p in plan), default=0)

    whole = coded.groupBy("part").agg(F.sum(F.floor(F.col("tokens") / window)).alias("n"))
    whole = saved(whole.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n") + used).alias("base")), "pack-windows")
    here = coded.join(broadcast_if_bounded(counts.select("part", "length", "before")), ["part", "length"]).join(
        broadcast_if_bounded(whole), "part").withColumn("place", F.col("before") + F.col("earlier")).alias("d")
    i = F.col("first") + F.col("place") - F.col("low")
    placed = here.join(F.broadcast(places).alias("p"), (F.col("d.length") == F.col("p.length")) & (
        F.col("place") >= F.col("low")) & (F.col("place") < F.col("high")), "left").select(
        "id", "ids", "tokens", (F.col("base") + F.col("windows")).alias("alone"), "start", "size", (
            F.col("sequence") + F.floor(i / F.col("per"))).alias("sequence"), (
            F.col("at") + i % F.col("per") * F.col("size")).alias("at"))
    return placed.mapInArrow(_cut(window), f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                             "sequence_id long, offset long").withColumnRenamed("id", doc_id)
