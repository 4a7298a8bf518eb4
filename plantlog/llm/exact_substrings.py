"""Removal of exactly repeated byte strings with sharded suffix arrays.

A byte goes when it lies in a string of ``LENGTH`` bytes that also starts anywhere else. Every window of
``LENGTH`` bytes has an *anchor*: its smallest-hashed gram of ``GRAM`` bytes (the leftmost of equals).
Equal windows have equal anchors at equal places, so a hash of the anchor deals windows to shards.

1. Anchors of all texts are counted by one aggregation. A window whose anchor occurs once is unique;
   windows of repeated anchors are left.
2. Runs of such windows with one anchor are *stretches*. Equal stretches of an anchor become one with a
   count. An anchor with a single stretch is decided by its count; the others go to shards.
3. A shard concatenates its stretches, sorts their suffixes by induced sorting and computes permuted
   common prefixes; suffixes with ``LENGTH`` common bytes form runs, and a window is repeated when its
   run holds another window start (or its stretch a second occurrence).
4. Repeated windows become byte ranges per text, merged and cut out.

Anchors with over ``WIDE`` different stretches are split by the windows' place before the anchor, and
those with over ``HOT`` into single windows by place and a salt of their bytes, which loses no match.
Texts of fewer bytes, and equal texts (decided whole), never reach these steps. Texts are told apart by
their MD5 digest.

Defined results: a null text is empty; repeated rows and equal texts are copies of each other; an empty
table gives an empty table; only ``doc_id`` and ``text`` are read. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantlog.functions.sizing import broadcast_if_bounded
from plantlog.llm.common import ByteTexts, chunks, saved
from plantlog.llm.suffix_array import permuted_lcp, suffix_array

LENGTH, GRAM = 400, 200
SPAN = LENGTH - GRAM + 1
WIDE, STEP, HOT = 64, 32, 4096
SHARD_BYTES = 400_000
#: Bytes that a task holds as arrays at a time: some fifteen of eight bytes each.
_PIECE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)


def digest(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _windowed_min(v: np.ndarray) -> np.ndarray:
    """Smallest of every ``SPAN`` consecutive values."""
    n = len(v) - SPAN + 1
    pad = np.full(-len(v) % SPAN, np.iinfo(np.uint64).max, np.uint64)
    blocks = np.concatenate((v, pad)).reshape(-1, SPAN)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[SPAN - 1:SPAN - 1 + n])


def anchors(t: ByteTexts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first window, anchor place) of all runs of windows with one anchor, by position in the
    joined bytes; a run ends where the next begins or where its text has no more windows."""
    if len(t.data) < LENGTH:
        return (np.zeros(0, np.int64),) * 3
    at = np.arange(len(t.data) - GRAM + 1)
    h = t.hashes(at, at + GRAM)
    low = _windowed_min((h & ~_PLACE) | at.astype(np.uint64))
    place = (low & _PLACE).astype(np.int64)
    doc = np.searchsorted(t.offsets, np.arange(len(place)), "right") - 1
    valid = np.arange(len(place)) + LENGTH <= t.offsets[doc + 1]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~valid[:-1]
    start = np.flatnonzero(new & valid)
    return doc[start], start, place[start]


def _parts(column: pa.Array) -> Iterator[tuple[int, int, ByteTexts, int]]:
    """(first row, end row, texts, byte offset in the row): chunks of rows, longer rows in pieces that
    overlap by one window less a byte."""
    for lo, hi, t in chunks(column, _PIECE):
        if len(t.data) <= _PIECE:
            yield lo, hi, t, 0
            continue
        for k in range(lo, hi):
            whole = t.text(k - lo)
            for a in range(0, max(1, len(whole) - LENGTH + 1), _PIECE):
                yield k, k + 1, ByteTexts.of([whole[a:a + _PIECE + LENGTH - 1]]), a


def _count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        short = batch.column("k").to_numpy()
        for lo, hi, t, _ in _parts(batch.column("text")):
            doc, _, place = anchors(t)
            if len(doc):
                where, first = np.unique(place, return_index=True)
                fp = t.hashes(where, where + GRAM).view(np.int64)
                pair, n = np.unique(np.stack((short[lo + doc[first]], fp), 1), axis=0, return_counts=True)
                if len(t.data) > _PIECE // 2 and hi - lo == 1:
                    n[:] = 2  # a text in pieces: its other pieces may hold the anchor again
                yield pa.RecordBatch.from_arrays(
                    [pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy()), pa.array(n.astype(np.int32))],
                    ["k", "fp", "n"])


def _stretches(t: ByteTexts, repeated: list[np.ndarray]):
    """(text, first window, windows, anchor place, anchor hash) of the runs whose anchor is repeated;
    ``repeated``: hashes of each text's repeated anchors."""
    doc, start, place = anchors(t)
    end = np.minimum(np.append(start[1:], len(t.data)), t.offsets[doc + 1] - LENGTH + 1)
    fp = t.hashes(place, place + GRAM).view(np.int64)
    cuts = np.searchsorted(doc, np.arange(len(t) + 1))
    keep = np.concatenate([np.isin(fp[a:b], own) for a, b, own in zip(cuts[:-1], cuts[1:], repeated)])
    return doc[keep], start[keep], (end - start)[keep], place[keep], fp[keep]


_ROWS = "key binary, fp long, cid long, first int, windows int, lead int"


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column("fps")
        keys = batch.column("key").to_pylist()
        for lo, hi, t, skip in _parts(batch.column("text")):
            sets = [np.asarray(fps[i].values) for i in range(lo, hi)]
            d, a, n, p, f = _stretches(t, sets)
            if len(d):
                cid = t.hashes(a, a + n + LENGTH - 1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([keys[lo + i] for i in d], pa.binary()), pa.array(f), pa.array(cid), pa.array(
                        (a - t.offsets[d] + skip).astype(np.int32)), pa.array(n.astype(np.int32)),
                     pa.array((p - a).astype(np.int32))], ["key", "fp", "cid", "first", "windows", "lead"])


_SHARDED = "shard long, fp long, cid long, n long, at int, windows int, content binary"


def _mixed(*values: int) -> int:
    return int.from_bytes(hashlib.blake2b(repr(values).encode(), digest_size=8).digest(), "little", signed=True)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of chosen stretches, split as their anchor's width asks."""
    for batch in batches:
        for text, picks in zip(batch.column("text"), batch.column("picks").to_pylist()):
            raw = text.as_buffer()
            out = []
            for p in picks:
                cuts = [(0, p["windows"], _mixed(p["fp"]))]
                if p["kinds"] > HOT:
                    salts = -(-p["kinds"] // HOT)
                    cuts = []
                    for i in range(p["windows"]):
                        a = p["first"] + i
                        salt = int.from_bytes(hashlib.blake2b(raw[a:a + LENGTH], digest_size=4).digest(), "little")
                        cuts.append((i, i + 1, _mixed(p["fp"], p["lead"] - i, salt % salts)))
                elif p["kinds"] > WIDE:
                    group = (p["lead"] - np.arange(p["windows"])) // STEP
                    edge = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), p["windows"]]
                    cuts = [(a, b, _mixed(p["fp"], int(group[a]))) for a, b in zip(edge[:-1], edge[1:])]
                for a, b, shard in cuts:
                    lo = p["first"] + a
                    out.append((shard, p["fp"], p["cid"], p["n"], a, b - a, raw[lo:lo + b - a + LENGTH - 1].to_pybytes()))
            cols = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (
                pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()))],
                ["shard", "fp", "cid", "n", "at", "windows", "content"])


def repeated_windows(contents: list[bytes], windows: list[int], counts: list[int]) -> list[np.ndarray]:
    """For each stretch, which of its windows occur elsewhere, in it, or in another of its occurrences."""
    size = np.array([len(c) + 1 for c in contents])
    starts = np.concatenate(([0], np.cumsum(size)[:-1]))
    s = np.ones(size.sum() + 1, np.int64)
    s[-1] = 0
    inside = np.ones(len(s), bool)
    inside[-1] = False
    inside[starts + size - 1] = False
    s[inside] = np.frombuffer(b"".join(contents), np.uint8).astype(np.int64) + 2
    weight = np.zeros(len(s))
    for a, n, c in zip(starts, windows, counts):
        weight[a:a + n] = c
    sa = suffix_array(s, 258)
    common = permuted_lcp(s, sa)
    run = np.cumsum(common[sa] < LENGTH)
    total = np.bincount(run, weights=weight[sa])
    many = np.zeros(len(s), bool)
    many[sa] = total[run] >= 2
    return [many[a:a + n] for a, n in zip(starts, windows)]


def _sort_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by shard key; small shards share one suffix array."""
    held, size, last = [], 0, None

    def flush() -> Iterator[pa.RecordBatch]:
        found = repeated_windows([r["content"] for r in held], [r["windows"] for r in held], [r["n"] for r in held])
        out = []
        for r, many in zip(held, found):
            edge = np.flatnonzero(np.diff(np.concatenate(([0], many.astype(np.int8), [0]))))
            out += [(r["fp"], r["cid"], r["at"] + int(a), r["at"] + int(b)) for a, b in zip(edge[::2], edge[1::2])]
        if out:
            f, c, a, b = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()), pa.array(c, pa.int64()), pa.array(
                a, pa.int32()), pa.array(b, pa.int32())], ["fp", "cid", "lo", "hi"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["shard"] != last and size > SHARD_BYTES:
                yield from flush()
                held, size = [], 0
            last = row["shard"]
            held.append(row)
            size += len(row["content"])
    if held:
        yield from flush()


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for key, text, spans in zip(batch.column("key"), batch.column("text"), batch.column("spans").to_pylist()):
            raw, kept, end, spans_ = text.as_buffer().to_pybytes(), [], 0, []
            for a, b in sorted((s["a"], s["b"]) for s in spans):
                if spans_ and a <= spans_[-1][1]:
                    spans_[-1][1] = max(b, spans_[-1][1])
                else:
                    spans_.append([a, b])
            for a, b in spans_:
                kept.append(raw[end:a])
                end = b
            kept.append(raw[end:])
            left = b"".join(kept)
            out.append((key.as_py(), len(raw) - len(left), len(spans_), hashlib.sha256(left).hexdigest(),
                        [{"start": a, "end": b} for a, b in spans_]))
        if out:
            k, r, n, sha, spans = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(r, pa.int64()), pa.array(
                n, pa.int64()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.struct(
                    [("start", pa.int64()), ("end", pa.int64())])))],
                ["key", "n_removed", "n_spans", "kept_sha256", "spans"])


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` and ``spans`` (byte ranges, end
    exclusive) for every row of ``docs``."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"), digest(F.col(text)).alias("key"))
    narrow = saved(rows.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"),
                               F.sha2("text", 256).alias("sha")), "exact-rows")
    copies = saved(narrow.groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("one"),
                                            F.max("n_bytes").alias("n_bytes")), "exact-copies")
    # A short name of a text for counting: two texts that share it only keep more windows for step 3.
    long_ = rows.where(F.octet_length("text") >= LENGTH).withColumn("k", F.xxhash64("key"))

    counted = saved(long_.select("k", "text").mapInArrow(_count_anchors, "k long, fp long, n int"), "exact-anchors")
    repeated = counted.groupBy("fp").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.max("n").alias("n")).where(
        "lo != hi OR n > 1").select("fp")
    flagged = saved(counted.join(repeated, "fp").groupBy("k").agg(
        F.array_sort(F.collect_set("fp")).alias("fps")), "exact-flagged")
    # One document of each text with repeated anchors.
    chosen = long_.join(broadcast_if_bounded(flagged.select("k")), "k", "left_semi")
    picked = chosen.join(copies.select(F.col("key").alias("same"), "one"),
                         (F.col("key") == F.col("same")) & F.col("doc_id").eqNullSafe(F.col("one")))
    texts = saved(picked.select("k", "key", "text"), "exact-texts")
    found = saved(texts.join(flagged, "k").select("key", "text", "fps").mapInArrow(_find, _ROWS), "exact-stretches")

    kinds = found.join(copies.select("key", "copies"), "key").groupBy("fp", "cid").agg(
        F.sum("copies").alias("n"), F.min(F.struct("key", "first", "windows", "lead")).alias("at"))
    kinds = saved(kinds, "exact-kinds")
    wide = saved(kinds.groupBy("fp").agg(F.count("*").alias("kinds")), "exact-wide")
    alone = kinds.join(wide.where("kinds = 1"), "fp").where("n > 1").select(
        "fp", "cid", F.lit(0).alias("lo"), F.col("at.windows").alias("hi"))
    mixed = kinds.join(wide.where("kinds > 1"), "fp").select("fp", "cid", "n", "kinds", "at.*")
    picks = mixed.groupBy("key").agg(F.collect_list(F.struct(
        "fp", "cid", "n", "kinds", "first", "windows", "lead")).alias("picks"))
    shards = texts.select("key", "text").dropDuplicates(["key"]).join(picks, "key").select(
        F.col("text").cast("binary").alias("text"), "picks").mapInArrow(_contents, _SHARDED)
    sorted_ = saved(shards.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _sort_shards, "fp long, cid long, lo int, hi int"), "exact-sorted")
    ranges = found.join(alone.union(sorted_), ["fp", "cid"]).select("key", F.struct(
        (F.col("first") + F.col("lo")).alias("a"), (F.col("first") + F.col("hi") + (LENGTH - 1)).alias("b")).alias("s"))
    spans = ranges.groupBy("key").agg(F.collect_list("s").alias("spans"))
    cut = saved(texts.select("key", F.col("text").cast("binary").alias("text")).dropDuplicates(["key"]).join(
        spans, "key").mapInArrow(_cut, "key binary, n_removed long, n_spans long, kept_sha256 string, "
                                       "spans array<struct<start:bigint,end:bigint>>"), "exact-cut")
    done = copies.select("key", "copies").join(cut, "key", "left")
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= LENGTH)
    all_ = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return narrow.join(done, "key").select(
        "doc_id", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(whole, all_).otherwise(F.coalesce("spans", none)).alias("spans"))

