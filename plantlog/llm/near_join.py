"""Similarity join of texts on word shingles with Bayesian candidate pruning.

Two texts are linked when the Jaccard similarity of their sets of five-word shingles reaches 0.8
(a text of one to four words is one shingle; a text without words is linked to nothing).

1. Every document becomes a MinHash signature of ``HASHES`` 16-bit values and a 128-bit fingerprint of
   its shingle set. Documents with one set form a *class*; only classes go on.
2. Signatures are cut into ``BANDS`` bands of ``ROWS`` values; classes that agree on a band are
   candidates. A pair at the threshold is missed with probability (1 - 0.8^5)^40 = 1.2e-7.
3. Candidates compare their signatures ``STEP`` values at a time. With a uniform prior, m matches of n
   give the posterior Beta(m + 1, n - m + 1); a pair whose chance to reach the threshold is below
   ``TOLERANCE`` is dropped at once.
4. What is left is verified exactly on the shingle sets (64-bit hashes).

Buckets of up to ``SMALL`` classes are joined as pairs. Larger buckets are never turned into pairs of
rows: their classes are dealt into chunks of ``CHUNK``, a task compares two chunks with matrix
operations and returns link counts per class and a spanning forest of the links. A pair is counted
in its first large bucket only, and the pair path leaves it to that bucket. Nothing is capped; a hot
bucket costs rows in proportion to its size times its number of chunks, spread over all tasks.

Defined results: a null or wordless text is its own class with no link; repeated rows are documents of
one class; ``doc_id`` may be null or repeated (rows are told apart by id and text); equal similarity to
the threshold is a link; an empty table gives an empty table. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantlog.functions.sizing import broadcast_if_bounded
from plantlog.llm.common import ByteTexts, chunks, free_name, mix, saved
from plantlog.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP = 40, 5, 25
HASHES = BANDS * ROWS
TOLERANCE = 1e-9
SMALL, CHUNK = 16, 512
_rng = np.random.Generator(np.random.PCG64(7))
_MULT = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _posterior(m: int, n: int, threshold: float) -> float:
    """P(similarity >= threshold) after m matches of n: 1 - I_t(m + 1, n - m + 1)."""
    log = [math.lgamma(n + 2) - math.lgamma(k + 1) - math.lgamma(n + 2 - k)
           + k * math.log(threshold) + (n + 1 - k) * math.log1p(-threshold) for k in range(m + 1)]
    return sum(map(math.exp, log))


def needed_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """Fewest matches after n compared values that keep a pair alive."""
    return {n: next(m for m in range(n + 1) if _posterior(m, n, threshold) >= tolerance)
            for n in range(STEP, HASHES + 1, STEP)}


_NEEDED = needed_matches()


def row_key(doc_id: Column, text: Column) -> Column:
    """Tells rows apart; repeated rows share it."""
    return F.md5(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")),
                             F.coalesce(text, F.lit(""))))


def shingle_sets(t: ByteTexts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all documents, by document, and where each document's begin."""
    first, h = t.windows(SHINGLE)
    doc = t.word_doc[first]
    counts = np.diff(t.word_offsets)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    if len(short):
        own = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE - 1):
            has = counts[short] > k
            own[has] = own[has] * np.uint64(0x9FB21C651E98DF25) + t.word_hash[
                t.word_offsets[:-1][short[has]] + k]
        h, doc = np.concatenate((h, mix(own))), np.concatenate((doc, short))
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[fresh], doc[fresh]
    return h, np.searchsorted(doc, np.arange(len(t) + 1))


def fingerprints(h: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits of each set, from two independent sums; None for the empty set."""
    size = np.diff(at)
    total = np.zeros((2, len(h) + 1), np.uint64)
    np.cumsum(mix(h + np.uint64(0x632BE59BD9B4E019)), out=total[0, 1:])
    np.cumsum(mix(h ^ np.uint64(0x8CB92BA72F3D8DD7)), out=total[1, 1:])
    part = total[:, at[1:]] - total[:, at[:-1]]
    both = np.ascontiguousarray(np.stack((mix(part[0] + size.astype(np.uint64)), mix(part[1])), 1))
    return [b.tobytes() if n else None for b, n in zip(both, size)]


def signatures(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(documents with shingles) x HASHES, 16 bits each."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.zeros((len(starts), HASHES), np.uint16)
    for k in range(HASHES if len(starts) else 0):
        low = np.minimum.reduceat((h * _MULT[k] + _ADD[k]) >> np.uint64(32), starts)
        out[:, k] = low & np.uint64(0xFFFF)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi, t in chunks(batch.column("text")):
            h, at = shingle_sets(t)
            sig = iter(signatures(h, at))
            sets = fingerprints(h, at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(lo, hi - lo), batch.column("row_key").slice(lo, hi - lo),
                 pa.array(sets, pa.binary()),
                 pa.array([next(sig).tobytes() if s else None for s in sets], pa.binary())],
                ["doc_id", "row_key", "fp", "sig"])


def _alive(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of signature rows survive the incremental comparison."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for n in range(STEP, HASHES + 1, STEP):
        matches = matches + (a[alive, n - STEP:n] == b[alive, n - STEP:n]).sum(1, dtype=np.int32)
        keep = matches >= _NEEDED[n]
        alive, matches = alive[keep], matches[keep]
    return alive


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    column = column.cast(pa.large_binary())
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            alive = _alive(_matrix(batch.column("sig_a"), np.uint16), _matrix(batch.column("sig_b"), np.uint16))
            yield batch.select(["a", "b"]).take(pa.array(alive))


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("set_a"), batch.column("set_b")):
            a, b = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(both >= THRESHOLD * (len(a) + len(b) - both) - 1e-9)
        yield batch.select(["a", "b", "n_a", "n_b"]).filter(pa.array(keep, pa.bool_()))


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections. Shingles held by the same documents count as one column."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    tag = np.random.Generator(np.random.PCG64(3)).integers(1, 1 << 63, n, dtype=np.uint64)
    pattern = np.add.reduceat(tag[owner], starts)
    _, pick, weight = np.unique(pattern, return_index=True, return_counts=True)
    ends = np.append(starts[1:], len(flat))
    out = np.zeros((n, n))
    for lo in range(0, len(pick), 2048):
        cols = pick[lo:lo + 2048]
        size = ends[cols] - starts[cols]
        rows = owner[np.repeat(starts[cols] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
                     + np.arange(size.sum())]
        m = np.zeros((n, len(cols)), np.float32)
        m[rows, np.repeat(np.arange(len(cols)), size)] = 1
        out += (m * weight[lo:lo + 2048].astype(np.float32)) @ m.T
    return out


def _forest(n: int, pairs: np.ndarray) -> list[tuple[int, int]]:
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for a, b in pairs:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            kept.append((a, b))
    return kept


def _chunk_links(rows: list[dict]) -> Iterator[tuple[bytes, bytes | None, int]]:
    """(class, other class of a forest edge, links) of two chunks of one bucket."""
    band, same = rows[0]["band"], rows[0]["ci"] == rows[0]["cj"]
    side = np.array([r["chunk"] == r["ci"] for r in rows])
    sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(len(rows), -1)
    large = np.array([r["large"] for r in rows], np.int64)
    left, right = np.flatnonzero(side), np.arange(len(rows)) if same else np.flatnonzero(~side)
    earlier = []
    for j in range(band):
        _, code = np.unique(sig[:, j * ROWS:(j + 1) * ROWS].copy().view(f"V{2 * ROWS}").ravel(),
                            return_inverse=True)
        code = np.where(large >> j & 1, code + 1, -1 - np.arange(len(rows)))
        earlier.append(code)
    pairs = []
    for i in left:
        others = right[right > i] if same else right
        for code in earlier:
            others = others[code[others] != code[i]]
        if len(others):
            ok = _alive(np.broadcast_to(sig[i], (len(others), HASHES)), sig[others])
            pairs.append(np.stack((np.full(len(ok), i), others[ok]), 1))
    if not pairs or not sum(map(len, pairs)):
        return
    pairs = np.concatenate(pairs)
    used, inverse = np.unique(pairs, return_inverse=True)
    inverse = inverse.reshape(pairs.shape)
    sets = [np.frombuffer(rows[i]["shingles"], np.uint64) for i in used]
    size = np.array([len(s) for s in sets])
    both = _intersections(sets)[inverse[:, 0], inverse[:, 1]]
    linked = both >= THRESHOLD * (size[inverse].sum(1) - both) - 1e-9
    pairs = pairs[linked]
    members = np.array([r["members"] for r in rows], np.int64)
    links = np.zeros(len(rows), np.int64)
    np.add.at(links, pairs[:, 0], members[pairs[:, 1]])
    np.add.at(links, pairs[:, 1], members[pairs[:, 0]])
    for i in np.flatnonzero(links):
        yield rows[i]["fp"], None, int(links[i])
    for a, b in _forest(len(rows), pairs):
        yield rows[a]["fp"], rows[b]["fp"], 0


def _large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by bucket and chunk pair; a group has at most two chunks."""
    def flush(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        if got := list(_chunk_links(rows)) if rows else None:
            a, b, n = zip(*got)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(
                n, pa.int64())], ["a", "b", "links"])

    group, held = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row["key"], row["ci"], row["cj"]
            if key != group:
                yield from flush(held)
                group, held = key, []
            held.append(row)
    yield from flush(held)


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(``fp``, ``shingles``) of the classes in ``wanted`` (``row_key``), from one document of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, t in chunks(batch.column("text")):
                h, at = shingle_sets(t)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fingerprints(h, at), pa.binary()),
                     pa.array([h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())],
                    ["fp", "shingles"])

    rows = docs.join(broadcast_if_bounded(wanted.select("row_key").distinct()), "row_key")
    return saved(rows.select("text").mapInArrow(run, "fp binary, shingles binary").dropDuplicates(["fp"]),
                 "near-sets")


def near_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``row_key``, ``class_id`` (smallest ``doc_id`` of the
    documents reachable over links), ``class_key`` (``row_key`` of that document) and ``n_links``, the
    number of other documents linked to this one."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"),
                       row_key(F.col(doc_id), F.col(text)).alias("row_key"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    described = saved(docs.mapInArrow(
        _describe, f"doc_id {kind}, row_key string, fp binary, sig binary"), "near-described")
    classes = saved(described.where("fp IS NOT NULL").groupBy("fp").agg(
        F.count("*").alias("members"), F.min(F.struct("doc_id", "row_key")).alias("first"),
        F.first("sig").alias("sig")), "near-classes")

    band = classes.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"), "sig").select(
        "fp", "band", F.xxhash64("band", F.expr(
            f"substring(sig, band * {2 * ROWS} + 1, {2 * ROWS})")).alias("key"))
    shared = band.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = saved(band.join(shared, "key"), "near-buckets")
    masks = members.where(F.col("size") > SMALL).groupBy("fp").agg(
        F.expr("bit_or(shiftleft(1L, band))").alias("large"))
    masks = saved(masks, "near-large")

    small = members.where(F.col("size") <= SMALL).select("key", "fp")
    pairs = small.alias("x").join(small.alias("y"), "key").where("x.fp < y.fp").select(
        F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    node = classes.join(masks, "fp", "left").select("fp", "sig", "members", F.coalesce(
        "large", F.lit(0).cast("long")).alias("large"), "first.row_key")
    side = lambda n: node.select(F.col("fp").alias(n), F.col("sig").alias(f"sig_{n}"),
                                 F.col("large").alias(f"large_{n}"))
    # A pair that also shares a large bucket is counted there.
    both = F.expr(f"""exists(sequence(0, {BANDS - 1}), i ->
        (shiftright(large_a & large_b, i) & 1) = 1 AND
        substring(sig_a, i * {2 * ROWS} + 1, {2 * ROWS}) = substring(sig_b, i * {2 * ROWS} + 1, {2 * ROWS}))""")
    alive = saved(pairs.join(side("a"), "a").join(side("b"), "b").where(~both).select(
        "a", "b", "sig_a", "sig_b").mapInArrow(_prune, "a binary, b binary"), "near-alive")

    wanted = alive.select(F.col("a").alias("fp")).union(alive.select("b")).union(
        masks.select("fp")).distinct().join(classes, "fp").select("first.row_key")
    sets = _sets(docs, saved(wanted, "near-wanted"))
    weigh = lambda n: sets.join(classes, "fp").select(
        F.col("fp").alias(n), F.col("shingles").alias(f"set_{n}"), F.col("members").alias(f"n_{n}"))
    links = saved(alive.join(weigh("a"), "a").join(weigh("b"), "b").mapInArrow(
        _verify, "a binary, b binary, n_a long, n_b long"), "near-links")

    n_chunks = F.ceil(F.col("size") / CHUNK).cast("int")
    dealt = members.where(F.col("size") > SMALL).withColumn("n", n_chunks).withColumn(
        "chunk", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "key", "band", "fp", "chunk", F.least("chunk", "other").alias("ci"), F.greatest("chunk", "other").alias("cj"))
    heavy = dealt.join(node.drop("row_key").join(sets, "fp"), "fp")
    blocks = saved(heavy.repartition("key", "ci", "cj").sortWithinPartitions("key", "ci", "cj").mapInArrow(
        _large, "a binary, b binary, links long"), "near-blocks")

    edges = links.select("a", "b").union(blocks.where("b IS NOT NULL").select("a", "b"))
    labels = components(edges)
    counted = links.select(F.col("a").alias("fp"), F.col("n_b").alias("links")).union(
        links.select("b", "n_a")).union(blocks.where("b IS NULL").select("a", "links")).groupBy(
        "fp").agg(F.sum("links").alias("links"))
    grouped = classes.select("fp", "members", "first").join(
        labels.withColumnRenamed("node", "fp"), "fp", "left").join(counted, "fp", "left").select(
        "fp", F.coalesce("label", "fp").alias("label"), "first",
        (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    heads = grouped.groupBy("label").agg(F.min("first").alias("head"))
    result = saved(grouped.join(heads, "label").select("fp", "head", "n_links"), "near-result")
    return described.select("doc_id", "row_key", "fp").join(result, "fp", "left").select(
        "doc_id", "row_key",
        F.when(F.col("fp").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("class_id"),
        F.coalesce("head.row_key", "row_key").alias("class_key"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_per_class(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of every class of near duplicates: the one with the smallest id."""
    joined = saved(near_join(docs, doc_id, text), "near-judged")
    name = free_name(docs, "row_key")
    keyed = docs.withColumn(name, row_key(F.col(doc_id), F.col(text)))
    gone = joined.where("row_key != class_key").select(F.col("row_key").alias(name)).distinct()
    repeated = saved(joined.where("row_key = class_key").groupBy(F.col("row_key").alias(name)).count().where(
        "count > 1").select(name), "near-repeated")
    stay = keyed.join(broadcast_if_bounded(gone), name, "left_anti")
    few = broadcast_if_bounded(repeated)
    once = stay.join(few, name, "left_semi").dropDuplicates([name])
    return stay.join(few, name, "left_anti").union(once).drop(name)
