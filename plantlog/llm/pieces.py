"""SentencePiece encoding and decoding as a relational lattice.

Texts are escaped as the model asks (``▁`` in front and for every space) and cut into words at places
that no piece crosses: before ``▁``, and between letters and other characters when no piece of the
table mixes them. Only the distinct words of the corpus are segmented:

* every substring of up to the longest piece's length is exploded and equi-joined to the piece table
  (broadcast: its size is the model's vocabulary, not the data's);
* the edges are grouped by word and folded with the higher-order ``aggregate``. For a unigram model
  the fold is Viterbi over end positions. The scores of a BPE model are merge ranks, for which the best
  path is not the model's segmentation; there the fold keeps the lattice and takes its edges in rank
  order, left to right, each where it covers two neighbouring symbols;
* words of over ``_SHORT`` characters, and runs of spaces, have the same lattice, made from blocks of the
  word so that a row stays small; their edges are folded in a task, along linked symbols with a queue by
  rank, at n log n for n characters;
* characters without a piece become their UTF-8 byte pieces.

Documents are then encoded by looking up word hashes (64 bit) in a broadcast table of at most
``TABLE_BYTES``, the most frequent words. If the corpus has more, the rare words of a document are
joined to their segmentation by word and gathered per document first; every word is encoded alike.

Defined results: a null or empty text has no pieces; repeated rows are encoded one by one; other
columns pass through; a text of one unbroken run of letters is one word, whatever its length. Decoding
gives back the text, except that ``▁`` in a text becomes a space, as in any such model.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plantlog.llm.common import free_name, mix, saved

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
TABLE_BYTES = 64 << 20
BAR = "▁"
_SPAN = 64  # edge key: start * _SPAN + length
_BASE, _POW = 0x9E3779B97F4A7C15, {}
#: Bytes of text, and distinct words, that a task holds at a time (one longer text excepted).
_GROUP, _MERGE = 400_000, 150_000


class Pieces:
    """The piece table of a model file, and what follows from it."""

    def __init__(self, path: str = MODEL):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        model.ParseFromString(self.processor.serialized_model_proto())
        norm = model.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that leave texts as they are can be used")
        kinds = proto.ModelProto.SentencePiece
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined symbols are not supported")
        self._set([(p.piece, i, p.score, p.type == kinds.BYTE) for i, p in enumerate(model.pieces)
                   if p.type in (kinds.NORMAL, kinds.BYTE)], model.trainer_spec.unk_id,
                  model.trainer_spec.model_type == proto.TrainerSpec.BPE, norm.add_dummy_prefix)

    @classmethod
    def of(cls, rows: list[tuple[str, int, float]], unk: int, bpe: bool, prefix: bool = True) -> Pieces:
        self = cls.__new__(cls)
        self._set([(*r, False) for r in rows], unk, bpe, prefix)
        return self

    def _set(self, rows, unk: int, bpe: bool, prefix: bool) -> None:
        self.rows = [(p, i, s) for p, i, s, byte in rows if not byte]
        self.bytes = {int(p[3:5], 16): i for p, i, s, byte in rows if byte}
        self.first_byte = self.bytes.get(0, -1)
        if self.bytes and self.bytes != {b: self.first_byte + b for b in range(256)}:
            raise ValueError("byte pieces are expected to have consecutive ids")
        self.unk, self.bpe, self.prefix = unk, bpe, prefix
        self.longest = max((len(p) for p, _, _ in self.rows), default=1)
        if self.longest >= _SPAN:
            raise ValueError(f"pieces of {_SPAN} characters or more are not supported")
        bare = [p.lstrip(BAR) for p, _, _ in self.rows]
        if any(BAR in p for p in bare):
            raise ValueError("pieces with a space behind other characters are not supported")
        self.letters_apart = not any(len({c.isalpha() for c in p}) > 1 for p in bare)
        runs = {len(p) for p, _, _ in self.rows if not p.strip(BAR)}
        top = max(runs, default=1)
        powers = {1 << k for k in range(top.bit_length())}
        # Runs of spaces merge by doubling, so that a long one falls into pieces of the largest power.
        self.run = top if bpe and top == max(powers) and powers <= runs | {1} else 0

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "processor"}

    def table(self, spark: SparkSession) -> DataFrame:
        """(``piece``, ``rank``, ``score``); pieces of one score share a rank."""
        rank: dict[float, int] = {}
        rows = [(p, rank.setdefault(s, k), s) for k, (p, _, s) in enumerate(sorted(
            self.rows, key=lambda r: (-r[2], r[1])))]
        return spark.createDataFrame(rows, "piece string, rank int, score double")

    def symbol_ids(self) -> dict[str, list[int]]:
        return {p: [i] for p, i, _ in self.rows}

    def other_ids(self, symbol: str) -> list[int]:
        """Of a character without a piece."""
        return [self.bytes[b] for b in symbol.encode()] if self.bytes else [self.unk]


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    have = _POW.get(inverse)
    if have is None or len(have) < n:
        have = np.full(max(n, _GROUP), pow(_BASE, -1, 1 << 64) if inverse else _BASE, np.uint64)
        have[0] = 1
        _POW[inverse] = have = np.multiply.accumulate(have)
    return have[:n]


class Words:
    """The words of a few escaped texts: ``starts``, ``ends``, ``hash``; ``first`` is the index of each
    text's first word, with the number of words at the end."""

    def __init__(self, texts: list[str], prefix: bool, apart: bool, run: int):
        lengths = np.array([len(t) + (prefix and len(t) > 0) for t in texts], np.int64)
        joined = "".join(BAR + t if prefix and t else t for t in texts).replace(" ", BAR)
        self.joined = joined
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        n = len(code)
        bar = code == ord(BAR)
        kind = np.where(bar, np.int8(0), np.int8(1) + (_letters()[code] if apart else np.zeros(n, np.int8)))
        start = np.zeros(n + 1, bool)
        if n:
            before = kind[:-1]
            start[1:-1] = np.where(bar[1:], before != 0, (before != 0) & (before != kind[1:]))
        start[offsets] = True
        if run and n:
            heads = np.flatnonzero(bar & start[:-1])
            last = np.maximum.accumulate(np.where(start[:-1], np.arange(n), 0))
            step = np.arange(n) - last
            start[:-1] |= bar & (step > 0) & (step % run == 0) & (len(heads) > 0)
        self.starts = np.flatnonzero(start[:-1])
        self.ends = np.append(self.starts[1:], n) if len(self.starts) else self.starts
        self.first = np.searchsorted(self.starts, offsets)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(code.astype(np.uint64) + np.uint64(1)) * _powers(n), out=total[1:])
        size = (self.ends - self.starts).astype(np.uint64)
        self.hash = mix((total[self.ends] - total[self.starts]) * _powers(n + 1, True)[self.starts]
                        + size * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)

    def text(self, i: int) -> str:
        return self.joined[self.starts[i]:self.ends[i]]


def _groups(column: pa.Array, limit: int = _GROUP) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows of about ``limit`` bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo, base = 0, 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield lo, [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo, base = hi, int(ends[hi - 1])


def distinct_words(texts: DataFrame, pieces: Pieces) -> DataFrame:
    """(``h``, ``word``, ``n``) of a table of one text column."""
    options = pieces.prefix, pieces.letters_apart, pieces.run

    def merged(parts: list[tuple]) -> pa.RecordBatch:
        h, n = (np.concatenate([p[k] for p in parts]) for k in (0, 2))
        words = pa.concat_arrays([p[1] for p in parts])
        uniq, first, at = np.unique(h, return_index=True, return_inverse=True)
        count = np.bincount(at, weights=n, minlength=len(uniq)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(uniq), words.take(pa.array(first)), pa.array(count)],
                                          ["h", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        for batch in batches:
            for _, texts in _groups(batch.column(0)):
                w = Words(texts, *options)
                h, first, n = np.unique(w.hash, return_index=True, return_counts=True)
                cuts = zip(w.starts[first].tolist(), w.ends[first].tolist())
                parts.append((h, pa.array([w.joined[a:b] for a, b in cuts], pa.string()), n))
                if sum(len(p[0]) for p in parts) > _MERGE:
                    yield merged(parts)
                    parts = []
        if parts:
            yield merged(parts)

    # Grouped by both, so that the sums are hashed; equal words have equal hashes.
    return texts.mapInArrow(run, "h long, word string, n long").groupBy("h", "word").agg(F.sum("n").alias("n"))


def _one(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _viterbi_fold(edges: Column, n: Column, longest: int, floor: float) -> Column:
    """Borders of the best path. State per end position: score, start of the last edge (ties: the
    longest last edge). A character without a piece may be passed at ``floor``."""
    def step(acc: Column, j: Column) -> Column:
        options = F.transform(F.sequence(F.greatest(j - longest, F.lit(0)), j - 1), lambda i: F.struct(
            (F.element_at(acc, i + 1)["score"] + F.coalesce(
                F.try_element_at(edges, i * _SPAN + j - i)["score"],
                F.when(j - i == 1, F.lit(floor)))).alias("score"), (-i).alias("back")))
        return F.concat(acc, F.array(F.array_max(F.filter(options, lambda o: o["score"].isNotNull()))))

    best = F.aggregate(F.sequence(F.lit(1), n), F.array(F.struct(
        F.lit(0.0).alias("score"), F.lit(0).alias("back"))), step)
    return _one(best, lambda s: F.reverse(F.aggregate(F.sequence(F.lit(1), n), F.array(n), lambda b, _: F.when(
        F.element_at(b, -1) > 0, F.concat(b, F.array(-F.element_at(s, F.element_at(b, -1) + 1)["back"]))
    ).otherwise(b))))


def _shift(x: Column, n: Column) -> Column:
    return F.call_function("shiftleft", x, n)


def _rank_fold(ordered: Column, n: Column) -> Column:
    """The merge segmentation of a word of up to ``_SHORT`` characters without runs of spaces, in one
    pass: a trained piece ranks behind the pieces that it is merged from, so taking the edges from the
    best rank on, left to right, meets every merge in the model's order. Borders are bits; an edge
    merges two neighbouring symbols when it ends on borders and has exactly one inside."""
    one = F.lit(1).cast("long")

    def step(b: Column, e: Column) -> Column:
        lo, size = _start(e), _length(e)
        inside = b.bitwiseAND(_shift(_shift(one, size - 1) - 1, lo + 1))
        ends = _shift(one, lo).bitwiseOR(_shift(one, lo + size))
        return F.when((b.bitwiseAND(ends) == ends) & (F.bit_count(inside) == 1), b - inside).otherwise(b)

    bits = F.aggregate(ordered, _shift(one, n + 1) - 1, step)
    return _one(bits, lambda x: F.filter(F.sequence(F.lit(0), n), lambda i: x.bitwiseAND(_shift(one, i)) != 0))


#: An edge in one long: rank, start, length.
_START, _LENGTH, _SHORT = 24, 6, 60
#: Starts of a long word in one row.
_BLOCK = 256


def _start(e: Column) -> Column:
    return F.shiftright(e, _LENGTH).bitwiseAND(F.lit((1 << _START) - 1).cast("long")).cast("int")


def _length(e: Column) -> Column:
    return e.bitwiseAND(F.lit((1 << _LENGTH) - 1).cast("long")).cast("int")


def _folded(edges: dict[int, int], n: int) -> list[int]:
    """Symbol borders of the merge segmentation of a word of ``n`` characters; ``edges``: rank by start and
    length. Neighbours merge by best rank, then leftmost; a queued pair is stale once a side has grown."""
    ends, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(rank, at // _SPAN, at % _SPAN) for at, rank in edges.items() if at % _SPAN == 2]
    heapq.heapify(queue)
    alive = bytearray(b"\1") * n

    def offer(left: int) -> None:
        middle = ends[left]
        if middle < n:
            size = ends[middle] - left
            if size < _SPAN and (rank := edges.get(left * _SPAN + size)) is not None:
                heapq.heappush(queue, (rank, left, size))

    while queue:
        _, left, size = heapq.heappop(queue)
        middle = ends[left]
        if not alive[left] or middle >= n or ends[middle] - left != size:
            continue
        alive[middle] = 0
        ends[left] = end = ends[middle]
        if end < n:
            before[end] = left
        offer(left)
        if before[left] >= 0:
            offer(before[left])
    return [i for i in range(n) if alive[i]] + [n]


def _best_path(edges: dict[int, float], n: int, longest: int, floor: float) -> list[int]:
    """Borders of the best path, as ``_viterbi_fold`` finds it."""
    score, back = [0.0] + [0.0] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        score[j], i = max((score[i] + edges.get(i * _SPAN + j - i, floor), -i) for i in range(max(0, j - longest), j)
                          if j - i == 1 or i * _SPAN + j - i in edges)
        back[j] = -i
    borders = [n]
    while borders[-1]:
        borders.append(back[borders[-1]])
    return borders[::-1]


def _long_words(longs: DataFrame, table: DataFrame, pieces: Pieces, low: float) -> DataFrame:
    """(``h``, ``n``, ``ids``) of long words: the lattice from blocks, folded in tasks."""
    blocks = longs.select("h", F.explode(F.transform(F.sequence(F.lit(0), F.length("word") - 1, F.lit(_BLOCK)), lambda b: F.struct(
        b.alias("base"), F.col("word").substr(b + 1, F.lit(_BLOCK + pieces.longest - 1)).alias("part")))).alias("block")).select(
        "h", "block.*")
    starts = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.least(F.lit(_BLOCK), F.length("part")) - 1)))
    subs = starts.withColumn("len", F.explode(F.sequence(F.lit(1), F.least(F.lit(pieces.longest), F.length("part") - F.col("at")))))
    subs = subs.select("h", ((F.col("base") + F.col("at")).cast("long") * _SPAN + F.col("len")).alias("at"),
                       F.col("part").substr(F.col("at") + 1, F.col("len")).alias("piece"))
    edges = subs.join(table, "piece").groupBy("h").agg(F.collect_list(F.struct("at", "rank", "score")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.symbol_ids()
        for batch in batches:
            out = []
            for word, found in zip(batch.column("word").to_pylist(), batch.column("edges")):
                found = found.values
                at = found.field("at").to_pylist() if found is not None else []
                if pieces.bpe:
                    borders = _folded(dict(zip(at, found.field("rank").to_pylist() if at else [])), len(word))
                else:
                    borders = _best_path(dict(zip(at, found.field("score").to_pylist() if at else [])), len(word), pieces.longest, low)
                symbols = (word[a:b] for a, b in zip(borders[:-1], borders[1:]))
                out.append([i for x in symbols for i in known.get(x) or pieces.other_ids(x)])
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("n"), pa.array(
                out, pa.list_(pa.int32()))], ["h", "n", "ids"])

    return longs.join(edges, "h", "left").select("h", "n", "word", "edges").mapInArrow(run, "h long, n long, ids array<int>")


def segment(words: DataFrame, pieces: Pieces) -> DataFrame:
    """(``h``, ``n``, ``ids``) of (``h``, ``word``, ``n``), one row per word. Grouped by the columns that
    ``distinct_words`` groups by, so that the edges of a word are already where they are needed. Long words
    pass as one row and are segmented apart."""
    table = F.broadcast(pieces.table(words.sparkSession))
    size, double = F.length("word"), F.contains("word", F.lit(BAR * 2))
    long_ = (size > _SHORT) | double if pieces.bpe else size > _SHORT
    subs = words.withColumn("at", F.explode(F.when(long_, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), size - 1)))).withColumn(
        "len", F.explode(F.when(long_, F.array(F.lit(1))).otherwise(F.sequence(F.lit(1), F.least(
            F.lit(pieces.longest), size - F.col("at"))))))
    subs = subs.withColumn("piece", F.col("word").substr(F.col("at") + 1, F.col("len")))
    place = F.col("at").cast("long") * (1 << _LENGTH) + F.col("len")
    low = min((s for _, _, s in pieces.rows), default=0.0) - 10.0
    if pieces.bpe:
        edge = F.col("rank").cast("long") * (1 << _START + _LENGTH) + place
        wanted = (F.col("len") > 1) & F.col("rank").isNotNull()
        edges = subs.join(table, "piece", "left").where(wanted | (F.col("len") == 1) & (F.col("at") == 0)).groupBy(
            "h", "word").agg(F.max("n").alias("n"), F.collect_list(F.when(wanted, edge)).alias("edges"))
        borders = _rank_fold(F.array_sort("edges"), size)
    else:
        edges = subs.join(table, "piece", "left").where("rank IS NOT NULL OR len = 1").groupBy("h", "word").agg(
            F.max("n").alias("n"), F.map_from_entries(F.collect_list(F.when(
                F.col("rank").isNotNull(), F.struct((F.col("at") * _SPAN + F.col("len")).alias("k"), F.struct(
                    "score").alias("v"))))).alias("edges"))
        borders = _viterbi_fold(F.col("edges"), size, pieces.longest, low)
    symbols = edges.select("h", "n", "word", F.when(~long_, borders).alias("b")).select("h", "n", F.transform(
        F.slice("b", 1, F.size("b") - 1), lambda lo, i: F.col("word").substr(
            lo + 1, F.element_at(F.col("b"), i + 2) - lo)).alias("symbols"), F.when(long_, F.col("word")).alias("word"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.symbol_ids()
        for batch in batches:
            ids = [None if word is None else [i for x in word for i in known.get(x) or pieces.other_ids(x)]
                   for word in batch.column("symbols").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("n"), pa.array(
                ids, pa.list_(pa.int32())), batch.column("word")], ["h", "n", "ids", "word"])

    done = saved(symbols.mapInArrow(run, "h long, n long, ids array<int>, word string"), "piece-words")
    longs = done.where("word IS NOT NULL").select("h", "n", "word")
    short = done.where("word IS NULL").select("h", "n", "ids")
    if not longs.limit(1).count():
        return short
    return short.union(saved(_long_words(longs, table, pieces, low), "piece-long"))


class _Table:
    """Sorted word hashes with their ids, as arrays."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks().sort_by("h")
        ids = rows.column("ids").combine_chunks()
        ids = ids.chunk(0) if isinstance(ids, pa.ChunkedArray) else ids
        self.keys = rows.column("h").to_numpy()
        self.offsets = ids.offsets.to_numpy().astype(np.int32)
        self.ids = np.asarray(ids.values)[:self.offsets[-1]] if len(ids) else np.zeros(0, np.int32)
        if self.ids.max(initial=0) < 1 << 16:
            self.ids = self.ids.astype(np.uint16)


def _lookup(w: Words, table: _Table, extra: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all words, and ids per word. ``extra``: (hash, ids) of words beyond the table."""
    uniq, inverse = np.unique(w.hash, return_inverse=True)
    keys, offsets, ids = table.keys, table.offsets, table.ids
    if extra:
        ids = ids.astype(np.int32)
        more = sorted(dict(extra).items())
        keys = np.concatenate((keys, [h for h, _ in more]))
        offsets = np.concatenate((offsets, offsets[-1] + np.cumsum([len(i) for _, i in more])))
        ids = np.concatenate((ids, np.concatenate([np.asarray(i, np.int32) for _, i in more])))
        order = np.argsort(keys, kind="stable")
    else:
        order = None
    at = np.searchsorted(keys, uniq, sorter=order)
    at = order[np.minimum(at, len(keys) - 1)] if order is not None else at
    if len(uniq) and not (at < len(keys)).all() or (keys[at] != uniq).any():
        raise KeyError("a word has no segmentation")
    at = at[inverse]
    count = (offsets[at + 1] - offsets[at]).astype(np.int64)
    head = np.repeat(offsets[at] - np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(at) else at
    return ids[head + np.arange(count.sum())].astype(np.int32), count


def encode(docs: DataFrame, text: str = "text", pieces: Pieces | None = None,
           table_bytes: int = TABLE_BYTES, decoded: str | None = None) -> DataFrame:
    """``row`` (all columns of ``docs``) and ``ids``; with ``decoded``, what they decode to under that name."""
    spark, pieces = docs.sparkSession, pieces or Pieces()
    texts = docs.select(F.col(text).alias("text"))
    words = segment(distinct_words(texts, pieces), pieces)
    ranks = dict(words.groupBy(F.floor(F.log2("n")).cast("int").alias("g")).agg(F.sum(F.lit(12) + 2 * F.size("ids"))).collect())
    total, floor = 0, 63
    while floor > 0 and total + ranks.get(floor - 1, 0) <= table_bytes:
        floor -= 1
        total += ranks.get(floor, 0)
    frequent = F.floor(F.log2("n")) >= floor
    table = spark.sparkContext.broadcast(_Table(words.where(frequent).select("h", "ids").toArrow()))
    options = pieces.prefix, pieces.letters_apart, pieces.run
    rows = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    if floor:
        rows = _with_rare(rows, words.where(~frequent).select("h", "ids"), table, options)
    else:
        rows = rows.withColumn("extra", F.lit(None).cast("array<struct<h:bigint,ids:array<int>>>"))
    back = _decoder(pieces) if decoded else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            for lo, group in _groups(column):
                extra = [(e["h"], e["ids"]) for x in batch.column("extra").slice(lo, len(group)).to_pylist()
                         for e in x or ()]
                w = Words(group, *options)
                ids, count = _lookup(w, table.value, extra)
                ends = np.concatenate(([0], np.cumsum(count)))[w.first]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                more = [back(lists)] if back else []
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row").slice(lo, len(group)), lists, *more], ["row", "ids", "decoded"][:2 + len(more)])

    schema = f"row {docs.schema.simpleString()}, ids array<int>"
    if not decoded:
        return rows.mapInArrow(run, schema)
    return rows.mapInArrow(run, f"{schema}, decoded string").withColumnRenamed("decoded", decoded)


def _with_rare(rows: DataFrame, rare: DataFrame, table, options) -> DataFrame:
    """Adds ``extra``, the segmentation of each text's words beyond the table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, group in _groups(batch.column("text")):
                w = Words(group, *options)
                doc = np.repeat(np.arange(len(group)), np.diff(w.first))
                keys = table.value.keys
                at = np.minimum(np.searchsorted(keys, w.hash), max(len(keys) - 1, 0))
                new = keys[at] != w.hash if len(keys) else np.ones(len(w.hash), bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(lo + doc[new])), pa.array(w.hash[new])], ["key", "h"])

    keyed = rows.withColumn("key", F.md5(F.coalesce("text", F.lit(""))))
    missing = keyed.select("text", "key").mapInArrow(run, "key string, h long").distinct()
    extra = missing.join(rare, "h").groupBy("key").agg(F.collect_list(F.struct("h", "ids")).alias("extra"))
    return keyed.join(extra, "key", "left").select("row", "text", "extra")


def _decoder(pieces: Pieces) -> Callable[[pa.ListArray], pa.Array]:
    """Texts of lists of ids; bytes that form no character become U+FFFD."""
    top = max([i for _, i, _ in pieces.rows] + list(pieces.bytes.values()) + [pieces.unk]) + 1
    table: list[bytes] = [b""] * top
    for p, i, _ in pieces.rows:
        table[i] = p.replace(BAR, " ").encode()
    for b, i in pieces.bytes.items():
        table[i] = bytes([b])
    table[pieces.unk] = " ⁇ ".encode()
    skip = int(pieces.prefix)
    size = np.array([len(b) for b in table], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    letters = np.frombuffer(b"".join(table), np.uint8)

    def texts(lists: pa.ListArray) -> pa.Array:
        lists = lists.fill_null([]) if lists.null_count else lists
        flat = lists.flatten().to_numpy()
        count = size[flat]
        ends = np.concatenate(([0], np.cumsum(count)))
        data = letters[np.repeat(begin[flat] - ends[:-1], count) + np.arange(ends[-1])]
        at = ends[np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy())))]
        keep = np.ones(len(data), bool)
        # The first byte of a text is the space that encoding put there.
        keep[at[:-1][np.diff(at) > 0]] = not skip
        at = np.concatenate(([0], np.cumsum(keep)))[at].astype(np.int32)
        raw = pa.BinaryArray.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), pa.py_buffer(data[keep])])
        try:
            return raw.cast(pa.string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())

    return texts


def decode(rows: DataFrame, ids: str = "ids", pieces: Pieces | None = None) -> DataFrame:
    """``rows`` with ``decoded``."""
    texts = _decoder(pieces or Pieces())
    name = free_name(rows, "decoded")
    kept = rows.select(F.struct("*").alias("row"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row"), texts(part.column("ids"))], ["row", "text"])

    return kept.mapInArrow(run, f"row {rows.schema.simpleString()}, text string").select(
        "row.*", F.col("text").alias(name))
