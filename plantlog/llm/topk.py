"""Exact top-k search by tiled matrix products.

Vectors are packed into tiles of ``TILE`` rows where they are read; queries into blocks of ``BLOCK`` rows.
A tile meets every block once, through an equi-join on block number and ``shelf`` (a group of tiles);
neither side is broadcast and no pair of rows exists outside a matrix product. Each product keeps its
``k`` best per query by partial selection, tiles of one shelf are merged while they pass, and the lists
of all shelves are merged in a tree of fan-in ``FAN``, so no task sees more than ``FAN * k`` rows a query.

Entries are exact at any size of the double. Products are exact: float64 while every sum is below 2**53, else 64-bit or unbounded integers
(scores beyond 64 bits are held at its ends). Only vectors of the query's own length are compared.

Defined results: vectors that are null, empty, or hold a null or non-finite component, and rows without
an id, take no part; a query skips its own row only, so a repeated row is a candidate for its twin;
ties go to the smaller id; other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plantlog.llm.common import saved

TILE, BLOCK, SHELF, FAN = 4096, 1024, 16, 64
_TILES = "tile long, dim int, uids binary, ids binary, matrix binary"


def quantise(x: np.ndarray) -> np.ndarray:
    """floor(256 * x) as integers, of unbounded size where 64 bits are too few."""
    x = x.astype(np.float64)
    if x.size and np.abs(x).max() >= 2.0 ** 54:
        # From 2**53 on a double is an integer; 256 times it may be no double any more.
        return np.array([256 * int(v) if abs(v) >= 2.0 ** 53 else int(np.floor(256 * v)) for v in x.ravel()], object).reshape(x.shape)
    return np.floor(256 * x).astype(np.int64)


def _pack(matrix: np.ndarray) -> bytes:
    """Rows as big a type as they need, named by the first byte."""
    if matrix.dtype == object:
        return b"o" + ",".join(map(str, matrix.ravel())).encode()
    top = np.abs(matrix).max(initial=0)
    kind = b"h" if top < 1 << 15 else b"i" if top < 1 << 31 else b"q"
    return kind + matrix.astype(kind.decode()).tobytes()


def _unpack(raw: bytes, dim: int) -> np.ndarray:
    if raw[:1] == b"o":
        return np.array([int(v) for v in raw[1:].split(b",")], object).reshape(-1, dim)
    return np.frombuffer(raw, raw[:1].decode(), offset=1).reshape(-1, dim).astype(np.int64)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    base, row, tile = TaskContext.get().partitionId() << 40, 0, 0
    held: dict[int, list] = {}

    def flush(dim: int) -> pa.RecordBatch:
        nonlocal tile
        uids, ids, matrix = (np.concatenate(x) for x in zip(*held.pop(dim)))
        order = np.argsort(ids, kind="stable")
        tile += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([base + tile]), pa.array([dim], pa.int32()), pa.array([uids[order].tobytes()]),
             pa.array([ids[order].tobytes()]), pa.array([_pack(matrix[order])])],
            ["tile", "dim", "uids", "ids", "matrix"])

    for batch in batches:
        ids = batch.column("id").to_numpy(zero_copy_only=False).astype(np.int64)
        vectors = batch.column("vector")
        at = vectors.offsets.to_numpy()
        flat = vectors.values.to_numpy(zero_copy_only=False)
        uids = base + row + np.arange(len(ids))
        row += len(ids)
        size = np.diff(at)
        for dim in np.unique(size):
            pick = np.flatnonzero(size == dim)
            for lo in range(0, len(pick), TILE):
                some = pick[lo:lo + TILE]
                held.setdefault(int(dim), []).append((uids[some], ids[some], quantise(
                    flat[at[some][:, None] + np.arange(dim)])))
                if sum(len(x[0]) for x in held[dim]) >= TILE:
                    yield flush(int(dim))
    for dim in list(held):
        yield flush(dim)


def _queries(every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], np.int64)
                pick = np.flatnonzero(ids % every == 0)
                matrix = _unpack(r["matrix"], r["dim"])[pick]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["dim"]] * len(pick), pa.int32()),
                     pa.array(np.frombuffer(r["uids"], np.int64)[pick]), pa.array(ids[pick]),
                     pa.array([_pack(m[None, :]) for m in matrix], pa.binary())],
                    ["dim", "uid", "id", "row"])
    return run


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores of one query, ties to the smaller id."""
    if len(scores) > k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= floor)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    if q.dtype != object and c.dtype != object:
        bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
        if bound < 2.0 ** 53:
            return (q.astype(np.float64) @ c.T.astype(np.float64)).astype(np.int64)
        if bound < 2.0 ** 63:
            return q @ c.T
    wide = np.dot(q.astype(object), c.T.astype(object))
    return np.clip(wide, -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, q, best = None, None, []

        def flush() -> pa.RecordBatch:
            n = [len(b[0]) for b in best]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(q["uid"], n)), pa.array(np.repeat(q["id"], n)),
                 pa.array(np.full(sum(n), group[2], np.int32)), pa.array(np.concatenate([b[0] for b in best])),
                 pa.array(np.concatenate([b[1] for b in best]))], ["uid", "query_id", "shelf", "vec_id", "score"])

        for batch in batches:
            for r in batch.to_pylist():
                if (r["dim"], r["block"], r["shelf"]) != group:
                    if group:
                        yield flush()
                    group = r["dim"], r["block"], r["shelf"]
                    rows = r["queries"]
                    parts = [_unpack(x["row"], r["dim"]) for x in rows]
                    q = {"uid": np.array([x["uid"] for x in rows]), "id": np.array([x["id"] for x in rows]),
                         "m": np.concatenate(parts)}
                    best = [(np.zeros(0, np.int64),) * 2] * len(rows)
                uids, ids = (np.frombuffer(r[n], np.int64) for n in ("uids", "ids"))
                scores = _products(q["m"], _unpack(r["matrix"], r["dim"]))
                for i, own in enumerate(q["uid"]):
                    pick = _best(scores[i], ids, k + 1)
                    pick = pick[uids[pick] != own][:k]
                    s, v = np.concatenate((best[i][1], scores[i][pick])), np.concatenate((best[i][0], ids[pick]))
                    top = _best(s, v, k)
                    best[i] = v[top], s[top]
        if group:
            yield flush()
    return run


def _valid(v: Column) -> Column:
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x.cast("double")) < float("inf")))


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, vec_id: str = "vec_id",
          embedding: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` best candidates of every row whose id is
    divisible by ``every``."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).alias("vector")).where(
        F.col("id").isNotNull() & F.coalesce(_valid(F.col("vector")), F.lit(False)))
    tiles = saved(rows.mapInArrow(_tiles, _TILES), "topk-tiles")
    queries = saved(tiles.mapInArrow(_queries(every), "dim int, uid long, id long, row binary"), "topk-queries")
    blocks = {r["dim"]: -(-r["count"] // BLOCK) for r in queries.groupBy("dim").count().collect()}
    shelves = {r["dim"]: -(-r["count"] // SHELF) for r in tiles.groupBy("dim").count().collect()}
    sizes = vectors.sparkSession.createDataFrame(
        [(d, n, shelves[d]) for d, n in blocks.items()], "dim int, blocks int, shelves int")
    packed = queries.join(F.broadcast(sizes), "dim").groupBy("dim", "shelves", F.pmod(
        F.xxhash64("uid"), F.col("blocks")).cast("int").alias("block")).agg(
        F.collect_list(F.struct("uid", "id", "row")).alias("queries"))
    packed = packed.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.col("shelves") - 1))).drop("shelves")
    laid = tiles.join(F.broadcast(sizes), "dim").withColumn("shelf", F.pmod(
        F.xxhash64("tile"), F.col("shelves")).cast("int")).withColumn("block", F.explode(
            F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "shelves")
    lists = laid.join(packed, ["dim", "block", "shelf"]).mapInArrow(
        _search(k), "uid long, query_id long, shelf int, vec_id long, score long")

    def merged(df: DataFrame, *keys: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    width = max(shelves.values(), default=1)
    while width > FAN:
        lists = merged(lists.withColumn("shelf", F.expr(f"shelf div {FAN}").cast("int")), "uid", "shelf").drop("rank")
        width = -(-width // FAN)
    return merged(lists, "uid").select("query_id", "rank", "vec_id", "score")
