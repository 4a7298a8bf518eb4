"""Whitening of quantised embeddings: exact covariance, eigenvectors refined in higher precision.

Entries become integers, floor(256 * c). The fit list holds every distinct vector once. Its moments are sums
of integers and exact: a first pass gives n and S, a second the products of x - m with m the rounded mean,
so values are centred before they are multiplied; what m leaves of the mean is corrected in integers.

The eigenvectors come from float32 and are corrected by Ogita-Aishima iterations in extended precision, a
few matrix products each, with errors that square from step to step. Eigenvalues closer than the step's
error bound form clusters whose vectors the iteration cannot tell apart: each is solved anew as a small
matrix, the covariance inside its subspace less the cluster's mean, where the spread is large again.

Scale: distinct vectors are one shuffle of the vectors, partially aggregated first, so copies cost a row per
task. Each task sums its own d x d products with BLAS; partial sums are merged in a tree of fan-in
``FAN``. The driver holds d x d numbers for each vector length, never rows. Vectors of different lengths are
populations of their own.

Defined results: rows with a null vector, a null or non-finite entry, or no entry have no rows; entries beyond
64 bits after scaling are held at their ends; ``deviation`` is null where it passes 64 bits; a component whose
variance is 0 (fewer distinct vectors than components, constant entries) has ``whitened`` null, ``explained``
0 (null if nothing varies) and does not count for ``identity_error``; for equal eigenvalues any orthonormal
basis of their space is right and one is used for all rows; repeated rows weigh once and are all returned;
an empty table gives an empty table; only id and vector are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plantlog.llm.common import saved

SCALE, COMPONENTS, FAN, ROWS = 256, 4, 32, 2048
STEPS = 40
Wide = np.longdouble


def quantised(vector: Column) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(SCALE) * c.cast("double")).cast("long"))


def _usable(v: Column) -> Column:
    return F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(
        c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def _dump(x: np.ndarray) -> bytes:
    """Numbers of one kind: floats, 64-bit integers, or decimal text beyond."""
    if x.dtype == np.float64:
        return b"d" + x.tobytes()
    if x.dtype == object and max((abs(v) for v in x.ravel()), default=0) >= 1 << 63:
        return b"o" + ",".join(map(str, x.ravel())).encode()
    return b"q" + x.astype(np.int64).tobytes()


def _load(raw: bytes) -> np.ndarray:
    if raw[:1] == b"o":
        return np.array([int(v) for v in raw[1:].split(b",")], object)
    x = np.frombuffer(raw, raw[:1].decode(), offset=1)
    # Sums of many parts may pass 64 bits: integers add as unbounded ones.
    return x if raw[:1] == b"d" else x.astype(object)


def vectors_of(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their vectors as a matrix) per length, ``ROWS`` at a time."""
    at, flat = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    size = np.diff(at)
    for dim in np.unique(size).tolist():
        pick = np.flatnonzero(size == dim)
        for lo in range(0, len(pick), ROWS):
            some = pick[lo:lo + ROWS]
            yield some, flat[at[some][:, None] + np.arange(dim)]


def _centred(x: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """x - centre, exact: 64-bit integers if they fit."""
    top = max(int(x.max()), -int(x.min())) + max((abs(int(c)) for c in centre), default=0)
    return x - centre.astype(np.int64) if top < 1 << 62 else x.astype(object) - centre


def _gram(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exact: float64 products where all sums stay below 2**53."""
    top = int(np.abs(y).max()) if y.size else 0
    if top * top * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    return y.astype(object).T @ y.astype(object)


def _tree_sum(fit: DataFrame, part_of: Callable[[np.ndarray], list[np.ndarray]]) -> dict[int, list[np.ndarray]]:
    """Per vector length: the sums, over all rows, of the arrays that ``part_of`` makes of a matrix."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        sums: dict[int, list] = {}
        for batch in batches:
            for _, x in vectors_of(batch.column("x")):
                new = part_of(x)
                old = sums.get(x.shape[1])
                sums[x.shape[1]] = new if old is None else [a + b for a, b in zip(old, new)]
        part = TaskContext.get().partitionId()
        for dim, parts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([part]), pa.array(
                [[_dump(p) for p in parts]], pa.list_(pa.binary()))], ["dim", "part", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total: list = []
        for parts in table.column("sums").to_pylist():
            arrays = [_load(p) for p in parts]
            total = arrays if not total else [a + b for a, b in zip(total, arrays)]
        return pa.table({"dim": table.column("dim")[:1], "part": table.column("up")[:1], "sums": pa.array(
            [[_dump(t) for t in total]], pa.list_(pa.binary()))})

    kind = "dim int, part long, sums array<binary>"
    parts, width = saved(fit.mapInArrow(partial, kind), "white-parts"), max(fit.rdd.getNumPartitions(), 1)
    while width > 1:
        parts = saved(parts.withColumn("up", F.floor(F.col("part") / FAN).cast("long")).groupBy("dim", "up").applyInArrow(
            merge, kind), "white-sums")
        width = -(-width // FAN)
    return {r["dim"]: [_load(s) for s in r["sums"]] for r in parts.collect()}


def _orthonormal(q: np.ndarray) -> np.ndarray:
    for _ in range(2):
        for i in range(q.shape[1]):
            q[:, i] -= q[:, :i] @ (q[:, :i].T @ q[:, i])
            q[:, i] /= np.sqrt((q[:, i] ** 2).sum())
    return q


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > width) + 1
    return [c for c in np.split(order, cuts) if len(c) > 1]


def refined(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and eigenvectors of a symmetric matrix of extended precision."""
    d, scale = len(matrix), np.abs(matrix).max(initial=0)
    if not scale:
        return np.zeros(d, Wide), np.eye(d, dtype=Wide)
    a, one = (matrix / scale).astype(Wide), np.eye(d, dtype=Wide)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(Wide)
    size, best, still = np.sqrt((a ** 2).sum()), np.inf, 0
    for _ in range(STEPS):
        r, s = one - x.T @ x, x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        bound = 2 * (np.sqrt(((s - np.diag(values)) ** 2).sum()) + size * np.sqrt((r ** 2).sum()))
        gap = values[None, :] - values[:, None]
        clear = np.abs(gap) > bound
        e = np.where(clear, (s + values[None, :] * r) / np.where(clear, gap, 1), r / 2)
        x = x + x @ e
        for c in _clusters(values, bound):
            q = _orthonormal(x[:, c].copy())
            inside = q.T @ (a @ q - values[c].mean() * q)
            inside = (inside + inside.T) / 2
            spread = np.abs(inside).max()
            if spread > np.finfo(Wide).eps * size:
                x[:, c] = q @ np.linalg.eigh((inside / spread).astype(np.float64))[1].astype(Wide)
            else:
                x[:, c] = q
        moved = np.abs(e).max() + np.abs(np.where(clear, 0, s - np.diag(np.diag(s)))).max()
        still = still + 1 if moved >= best / 2 else 0
        best = min(best, moved)
        if moved < 8 * np.finfo(Wide).eps or still > 2:
            break
    x = _orthonormal(x)
    values = np.einsum("ij,ij->j", x, a @ x) * scale
    order = np.argsort(-values, kind="stable")
    return values[order], x[:, order]


@dataclass
class Model:
    """Moments and components of the vectors of one length; ``rest`` is what ``centre`` leaves of the mean."""
    n: int
    sums: np.ndarray
    centre: np.ndarray
    rest: np.ndarray
    axes: np.ndarray
    values: np.ndarray
    explained: list[float | None]
    error: float | None = None

    @property
    def live(self) -> np.ndarray:
        return self.values > 0

    def whiten(self, x: np.ndarray) -> np.ndarray:
        y = _centred(x, self.centre).astype(np.float64) - self.rest
        with np.errstate(divide="ignore", invalid="ignore"):
            return (y @ self.axes) / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        y, left = _centred(x, self.centre), self.sums - self.n * self.centre
        top = self.n * (int(np.abs(y).max()) if y.size else 0) + max(abs(int(v)) for v in left)
        if top * top * x.shape[1] < 1 << 62:
            z = self.n * y.astype(np.int64) - left.astype(np.int64)
            return (z * z).sum(axis=1).tolist()
        z = self.n * y.astype(object) - left
        return [int(v) if v < 1 << 63 else None for v in (z * z).sum(axis=1)]


def fit(distinct: DataFrame, components: int = COMPONENTS) -> dict[int, Model]:
    """A model per vector length from the table ``distinct`` (``x``)."""
    def first(x: np.ndarray) -> list[np.ndarray]:
        return [np.array([len(x)], object), x.astype(object).sum(axis=0) if _large(x) else x.sum(axis=0).astype(object)]

    totals = {dim: (int(n[0]), s) for dim, (n, s) in _tree_sum(distinct, first).items()}
    centres = {dim: np.array([(2 * int(v) + n) // (2 * n) for v in s], object) for dim, (n, s) in totals.items()}
    grams = _tree_sum(distinct, lambda x: [_gram(_centred(x, centres[x.shape[1]])).ravel()])
    models = {}
    for dim, (n, s) in totals.items():
        m, centre = grams[dim][0].reshape(dim, dim), centres[dim]
        left = s - n * centre
        # n^2 V = n * sum (x-m)(x-m)' - D D' with D = S - n m, all in integers.
        exact = n * m - np.outer(left, left)
        v = exact.astype(Wide) / Wide(n) / Wide(n)
        values, axes = refined(v)
        trace, k = np.trace(v), min(components, dim)
        values = np.where(values > trace * Wide(2.0 ** -54), values, 0)[:k]
        models[dim] = Model(n, s, centre, (left.astype(Wide) / n).astype(np.float64), axes[:, :k].astype(np.float64),
                            values.astype(np.float64), [float(e / trace) if trace else None for e in values])
    squares = _tree_sum(distinct, lambda x: [_square(models[x.shape[1]].whiten(x), models[x.shape[1]].live)])
    for dim, model in models.items():
        k = int(model.live.sum())
        model.error = float(np.abs(squares[dim][0].reshape(k, k) / model.n - np.eye(k)).max()) if k else None
    return models


def _large(x: np.ndarray) -> bool:
    return max(int(x.max()), -int(x.min())) * len(x) >= 1 << 62


def _square(w: np.ndarray, live: np.ndarray) -> np.ndarray:
    return (w[:, live].T @ w[:, live]).ravel()


def _apply(models: dict[int, Model]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in vectors_of(batch.column("x")):
                model = models[x.shape[1]]
                k, w = len(model.values), model.whiten(x)
                dead = np.broadcast_to(~model.live, w.shape)
                each = lambda v: np.repeat(v, k)
                deviation = pa.array(model.deviations(x), pa.int64()).take(pa.array(each(np.arange(len(rows)))))
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").take(pa.array(each(rows))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    pa.array(np.full(len(rows) * k, model.n)), deviation,
                    pa.array(w.ravel(), pa.float64(), mask=dead.ravel()), pa.array(model.explained * len(rows), pa.float64()),
                    pa.array([model.error] * (len(rows) * k), pa.float64())],
                    ["id", "component", "n", "deviation", "whitened", "explained", "identity_error"])
    return run


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
           components: int = COMPONENTS) -> DataFrame:
    """Per usable row and component (from 1, by falling variance): id, ``component``, ``n``, ``deviation``,
    ``whitened``, ``explained``, ``identity_error``."""
    rows = vectors.where(_usable(F.col(embedding))).select(F.col(vec_id).alias("id"), quantised(F.col(embedding)).alias("x"))
    models = fit(saved(rows.select("x").distinct(), "white-fit"), components)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_apply(models), f"id {kind}, component int, n long, deviation long, whitened double, "
                           "explained double, identity_error double").withColumnRenamed("id", vec_id)
