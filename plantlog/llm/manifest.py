"""Merkle manifest of a dataset: digests of rows, one tree per group, one root, a proof per row.

``H`` is the lowercase hex SHA-256 of its inputs, digests as hex text. A leaf is H of its fields; per group
the leaves ascend by id, and while several nodes remain every ``ARITY`` consecutive ones become their H
(a shorter last run too). Group roots, ordered by group (null first, bytewise), become the root likewise.

A parent hashes its children one after the other and keeps a copy of the hash state *before each child*.
To fold a replaced child, the state before its slot is copied and takes the replacement and the siblings
on its right only; what lies on the left is in the state.

Scale: rows shrink to digests where they are read. Positions come from a range sort with per-partition
counts. A tree is cut into tiles of ``ARITY ** LEVELS`` consecutive nodes; a task builds whole tiles, so a
group of any size spreads over tasks and one pass shrinks the nodes by that factor. The way up
goes tile by tile to the roots; the way down hands each tile its path (a few nodes per level), and leaves
fold through the states of their own tile and of that path. Texts are read once, and no pass sorts or
collects a whole group.

Defined results: a null field is ``-``; an empty text ``0:``; rows without a group are a group of their own,
rows without an id come first in theirs; rows with equal ids are ordered by leaf digest, equal rows among
themselves are interchangeable; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from plantlog.functions.sizing import broadcast_if_bounded
from plantlog.llm.common import saved

ARITY, LEVELS = 2, 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<left:string,right:string>>"
_PATH = f"grp string, tile long, path {_STEP}, subroot string, root string"


def leaf_digest(fields: list[Column]) -> Column:
    """H of the fields, each with its length in bytes before it."""
    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*map(framed, fields)), 256)


class Parent:
    """Hash of a run of children, with the state before each of them."""
    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        state, self.children, self.states = sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def fold(self, slot: int, child: bytes) -> bytes:
        """Digest with ``child`` in the place of the one at ``slot``."""
        state = self.states[slot].copy()
        state.update(child)
        for right in self.children[slot + 1:]:
            state.update(right)
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1:])


class Step:
    """A level above the tile, as its path holds it: the state behind the left siblings."""
    __slots__ = ("left", "right", "state")

    def __init__(self, left: bytes, right: bytes):
        self.left, self.right, self.state = left, right, sha256(left)

    def fold(self, child: bytes) -> bytes:
        state = self.state.copy()
        state.update(child + self.right)
        return state.hexdigest().encode()


def levels(nodes: list[bytes], height: int | None = None) -> list[list[Parent]]:
    """Parents of ``nodes`` per level: ``height`` levels, or until one node is left."""
    out: list[list[Parent]] = []
    while len(out) < height if height is not None else len(nodes) > 1:
        out.append([Parent(nodes[i:i + ARITY]) for i in range(0, len(nodes), ARITY)])
        nodes = [p.digest for p in out[-1]]
    return out


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition and the running number inside (partition, group) to sorted rows."""
    from pyspark import TaskContext
    part, last, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        numbers = []
        for g in batch.column("grp").to_pylist():
            n = n + 1 if g == last else 0
            last = g
            numbers.append(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(numbers), pa.int32()), pa.array(numbers, pa.int64())],
            [*batch.schema.names, "part", "idx"])


def positions(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with ``grp``) and ``pos``, the place inside the group by ``order``, and ``n``, its size."""
    schema = f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in rows.schema)}, part int, idx long"
    laid = saved(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).mapInArrow(
        _number, schema), "manifest-ordered")
    group = Window.partitionBy("grp")
    counts = laid.groupBy("grp", "part").count().select(
        "grp", "part", F.sum("count").over(group).alias("n"),
        (F.sum("count").over(group.orderBy("part")) - F.col("count")).alias("before"))
    return laid.join(broadcast_if_bounded(saved(counts, "manifest-counts")), ["grp", "part"]).select(
        *rows.columns, (F.col("before") + F.col("idx")).alias("pos"), "n")


def _tiled(nodes: DataFrame, deep: int) -> DataFrame:
    return nodes.withColumn("tile", F.floor(F.col("pos") / ARITY ** deep).cast("long"))


def _height(deep: int, table: pa.Table) -> int | None:
    """A tile of several has all levels, even where its nodes are few; a lone one ends at its root."""
    return deep if table.column("n")[0].as_py() > ARITY ** deep else None


def _hashes(table: pa.Table) -> list[bytes]:
    return [h.encode() for h in table.column("hash").to_pylist()]


def _shrink(deep: int, table: pa.Table) -> pa.Table:
    table = table.sort_by("pos")
    nodes = _hashes(table)
    tree = levels(nodes, _height(deep, table))
    root = tree[-1][0].digest if tree else nodes[0]
    n = table.column("n")[0].as_py()
    return pa.table({"grp": table.column("grp")[:1], "pos": table.column("tile")[:1], "n": [-(-n // ARITY ** deep)],
                     "hash": [root.decode()]})


def _task(fn: Callable, deep: int) -> Callable:
    """``fn`` with its depth, under the plain signature that the grouped calls look at."""
    if fn is _shrink:
        return lambda table: fn(deep, table)
    return lambda nodes, above: fn(deep, nodes, above)


def _up(nodes: DataFrame, deep: int) -> list[DataFrame]:
    """``nodes`` and the tables above it, down to one node per group."""
    out, top = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while top > 1:
        out.append(saved(_tiled(out[-1], deep).select("grp", "tile", "pos", "n", "hash").groupBy("grp", "tile").applyInArrow(
            _task(_shrink, deep), "grp string, pos long, n long, hash string"), "manifest-nodes"))
        top = -(-top // ARITY ** deep)
    return out


def _way(tree: list[list[Parent]], place: int) -> Iterator[tuple[Parent, int]]:
    for level in tree:
        yield level[place // ARITY], place % ARITY
        place //= ARITY


def _hand_down(deep: int, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Path of every node of a tile: its siblings in the tile, then the path of the tile."""
    nodes = nodes.sort_by("pos")
    tree, rest = levels(_hashes(nodes), _height(deep, nodes)), above.column("path")[0].as_py()
    paths = [[dict(zip(("left", "right"), (s.decode() for s in p.siblings(slot)))) for p, slot in _way(tree, i)] + rest
             for i in range(len(nodes))]
    same = lambda c: [above.column(c)[0].as_py()] * len(nodes)
    kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
    return pa.table({"grp": nodes.column("grp"), "tile": nodes.column("pos"), "path": pa.array(paths, kind),
                     "subroot": pa.array(same("subroot"), pa.string()), "root": pa.array(same("root"), pa.string())})


def _down(tables: list[DataFrame], path: DataFrame, last: Callable, schema: str, deep: int) -> DataFrame:
    """Hands ``path`` (of the root tile) down to the lowest of ``tables``, which ``last`` turns into rows."""
    for i, nodes in reversed(list(enumerate(tables[:-1]))):
        step = _tiled(nodes, deep).groupBy("grp", "tile").cogroup(path.groupBy("grp", "tile"))
        path = step.applyInArrow(_task(last, deep), schema) if i == 0 else saved(
            step.applyInArrow(_task(_hand_down, deep), _PATH), "manifest-paths")
    return path


def _prove(deep: int, leaves: pa.Table, above: pa.Table) -> pa.Table:
    leaves = leaves.sort_by("pos")
    nodes = _hashes(leaves)
    tree = levels(nodes, _height(deep, leaves))
    steps = [Step(s["left"].encode(), s["right"].encode()) for s in above.column("path")[0].as_py()]
    upper = b"".join(s.left + s.right for s in steps)
    subroot, root = above.column("subroot")[0].as_py(), above.column("root")[0].as_py()
    proofs, folded = [], []
    for i, changed in enumerate(leaves.column("changed").to_pylist()):
        value, proof = changed.encode() if changed else nodes[i], sha256()
        for parent, slot in _way(tree, i):
            for s in parent.siblings(slot):
                proof.update(s)
            value = parent.fold(slot, value)
        for s in steps:
            value = s.fold(value)
        proof.update(upper)
        proofs.append(proof.hexdigest())
        folded.append(value.decode())
    full = lambda v: pa.array([v] * len(nodes), pa.string())
    folded_root = pa.array(folded, pa.string())
    return pa.table({"id": leaves.column("id"), "leaf": leaves.column("hash"), "subroot": full(subroot), "root": full(root),
                     "proof_sha256": pa.array(proofs, pa.string()), "folded_root": folded_root,
                     "verified": pc.equal(folded_root, root)})


def manifest(docs: DataFrame, group: str = "lang", doc_id: str = "doc_id", fields: tuple[str, ...] = FIELDS,
             changes: dict[str, Column] | None = None, changed: Column | None = None, deep: int = LEVELS) -> DataFrame:
    """One row per row of ``docs``: its id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (H of its
    siblings up to the root), ``folded_root`` and ``verified``. Rows where ``changed`` holds are folded with
    the fields of ``changes`` in place of their own, as a reader of a tampered table would. ``deep`` is the
    number of levels of a tile."""
    own = leaf_digest([F.col(f) for f in fields])
    new = leaf_digest([(changes or {}).get(f, F.col(f)) for f in fields])
    # A prefix keeps the null group apart from every text and before them all.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = docs.select(key.alias("grp"), F.col(doc_id).alias("id"), own.alias("hash"), F.when(
        changed if changed is not None else F.lit(False), new).alias("changed"))
    rows = saved(rows, "manifest-leaves").withColumn("uid", F.monotonically_increasing_id())
    leaves = saved(positions(rows, "id", "hash", "uid").drop("uid"), "manifest-positions")
    up = _up(leaves, deep)
    if len(up) == 1:
        # Groups of one row each: the leaf is the subroot; one pass through lone tiles keeps one form.
        up.append(leaves.select("grp", "pos", "n", "hash"))
    roots = saved(positions(up[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "hash"), "name"),
                  "manifest-roots")
    above = _up(roots, deep)
    if len(above) == 1:
        above.append(roots.select("grp", "pos", "n", "hash"))
    start = above[-1].select("grp", F.lit(0).cast("long").alias("tile"), F.array().cast(_STEP).alias("path"), F.lit(
        "").alias("subroot"), F.col("hash").alias("root"))
    tops = saved(_down(above, start, _named, _PATH, deep), "manifest-tops")
    identity = dict((f.name, f.dataType.simpleString()) for f in docs.schema)[doc_id]
    return _down(up, tops, _prove, f"id {identity}, leaf string, subroot string, root string, proof_sha256 string, "
                 "folded_root string, verified boolean", deep).withColumnRenamed("id", doc_id)


def _named(deep: int, nodes: pa.Table, above: pa.Table) -> pa.Table:
    """Paths of the group roots, under the names of their groups."""
    nodes = nodes.sort_by("pos")
    out = _hand_down(deep, nodes, above)
    return out.set_column(0, "grp", nodes.column("name")).set_column(1, "tile", pa.array([0] * len(nodes), pa.int64())
                                                                     ).set_column(3, "subroot", nodes.column("hash"))
