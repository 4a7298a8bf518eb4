"""Input, intermediates in the cluster's shared folder, and byte-level text arrays for tasks.

``ByteTexts`` holds the UTF-8 bytes of a few documents as one array. Words are runs of bytes other
than space and 0x09-0x0D (``[^\\x20\\x09-\\x0D]+``); all counting and hashing is vectorised, so a
task never builds one Python object per word. Texts enter whole; ``chunks`` only groups documents,
so that a task holds about ``CHUNK_BYTES`` (or one longer document) at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from plantlog.session import work_dir

CHUNK_BYTES = 3 << 20
WORD = r"[^\x20\x09-\x0D]+"
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Spark removes the shuffle files of a query that has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends at files that outlive
    any executor, and the shuffles behind them may go at once."""
    spark = df.sparkSession
    path, before = work_dir(spark, name), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Removes the files of ``saved`` frames that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_at)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = stem
    while name.lower() in taken:
        name = f"_{name}"
    return name


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        have[0] = 1
        _POWERS[base] = np.multiply.accumulate(have)
    return _POWERS[base][:n]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, ByteTexts]]:
    """(first row, end row, texts) of consecutive rows; null is the empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[
        column.offset:column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, ByteTexts(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
        lo = hi


class ByteTexts:
    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    @classmethod
    def of(cls, texts: Iterable[bytes]) -> ByteTexts:
        texts = list(texts)
        return cls(np.frombuffer(b"".join(texts), np.uint8),
                   np.cumsum([0, *map(len, texts)]).astype(np.int64))

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """Number of set flags (one per byte) of each document."""
        total = np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    @cached_property
    def space(self) -> np.ndarray:
        return _SPACE[self.data]

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end byte of every word, in order."""
        n = len(self.data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        solid = ~self.space
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.concatenate(([True], self.space[:-1]))
        after = np.concatenate((self.space[1:], [True]))
        return (np.flatnonzero(solid & (before | edge[:-1])),
                np.flatnonzero(solid & (after | edge[1:])) + 1)

    @cached_property
    def word_doc(self) -> np.ndarray:
        return np.searchsorted(self.offsets, self.words[0], "right") - 1

    @cached_property
    def word_offsets(self) -> np.ndarray:
        """Index of the first word of each document, and the number of words."""
        return np.searchsorted(self.words[0], self.offsets)

    @cached_property
    def _prefix(self) -> np.ndarray:
        out = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * _powers(_BASE, len(self.data)), out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of the bytes of each range; equal bytes give equal hashes in every task."""
        p = self._prefix
        raw = (p[ends] - p[starts]) * _powers(_INV, len(p))[starts]
        return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    @cached_property
    def word_hash(self) -> np.ndarray:
        return self.hashes(*self.words)

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each run of ``size`` words inside one document."""
        h, doc = self.word_hash, self.word_doc
        n = len(h) - size + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        acc = np.zeros(n, np.uint64)
        for k in range(size):
            acc = acc * np.uint64(0x9FB21C651E98DF25) + h[k:k + n]
        first = np.flatnonzero(doc[:n] == doc[size - 1:])
        return first, mix(acc[first])

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()
