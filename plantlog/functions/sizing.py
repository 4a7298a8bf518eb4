"""Size checks that come before any broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Rows of a dimension, and bytes of its rows as text, that every executor can hold.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 64 << 20


def bounded_rows(df: DataFrame, limit: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when ``df`` has at most ``limit`` rows of ``max_bytes`` together; reads no more rows than
    it must to know. Wide rows count by the text of all their fields."""
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    n, size = df.limit(limit + 1).agg(F.count("*"), F.sum(width.cast("bigint"))).first()
    return n <= limit and (size or 0) <= max_bytes


def broadcast_if_bounded(df: DataFrame, limit: int = BROADCAST_ROWS,
                         max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast a side proven small; otherwise leave the join to AQE (skew splits included)."""
    return F.broadcast(df) if bounded_rows(df, limit, max_bytes) else df
