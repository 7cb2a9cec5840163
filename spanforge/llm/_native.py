"""Column expressions on words, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Rows of a table that are broadcast at most; larger ones are joined by shuffles.
BROADCAST_ROWS = 200_000
#: Bytes of text in it at most.
BROADCAST_BYTES = 32 << 20


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _UPPER.lower())


def split_words(text: Column, separators: str) -> Column:
    """Words between runs of a character class; no words in null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+"), "")


def indices(n: Column) -> Column:
    """0 .. n-1, none where n is not positive."""
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("array()").cast("array<int>"))


def window_hashes(words: str, k: int) -> Column:
    """Hashes of all windows of k words of an array column."""
    w = F.col(words)
    return F.transform(indices(F.size(w) - (k - 1)), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))


def small(df: DataFrame, rows: int, n_bytes: int | None = 0) -> DataFrame:
    """A broadcast hint, where so many rows with so many bytes of text are few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (n_bytes or 0) <= BROADCAST_BYTES else df
