"""Running aggregates that don't gather a key's rows in one task.

A window over (keys) alone puts all rows of a key into one task; with a handful of references that is
the whole table. Here positions are cut into buckets: each bucket runs on its own, and a small table
of one row per bucket carries what came before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 1 << 16


def running(df: DataFrame, keys: list[str], pos: str, order: list[Column | str], value: Column, out: str, how: str = "sum", include: bool = True, bucket: int = BUCKET) -> DataFrame:
    """``df`` with the running sum or max of ``value`` in (pos, order), up to this row or the one before."""
    agg: Callable = {"sum": F.sum, "max": F.max}[how]
    # one exchange serves the rows and their bucket totals
    rows = df.withColumns({"_value": value, "_bucket": F.floor(F.col(pos) / bucket)}).repartition(*keys, "_bucket")
    frame = Window.partitionBy(*keys, "_bucket").orderBy(pos, *order).rowsBetween(Window.unboundedPreceding, 0 if include else -1)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_bucket").agg(agg("_value").alias("_total"))
    carried = totals.withColumn("_carry", agg("_total").over(before)).drop("_total")
    inner = rows.withColumn("_inner", agg("_value").over(frame))
    joined = inner.join(carried, [*keys, "_bucket"])
    if how == "sum":
        result = F.when(F.col("_inner").isNotNull() | F.col("_carry").isNotNull(), F.coalesce("_inner", F.lit(0)) + F.coalesce("_carry", F.lit(0)))
    else:
        result = F.greatest("_inner", "_carry")
    return joined.withColumn(out, result).drop("_value", "_bucket", "_inner", "_carry")


def next_row(df: DataFrame, keys: list[str], pos: str, value: str, out: str, bucket: int = BUCKET) -> DataFrame:
    """``df`` with ``value`` of the following row by ``pos``; positions of a key are distinct."""
    rows = df.withColumn("_bucket", F.floor(F.col(pos) / bucket)).repartition(*keys, "_bucket")
    own = Window.partitionBy(*keys, "_bucket").orderBy(pos)
    firsts = rows.groupBy(*keys, "_bucket").agg(F.min_by(value, pos).alias("_first"))
    firsts = firsts.withColumn("_after", F.lead("_first").over(Window.partitionBy(*keys).orderBy("_bucket"))).drop("_first")
    joined = rows.withColumn("_next", F.lead(value).over(own)).join(firsts, [*keys, "_bucket"])
    return joined.withColumn(out, F.coalesce("_next", "_after")).drop("_bucket", "_next", "_after")


def islands(df: DataFrame, keys: list[str], start: str, end: str, tolerance: int = 0, order: list[str] | None = None, touching: bool = False, out: str = "island") -> DataFrame:
    """``df`` with the number of its cluster: a row starts one if it begins ``tolerance`` or more
    after everything before it has ended (with ``touching``: more than that)."""
    order = [end, *(order or [])]
    rows = running(df, keys, start, order, F.col(end), "_reach", "max", include=False)
    gap = F.col(start) - F.col("_reach")
    opens = F.coalesce(gap > tolerance if touching else gap >= tolerance, F.lit(True))
    # among equal rows the one that opens the cluster comes first
    marked = rows.withColumn("_opens", opens.cast("bigint"))
    return running(marked, keys, start, [*order, F.desc("_opens")], F.col("_opens"), out).drop("_reach", "_opens")
