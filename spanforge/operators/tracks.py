"""Tracks: coverage, clusters, junctions, profiles, smoothing, rolling windows, numeric ranges."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import region as R
from . import scan

KEYS = ["ref", "strand"]


def clusters(df: DataFrame, tolerance: int = 0, aggs: list[Column] | None = None, start: str = "s", end: str = "e", touching: bool = False) -> DataFrame:
    """Overlapping rows per (ref, strand) merged: bounds, number of rows and further aggregates."""
    marked = scan.islands(df, KEYS, start, end, tolerance, touching=touching)
    return marked.groupBy(*KEYS, "island").agg(F.min(start).alias("s"), F.max(end).alias("e"), F.count("*").alias("n"), *(aggs or [])).drop("island")


def coverage(df: DataFrame, value: Column, parts: str = "parts") -> DataFrame:
    """Runs of equal summed value (ref, strand, s, e, depth), without runs of depth 0.

    Neighbouring runs of equal depth stay apart where an interval starts or ends between them only if the
    depth changes there.
    """
    each = df.select(*KEYS, value.alias("v"), F.explode(parts).alias("p"))
    both = F.array(F.struct(F.col("p.s").alias("pos"), F.col("v").alias("v")), F.struct(F.col("p.e").alias("pos"), (-F.col("v")).alias("v")))
    each = each.select(*KEYS, F.explode(both).alias("x")).select(*KEYS, "x.pos", "x.v")
    steps = each.groupBy(*KEYS, F.floor(F.col("pos") / scan.BUCKET).alias("_b"), "pos").agg(F.sum("v").alias("v")).where("v <> 0").repartition(*KEYS, "_b")
    # depth and the next step inside a bucket; a row per bucket carries the depth in and the first step after
    own = Window.partitionBy(*KEYS, "_b").orderBy("pos")
    inside = steps.withColumns({"_d": F.sum("v").over(own.rowsBetween(Window.unboundedPreceding, 0)), "_e": F.lead("pos").over(own)})
    border = Window.partitionBy(*KEYS).orderBy("_b")
    borders = steps.groupBy(*KEYS, "_b").agg(F.sum("v").alias("_t"), F.min("pos").alias("_f"))
    borders = borders.select(*KEYS, "_b", F.coalesce(F.sum("_t").over(border.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_c"), F.lead("_f").over(border).alias("_n"))
    runs = inside.join(borders, [*KEYS, "_b"]).select(*KEYS, F.col("pos").alias("s"), F.coalesce("_e", "_n").alias("e"), (F.col("_d") + F.col("_c")).alias("depth"))
    return runs.where("depth <> 0 and e is not null")


def junctions(df: DataFrame, value: Column, parts: str = "parts") -> DataFrame:
    """Introns with their summed value."""
    each = df.select(*KEYS, value.alias("v"), F.explode(R.introns(parts)).alias("i"))
    return each.groupBy(*KEYS, F.col("i.s").alias("s"), F.col("i.e").alias("e")).agg(F.sum("v").alias("v"))


def position_profile(df: DataFrame, kind: str, value: Column, offset: int = 0, parts: str = "parts") -> DataFrame:
    """Summed value at a named position of each row."""
    return df.groupBy(*KEYS, R.position(kind, "strand", parts, offset).alias("pos")).agg(F.sum(value).alias("v"))


def range_aggregates(track: DataFrame, regions: DataFrame, region_id: str, value: str = "value") -> DataFrame:
    """Min, max, sum, mean per position and mean of present values of a numeric track in regions.

    ``track``: (ref, pos, value); ``regions``: (region_id, ref, s, e). NaN where a region has no value.
    """
    from .joins import bin_of, explode_bins

    width = 1024
    spread = explode_bins(regions, "s", "e", width, "_bin")
    hits = spread.join(track.withColumn("_bin", bin_of(F.col("pos"), width)), ["ref", "_bin"], "left").where("pos is null or (pos >= s and pos < e)")
    found = hits.where("pos is not null").groupBy(region_id).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.count(value).alias("n"))
    out = regions.join(found, region_id, "left")
    nan = F.lit(float("nan"))
    return out.select(
        region_id, *[F.coalesce(c, nan).alias(c) for c in ("min", "max", "sum")], F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce(F.col("sum") / (F.col("e") - F.col("s")), nan).alias("mean"), F.coalesce(F.col("sum") / F.col("n"), nan).alias("available_mean"),
    )


def numbered(df: DataFrame, order: list[Column | str], keys: list[str] | None = None, out: str = "rn") -> DataFrame:
    """Row numbers from 0. Without keys the order is global: range partitions are counted first, so
    that no task gets all rows."""
    if keys:
        return df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint"))
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND((1 << 33) - 1)})
    from ..plans import store

    placed = store.stored(placed, "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    first = sizes.withColumn("_first", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return placed.join(F.broadcast(first.drop("_n")), "_part").withColumn(out, F.col("_at") + F.col("_first")).drop("_id", "_part", "_at", "_first")


def kernel(name: str, half: int) -> list[float]:
    """Weights at offsets -half..half, summing to 1."""
    offsets = range(-half, half + 1)
    shape = {
        "Gaussian": lambda x: math.exp(-0.5 * (x / max(half / 2, 1e-9)) ** 2),
        "Epanechnikov": lambda x: 1 - (x / (half + 1)) ** 2,
        "Singleton": lambda x: 1.0 if x == 0 else 0.0,
        "Uniform": lambda x: 1.0,
    }[name]
    w = [shape(x) for x in offsets]
    return [x / sum(w) for x in w]


def smooth(df: DataFrame, keys: list[str], pos: str, value: str, weights: list[float], out: str = "smoothed") -> DataFrame:
    """Kernel-weighted sums over dense positions; rows nearer to an edge than the kernel stay as they are."""
    half = len(weights) // 2
    spread = df.select(*keys, F.col(value).alias("_v"), F.explode(F.array(*[F.struct((F.col(pos) - (i - half)).alias("p"), F.lit(w).alias("w")) for i, w in enumerate(weights)])).alias("_k"))
    sums = spread.groupBy(*keys, F.col("_k.p").alias(pos)).agg(F.sum(F.col("_v") * F.col("_k.w")).alias("_s"), F.count("*").alias("_n"))
    return df.join(sums, [*keys, pos]).withColumn(out, F.when(F.col("_n") == len(weights), F.col("_s")).otherwise(F.col(value))).drop("_s", "_n")


def rolling(df: DataFrame, keys: list[str], order: list[Column | str], before: int, after: int, aggs: dict[str, Column]) -> DataFrame:
    """Aggregates over so many rows before and after, per key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-before, after)
    return df.withColumns({k: a.over(w) for k, a in aggs.items()})


def rolling_equisize(df: DataFrame, keys: list[str], covariate: str, value: str, half: int, step: int) -> DataFrame:
    """Statistics of windows of 2*half+1 rows around every ``step``-th row by covariate, with all ties
    at both borders included. Per window: the middle's covariate, its rows and their mean."""
    rows = df.withColumns({"_rn": F.row_number().over(Window.partitionBy(*keys).orderBy(covariate, value)) - 1, "_n": F.count("*").over(Window.partitionBy(*keys))})
    middle = rows.where(f"_rn % {step} = 0").select(*keys, F.col("_rn").alias("mid"), F.col(covariate).alias("at"), F.greatest(F.col("_rn") - half, F.lit(0)).alias("lo"), F.least(F.col("_rn") + half, F.col("_n") - 1).alias("hi"))
    # rows and sums up to and before each covariate, so that a window is a difference
    ties = df.groupBy(*keys, covariate).agg(F.count("*").alias("c"), F.sum(value).alias("t"))
    upto = Window.partitionBy(*keys).orderBy(covariate).rowsBetween(Window.unboundedPreceding, 0)
    sums = ties.withColumns({"_c": F.sum("c").over(upto), "_t": F.sum("t").over(upto)})
    at = rows.select(*keys, "_rn", covariate).join(sums, [*keys, covariate])
    low = at.select(*keys, F.col("_rn").alias("lo"), (F.col("_c") - F.col("c")).alias("c0"), (F.col("_t") - F.col("t")).alias("t0"))
    high = at.select(*keys, F.col("_rn").alias("hi"), F.col("_c").alias("c1"), F.col("_t").alias("t1"))
    found = middle.join(low, [*keys, "lo"]).join(high, [*keys, "hi"])
    n = F.col("c1") - F.col("c0")
    return found.select(*keys, "mid", "at", n.alias("n"), ((F.col("t1") - F.col("t0")) / n).alias("mean"))


def rolling_covariate(df: DataFrame, keys: list[str], covariate: str, value: str, width: float, overlap: float) -> DataFrame:
    """Windows of a fixed covariate width, the next starting ``width - overlap`` on, from the smallest
    covariate of the key. Per window: start, rows and mean value."""
    step = width - overlap
    first = df.groupBy(*keys).agg(F.min(covariate).alias("_min"))
    rows = df.join(first, keys)
    at = F.col(covariate) - F.col("_min")
    last = F.floor(at / step)
    windows = rows.withColumn("_w", F.explode(F.sequence(F.greatest(F.lit(0).cast("bigint"), F.floor((at - width) / step) + 1), last)))
    return windows.groupBy(*keys, "_w", "_min").agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(*keys, (F.col("_min") + F.col("_w") * step).alias("from"), "n", "mean")


def metagene(df: DataFrame, regions: DataFrame, region_id: str, bins: int) -> DataFrame:
    """Profile over regions scaled to a fixed number of bins: (bin, v). ``df``: (ref, pos, value)."""
    from .joins import bin_of, explode_bins

    hits = explode_bins(regions, "s", "e", 1024, "_bin").join(df.withColumn("_bin", bin_of(F.col("pos"), 1024)), ["ref", "_bin"]).where("pos >= s and pos < e")
    at = F.floor((F.col("pos") - F.col("s")) * bins / (F.col("e") - F.col("s")))
    return hits.groupBy(at.alias("bin")).agg(F.sum("value").alias("v"))


def pattern_matrix(df: DataFrame, length: str, pos: str, value: Column, weights: list[float] | None = None) -> DataFrame:
    """Summed value by length and position, (length, pos, v), spread along the positions by kernel weights."""
    sums = df.groupBy(length, pos).agg(F.sum(value).alias("v"))
    if weights is None:
        return sums
    half = len(weights) // 2
    each = F.explode(F.array(*[F.struct((F.col(pos) + i - half).alias("p"), F.lit(w).alias("w")) for i, w in enumerate(weights)]))
    spread = sums.select(length, "v", each.alias("k"))
    return spread.groupBy(length, F.col("k.p").alias(pos)).agg(F.sum(F.col("v") * F.col("k.w")).alias("v"))
