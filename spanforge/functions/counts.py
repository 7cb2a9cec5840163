"""Read counts, downsampling, fold changes and other vector functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COUNT_MODES = ("All", "Weight", "Divide", "Unique", "CollapseAll", "CollapseUnique", "No")


def count(mode: str, n: Column, multiplicity: Column, weight: Column | None = None) -> Column:
    """A count in one of the seven modes; the weight is 1 / multiplicity where none is stored."""
    one = F.greatest(multiplicity, F.lit(1))
    weight = 1.0 / one if weight is None else weight
    return {
        "All": lambda: n, "Weight": lambda: n * weight, "Divide": lambda: n / one,
        "Unique": lambda: F.when(multiplicity <= 1, n).otherwise(0),
        "CollapseAll": lambda: F.when(n > 0, 1).otherwise(0),
        "CollapseUnique": lambda: F.when((n > 0) & (multiplicity <= 1), 1).otherwise(0),
        "No": lambda: F.lit(0),
    }[mode]()


def vector_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


DOWNSAMPLERS = ("No", "Max", "Logsc", "Log", "Min", "SquareRoot", "Digital")


def downsample(mode: str, v: Column) -> Column:
    """A count vector made smaller: by its maximum, logarithmically, to 0/1, ..."""
    top = F.array_max(v)
    low = F.array_min(F.filter(v, lambda x: x > 0))
    return {
        "No": lambda: v,
        "Max": lambda: F.when(top > 1, F.transform(v, lambda x: x / top)).otherwise(v),
        "Logsc": lambda: F.when(top > 0, F.transform(v, lambda x: x / top * F.log2(top))).otherwise(v),
        "Log": lambda: F.transform(v, lambda x: F.log2(x + 1)),
        "Min": lambda: F.when(low.isNotNull(), F.transform(v, lambda x: x / low)).otherwise(v),
        "SquareRoot": lambda: F.transform(v, F.sqrt),
        "Digital": lambda: F.transform(v, lambda x: F.when(x > 0, 1.0).otherwise(0.0)),
    }[mode]()


def log2_fold_change(a: Column, b: Column, pseudo: float = 1.0) -> Column:
    return F.log2((a + pseudo) / (b + pseudo))


def map_fold_change(a: Column, b: Column, prior_a: float, prior_b: float) -> Column:
    """The mode of the posterior under a beta prior."""
    return F.log2((a + prior_a - 1) / (b + prior_b - 1))


def rpm(value: Column, total: Column) -> Column:
    return value * 1e6 / total


def cumulative(v: Column) -> Column:
    return F.aggregate(v, F.array().cast("array<double>"), lambda acc, x: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + x)))


def decumulate(v: Column) -> Column:
    return F.transform(v, lambda x, i: x - F.coalesce(F.get(v, i - 1), F.lit(0.0)))


def normalized(v: Column) -> Column:
    return F.transform(v, lambda x: x / vector_sum(v))


def argmax(v: Column) -> Column:
    return F.array_position(v, F.array_max(v)) - 1


def _mean(v: Column) -> Column:
    return vector_sum(v) / F.size(v)


def _power(v: Column, k: int) -> Column:
    m = _mean(v)
    return F.aggregate(F.transform(v, lambda x: F.pow(x - m, F.lit(k))), F.lit(0.0), lambda a, x: a + x)


def _median(v: Column) -> Column:
    s = F.array_sort(v)
    return (F.get(s, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(s, F.floor(F.size(v) / 2).cast("int"))) / 2


#: Vector functions by name.
VECTOR = {
    "Sum": vector_sum,
    "Mean": _mean,
    "Min": F.array_min,
    "Max": F.array_max,
    "Product": lambda v: F.aggregate(v, F.lit(1.0), lambda a, x: a * x),
    "SumOfSquares": lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x),
    "SumOfLogs": lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + F.log(x)),
    "GeometricMean": lambda v: F.exp(F.aggregate(v, F.lit(0.0), lambda a, x: a + F.log(x)) / F.size(v)),
    "GeometricMeanRemoveNonPositive": lambda v: VECTOR["GeometricMean"](F.filter(v, lambda x: x > 0)),
    "Variance": lambda v: F.when(F.size(v) > 1, _power(v, 2) / (F.size(v) - 1)),
    "StandardDeviation": lambda v: F.sqrt(VECTOR["Variance"](v)),
    "SinhMean": lambda v: F.sinh(_mean(F.transform(v, F.asinh))),
    "Median": _median,
    "Mad": lambda v: _median(F.transform(v, lambda x: F.abs(x - _median(v)))),
    "Count": lambda v: F.size(v).cast("double"),
    "Entropy": lambda v: -F.aggregate(F.filter(v, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x / vector_sum(v) * F.log2(x / vector_sum(v))),
}


def quantile(v: Column, q: float) -> Column:
    """Linear interpolation between order statistics."""
    s, at = F.array_sort(v), (F.size(v) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.get(s, low), F.get(s, F.least(low + 1, F.size(v) - 1))
    return a + (b - a) * (at - low)


def order_statistic(v: Column, rank: int) -> Column:
    return F.get(F.array_sort(v), F.lit(rank))


def trimmed_mean(v: Column, q: float) -> Column:
    """Mean without the share ``q`` of the values at either end."""
    k = F.floor(F.size(v) * F.lit(q)).cast("int")
    return _mean(F.slice(F.array_sort(v), k + 1, F.size(v) - 2 * k))


def bin_fixed(x: Column, low: float, high: float, bins: int) -> Column:
    """Bin index; -1 below, ``bins`` above; truncates toward zero just below the minimum, as its callers expect."""
    at = (x - low) * bins / (high - low)
    return F.when(at <= -1, -1).when(at >= bins, bins).otherwise(at.cast("bigint")).cast("bigint")


def bin_boundaries(x: Column, bounds: list[float]) -> Column:
    """How many boundaries are at most x, less one."""
    return (F.size(F.filter(F.array(*[F.lit(float(b)) for b in bounds]), lambda b: b <= x)) - 1).cast("bigint")


def ec_minmax(v: Column) -> Column:
    return F.transform(v, lambda x: (x - F.array_min(v)) / (F.array_max(v) - F.array_min(v)))


def zscores(v: Column) -> Column:
    return F.transform(v, lambda x: (x - _mean(v)) / VECTOR["StandardDeviation"](v))
