"""Statistics over columns: multiple testing, ROC, counters, tests, EM, UMI collapsing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan, tracks


def benjamini_hochberg(df: DataFrame, p: str, order: list[str], out: str = "q") -> DataFrame:
    """Adjusted p-values: the running minimum of n / rank * p from the largest p down."""
    n = df.count()
    ranked = tracks.numbered(df, [p, *order], None, "_rank").withColumn("_back", F.lit(n) - F.col("_rank"))
    value = F.least(F.lit(1.0), F.col(p) * n / (F.col("_rank") + 1))
    return scan.running(ranked.withColumn("_all", F.lit(1)), ["_all"], "_back", [], -value, "_m", "max").withColumn(out, -F.col("_m")).drop("_rank", "_back", "_all", "_m")


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """Per distinct score, from high to low: true and false positives when it is the cutoff."""
    steps = df.groupBy(score).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.count("*").alias("n")).withColumn("f", F.col("n") - F.col("p"))
    ranked = tracks.numbered(steps, [F.desc(score)], None, "_row").withColumn("_all", F.lit(1))
    for count, out in (("p", "tp"), ("f", "fp")):
        ranked = scan.running(ranked, ["_all"], "_row", [], F.col(count), out)
    return ranked.select(score, "tp", "fp")


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row with the area under the ROC curve, ties counting half."""
    pos, neg = F.col(label).cast("bigint"), 1 - F.col(label).cast("bigint")
    steps = df.groupBy(score).agg(F.sum(pos).alias("p"), F.sum(neg).alias("n"))
    below = scan.running(tracks.numbered(steps, [score], None, "_row").withColumn("_all", F.lit(1)), ["_all"], "_row", [], F.col("n"), "_below")
    return below.agg((F.sum(F.col("p") * (F.col("_below") - F.col("n") / 2)) / (F.sum("p") * F.sum("n"))).alias("auc"))


def counter(df: DataFrame, keys: list[str], dimension: str, values: list) -> DataFrame:
    """Counts per key with a column for each value of a dimension, 0 where there is none."""
    return df.groupBy(*keys).pivot(dimension, values).count().na.fill(0)


def column_entropy(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Shannon entropy in bits of a column's values per key."""
    n = df.groupBy(*keys, value).count()
    total = n.groupBy(*keys).agg(F.sum("count").alias("t"))
    p = F.col("count") / F.col("t")
    return n.join(total, keys).groupBy(*keys).agg((-F.sum(p * F.log2(p))).alias("entropy"))


def equivalence_classes(hits: DataFrame, row: str, member: str, value: Column | None = None) -> DataFrame:
    """Rows by the sorted set of members that they are compatible with: (members, n)."""
    sets = hits.groupBy(row).agg(F.array_sort(F.collect_set(member)).alias("members"), F.first(F.lit(1) if value is None else value).alias("_v"))
    return sets.groupBy("members").agg(F.sum("_v").alias("n"))


def em_proportions(classes: DataFrame, members: str = "members", n: str = "n", tolerance: float = 0.01, max_steps: int = 1000) -> DataFrame:
    """Member proportions by expectation maximisation over equivalence-class counts.

    Stops when no expected count moves by more than ``tolerance``. Each step is a join and a group-by;
    the state is written every few steps to cut the lineage.
    """
    from ..plans import store

    numbered = store.stored(classes.select(F.monotonically_increasing_id().alias("c"), F.col(n).cast("double").alias("n"), F.col(members).alias("ms")), "em")
    flat = numbered.select("c", "n", F.explode("ms").alias("m"))
    total = classes.agg(F.sum(n)).first()[0] or 0
    k = flat.select("m").distinct().count()
    pi = flat.select("m").distinct().withColumn("pi", F.lit(1.0 / max(k, 1)))
    for _ in range(max_steps):
        shares = flat.join(pi, "m")
        sums = shares.groupBy("c").agg(F.sum("pi").alias("s"))
        new = shares.join(sums, "c").groupBy("m").agg((F.sum(F.col("n") * F.col("pi") / F.col("s")) / F.lit(float(total))).alias("new"))
        both = store.stored(new.join(pi, "m"), "em-step")
        moved = both.agg(F.max(F.abs(F.col("new") - F.col("pi")) * float(total))).first()[0]
        pi = both.select("m", F.col("new").alias("pi"))
        if moved is None or moved <= tolerance:
            break
    return pi


def collapse_umis(df: DataFrame, keys: list[str], umi: str, correct: bool = False) -> DataFrame:
    """Distinct UMIs per key. With ``correct``, a UMI joins one that differs in one place and has at least
    2 * count - 1 reads, rarest first."""
    counts = df.groupBy(*keys, umi).agg(F.count("*").alias("n"))
    if not correct:
        return counts.groupBy(*keys).agg(F.count("*").alias("umis"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        left = dict(sorted(zip(pdf[umi], pdf["n"], strict=True)))
        letters = sorted({c for u in left for c in u})
        for u in sorted(left, key=lambda u: (left[u], u)):
            beside = (u[:i] + c + u[i + 1 :] for i, old in enumerate(u) for c in letters if c != old)
            near = [v for v in beside if left.get(v, 0) >= 2 * left[u] - 1 and v in left]
            if near:
                v = max(near, key=lambda v: (left[v], v))
                left[v] += left.pop(u)
        return pd.DataFrame([[*pdf[keys].iloc[0], len(left)]], columns=[*keys, "umis"])

    schema = ", ".join(f"{c} {t}" for c, t in counts.dtypes if c in keys) + ", umis bigint"
    return counts.groupBy(*keys).applyInPandas(merge, schema)


_LOG_FACTORIALS = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 1 << 12)))])


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """From a table, and by Stirling's series beyond it."""
    x = np.maximum(k, 1).astype(np.float64)
    series = x * np.log(x) - x + 0.5 * np.log(2 * math.pi * x) + 1 / (12 * x) - 1 / (360 * x**3)
    return np.where(k < len(_LOG_FACTORIALS), _LOG_FACTORIALS[np.minimum(k, len(_LOG_FACTORIALS) - 1)], series)


def fisher_exact(df: DataFrame, a: str, b: str, c: str, d: str, out: str = "p", tail: str = "two") -> DataFrame:
    """p of 2x2 tables from hypergeometric terms: ``left`` (a as small or smaller), ``right`` or ``two`` tailed."""

    def p_value(w: int, x: int, y: int, z: int) -> float:
        low = max(0, w - z)
        k = np.arange(low, min(w + x, w + y) + 1)
        base = _log_factorial(np.array([w + x, y + z, w + y, x + z])).sum() - _log_factorial(np.array([w + x + y + z]))[0]
        terms = np.exp(base - _log_factorial(k) - _log_factorial(w + x - k) - _log_factorial(w + y - k) - _log_factorial(z - w + k))
        own = terms[w - low]
        chosen = {"left": k <= w, "right": k >= w, "two": terms <= own * (1 + 1e-7)}[tail]
        return float(min(1.0, terms[chosen].sum()))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(**{out: [p_value(*map(int, r)) for r in pdf[[a, b, c, d]].itertuples(index=False)]})

    return df.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + f", {out} double")


def normal_two_sided(z: Column) -> Column:
    """P(|Z| >= |z|), by a rational approximation of the complementary error function (relative error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # Chebyshev coefficients of the approximation, from the highest power down.
    powers = (0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223)
    series = F.lit(0.0)
    for c in powers:
        series = series * t + c
    return t * F.exp(series - x * x)


def mann_whitney(df: DataFrame, keys: list[str], group: str, value: str) -> DataFrame:
    """U of the rows whose group is true, and a two-sided p by normal approximation with ties."""
    tied = df.groupBy(*keys, value).agg(F.count("*").alias("_t"), F.sum(F.col(group).cast("bigint")).alias("_g"))
    below = F.coalesce(F.sum("_t").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = tied.withColumn("_r", below + (F.col("_t") + 1) / 2)
    s = ranks.groupBy(*keys).agg(F.sum(F.col("_r") * F.col("_g")).alias("_w"), F.sum("_g").alias("_m"), F.sum("_t").alias("_n"), F.sum(F.pow("_t", F.lit(3)) - F.col("_t")).alias("_ties"))
    m, n = F.col("_m"), F.col("_n") - F.col("_m")
    u = F.col("_w") - m * (m + 1) / 2
    sigma = F.sqrt(m * n / 12 * (F.col("_n") + 1 - F.col("_ties") / (F.col("_n") * (F.col("_n") - 1))))
    z = (u - m * n / 2) / sigma
    return s.select(*keys, u.alias("u"), z.alias("z"), normal_two_sided(z).alias("p"))


def one_way_anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: F with its degrees of freedom."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"))
    t = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum((F.col("n") - 1) * F.col("v")).alias("w"))
    between = (F.col("ss") - F.col("s") * F.col("s") / F.col("n")) / (F.col("k") - 1)
    return t.select((between / (F.col("w") / (F.col("n") - F.col("k")))).alias("f"), (F.col("k") - 1).alias("df1"), (F.col("n") - F.col("k")).alias("df2"))


def beta_quantile(a: float, b: float, q: float) -> float:
    """Quantile of a beta distribution by bisection on its regularised incomplete integral."""
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if beta_cdf(a, b, mid) < q else (lo, mid)
    return (lo + hi) / 2


def beta_cdf(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    total = d
    for m in range(1, 300):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + term * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + term / c
            c = c if abs(c) > tiny else tiny
            total *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return front * total


def beta_logits(a: np.ndarray, b: np.ndarray, q: float) -> np.ndarray:
    """ln(x / (1 - x)) at the quantile x of each beta distribution: Newton steps on the logit, kept inside a bracket."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    constant = np.array([math.lgamma(x + y) - math.lgamma(x) - math.lgamma(y) for x, y in zip(a.tolist(), b.tolist(), strict=True)])
    out = np.log(a / b)
    todo = np.arange(len(a))
    lo, hi = np.full(len(a), -700.0), np.full(len(a), 700.0)
    for _ in range(200):
        if not len(todo):
            break
        t, p, r = out[todo], a[todo], b[todo]
        log_x, log_y = -np.logaddexp(0, -t), -np.logaddexp(0, t)
        density = np.exp(constant[todo] + p * log_x + r * log_y)  # of the logit
        # from the smaller side, so that far tails keep their digits
        flip = np.exp(log_x) > (p + 1) / (p + r + 2)
        tail = density * _beta_fraction(np.where(flip, r, p), np.where(flip, p, r), np.exp(np.where(flip, log_y, log_x)))
        off = np.where(flip, (1 - q) - tail, tail - q)
        lo[todo], hi[todo] = np.where(off < 0, t, lo[todo]), np.where(off < 0, hi[todo], t)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            new = t - off / density
        new = np.where((new > lo[todo]) & (new < hi[todo]), new, (lo[todo] + hi[todo]) / 2)
        out[todo] = np.where(off == 0, t, new)
        todo = todo[(off != 0) & (np.abs(new - t) > 1e-14 * np.maximum(1, np.abs(t)))]
    return out


def _beta_fraction(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The continued fraction of the incomplete beta function, over a."""
    tiny = 1e-300
    away = lambda v: np.where(np.abs(v) > tiny, v, tiny)
    c, d = np.ones(len(a)), 1 / away(1 - (a + b) * x / (a + 1))
    total, out, at = d.copy(), np.empty(len(a)), np.arange(len(a))
    for m in range(1, 100_000):
        for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / away(1 + term * d)
            c = away(1 + term / c)
            total = total * d * c
        going = np.abs(d * c - 1) >= 1e-14
        if not going.all():
            out[at[~going]] = total[~going] / a[~going]
            a, b, x, c, d, total, at = (v[going] for v in (a, b, x, c, d, total, at))
            if not len(at):
                return out
    out[at] = total / a
    return out


def fold_change_interval(df: DataFrame, a: str, b: str, level: float = 0.95) -> DataFrame:
    """Log2 fold changes (a+1)/(b+1) with a credible interval from the beta posterior. Equal pairs of a batch are computed once."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            pairs, at = np.unique(pdf[[a, b]].to_numpy(np.float64), axis=0, return_inverse=True)
            at = at.reshape(-1)
            lower, upper = (beta_logits(pairs[:, 0] + 1, pairs[:, 1] + 1, q) / math.log(2) for q in ((1 - level) / 2, (1 + level) / 2))
            yield pdf.assign(lower=lower[at], upper=upper[at])

    df = df.withColumn("lfc", F.log2((F.col(a) + 1.0) / (F.col(b) + 1.0)))
    return df.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + ", lower double, upper double")


def markov_chain(df: DataFrame, keys: list[str], order: list[str], state: str) -> DataFrame:
    """Transition counts and probabilities between neighbouring states."""
    moves = df.withColumn("_to", F.lead(state).over(Window.partitionBy(*keys).orderBy(*order))).where("_to is not null").groupBy(F.col(state).alias("from"), F.col("_to").alias("to")).agg(F.count("*").alias("n"))
    total = moves.groupBy("from").agg(F.sum("n").alias("t"))
    return moves.join(total, "from").select("from", "to", "n", (F.col("n") / F.col("t")).alias("p"))


def max_scoring_segment(df: DataFrame, keys: list[str], pos: str, score: str) -> DataFrame:
    """The best sum of consecutive scores per key, as running sum less its smallest value before."""
    w = Window.partitionBy(*keys).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_s", F.sum(score).over(w))
    before = F.least(F.lit(0), F.coalesce(F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.withColumn("_best", F.col("_s") - before).groupBy(*keys).agg(F.max("_best").alias("best"))


def combine_p_values(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Fisher's combined p per key: the tail of a chi-square with 2k degrees of freedom, a finite sum."""
    g = df.groupBy(*keys).agg((-F.sum(F.log(p))).alias("_x"), F.count("*").cast("int").alias("_n"))
    term = F.aggregate(F.sequence(F.lit(1), F.col("_n")), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("t")), lambda a, i: F.struct((a["s"] + a["t"]).alias("s"), (a["t"] * F.col("_x") / i).alias("t")))
    return g.select(*keys, F.col("_n").alias("tests"), (F.exp(-F.col("_x")) * term["s"]).alias("p"))


def mantel_haenszel(df: DataFrame, a: str, b: str, c: str, d: str) -> DataFrame:
    """One row: the common odds ratio of 2x2 tables and the chi-square statistic without correction."""
    n = F.col(a) + F.col(b) + F.col(c) + F.col(d)
    rows = df.where(n > 1)
    expected = (F.col(a) + F.col(b)) * (F.col(a) + F.col(c)) / n
    variance = (F.col(a) + F.col(b)) * (F.col(c) + F.col(d)) * (F.col(a) + F.col(c)) * (F.col(b) + F.col(d)) / (n * n * (n - 1))
    s = rows.agg(F.sum(F.col(a) * F.col(d) / n).alias("x"), F.sum(F.col(b) * F.col(c) / n).alias("y"), F.sum(F.col(a) - expected).alias("e"), F.sum(variance).alias("v"))
    return s.select((F.col("x") / F.col("y")).alias("odds_ratio"), (F.col("e") * F.col("e") / F.col("v")).alias("chi2"))


def cross_correlation(a: DataFrame, b: DataFrame, keys: list[str], pos: str, value: str, lags: range) -> DataFrame:
    """Pearson correlation of two tracks at each lag of the second, over positions that both have."""
    shifted = b.select(*keys, F.col(value).alias("_b"), F.explode(F.array(*[F.lit(x) for x in lags])).alias("lag"), F.col(pos).alias("_p")).withColumn(pos, F.col("_p") - F.col("lag"))
    return a.join(shifted, [*keys, pos]).groupBy("lag").agg(F.corr(value, "_b").alias("r"), F.count("*").alias("n"))


def iqr_outliers(df: DataFrame, keys: list[str], value: str, cutoff: float = 1.5, out: str = "outlier") -> DataFrame:
    """Rows beyond the quartiles by so many interquartile ranges."""
    q = df.groupBy(*keys).agg(F.percentile(value, 0.25).alias("_q1"), F.percentile(value, 0.75).alias("_q3"))
    width = (F.col("_q3") - F.col("_q1")) * cutoff
    return df.join(q, keys).withColumn(out, (F.col(value) < F.col("_q1") - width) | (F.col(value) > F.col("_q3") + width)).drop("_q1", "_q3")


def digamma(x: float) -> float:
    """By recurrence to x >= 8 and an asymptotic series."""
    shift = 0.0
    while x < 8:
        shift -= 1 / x
        x += 1
    y = 1 / (x * x)
    return shift + math.log(x) - 0.5 / x - y * (1 / 12 - y * (1 / 120 - y * (1 / 252 - y / 240)))


def posterior_mean_fold_change(df: DataFrame, a: str, b: str, prior_a: float = 1.0, prior_b: float = 1.0, out: str = "lfc") -> DataFrame:
    """Posterior mean of the log2 fold change under a beta prior."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(**{out: [(digamma(x + prior_a) - digamma(y + prior_b)) / math.log(2) for x, y in zip(pdf[a], pdf[b], strict=True)]})

    return df.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + f", {out} double")


def ecdf(df: DataFrame, keys: list[str], value: str, out: str = "ecdf") -> DataFrame:
    return df.withColumn(out, F.cume_dist().over(Window.partitionBy(*keys).orderBy(value)))
