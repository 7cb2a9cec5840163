"""Column frames: factors, binding, transposition, sums, unique names, prefix search, neighbours."""

from __future__ import annotations

from functools import reduce
from itertools import permutations as _permutations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from . import flow


class Factor:
    """An ordered categorical: a string column with a fixed list of levels."""

    def __init__(self, levels: list[str]):
        if len(set(levels)) != len(levels):
            raise ValueError("levels repeat")
        self.levels = list(levels)

    @staticmethod
    def of(df: DataFrame, column: str, most: int = 10_000) -> Factor:
        """Levels in sorted order; a column of more than ``most`` levels is none."""
        rows = df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"{column} has more than {most} levels")
        return Factor([r[0] for r in rows])

    def index(self, column: str) -> Column:
        """The level's number, null for values that are no level."""
        table = F.create_map(*[F.lit(x) for i, level in enumerate(self.levels) for x in (level, i)])
        return F.try_element_at(table, F.col(column))

    def tabulate(self, df: DataFrame, column: str) -> DataFrame:
        """Counts of all levels, those without rows included, in level order."""
        spark = df.sparkSession
        levels = spark.createDataFrame([(i, x) for i, x in enumerate(self.levels)], f"level int, {column} string")
        counts = df.groupBy(column).agg(F.count("*").alias("n"))
        return levels.join(counts, column, "left").select("level", column, F.coalesce("n", F.lit(0)).alias("n"))


def bind_rows(*frames: DataFrame) -> DataFrame:
    return flow.chain(*frames)


def bind_columns(order: list[str], left: DataFrame, right: DataFrame) -> DataFrame:
    return flow.frame_merge(order, left, right).drop("i")


def transpose(df: DataFrame, key: str, name: str = "column") -> DataFrame:
    """Rows become columns named by ``key``; the numeric columns become rows."""
    values = [c for c in df.columns if c != key]
    return df.unpivot(key, values, name, "_v").groupBy(name).pivot(key).agg(F.first("_v"))


def row_sums(df: DataFrame, columns: list[str], out: str = "total") -> DataFrame:
    return df.withColumn(out, reduce(lambda a, b: a + b, [F.col(c) for c in columns]))


def column_sums(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.sum(c).alias(c) for c in columns])


def make_unique(df: DataFrame, name: str, order: list[str], out: str) -> DataFrame:
    """Names made distinct: the first of equals stays, the others get _1, _2, ..."""
    numbered = flow.Flow(df).ranks([name], order, "_n").df
    return numbered.withColumn(out, F.when(F.col("_n") == 0, F.col(name)).otherwise(F.concat_ws("_", name, "_n"))).drop("_n")


def prefix_join(df: DataFrame, text: str, prefixes: DataFrame, prefix: str, longest: int) -> DataFrame:
    """Rows with each prefix of a table that their text starts with, by an equi-join on all its beginnings up to ``longest``."""
    spread = df.withColumn("_p", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.greatest(F.length(text), F.lit(1)), F.lit(longest))), lambda n: F.substr(F.col(text), F.lit(1), n))))
    return spread.join(prefixes.withColumnRenamed(prefix, "_p"), "_p").withColumnRenamed("_p", prefix)


def hamming_neighbours(word: Column, alphabet: str = "ACGT") -> Column:
    """All words that differ from this one in exactly one place."""
    letters = F.array(*[F.lit(c) for c in alphabet])
    n = F.length(word)
    at = lambda i: F.transform(F.filter(letters, lambda c: c != F.substr(word, i, F.lit(1))), lambda c: F.concat(F.substr(word, F.lit(1), i - 1), c, F.substr(word, i + 1, n)))
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), at))).otherwise(F.array().cast("array<string>"))


def mismatch_graph(words: DataFrame, word: str, alphabet: str = "ACGT") -> DataFrame:
    """Pairs (a, b), a < b, of distinct words at Hamming distance 1, by joining neighbours instead of all pairs."""
    w = words.select(F.col(word).alias("a")).distinct()
    near = w.select("a", F.explode(hamming_neighbours(F.col("a"), alphabet)).alias("b")).where("a < b")
    return near.join(w.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")


def near_pairs(df: DataFrame, group: list[str], key: str, word: str) -> DataFrame:
    """Pairs of a group, each once, whose words are of one length and differ in one place at most: structs ``a``
    and ``b`` with a's key the smaller. Rows meet under their words with one place left out; equal words only meet
    at the first."""
    rows = df.select(*group, F.struct(*[c for c in df.columns if c not in group]).alias("a"), F.col(word).alias("_w"))
    n = F.length("_w")
    rows = rows.withColumn("_i", F.explode(F.sequence(F.lit(1), F.greatest(n, F.lit(1)))))
    rows = rows.withColumns({"_n": n, "_rest": F.concat(F.substr("_w", F.lit(1), F.col("_i") - 1), F.substr("_w", F.col("_i") + 1, n))})
    other = rows.withColumnsRenamed({"a": "b", "_w": "_v"})
    met = rows.join(other, [*group, "_i", "_n", "_rest"]).where((F.col(f"a.{key}") < F.col(f"b.{key}")) & ((F.col("_w") != F.col("_v")) | (F.col("_i") == 1)))
    return met.select(*group, "a", "b")


def permutations(items: list) -> list[tuple]:
    return list(_permutations(items))


def observe(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """The frame, and metrics that are known once an action has run over it."""
    o = Observation()
    return df.observe(o, *[c.alias(n) for n, c in metrics.items()]), o
