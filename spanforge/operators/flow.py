"""Dataflow operators over DataFrames with an explicit order where the operation depends on one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scan, tracks


class Flow:
    """A chain of dataflow steps; every method returns a new Flow and nothing runs before an action."""

    def __init__(self, df: DataFrame):
        self.df = df

    def _with(self, df: DataFrame) -> Flow:
        return Flow(df)

    def map(self, **columns: Column | str) -> Flow:
        return self._with(self.df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()]))

    def filter(self, predicate: Column | str) -> Flow:
        return self._with(self.df.where(predicate))

    def remove_nulls(self, *columns: str) -> Flow:
        return self._with(self.df.dropna(subset=list(columns) or None))

    def cast_filtered(self, column: str, kind: str) -> Flow:
        """Rows whose value has the type, cast to it."""
        return self._with(self.df.withColumn(column, F.col(column).try_cast(kind)).where(F.col(column).isNotNull()))

    def iff(self, condition: bool, step: Callable[[Flow], Flow]) -> Flow:
        return step(self) if condition else self

    def unfold(self, column: str, out: str) -> Flow:
        return self._with(self.df.withColumn(out, F.explode(column)))

    def require(self, predicate: Column, message: str) -> Flow:
        """Fails on the first row that breaks the predicate."""
        ok = F.when(predicate, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean"))
        return self._with(self.df.where(ok))

    def sort(self, *order: Column | str) -> Flow:
        return self._with(self.df.orderBy(*order))

    def resort(self, weak: list[str], strong: list[Column | str]) -> Flow:
        """Rows sorted inside runs of equal weak keys, by ranges of them."""
        return self._with(self.df.repartitionByRange(*weak).sortWithinPartitions(*weak, *strong))

    def head(self, n: int) -> Flow:
        return self._with(self.df.limit(n))

    def skip(self, n: int, *order: Column | str) -> Flow:
        return self._with(self.df.orderBy(*order).offset(n))

    def sub(self, start: int, stop: int, *order: Column | str) -> Flow:
        """Rows start .. stop-1 in the order."""
        return self._with(self.df.orderBy(*order).offset(start).limit(stop - start))

    def skip_while(self, keys: list[str], order: list[Column | str], predicate: Column) -> Flow:
        """Per key, the rows from the first one on that breaks the predicate."""
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return self._with(self.df.withColumn("_broken", F.max((~predicate).cast("int")).over(w)).where("_broken = 1").drop("_broken"))

    def tabulate(self, *keys: str, out: str = "n") -> Flow:
        return self._with(self.df.groupBy(*keys).agg(F.count("*").alias(out)))

    def fold(self, keys: list[str], **aggs: Column) -> Flow:
        return self._with(self.df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggs.items()]))

    def group(self, keys: list[str], out: str = "rows") -> Flow:
        """All rows of a key as a sorted array of structs."""
        rest = [c for c in self.df.columns if c not in keys]
        return self._with(self.df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(out)))

    def index_smallest(self, keys: list[str], order: list[str]) -> Flow:
        """For each key the row that comes first."""
        row = F.min(F.struct(*order, *[c for c in self.df.columns if c not in [*keys, *order]])).alias("_row")
        return self._with(self.df.groupBy(*keys).agg(row).select(*keys, "_row.*"))

    def index_combine(self, keys: list[str], column: str, combine: Callable[[str], Column]) -> Flow:
        return self._with(self.df.groupBy(*keys).agg(combine(column).alias(column)))

    def unique_global(self, *keys: str) -> Flow:
        return self._with(self.df.dropDuplicates(list(keys) or None))

    def unique_adjacent(self, keys: list[str], order: list[Column | str], value: str) -> Flow:
        """Per key, rows whose value differs from that of the row before."""
        w = Window.partitionBy(*keys).orderBy(*order)
        previous, first = F.lag(value).over(w), F.row_number().over(w)
        return self._with(self.df.withColumns({"_p": previous, "_f": first}).where((F.col("_f") == 1) | ~F.col(value).eqNullSafe(F.col("_p"))).drop("_p", "_f"))

    def multiplex_runs(self, keys: list[str], order: list[Column | str], value: str, out: str = "run") -> Flow:
        """Per key, the number of the run of equal neighbouring values."""
        w = Window.partitionBy(*keys).orderBy(*order)
        opens = F.when(F.row_number().over(w) == 1, 1).otherwise((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("bigint"))
        marked = self.df.withColumn("_opens", opens)
        return self._with(marked.withColumn(out, F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_opens"))

    def blocks_by(self, keys: list[str], pos: str, header: Column, out: str = "block") -> Flow:
        """A new block at each header row; rows before the first are block 0."""
        return self._with(scan.running(self.df, keys, pos, [], header.cast("bigint"), out))

    def blocks_of(self, n: int, order: list[Column | str], keys: list[str] | None = None, out: str = "block") -> Flow:
        rows = tracks.numbered(self.df, order, keys, "_rn")
        return self._with(rows.withColumn(out, F.floor(F.col("_rn") / n)).drop("_rn"))

    def previous(self, n: int, keys: list[str], order: list[Column | str], column: str) -> Flow:
        """The values of the n rows before, nearest first."""
        w = Window.partitionBy(*keys).orderBy(*order)
        return self._with(self.df.withColumn("previous", F.array_compact(F.array(*[F.lag(column, i).over(w) for i in range(1, n + 1)]))))

    def check_order(self, keys: list[str], order: list[Column | str], column: str) -> Flow:
        """Fails where a value is smaller than that of the row before."""
        before = F.lag(column).over(Window.partitionBy(*keys).orderBy(*order))
        checked = self.df.withColumn("_ok", F.when(before > F.col(column), F.raise_error(F.lit(f"{column} is not in order")).cast("boolean")).otherwise(F.lit(True)))
        return self._with(checked.where("_ok").drop("_ok"))

    def ranks(self, keys: list[str], order: list[Column | str], out: str = "rank") -> Flow:
        return self._with(self.df.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("bigint")))

    def sample(self, fraction: float, seed: int) -> Flow:
        return self._with(self.df.sample(fraction=fraction, seed=seed))

    def random_entry(self, seed: int) -> Flow:
        return self._with(self.df.orderBy(F.rand(seed)).limit(1))

    def melt(self, ids: list[str], values: list[str]) -> Flow:
        return self._with(self.df.unpivot(ids, values, "variable", "value"))

    def checkpoint(self) -> Flow:
        from ..plans import store

        return self._with(store.stored(self.df, "flow"))


def chain(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def alternating(order: list[Column | str], *frames: DataFrame) -> DataFrame:
    """Round robin over ordered frames: columns turn (round) and src (index) give the order."""
    return chain(*[tracks.numbered(df, order, None, "turn").withColumn("src", F.lit(i)) for i, df in enumerate(frames)])


def merge_sorted(key: list[str], *frames: DataFrame) -> DataFrame:
    """Ordered union, ties by source."""
    return chain(*[df.withColumn("src", F.lit(i)) for i, df in enumerate(frames)]).orderBy(*key, "src")


def positional_zip(order: list[Column | str], left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of equal position side by side, as structs a and b; fails if the lengths differ."""
    a = tracks.numbered(left.select("*", F.struct("*").alias("_row")), order, None, "_i").select(F.col("_i").alias("i"), F.col("_row").alias("a"))
    b = tracks.numbered(right.select("*", F.struct("*").alias("_row")), order, None, "_i").select(F.col("_i").alias("i"), F.col("_row").alias("b"))
    joined = a.join(b, "i", "full_outer")
    bad = F.col("a").isNull() | F.col("b").isNull()
    return joined.where(F.when(bad, F.raise_error(F.lit("inputs differ in length")).cast("boolean")).otherwise(F.lit(True)))


def frame_merge(order: list[Column | str], left: DataFrame, right: DataFrame) -> DataFrame:
    """Columns of both frames, row by row."""
    return positional_zip(order, left, right).select("i", "a.*", *[F.col(f"b.{c}") for c in right.columns if c not in left.columns])


def parallel(name_to_frame: dict[str, DataFrame], key: list[str]) -> DataFrame:
    from .joins import zip_join

    return zip_join(name_to_frame, key)


def set_operation(op: str, a: Column, b: Column) -> Column:
    """Union, Intersect or Subtract of set-valued cells, sorted."""
    return F.array_sort({"Union": F.array_union, "Intersect": F.array_intersect, "Subtract": F.array_except}[op](a, b))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], combine: dict[str, Callable[[str], Column]]) -> DataFrame:
    """Rows of both by key, values of equal keys put together."""
    return chain(old.select(*keys, *combine), new.select(*keys, *combine)).groupBy(*keys).agg(*[f(c).alias(c) for c, f in combine.items()])


def split_write(df: DataFrame, condition: Column, inside: str, outside: str) -> None:
    """Rows that meet a condition go to one folder, the others to another."""
    hit = F.coalesce(condition, F.lit(False))
    df.where(hit).write.parquet(inside)
    df.where(~hit).write.parquet(outside)


def cross_product(df: DataFrame, **lists: list) -> DataFrame:
    """Every row with every combination of the given values."""
    for name, values in lists.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df
