"""Table views with paging, and a versioned catalog of tables in Parquet folders."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class View:
    """An immutable query on a table; each method gives a new view."""

    table: DataFrame
    columns: tuple[str, ...] = ()
    condition: Column | None = None
    order: tuple[Column | str, ...] = ()
    window: tuple[int, int] | None = None
    page_size: int = 1000

    def select(self, *columns: str) -> View:
        return replace(self, columns=columns)

    def where(self, condition: Column | str, op: str = "AND") -> View:
        """Combine with the condition so far: AND, OR, or NEW to replace it."""
        c = F.expr(condition) if isinstance(condition, str) else condition
        if self.condition is not None and op != "NEW":
            c = self.condition & c if op == "AND" else self.condition | c
        return replace(self, condition=c)

    def where_ids(self, column: str, ids: list | DataFrame) -> View:
        """Rows whose id is in a set: the bounds and the values of a list, or a semi join with a frame's first column."""
        if isinstance(ids, DataFrame):
            known = ids.select(F.col(ids.columns[0]).alias(column)).distinct()
            return replace(self, table=self.table.join(known, column, "left_semi").select(*self.table.columns))
        if not ids:
            return self.where(F.lit(False))
        return self.where(F.col(column).between(min(ids), max(ids)) & F.col(column).isin(list(ids)))

    def where_attribute(self, key: str, attributes: DataFrame, condition: Column | str) -> View:
        """Rows whose key has an entry in another table that meets a condition."""
        return self.where_ids(key, attributes.where(condition).select(key))

    def order_by(self, *order: Column | str) -> View:
        return replace(self, order=order)

    def page(self, start: int, stop: int) -> View:
        return replace(self, window=(start, stop))

    def page_checked(self, start: int, stop: int) -> View:
        """Like page, with bounds clamped to the rows there are."""
        n = self.size()
        return self.page(min(max(start, 0), n), min(max(stop, 0), n))

    def first(self) -> View:
        return self.page(0, self.page_size)

    def next(self) -> View:
        start, stop = self.window or (0, 0)
        return self.page(stop, stop + (stop - start or self.page_size))

    def prev(self) -> View:
        start, stop = self.window or (0, self.page_size)
        return self.page(max(0, start - (stop - start)), start)

    def last(self) -> View:
        n = self.size()
        return self.page((n - 1) // self.page_size * self.page_size if n else 0, n)

    def rows(self) -> DataFrame:
        """All rows of the view, without its page."""
        df = self.table if self.condition is None else self.table.where(self.condition)
        return df.orderBy(*self.order) if self.order else df

    def iterate(self) -> DataFrame:
        df = self.rows()
        if self.window:
            df = df.offset(self.window[0]).limit(self.window[1] - self.window[0])
        return df.select(*self.columns) if self.columns else df

    def size(self) -> int:
        return replace(self, order=()).rows().count()

    def delete(self) -> DataFrame:
        """The table without the view's rows; with an order and page, only those of the page go."""
        if self.window is None:
            return self.table if self.condition is None else self.table.where(~F.coalesce(self.condition, F.lit(False)))
        from . import tracks

        hit = F.lit(True) if self.condition is None else F.coalesce(self.condition, F.lit(False))
        inside, outside = self.table.where(hit), self.table.where(~hit)
        numbered = tracks.numbered(inside, list(self.order) or list(self.table.columns), None, "_rn")
        return numbered.where(~F.col("_rn").between(self.window[0], self.window[1] - 1)).drop("_rn").unionByName(outside)


class Catalog:
    """Tables as folders ``root/name/version=N``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def versions(self, name: str) -> list[int]:
        fs, jvm = self._fs()
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        if not fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(path) if s.getPath().getName().startswith("version="))

    def contains(self, name: str) -> bool:
        return bool(self.versions(name))

    def create(self, name: str, df: DataFrame) -> int:
        """A new version of a table, and its number."""
        version = max(self.versions(name), default=0) + 1
        df.write.parquet(f"{self.root}/{name}/version={version}")
        return version

    def open(self, name: str, version: int | None = None) -> DataFrame:
        known = self.versions(name)
        if not known:
            raise KeyError(name)
        return self.spark.read.parquet(f"{self.root}/{name}/version={version or known[-1]}")

    def create_or_open(self, name: str, df: DataFrame) -> DataFrame:
        if not self.contains(name):
            self.create(name, df)
        return self.open(name)

    def insert(self, name: str, df: DataFrame) -> None:
        """Append rows to the newest version."""
        df.write.mode("append").parquet(f"{self.root}/{name}/version={self.versions(name)[-1]}")

    def update(self, name: str, condition: Column, **values: Column) -> int:
        """A new version with values set where the condition holds."""
        df = self.open(name)
        return self.create(name, df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, name: str, condition: Column) -> int:
        """A new version without the rows where the condition holds."""
        return self.create(name, self.open(name).where(~F.coalesce(condition, F.lit(False))))

    def drop(self, name: str) -> None:
        fs, jvm = self._fs()
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}"), True)


def check_expression(df: DataFrame, expression: str) -> str | None:
    """What is wrong with an expression over the columns of a frame; None if nothing."""
    try:
        df.select(F.expr(expression)).schema  # noqa: B018
    except AnalysisException as e:
        return str(e).splitlines()[0]
    return None


def split_condition(text: str) -> list[tuple[str, str]]:
    """A condition as a sequence of (AND or OR, clause) at the top level, outside quotes and parentheses; BETWEEN keeps its AND."""
    out, depth, at, word, op, between = [], 0, 0, "", "AND", False
    for token in re.finditer(r"'(?:[^']|'')*'|[()]|\b(?:and|or|between)\b|.", text, re.IGNORECASE | re.DOTALL):
        word = token.group().upper()
        depth += (word == "(") - (word == ")")
        if depth == 0 and word == "BETWEEN":
            between = True
        elif depth == 0 and word == "AND" and between:
            between = False
        elif depth == 0 and word in ("AND", "OR"):
            out.append((op, text[at : token.start()].strip()))
            op, at = word, token.end()
    return [*out, (op, text[at:].strip())]


def scope(spark: SparkSession, kind: str, root: str | None = None) -> Catalog:
    """A catalog of its own root, of the session's warehouse (``Workspace``) or of its shared scratch folder (``Temporary``)."""
    from ..plans import store

    if kind == "Workspace":
        root = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/tables"
    elif kind == "Temporary":
        root = store.folder(spark, "tables")
    elif root is None:
        raise ValueError("a catalog of its own needs a root")
    return Catalog(spark, root)
