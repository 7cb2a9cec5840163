"""JSON documents and multi-pattern search."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def get(document: Column, path: str) -> Column:
    """The value at a path such as ``.a[0].b``, as text."""
    return F.get_json_object(document, "$" + path)


def merge(a: Column, b: Column) -> Column:
    """Two flat JSON objects as one; keys of ``b`` win."""
    kind = "map<string,string>"
    left, right = F.from_json(a, kind), F.from_json(b, kind)
    return F.to_json(F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right))


def cascade(*documents: Column, path: str) -> Column:
    """The first document's value at a path that has one."""
    return F.coalesce(*[get(d, path) for d in documents])


def find_patterns(df: DataFrame, text: str, patterns: list[str], out: str = "found") -> DataFrame:
    """The patterns that occur in a text, sorted, all searched at once by an automaton."""
    import ahocorasick

    kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes) + f", {out} array<string>"
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = ahocorasick.Automaton()
        for p in patterns:
            machine.add_word(p, p)
        machine.make_automaton()
        for b in batches:
            hits = [sorted({p for _, p in machine.iter(x)}) if x else [] for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hits, pa.list_(pa.string()))], names=[*b.schema.names, out])

    return df.mapInArrow(run, kinds)


def align(df: DataFrame, a: str, b: str, match: int = 1, mismatch: int = -1, gap: int = -1, mode: str = "global", out: str = "score") -> DataFrame:
    """Scores of pairwise alignments with linear gaps: global, local or free-shift."""
    import numpy as np

    def score(x: str, y: str) -> int:
        free, local = mode != "global", mode == "local"
        row = np.zeros(len(y) + 1, int) if free else gap * np.arange(len(y) + 1)
        best = int(row[-1]) if mode == "free" else 0
        other = np.array([ord(c) for c in y])
        for i, c in enumerate(x, 1):
            steps = np.maximum(row[:-1] + np.where(other == ord(c), match, mismatch), row[1:] + gap)
            if local:
                steps = np.maximum(steps, 0)
            new = np.concatenate([[0 if free else gap * i], steps])
            # gaps along the row: a running maximum after taking the slope out
            slope = gap * np.arange(len(y) + 1)
            row = np.maximum.accumulate(new - slope) + slope
            best = max(best, int(row.max()) if local else int(row[-1]))
        return best if local else max(best, int(row.max())) if free else int(row[-1])

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            yield pdf.assign(**{out: [score(x, y) for x, y in zip(pdf[a], pdf[b], strict=True)]})

    return df.mapInPandas(run, ", ".join(f"{n} {t}" for n, t in df.dtypes) + f", {out} bigint")
