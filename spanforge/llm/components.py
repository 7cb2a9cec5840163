"""Connected components of an edge table by alternating stars over locally contracted edges.

Each round contracts the edges of every partition to a forest (a union-find over that partition
only), then links larger neighbours and smaller neighbours of each node to the smallest one seen.
Rounds are written to the shared folder; no edge reaches the driver. Partitions take TASK_EDGES
edges, so a graph of no more is done by its first contraction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch

EDGE = "u long, v long"
#: Edges that one task contracts; bounds its memory to some 100 MB.
TASK_EDGES = 1 << 20


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its tree) for every node that isn't the smallest itself."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while not np.array_equal(new, hop := new[new]):
            new = hop
        if np.array_equal(new, label):
            break
        label = new
    child = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[child], nodes[label[child]]


def central_partners(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of one group, for each row only that with its partner of the most pairs: as many
    pairs as rows at most, and every row that has a pair keeps one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = at, np.concatenate([at[len(a) :], at[: len(a)]])
    degree = np.bincount(u)
    order = np.lexsort((v, -degree[v], u))
    first = order[np.append(True, u[order][1:] != u[order][:-1])]
    x, y = np.minimum(u[first], v[first]), np.maximum(u[first], v[first])
    pairs = np.unique(x * len(nodes) + y)
    return nodes[pairs // len(nodes)], nodes[pairs % len(nodes)]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        u, v = forest(np.concatenate([u, batch.column(0).to_numpy()]), np.concatenate([v, batch.column(1).to_numpy()]))
    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, u_col: str = "u", v_col: str = "v") -> DataFrame:
    """(node, component) for every node with an edge; the component is its smallest node.

    Nulls and loops are dropped; repeated edges count once; an empty table gives an empty result.
    """
    spark = edges.sparkSession
    a, b = F.col(u_col).cast("long"), F.col(v_col).cast("long")
    e = edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    e = _scratch.stored(e, "edges")
    while True:
        tasks = -(-e.count() // TASK_EDGES)
        if tasks <= 1:
            e = _scratch.stored(e.coalesce(1).mapInArrow(_local, EDGE), "edges")
            break
        e = e.repartition(tasks, "u").mapInArrow(_local, EDGE)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # edges to the smallest neighbour that point downwards already
        large = large.union(low.where("u <> m").select("u", F.col("m").alias("v")))
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        star = small.select("u", F.col("m").alias("v")).union(
            large.join(small, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        )
        e = _scratch.stored(star.distinct(), "edges")
        # a star forest: every node hangs on one node that hangs on none
        row = e.agg(F.count("*").alias("n"), F.count_distinct("u").alias("d")).first()
        if row["n"] == row["d"] and e.select("v").distinct().join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
