"""Shared scratch space: tables written once under ``spark.checkpoint.dir`` and side files read from there.

Every intermediate result that is used twice is written as Parquet below the folder that the session
names in ``spark.checkpoint.dir``; it outlives lost executors and cuts the lineage.
"""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.dataset as pads
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder name below the session's checkpoint folder. Where none is set, one of this machine
    does for a local session; a cluster's executors would not share it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spanforge-")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/spanforge-{label}-{uuid.uuid4().hex}"
    if _made:
        _made[-1].append((label, path))
    return path


_made: list[list[tuple[str, str]]] = []


@contextmanager
def passing(spark: SparkSession, *keep: str) -> Iterator[None]:
    """Tables written inside are deleted at the end, but for those of the labels in ``keep``, which pass to the block around, if any.
    What leaves the block must be written, or read kept tables only."""
    _made.append([])
    try:
        yield
    finally:
        made = _made.pop()
        if _made:
            _made[-1].extend(x for x in made if x[0] in keep)
    for label, path in made:
        if label not in keep:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: While a table is written, rows go to Python in small batches, so that no task holds all its blocks at once; shuffle files of
#: its query go as soon as it is there, and not when the driver collects its garbage.
_SETTINGS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20)}


def materialize(df: DataFrame, label: str, partition_by: str | None = None) -> str:
    """Write ``df`` once below the shared folder and return the path."""
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    writer = (
        df.write.option("compression", "zstd")
        .option("parquet.page.size.row.check.min", "1")
        .option("parquet.block.size.row.check.min", "1")
    )
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = {k: spark.conf.get(k, None) for k in _SETTINGS}
    for k, v in _SETTINGS.items():
        spark.conf.set(k, v)
    try:
        writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return path


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once and read again."""
    return df.sparkSession.read.schema(df.schema).parquet(materialize(df, label))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder's URI and the path in it, for use in Python workers."""
    for hadoop, arrow in (("s3a://", "s3://"), ("s3n://", "s3://")):
        if uri.startswith(hadoop):
            uri = arrow + uri[len(hadoop) :]
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def read_side_table(uri: str, columns: list[str]) -> pa.Table | None:
    """A small Parquet folder below the shared folder; None where it holds no file."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return None
    data = pads.dataset(path, format="parquet", filesystem=fs)
    return data.to_table(columns=columns) if data.files else None


def read_sorted(uri: str, columns: list[str], keys: int) -> Iterator[tuple]:
    """Rows of a Parquet folder, of files that are sorted by the first ``keys`` columns, in that order and a few at a time."""
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return iter(())

    def rows(name: str) -> Iterator[tuple]:
        with fs.open_input_file(name) as f:
            for batch in pq.ParquetFile(f, buffer_size=1 << 20, pre_buffer=False).iter_batches(64, columns=columns):
                cells = [batch.column(c).to_pylist() for c in columns]
                while cells[0]:
                    yield tuple(c.pop(0) for c in cells)

    names = sorted(x.path for x in fs.get_file_info(pafs.FileSelector(path)) if x.base_name.endswith(".parquet"))
    return heapq.merge(*map(rows, names), key=lambda r: r[:keys])


def partitions_for(spark: SparkSession, n_bytes: int, per_partition: int = 16 << 20) -> int:
    """Partitions for so many bytes: in proportion to the data, and enough for every core."""
    return max(2 * spark.sparkContext.defaultParallelism, -(-int(n_bytes or 0) // per_partition))
