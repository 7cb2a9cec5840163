"""Blocks of documents and packed key exchanges between them.

``block_table`` writes documents once as rows of a few MB each. ``exchange`` deals sorted key arrays
of all blocks out to tasks by the keys' leading bits, lets a function answer each array given all
arrays of its key range, and writes the answers in files by block, where the next pass over the
blocks reads its own. Texts are never shuffled, and a key costs about six bytes on the way.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _scratch

BLOCK_BYTES = (2 << 20) - 1
BLOCK_SCHEMA = "bid long, doc_id array<long>, flag array<boolean>, lens array<long>, data binary"
_BITS = 20  # blocks of one task


@dataclass
class Block:
    bid: int
    doc_id: pa.Array
    flag: np.ndarray
    lens: np.ndarray
    data: np.ndarray
    carry: pa.Array | None = None

    def only(self, slots: np.ndarray) -> tuple[Block, np.ndarray]:
        """A block of these documents only, and the place of each slot in it."""
        asked, place = np.unique(slots, return_inverse=True)
        offsets = np.cumsum(self.lens + 1) - self.lens - 1
        data = np.concatenate([self.data[:0], *(self.data[offsets[d] : offsets[d] + self.lens[d] + 1] for d in asked)])
        return Block(self.bid, self.doc_id.take(pa.array(asked)), self.flag[asked], self.lens[asked], data), place


def _build(block_bytes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bid = TaskContext.get().partitionId() << _BITS
        ids, flags, lens, parts, rest, held = [], [], [], [], [], 0
        kind = None

        def flush() -> pa.RecordBatch:
            columns = [pa.array([bid], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([flags], pa.list_(pa.bool_())),
                       pa.array([lens], pa.list_(pa.int64())), pa.array([b"".join(x + b" " for x in parts)], pa.binary())]
            if kind is not None:
                columns.append(pa.array([rest], pa.list_(kind)))
            return pa.RecordBatch.from_arrays(columns, names=["bid", "doc_id", "flag", "lens", "data", "carry"][: len(columns)])

        for batch in batches:
            others = [None] * batch.num_rows
            if batch.num_columns > 3:
                kind, others = batch.column(3).type, batch.column(3).to_pylist()
            for i, flag, text, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), others, strict=True):
                text = text.as_py() or b""
                if ids and held + len(text) > block_bytes:
                    yield flush()
                    bid, ids, flags, lens, parts, rest, held = bid + 1, [], [], [], [], [], 0
                ids.append(i)
                flags.append(bool(flag))
                lens.append(len(text))
                parts.append(text)
                rest.append(other)
                held += len(text) + 1
        if ids:
            yield flush()

    return run


def block_table(docs: DataFrame, id_col: str, text_col: str, flag: object = None, block_bytes: int = BLOCK_BYTES, carry: list[str] | None = None) -> tuple[DataFrame, int]:
    """The documents as a table of blocks in the shared folder, and the bytes of text in it.

    Columns named in ``carry`` go along as they are. A text must be shorter than 2 GB, as a cell of the exchange with
    Python can't hold more; a longer one fails the job.
    """
    spark = docs.sparkSession
    columns = [
        F.col(id_col).cast("long").alias("doc_id"),
        (F.lit(False) if flag is None else flag).alias("flag"),
        F.col(text_col).cast("binary").alias("text"),
    ]
    schema = BLOCK_SCHEMA
    if carry:
        columns.append(F.struct(*[docs[c] for c in carry]).alias("carry"))
        schema += f", carry array<{docs.select(columns[-1]).schema['carry'].dataType.simpleString()}>"
    path = _scratch.materialize(docs.select(*columns).mapInArrow(_build(block_bytes), schema), "blocks")
    blocks = spark.read.schema(schema).parquet(path)
    n_bytes = blocks.select(F.sum(F.aggregate("lens", F.lit(0).cast("long"), lambda a, x: a + x + 1))).first()[0]
    return blocks, int(n_bytes or 0)


#: Arrays from this size on go back to the system when they are freed. Below ``KEPT_BYTES`` they may be kept for the next ones instead:
#: new pages cost more time than what is done on them.
RETURNED_BYTES = 1 << 18
KEPT_BYTES = 8 << 20


def _return_memory(least: int) -> None:
    """Let the C library give arrays of ``least`` bytes and more back to the system once they are freed, those of
    Arrow too; by itself it keeps more and more of them for later. Of smaller ones it keeps eight times as much at most at its heap's end."""
    try:
        pa.set_memory_pool(pa.system_memory_pool())
        libc = ctypes.CDLL("libc.so.6")
        libc.mallopt(-3, least)  # M_MMAP_THRESHOLD
        libc.mallopt(-1, 1 << 17 if least <= RETURNED_BYTES else 8 * least)  # M_TRIM_THRESHOLD
    except (OSError, AttributeError):  # another C library
        return


def each_block(batches: Iterator[pa.RecordBatch], least: int = RETURNED_BYTES) -> Iterator[Block]:
    _return_memory(least)
    for batch in batches:
        for i in range(batch.num_rows):
            yield Block(
                batch.column(0)[i].as_py(),
                batch.column(1)[i].values,
                np.asarray(batch.column(2)[i].values.to_numpy(zero_copy_only=False), dtype=bool),
                np.asarray(batch.column(3)[i].values, dtype=np.int64),
                np.frombuffer(batch.column(4)[i].as_buffer(), dtype=np.uint8),
                batch.column(5)[i].values if batch.num_columns > 5 else None,
            )


def planes(x: np.ndarray) -> bytes:
    """Bytes of an array by significance, so that leading zero bytes lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def from_planes(data: bytes, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(dtype)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, np.uint64), dtype=np.uint64)


def bucket_starts(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n equal key ranges starts in sorted keys."""
    return np.searchsorted(keys >> np.uint64(32), (np.arange(n + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(n))


SENT_SCHEMA = "bid long, bucket int, keys binary, extra array<binary>"


def sent_rows(bid: int, keys: np.ndarray, extra: list[np.ndarray], n_buckets: int, has: dict[int, np.ndarray] | None = None) -> Iterator[pa.RecordBatch]:
    """Rows that deal sorted keys, and arrays beside them, out to the buckets. Of the arrays in ``has`` only
    these keys' values go; who gets them must be able to tell which."""
    at = bucket_starts(keys, n_buckets)
    full = np.flatnonzero(np.diff(at))

    def cell(j: int, b: int) -> bytes:
        x = extra[j][at[b] : at[b + 1]]
        return planes(np.ascontiguousarray(x[has[j][at[b] : at[b + 1]]] if has and j in has else x))

    if len(full):
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(full), bid, np.int64)), pa.array(full.astype(np.int32)),
             pa.array([pack_keys(keys[at[b] : at[b + 1]]) for b in full], pa.binary()),
             pa.array([[cell(j, b) for j in range(len(extra))] for b in full], pa.list_(pa.binary()))],
            names=["bid", "bucket", "keys", "extra"],
        )


def exchange(sent: DataFrame, n_buckets: int, dtypes: list[type], answer: Callable, label: str, stats: str | None = None) -> tuple[str, DataFrame]:
    """Answers to sent key arrays, as a folder of files by the block's task.

    ``answer(keys, extra, source)`` gets the concatenated keys of a task, the arrays beside them and
    the index of the sending row of each, and returns (one array aligned with keys, a list of sums).
    The sums of all tasks come back as a one-row DataFrame column ``stats``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bids, buckets, keys, extra = [], [], [], [[] for _ in dtypes]
        for batch in batches:
            bids += batch.column(0).to_pylist()
            buckets += batch.column(1).to_pylist()
            keys += [unpack_keys(x.as_py()) for x in batch.column(2)]
            for row in batch.column(3).to_pylist():
                for j, d in enumerate(dtypes):
                    extra[j].append(from_planes(row[j], d))
        if not keys:
            return
        # one order of the senders, whatever order the shuffle delivers them in
        order = sorted(range(len(bids)), key=lambda i: (bids[i], buckets[i]))
        bids, buckets, keys = [bids[i] for i in order], [buckets[i] for i in order], [keys[i] for i in order]
        extra = [[x[i] for i in order] for x in extra]
        sizes = np.array([len(k) for k in keys])
        out, sums = answer(np.concatenate(keys), [np.concatenate(x) for x in extra], np.repeat(np.arange(len(sizes)), sizes))
        cut = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(len(sizes)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([bids[i]], pa.int64()), pa.array([bids[i] >> _BITS], pa.int64()), pa.array([buckets[i]], pa.int32()),
                 pa.array([planes(np.ascontiguousarray(out[cut[i] : cut[i + 1]]))], pa.binary()), pa.array([list(map(float, sums)) if i == 0 else None], pa.list_(pa.float64()))],
                names=["bid", "grp", "bucket", "answer", "sums"],
            )

    spark = sent.sparkSession
    dealt = sent.repartition(n_buckets, "bucket").mapInArrow(run, "bid long, grp long, bucket int, answer binary, sums array<double>")
    n_back = max(2 * spark.sparkContext.defaultParallelism, n_buckets)
    back = dealt.repartitionById(n_back, F.pmod("grp", F.lit(n_back)).cast("int")).sortWithinPartitions("grp", "bid", "bucket")
    path = _scratch.materialize(back, label, partition_by="grp")
    return path, spark.read.schema("bid long, bucket int, answer binary, sums array<double>, grp long").parquet(path)


def summed(spark: SparkSession, answers: DataFrame, n: int) -> list[float]:
    """The sums that the tasks of an exchange gave, added up."""
    row = answers.where("sums is not null").select(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n)]).first()
    return [float(x or 0) for x in row]


class Answers:
    """In a task: the answers of an exchange to one block after another. They are read along with the
    blocks, which come in order, so that a task holds those of one block."""

    def __init__(self, path: str, dtype: type):
        self.path, self.dtype, self.grp, self.last = path, dtype, None, -1
        self.rows, self.next = iter(()), None

    def of(self, bid: int) -> np.ndarray:
        """The answers to the block's keys, in the order of its sorted keys."""
        if bid >> _BITS != self.grp or bid <= self.last:
            self.grp = bid >> _BITS
            self.rows = _scratch.read_sorted(f"{self.path}/grp={self.grp}", ["bid", "bucket", "answer"], 2)
            self.next = next(self.rows, None)
        self.last, found = bid, []
        while self.next is not None and self.next[0] <= bid:
            if self.next[0] == bid:
                found.append(from_planes(self.next[2], self.dtype))
            self.next = next(self.rows, None)
        return np.concatenate(found) if found else np.empty(0, self.dtype)
