"""Packing of tokenised documents into sequences: first-fit decreasing in random groups.

Documents are dealt to tasks by a hash of their row. A group's whole sequences are cut off first;
what remains of each document goes into bins first-fit decreasing, where a tournament tree over the
bins' capacities finds the first bin with room in logarithmic time. Then the fullest bins are topped
up by cutting the emptiest ones apart, and the last bin, if not full, is cut into sequences of
powers of two, which need no padding.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _scratch

PIECE_SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
#: The vocabulary's one special token.
END, END_ID = "<|endoftext|>", 50256
#: The vocabulary that has a rank file too.
RANKED = "byte_bpe_50k"
GROUP_DOCS = 8192
GROUP_TOKENS = 8 << 20


class Tournament:
    """Capacities of bins in a binary tree of maxima."""

    def __init__(self, n: int, capacity: int):
        self.size = 1 << max(0, (n - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def first(self, need: int) -> int:
        """Put ``need`` into the first bin that has room, and return the bin."""
        tree, i = self.tree, 1
        while i < self.size:
            i *= 2
            if tree[i] < need:
                i += 1
        bin_ = i - self.size
        tree[i] -= need
        while i > 1:
            i >>= 1
            top = max(tree[2 * i], tree[2 * i + 1])
            if tree[i] == top:
                break
            tree[i] = top
        return bin_


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item; no item is larger than the capacity."""
    bins = np.zeros(len(sizes), np.int64)
    tree = Tournament(max(1, len(sizes)), capacity)
    for i in np.argsort(-sizes, kind="stable").tolist():
        bins[i] = tree.first(int(sizes[i]))
    return bins


def pack_group(lengths: np.ndarray, capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of positive lengths."""
    pieces, sequence = [], 0
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((d, start, capacity, sequence, 0))
            sequence += 1
    rest = lengths % capacity
    items = np.flatnonzero(rest)
    where = first_fit_decreasing(rest[items], capacity)
    content: list[list[tuple[int, int, int]]] = [[] for _ in range(int(where.max()) + 1 if len(where) else 0)]
    for d, b in zip(items.tolist(), where.tolist(), strict=True):
        content[b].append((d, int(lengths[d] - rest[d]), int(rest[d])))
    filled = sorted(((sum(x[2] for x in c), i) for i, c in enumerate(content)), key=lambda x: (-x[0], x[1]))
    order, low = [i for _, i in filled], len(filled) - 1
    room = {i: capacity - n for n, i in filled}
    for high, b in enumerate(order):
        while room[b] and high < low:
            donor = order[low]
            d, start, n = content[donor].pop()
            take = min(n, room[b])
            content[b].append((d, start, take))
            room[b] -= take
            room[donor] += take
            if take < n:
                content[donor].append((d, start + take, n - take))
            if not content[donor]:
                low -= 1
        if high >= low:
            break
    for b in order:
        c = content[b]
        if not c:
            continue
        left = sum(x[2] for x in c)
        for size in [capacity] if left == capacity else [1 << j for j in reversed(range(left.bit_length())) if left >> j & 1]:
            offset = 0
            while offset < size:
                d, start, n = c.pop(0)
                take = min(n, size - offset)
                pieces.append((d, start, take, sequence, offset))
                offset += take
                if take < n:
                    c.insert(0, (d, start + take, n - take))
            sequence += 1
    return pieces


#: White space in a row that goes to the tokenizers library; the faster one's pattern would overflow its stack on a million.
LONG_RUN = 10_000
_LONG = re.compile(rf"\s{{{LONG_RUN}}}")


@lru_cache(maxsize=2)
def encoder(name: str, special: bool) -> Callable[[str], list[int]]:
    """Ids of a text as the ``tokenizers`` file ``name``.json gives them.

    The vocabulary's rank file and pattern give the same ids in a fifth of the time; texts with very long runs of
    white space, and vocabularies without a rank file, go through the tokenizers library itself.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))
    plain.encode_special_tokens = not special
    slow = lambda text: plain.encode(text, add_special_tokens=False).ids
    if name != RANKED:
        return slow
    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END: END_ID})
    allowed = {END} if special else set()

    def encode(text: str) -> list[int]:
        if len(text) >= LONG_RUN and _LONG.search(text):
            return slow(text)
        return fast.encode(text, allowed_special=allowed, disallowed_special=())

    return encode


def _pack(tokenizer: str, capacity: int, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = TaskContext.get().partitionId(), 0
        doc_ids, ids, held = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.array([len(x) for x in ids], np.int64)
            pieces = pack_group(lengths, capacity)
            first = (task << 36) + (group << 22)
            for i in range(0, len(pieces), 2048):
                part = pieces[i : i + 2048]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([doc_ids[p[0]] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()),
                     pa.array([ids[p[0]][p[1] : p[1] + p[2]].tobytes() for p in part], pa.binary()), pa.array([len(ids[p[0]]) for p in part], pa.int64()),
                     pa.array([first + p[3] for p in part], pa.int64()), pa.array([p[4] for p in part], pa.int64())],
                    names=["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"],
                )

        encode = encoder(tokenizer, special)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(np.array([*encode(text.as_py() or ""), 0], dtype="<u4"))
                doc_ids.append(doc_id)
                held += len(ids[-1])
                if len(ids) == GROUP_DOCS or held >= GROUP_TOKENS:
                    yield from flush()
                    doc_ids, ids, held, group = [], [], 0, group + 1
        if ids:
            yield from flush()

    return run


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k", capacity: int = 1024, special: bool = True) -> DataFrame:
    """Pieces of the tokenised documents and their places in sequences of ``capacity`` tokens.

    Per piece: (doc_id, start, length, ids as little-endian 32-bit integers, doc_tokens, sequence_id,
    offset). A document's tokens are its text's ids and a final id 0; null text counts as empty, so
    it has one token. The special token's name in a text is its id, as the tokenizers file has it by default, or
    without ``special`` ordinary text. Null ids stay null; repeated
    rows are packed each. Groups hold up to GROUP_DOCS documents or GROUP_TOKENS tokens and one more
    document, in the order in which a hash of the row's number deals them out.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("deal"))
    n_bytes = docs.select(F.sum(F.octet_length(F.col(text_col)))).first()[0]
    dealt = rows.repartition(_scratch.partitions_for(spark, n_bytes), "deal").select("doc_id", "text")
    return dealt.mapInArrow(_pack(tokenizer, capacity, special), PIECE_SCHEMA)
