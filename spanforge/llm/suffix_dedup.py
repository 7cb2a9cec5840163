"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Suffixes are ordered through ``length`` bytes only, by most-significant-digit passes whose digits are
hashes of byte runs, dealt out to tasks by their leading bits. A pass sends on only what the pass
before left undecided:

1. First digit, ``length - w + 1`` bytes, at anchors: of any w neighbouring starts the one whose first
   digit hashes lowest (the last of equals). Every string of ``length`` bytes holds the anchor that
   its own bytes choose, so equal strings meet at equal anchors. An anchor whose digit occurs once
   has no repeated string; where all that can be seen from the anchors with one digit is the same
   too, its strings are repeated; the others go on.
2. Second digit, all ``length`` bytes, for every start that chose an undecided anchor. Groups of
   equal digits are exactly the repeated windows.

Digits are 128 bits wide where they decide; 31 of them are of a polynomial modulo a prime, which holds for
any bytes, the others of polynomials modulo 2^64. No suffix, pair or text crosses the network, only digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from . import _scratch
from ._text import PrimeHash, SpanHash, mix

U64 = np.uint64


def _lowest(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values, the index of its lowest value (the last of equals)."""
    n = len(h)
    rows = -(-n // w)
    v = np.full(rows * w, 2**64 - 1, dtype=np.uint64)
    v[:n] = h
    v = v.reshape(rows, w)
    low = np.minimum.accumulate(v, axis=1)  # from each row's start
    pos = np.arange(rows * w, dtype=np.int32).reshape(rows, w)
    at = np.maximum.accumulate(np.where(v == low, pos, -1), axis=1)
    rev = v[:, ::-1]
    high = np.minimum.accumulate(rev, axis=1)  # to each row's end
    fresh = np.ones(rev.shape, dtype=bool)
    fresh[:, 1:] = rev[:, 1:] < high[:, :-1]
    back = np.arange(w, dtype=np.int32)[None, :]
    last = np.maximum.accumulate(np.where(fresh, back, -1), axis=1)
    left_at = (pos[:, :1] + (w - 1) - last)[:, ::-1].reshape(-1)
    left_low = high[:, ::-1].reshape(-1)
    m = n - w + 1
    right_low, right_at = low.reshape(-1)[w - 1 : w - 1 + m], at.reshape(-1)[w - 1 : w - 1 + m]
    return np.where(right_low <= left_low[:m], right_at, left_at[:m])


class _Anchors:
    """The anchors of a block: positions, the starts that chose each, and their digits."""

    def __init__(self, block: B.Block, length: int):
        self.length, w = length, max(1, length * 8 // 25)
        k = length - w + 1
        self.offsets = np.zeros(len(block.lens) + 1, dtype=np.int64)
        np.cumsum(block.lens + 1, out=self.offsets[1:])
        self.h1, self.prime = SpanHash(block.data, 1), PrimeHash(block.data, 1)
        digit = self.h1.windows(k)
        self.lo = self.hi = np.empty(0, np.int64)
        self.pairs = np.empty(0, np.int64)
        self.keys = self.extra = np.empty(0, U64)
        self.count = np.empty(0, np.uint8)
        if len(digit) < w:
            return
        chosen = _lowest(digit, w)
        valid = np.zeros(len(chosen) + 1, dtype=np.int8)
        long = block.lens >= length
        valid[self.offsets[:-1][long]] += 1
        np.subtract.at(valid, self.offsets[:-1][long] + block.lens[long] - length + 1, 1)
        starts = np.flatnonzero(np.cumsum(valid[:-1], dtype=np.int8))
        if not len(starts):
            return
        at = chosen[starts]
        first = np.flatnonzero(np.diff(at, prepend=-1))
        self.lo, self.hi = starts[first], starts[np.append(first[1:], len(starts)) - 1]
        pos = at[first].astype(np.int64)
        key = mix(digit[pos])
        seen = self.sound(mix(self.h1.raw(self.lo, self.hi + length)), self.lo, self.hi + length)
        seen = mix(seen + mix((pos - self.lo).astype(U64) * U64(1 << 20) + (self.hi - self.lo).astype(U64)))
        order = np.lexsort((seen, key))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (key[order][1:] != key[order][:-1]) | (seen[order][1:] != seen[order][:-1])
        self.pairs = np.empty(len(order), np.int64)
        self.pairs[order] = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        self.keys, self.extra = key[order][head], seen[order][head]
        self.count = np.minimum(np.diff(np.append(head, len(order))), 2).astype(np.uint8)
        self.head = order[head]

    def sound(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """33 bits of a hash and the span's 31 bits modulo the prime."""
        return h >> U64(31) << U64(31) | self.prime.raw(start, end)

    def ranges(self, which: np.ndarray) -> np.ndarray:
        """The starts that chose these anchors."""
        size = self.hi[which] - self.lo[which] + 1
        total = int(size.sum())
        out = np.ones(total, np.int64)
        if total:
            cut = np.cumsum(size)[:-1]
            out[0] = self.lo[which[0]]
            out[cut] = self.lo[which[1:]] - self.hi[which[:-1]]
        return np.cumsum(out)


UNIQUE, REPEATED, SPEAKER, UNDECIDED = 0, 1, 2, 3


def _first_digit(keys: np.ndarray, extra: list[np.ndarray], source: np.ndarray) -> tuple[np.ndarray, list]:
    seen, count = extra
    order = np.lexsort((seen, keys))
    k, x, c = keys[order], seen[order], count[order].astype(np.int64)
    new_k = np.ones(len(k), dtype=bool)
    new_k[1:] = k[1:] != k[:-1]
    new_x = new_k.copy()
    new_x[1:] |= x[1:] != x[:-1]
    gk, gx = np.cumsum(new_k) - 1, np.cumsum(new_x) - 1
    alone = np.bincount(gk, weights=c) == 1
    kinds = np.bincount(gk, weights=new_x) > 1
    same = np.bincount(gx, weights=c) > 1
    state = np.where(same[gx], np.where(kinds[gk] & new_x, SPEAKER, REPEATED), np.where(alone[gk], UNIQUE, UNDECIDED))
    out = np.empty(len(k), np.uint8)
    out[order] = state
    return out, []


def _last_digit(keys: np.ndarray, extra: list[np.ndarray], source: np.ndarray) -> tuple[np.ndarray, list]:
    order = np.lexsort((extra[0], keys))
    k, x = keys[order], extra[0][order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = (k[1:] != k[:-1]) | (x[1:] != x[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(k), np.uint8)
    out[order] = (np.bincount(group, weights=extra[1][order]) > 1)[group]
    return out, []


class _Undecided:
    """The starts of a block whose windows go into the last pass, and their distinct digits."""

    def __init__(self, block: B.Block, anchors: _Anchors, state: np.ndarray):
        per_anchor = state[anchors.pairs]
        speaks = np.zeros(len(per_anchor), dtype=bool)
        if len(per_anchor):
            speaks[anchors.head] = True
        self.asks = np.flatnonzero(per_anchor == UNDECIDED)
        chosen = np.flatnonzero((per_anchor == UNDECIDED) | ((per_anchor == SPEAKER) & speaks))
        self.starts = anchors.ranges(chosen)
        a = mix(anchors.h1.raw(self.starts, self.starts + anchors.length))
        b = anchors.sound(mix(SpanHash(block.data, 2).raw(self.starts, self.starts + anchors.length)), self.starts, self.starts + anchors.length) if len(self.starts) else a
        order = np.lexsort((b, a))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        self.pairs = np.empty(len(order), np.int64)
        self.pairs[order] = np.cumsum(new) - 1
        head = np.flatnonzero(new)
        self.keys, self.extra = a[order][head], b[order][head]
        self.count = np.minimum(np.diff(np.append(head, len(order))), 2).astype(np.uint8)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_bytes, spans array<struct<start,stop>>, kept binary).

    ``spans`` are the maximal runs of bytes covered by a string of ``length`` bytes that also starts
    anywhere else in the corpus, ``kept`` the other bytes. Null text counts as empty and gives no
    span; texts shorter than ``length`` never have one; a repeated row is a copy like any other, so
    both lose their bytes; a null id is kept as null. Other columns are ignored. An empty table gives
    an empty result.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    spark = docs.sparkSession
    blocks, n_bytes = B.block_table(docs, id_col, text_col)
    buckets = _scratch.partitions_for(spark, n_bytes)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(block: B.Block) -> Iterator[pa.RecordBatch]:
            a = _Anchors(block, length)
            yield from B.sent_rows(block.bid, a.keys, [a.extra, a.count], buckets)

        for block in B.each_block(batches):
            yield from one(block)

    states, _ = B.exchange(blocks.mapInArrow(first, B.SENT_SCHEMA), buckets, [np.uint64, np.uint8], _first_digit, "digit1")

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = B.Answers(states, np.uint8)

        def one(block: B.Block) -> Iterator[pa.RecordBatch]:
            u = _Undecided(block, _Anchors(block, length), answers.of(block.bid))
            yield from B.sent_rows(block.bid, u.keys, [u.extra, u.count], buckets)

        for block in B.each_block(batches):
            yield from one(block)

    repeats, _ = B.exchange(blocks.mapInArrow(second, B.SENT_SCHEMA), buckets, [np.uint64, np.uint8], _last_digit, "digit2")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states_of, repeats_of = B.Answers(states, np.uint8), B.Answers(repeats, np.uint8)

        def one(block: B.Block) -> pa.RecordBatch:
            a = _Anchors(block, length)
            state = states_of.of(block.bid)
            u = _Undecided(block, a, state)
            per_anchor = state[a.pairs]
            whole = np.flatnonzero((per_anchor == REPEATED) | (per_anchor == SPEAKER))
            hits = u.starts[repeats_of.of(block.bid)[u.pairs] > 0] if len(u.starts) else u.starts
            depth = np.zeros(len(block.data) + 1, np.int32)
            np.add.at(depth, a.lo[whole], 1)
            np.subtract.at(depth, a.hi[whole] + length, 1)
            np.add.at(depth, hits, 1)
            np.subtract.at(depth, hits + length, 1)
            gone = np.zeros(len(block.data) + 2, np.int8)
            gone[1:-1] = np.cumsum(depth[:-1]) > 0
            step = np.diff(gone)
            start, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
            per_doc = np.searchsorted(start, a.offsets)
            keep = gone[1:-1] == 0
            kept = [block.data[o : o + n][keep[o : o + n]].tobytes() if per_doc[i + 1] > per_doc[i] else block.data[o : o + n].tobytes() for i, (o, n) in enumerate(zip(a.offsets[:-1], block.lens, strict=True))]
            base = np.repeat(a.offsets[:-1], np.diff(per_doc))
            spans = pa.StructArray.from_arrays([pa.array(start - base), pa.array(stop - base)], names=["start", "stop"])
            return pa.RecordBatch.from_arrays(
                [block.doc_id.cast(pa.int64()), pa.array(block.lens), pa.ListArray.from_arrays(pa.array(per_doc.astype(np.int32)), spans), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

        for block in B.each_block(batches):
            yield one(block)

    return blocks.mapInArrow(cut, "doc_id long, n_bytes long, spans array<struct<start:long,stop:long>>, kept binary")


def digest(spans: DataFrame) -> DataFrame:
    """Counts and the hash of what is kept, per document."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return spans.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
