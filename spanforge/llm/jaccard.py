"""Exact n-gram Jaccard join in size-banded tiles with bitmap signatures.

Equal sets collapse into one class first. Sets that can link share a word window among the first
``n - ceil(t*n) + 1`` of a common order of windows (rare ones before frequent ones), and their sizes lie in
one size band or in two neighbouring ones: rows of one window and band, with those of the next band, form a group.

A first round pairs each row with the smallest row of its group's band and joins what links into
components. Later rounds decide the pairs between components:

* Groups of one component are done. Groups of windows that have the same rows by two minimum hashes, as the many windows
  of one family of near copies have, are united, so that a row stands there once and not once a window.
* A large group is cut into tiles. Rows of its largest component meet those of other components only, so they are
  copied as often as the others have tiles.
* Pairs of a tile are held against an upper bound of their overlap, from the bits in which two parity bitmaps
  differ: each such bit is a window that only one side has. What is left is decided by intersecting
  sorted arrays, the likeliest first, where the tile's links have not joined the two already. A set is sent once a tile.
* Where a tile has too many pairs, it pairs each row with that of the most possible partners first and leaves the rest to the
  next round; the last round leaves none. No partner is capped.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _blocks as B
from . import _scratch
from ._text import Words, mix, shingles
from .components import central_partners, components

U64 = np.uint64
LEAST_SIGNATURE_BITS = 256
#: How many frequent windows the common order knows. It orders only; results don't depend on it.
FREQUENT_WINDOWS = 1 << 17
TILE_ROWS = 2048
#: Windows of all sets of a tile, which bound its memory: tiles of larger sets take fewer rows.
TILE_WINDOWS = 4 << 20
#: Pairs of a tile that are decided in one piece.
PIECE_PAIRS = 1 << 17
#: Rows of a window's group beyond which it is dealt out to several tasks.
HOT_ROWS = 1 << 16
#: Pairs of a piece from which on they are screened together first.
SCREENED_PAIRS = 32
#: Pairs a row beyond which a tile is left to a later round.
PAIRS_PER_ROW = 8
HUB_ROWS = 512
#: Rows of a group up to which groups of one size are looked at together.
SMALL_GROUP = 12
_SLOT = 22
#: Place of a token that a row has several times, or too far behind to tell.
NO_PLACE = (1 << 16) - 1

SET_SCHEMA = "uid long, doc_id long, n long, f1 long, f2 long, sig array<long>, frequent array<long>, times array<long>"
GROUP_SCHEMA = "token long, uid long, n long, early boolean"
PIECE_SCHEMA = "tile long, family long, uids array<long>, pairs binary, partial boolean"


class Rule(NamedTuple):
    """When two rows of sizes n <= m link: ``num / den`` bounds n / m from below; ``possible(n, m, differ)`` tells for
    arrays or columns whether bitmaps that differ in so many bits allow a link; ``linked`` decides on the data of two rows.
    Where rows are sequences, ``placed(m, apart)`` tells whether the parts before and behind their common token may differ by ``apart`` in length.
    Rows larger than ``told`` come without their word of bitmap. ``screened(sets, u, v)`` tells which of many pairs may link at all."""

    num: int
    den: int
    possible: Callable
    linked: Callable[[np.ndarray, np.ndarray], bool]
    placed: Callable | None = None
    told: int | None = None
    screened: Callable | None = None


def jaccard_rule(num: int, den: int) -> Rule:
    def possible(n, m, differ):
        # the overlap is (n + m - symmetric difference) / 2 and the bits differ in no more than that difference
        return (den + num) * (n + m - differ) >= 2 * num * (n + m)

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        at = np.searchsorted(large, small)
        at[at == len(large)] = 0
        both = int(np.count_nonzero(large[at] == small))
        return den * both >= num * (len(small) + len(large) - both)

    return Rule(num, den, possible, linked)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)


def _sets(block: B.Block, k: int, only: np.ndarray | None = None) -> list[np.ndarray]:
    """The sorted window sets of a block's documents (of those in ``only``; empty arrays for others)."""
    flat, bounds = shingles(Words(block.data, block.lens), k)
    out = [np.empty(0, U64)] * len(block.lens)
    for d in range(len(block.lens)) if only is None else only:
        x = np.sort(flat[bounds[d] : bounds[d + 1]])
        out[d] = x[np.append(True, x[1:] != x[:-1])] if len(x) > 1 else x
    return out


def signature(tokens: np.ndarray) -> np.ndarray:
    """Parity bitmap of a set, as 64-bit words. Its width follows the set's size, so that unrelated
    sets differ in more bits than linked ones can; halves of a bitmap, xored, are that of half the width."""
    width = max(LEAST_SIGNATURE_BITS, 1 << (len(tokens) * 3 // 5).bit_length())
    bits = np.bincount((tokens >> U64(40)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(bits.astype(np.uint8)).view(U64)


def _describe(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, times = np.empty(0, U64), np.empty(0, np.int64)
        for block in B.each_block(batches):
            sets = _sets(block, k)
            f1 = np.array([int(np.sum(mix(s))) if len(s) else 0 for s in sets], dtype=U64)
            f2 = np.array([int(np.sum(mix(s ^ U64(0x5851F42D4C957F2D)) * U64(0x2545F4914F6CDD1D))) if len(s) else 0 for s in sets], dtype=U64)
            # windows of several different sets of the block
            _, kept = np.unique(f1, return_index=True)
            t, c = np.unique(np.concatenate([sets[i] for i in kept]) if len(kept) else tokens[:0], return_counts=True)
            both, at = np.unique(np.concatenate([tokens, t[c > 1]]), return_inverse=True)
            tokens, times = both, np.bincount(at, weights=np.concatenate([times, c[c > 1]]), minlength=len(both)).astype(np.int64)
            sigs = [signature(s) for s in sets]
            sig = np.concatenate(sigs) if sets else tokens[:0]
            cut = np.cumsum([0, *map(len, sigs)]).astype(np.int32)
            none = pa.nulls(len(sets), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array((block.bid << _SLOT) + np.arange(len(sets))), block.doc_id.cast(pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(_signed(f1)), pa.array(_signed(f2)),
                 pa.ListArray.from_arrays(pa.array(cut), pa.array(_signed(sig))), none, none],
                names=["uid", "doc_id", "n", "f1", "f2", "sig", "frequent", "times"],
            )
        often = times >= 4
        one = [pa.nulls(1, pa.int64())] * 5 + [pa.nulls(1, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(
            [*one, pa.array([_signed(tokens[often]).tolist()], pa.list_(pa.int64())), pa.array([times[often].tolist()], pa.list_(pa.int64()))],
            names=["uid", "doc_id", "n", "f1", "f2", "sig", "frequent", "times"],
        )

    return run


def _salted(token: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return mix(token ^ mix(salt.astype(U64) + U64(1)))


def _prefixes(k: int, num: int, den: int, reps: str, frequent: np.ndarray, rank: np.ndarray, salts: np.ndarray, n_buckets: int):
    """Send the first windows of each class's set. ``frequent`` is sorted; ``rank`` its order, ``salts``
    over how many keys a window's rows are dealt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(reps, ["slot"])
        for block in B.each_block(batches):
            slots = wanted.of(block.bid)[0]
            sets = _sets(block, k, slots)
            tokens, owner, size = [], [], []
            for d in slots:
                s = sets[d]
                n = len(s)
                p = n - -(-num * n // den) + 1
                if len(frequent) and n:
                    at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
                    common = frequent[at] == s
                    rare = s[~common]
                    chosen = rare[:p]
                    if len(chosen) < p:
                        rest = s[common]
                        chosen = np.concatenate([chosen, rest[np.argsort(rank[at[common]])][: p - len(chosen)]])
                else:
                    chosen = s[:p]
                tokens.append(chosen)
                owner.append(np.full(len(chosen), d, np.int64))
                # in the smaller set of a link, the first common window comes this early
                size.append(2 * n + (np.arange(len(chosen)) <= n - -(-2 * num * n // (num + den))).astype(np.uint32))
            if tokens:
                t, o, z = np.concatenate(tokens), np.concatenate(owner), np.concatenate(size).astype(np.uint32)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, t), len(frequent) - 1)
                    hot = np.flatnonzero((frequent[at] == t) & (salts[at] > 1))
                    t[hot] = _salted(t[hot], mix((o[hot] + (block.bid << _SLOT)).astype(U64)) % salts[at[hot]].astype(U64))
                order = np.argsort(t, kind="stable")
                yield from B.sent_rows(block.bid, t[order], [(o[order] + (block.bid << _SLOT)), z[order]], n_buckets)

    return run


def _partnered(group: np.ndarray, n: np.ndarray, bits: np.ndarray, rule: Rule, place: np.ndarray | None = None, comp: np.ndarray | None = None) -> np.ndarray:
    """For rows sorted by group, whether sizes, one word of bitmap and the token's places, if given, allow a link with another row of it,
    one of another component, if these are given; true for all rows of groups of more than TILE_ROWS, but for those of one component."""
    alive = np.zeros(len(group), dtype=bool)
    head = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    size = np.diff(np.append(head, len(group)))
    if comp is not None and len(head):
        mixed = np.minimum.reduceat(comp, head) < np.maximum.reduceat(comp, head)
        head, size = head[mixed], size[mixed]
    for start, s in zip(head[size > TILE_ROWS].tolist(), size[size > TILE_ROWS].tolist(), strict=True):
        alive[start : start + s] = True

    def possible(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
        differ = np.bitwise_count(bits[a] ^ bits[b]).astype(np.int64)
        if rule.told is not None:
            differ[large > rule.told] = 0
        ok = (large * rule.num <= small * rule.den) & rule.possible(small, large, differ)
        if place is not None:
            x, y = place[a], place[b]
            ok &= (x == NO_PLACE) | (y == NO_PLACE) | rule.placed(large, np.abs(x - y) + np.abs((n[a] - x) - (n[b] - y)))
        return ok if comp is None else ok & (comp[a] != comp[b])

    for s in range(2, SMALL_GROUP + 1):  # all groups of one size at a time
        first = head[size == s]
        for i in range(s if len(first) else 0):
            for j in range(i + 1, s):
                ok = possible(first + i, first + j)
                alive[first[ok] + i] = alive[first[ok] + j] = True
    for start, s in zip(head[large := (size > SMALL_GROUP) & (size <= TILE_ROWS)].tolist(), size[large].tolist(), strict=True):
        step = max(1, (1 << 18) // s)
        for i in range(0, s, step):
            a, b = np.arange(start + i, min(start + s, start + i + step))[:, None], np.arange(start, start + s)[None, :]
            ok = possible(a, b)
            ok[a == b] = False
            alive[a[:, 0]] |= ok.any(axis=1)
    return alive


def _groups(hot: np.ndarray, salts: np.ndarray, rule: Rule | None = None, plain: Callable | None = None):
    """Rows of windows that several sets have. Those of a ``hot`` window come under several keys, or ``plain`` tells
    keys without their salt and which have one. Where a
    word of bitmap comes with the rows, those that have no possible partner by ``rule`` in a group of a tile's size go; the token's
    place and the row's component (xor the row) may follow it."""
    salted = np.concatenate([np.empty(0, U64), *(_salted(np.full(int(n), w), np.arange(int(n))) for w, n in zip(hot, salts, strict=True))])
    true = np.repeat(hot, salts.astype(np.int64))
    order = np.argsort(salted)
    salted, true = salted[order], true[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, uids, sizes, words, places, comps = [np.empty(0, U64)], [np.empty(0, np.int64)], [np.empty(0, np.uint32)], [np.empty(0, U64)], [np.empty(0, np.uint16)], [np.empty(0, np.int64)]
        for batch in batches:
            for i in range(batch.num_rows):
                keys.append(B.unpack_keys(batch.column(2)[i].as_py()))
                for x, held in zip(batch.column(3)[i].as_py(), (uids, sizes, words, places, comps)):  # noqa: B905
                    held.append(B.from_planes(x, held[0].dtype))
        key, uid, size = np.concatenate(keys), np.concatenate(uids), np.concatenate(sizes)
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.zeros(len(order) + 1, dtype=bool)
        same[1:-1] = key[1:] == key[:-1]
        kept = same[:-1] | same[1:]
        if rule is not None:
            rows = np.flatnonzero(kept)
            at = order[rows]
            place = np.concatenate(places)[at].astype(np.int64) if len(places) > 1 else None
            comp = uid[at] ^ np.concatenate(comps)[at] if len(comps) > 1 else None
            n, word = (size >> 1).astype(np.int64), np.concatenate(words)
            if rule.told is not None:
                word, sent = np.zeros(len(n), U64), word
                word[n <= rule.told] = sent
            kept[rows] = _partnered(key[rows], n[at], word[at], rule, place, comp)
        if len(salted):
            at = np.minimum(np.searchsorted(salted, key), len(salted) - 1)
            found = salted[at] == key
            kept |= found
            key = np.where(found, true[at], key)
        if plain is not None:
            key, found = plain(key)
            kept |= found
        key, uid, size = key[kept], uid[order[kept]], size[order[kept]].astype(np.int64)
        for i in range(0, len(key), 1 << 17):
            at = slice(i, i + (1 << 17))
            yield pa.RecordBatch.from_arrays([pa.array(_signed(key[at])), pa.array(uid[at]), pa.array(size[at] >> 1), pa.array((size[at] & 1).astype(bool))], names=["token", "uid", "n", "early"])

    return run


class Wanted:
    """In a task: rows of a side table, by block."""

    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.grp, self.rows = path, columns, None, {}

    def of(self, bid: int) -> list[np.ndarray]:
        if bid >> B._BITS != self.grp:
            self.grp, self.rows = bid >> B._BITS, {}
            table = _scratch.read_side_table(f"{self.path}/grp={self.grp}", ["bid", *self.columns])
            if table is not None and len(table):
                data = [table.column(c).to_numpy() for c in ("bid", *self.columns)]
                order = np.lexsort(data[1::][::-1] + [data[0]])
                data = [x[order] for x in data]
                head = np.flatnonzero(np.append(True, data[0][1:] != data[0][:-1]))
                for a, b in zip(head, np.append(head[1:], len(order)), strict=True):
                    self.rows[int(data[0][a])] = [x[a:b] for x in data[1:]]
        return self.rows.get(bid, [np.empty(0, np.int64)] * len(self.columns))


def _side(df: DataFrame, label: str, parts: int) -> str:
    """Rows with a ``uid``, written by the task of its block; ``slot`` is its place there."""
    bid = F.shiftright("uid", _SLOT)
    rows = df.withColumns({"bid": bid, "slot": F.col("uid").bitwiseAND((1 << _SLOT) - 1), "grp": F.shiftright(bid, B._BITS)})
    return _scratch.materialize(rows.drop("uid").repartition(parts, "grp"), label, partition_by="grp")


def _members(k: int, path: str):
    """Send the sets that tiles ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(path, ["slot", "tile"])
        for block in B.each_block(batches):
            slot, tile = wanted.of(block.bid)
            if not len(slot):
                continue
            part, place = block.only(slot)
            sets = _sets(part, k)
            uid = slot + (block.bid << _SLOT)
            size = np.cumsum([sets[i].nbytes for i in place]) // (4 << 20)
            cut = [0, *(np.flatnonzero(np.diff(size)) + 1), len(slot)]
            for start, stop in zip(cut[:-1], cut[1:], strict=True):
                at = slice(start, stop)
                none = pa.nulls(stop - start, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(tile[at]), pa.array(uid[at]), none, pa.array([sets[i].tobytes() for i in place[at]], pa.binary())], names=["tile", "uid", "uids", "data"])

    return run


def _linked(sets: list[np.ndarray], u: np.ndarray, v: np.ndarray, rule: Rule) -> list[int]:
    """Which of the pairs (u, v) link, but for those that links before them have joined."""
    root = list(range(len(sets)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out, at = [], range(len(u))
    if rule.screened is not None and len(u) >= SCREENED_PAIRS:
        at = np.flatnonzero(rule.screened(sets, u, v))
        u, v, at = u[at], v[at], at.tolist()
    for i, a, b in zip(at, u.tolist(), v.tolist(), strict=True):
        x, y = top(a), top(b)
        if x != y and rule.linked(sets[a], sets[b]):
            root[y] = x
            out.append(i)
    return out


def _decide(rule: Rule):
    """Links of one tile after another. Rows come sorted by (tile, uid): first the tile's pairs, as places in its
    uids (no pairs: the first with each other), then its sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, uids, pairs, sets = None, [], b"", {}

        def finish() -> Iterator[pa.RecordBatch]:
            if tile is not None:
                u, v = np.frombuffer(pairs, np.int32).reshape(2, -1) if pairs is not None else (np.zeros(len(uids) - 1, np.int32), np.arange(1, len(uids), dtype=np.int32))
                found = _linked([sets[x] for x in uids], u, v, rule)
                ids = np.array(uids, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(ids[u[found]]), pa.array(ids[v[found]])], names=["u", "v"])

        for batch in batches:
            for i, (t, uid) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if uid is None:
                    yield from finish()
                    tile, uids, pairs, sets = t, batch.column(2)[i].as_py(), batch.column(3)[i].as_py(), {}
                else:
                    assert t == tile
                    sets[uid] = np.frombuffer(batch.column(3)[i].as_buffer(), U64).copy()
        yield from finish()

    return run


SENT_MEMBERS = "tile long, uid long, uids array<long>, data binary"


def decided(pieces: DataFrame, sent: DataFrame, rule: Rule, parts: int) -> DataFrame:
    """Links among the pairs of stored pieces of tiles, by the rows' data that was ``sent``; they join what all links would."""
    heads = pieces.select("tile", F.lit(None).cast("long").alias("uid"), "uids", F.col("pairs").alias("data"))
    dealt = sent.union(heads).repartition(parts, "tile").sortWithinPartitions("tile", "uid")
    return _scratch.stored(dealt.mapInArrow(_decide(rule), "u long, v long"), "links")


class _Bitmaps:
    """Bitmaps of rows, by width; a row is there in its own width and in half of it."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.width = lengths
        start = np.cumsum(lengths) - lengths
        self.at, self.rows = {}, {}
        for w in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == w)
            full = words[start[own][:, None] + np.arange(w)]
            for size, part in ((w, full), (w // 2, full[:, : w // 2] ^ full[:, w // 2 :])):
                if size not in self.at:
                    self.at[size], self.rows[size] = np.full(len(lengths), -1), []
                self.at[size][own] = sum(map(len, self.rows[size])) + np.arange(len(own))
                self.rows[size].append(part)
        self.rows = {w: np.concatenate(x) for w, x in self.rows.items()}

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), np.int64)
        width = np.minimum(self.width[a], self.width[b])
        for w in np.unique(width).tolist():
            at, rows = self.at[w], self.rows[w]
            for i in np.array_split(which := np.flatnonzero(width == w), len(which) * w // (1 << 20) + 1):
                out[i] = np.bitwise_count(rows[at[a[i]]] ^ rows[at[b[i]]]).sum(axis=1, dtype=np.int64)
        return out


def _tile(rule: Rule, limit: int | None):
    """Pieces of the pairs of a tile whose sizes and bitmaps allow a link. Rows come sorted by (family, ti, tj).

    Of a tile with more than ``limit`` pairs a row every row comes with its most central partner only,
    marked as partial.
    """

    def finish(cols: list[np.ndarray], words: np.ndarray) -> Iterator[pa.RecordBatch]:
        family, ti, tj, t, uid, n, early, upper, comp, lengths = cols
        bitmaps = _Bitmaps(words, lengths)
        head = np.flatnonzero(np.append(True, (family[1:] != family[:-1]) | (ti[1:] != ti[:-1]) | (tj[1:] != tj[:-1])))
        small: list[tuple] = []

        def possible(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            swap = n[a] > n[b]
            a, b = np.where(swap, b, a), np.where(swap, a, b)
            ok = early[a] & ~(upper[a] & upper[b]) & (comp[a] != comp[b]) & (n[b] * rule.num <= n[a] * rule.den)
            a, b = a[ok], b[ok]
            differ = bitmaps.differ(a, b)
            fine = rule.possible(n[a], n[b], differ)
            return a[fine], b[fine], -differ[fine] / (n[a] + n[b])[fine]

        def pieces(s: int, a: np.ndarray, b: np.ndarray, close: np.ndarray, rows: int) -> Iterator[tuple]:
            partial = limit is not None and len(a) > limit * rows
            if partial:
                a, b = central_partners(a, b)
            else:
                order = np.argsort(-close, kind="stable")
                a, b = a[order], b[order]
            for i in range(0, len(a), PIECE_PAIRS):
                at, place = np.unique(np.concatenate([a[i : i + PIECE_PAIRS], b[i : i + PIECE_PAIRS]]), return_inverse=True)
                name = int(mix(mix(family[s : s + 1].astype(U64)) + mix(np.array([(int(ti[s]) << 32) + int(tj[s])], U64)) + U64(i))[0] >> U64(1))
                yield name, int(family[s]), uid[at], place.astype(np.int32).tobytes(), partial

        ends = np.append(head[1:], len(family))
        within = ti[head] == tj[head]
        kept = np.ones(len(head), dtype=bool)
        for size in range(1, SMALL_GROUP + 1):  # all small tiles of one size at a time: most have no pair
            at = np.flatnonzero(within & (ends - head == size))
            kept[at] = False
            for i, j in combinations(range(size if len(at) else 0), 2):
                kept[at[np.isin(head[at] + i, np.concatenate(possible(head[at] + i, head[at] + j)[:2]))]] = True
        for s, e in zip(head[kept], ends[kept], strict=True):
            left, right = np.arange(s, e)[t[s:e] == ti[s]], np.arange(s, e)[t[s:e] == tj[s]]
            found = []
            step = max(1, (1 << 18) // max(1, len(right)))
            for i in range(0, len(left), step):
                a, b = np.repeat(left[i : i + step], len(right)), np.tile(right, len(left[i : i + step]))
                if ti[s] == tj[s]:
                    a, b = a[a < b], b[a < b]
                found.append(possible(a, b))
            if found:
                a, b, close = (np.concatenate(x) for x in zip(*found, strict=True))
                small += pieces(s, a, b, close, e - s)
            if sum(len(x[3]) for x in small) > 4 << 20:
                yield rows(small)
                small = []
        if small:
            yield rows(small)

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([x[j] for x in found], kind) for j, kind in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.bool_()))],
            names=["tile", "family", "uids", "pairs", "partial"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], []

        def joined() -> tuple[list[np.ndarray], np.ndarray]:
            return [np.concatenate([p[j] for p in held]) for j in range(10)], np.concatenate(words)

        for batch in batches:
            sig = batch.column(9)
            held.append([*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(9)), sig.value_lengths().to_numpy().astype(np.int64)])
            words.append(sig.flatten().to_numpy().view(U64))
            if sum(map(len, words)) >= 1 << 20:
                cols, all_words = joined()
                last = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]) | (cols[2] != cols[2][-1]))
                cut = last[-1] + 1 if len(last) else 0
                if cut:
                    at = cols[9][:cut].sum()
                    yield from finish([x[:cut] for x in cols], all_words[:at])
                    held, words = [[x[cut:] for x in cols]], [all_words[at:]]
        if held:
            yield from finish(*joined())

    return run


def _families(labelled: DataFrame, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows (family, uid, n, early, upper, comp, label, labels) of groups with several components, of families in ``only`` if given; and
    the stored (token, band, family, two) of these groups.
    A family's name follows from the rows of its groups, so it is the same in each round.

    ``upper``: of the second of the family's two bands. Rows meet in tiles by their labels; those of
    the largest component have the highest and don't meet each other.
    """
    h1, h2 = F.xxhash64(F.lit(1), "uid"), F.xxhash64("uid", F.lit(2))
    stats = labelled.groupBy("token", "band").agg(F.min("comp").alias("a"), F.max("comp").alias("z"), F.min(h1).alias("h1"), F.min(h2).alias("h2"))
    bands = Window.partitionBy("token").orderBy("band")  # some tens at most
    following = F.lead(F.struct("band", "a", "z", "h1", "h2")).over(bands)
    stats = stats.withColumn("x", F.when(following["band"] == F.col("band") + 1, following))
    mixed = F.least("a", "x.a") < F.greatest("z", "x.z")
    name = F.xxhash64("band", F.least("h1", "x.h1"), F.least("h2", "x.h2")).alias("family")
    keys = stats.where(mixed).select("token", "band", name, F.col("x").isNotNull().alias("two"))
    if only is not None:
        keys = keys.join(only, "family", "left_semi")
    keys = named = _scratch.stored(keys, "keys")
    sides = F.array(F.struct("band", F.lit(False).alias("upper")), F.when(F.col("two"), F.struct((F.col("band") + 1).alias("band"), F.lit(True).alias("upper"))))
    keys = keys.select("token", "family", F.explode(F.array_compact(sides)).alias("y")).select("token", "family", "y.*")
    rows = labelled.join(keys, ["token", "band"]).groupBy("family", "uid").agg(F.min("n").alias("n"), F.max("early").alias("early"), F.min("upper").alias("upper"), F.min("comp").alias("comp"))
    rows = _scratch.stored(rows, "rows")
    parts = rows.groupBy("family", "comp").agg(F.count("*").alias("c"), F.max("n").alias("n"))
    parts = parts.groupBy("family").agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("rows"), F.max("n").alias("n"))
    tile = F.greatest(F.lit(1), F.least(F.lit(TILE_ROWS), F.floor(TILE_WINDOWS / F.col("n"))))
    alone = F.col("rows") > tile
    others = F.ceil((F.col("rows") - F.col("top.c")) / tile)
    parts = parts.select("family", F.when(alone, F.col("top.comp")).alias("main"), F.when(alone, others).otherwise(F.lit(1)).cast("long").alias("others"), F.when(alone, F.ceil(F.col("top.c") / tile)).otherwise(F.lit(0)).cast("long").alias("mains"))
    first = F.coalesce(F.col("comp") == F.col("main"), F.lit(False))
    dealt = F.abs(F.xxhash64("uid") % F.when(first, F.col("mains")).otherwise(F.col("others"))) + F.when(first, F.col("others")).otherwise(F.lit(0))
    met = F.when(first, F.col("others")).otherwise(F.col("others") + F.col("mains"))
    return rows.join(parts, "family").select("family", "uid", "n", "early", "upper", "comp", dealt.alias("label"), met.alias("labels")), named


class Join(NamedTuple):
    sets: DataFrame
    links: DataFrame
    blocks: DataFrame
    parts: int


def similar_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, carry: list[str] | None = None) -> Join:
    """Sets of ``k``-word windows per document, and links that span all components of sets with
    ``den * |intersection| >= num * |union|``.

    ``sets``: (uid, doc_id, n, f1, f2), one row per document; (n, f1, f2) names its class of equal sets.
    ``links``: pairs (u, v) of representatives' uids.
    ``blocks``: the documents as they were read, with a struct of the columns in ``carry``.
    Words are runs of bytes other than ASCII white space, A-Z lower-cased. Null, empty and blank
    texts have an empty set and no link. Null ids stay null. Repeated rows are equal sets.
    """
    spark = docs.sparkSession
    whole, n_bytes = B.block_table(docs, id_col, text_col, carry=carry)
    blocks = whole.select("bid", "doc_id", "flag", "lens", "data")
    parts = _scratch.partitions_for(spark, n_bytes)
    described = _scratch.stored(blocks.mapInArrow(_describe(k), SET_SCHEMA), "sets")
    often = (
        described.where("uid is null").select(F.explode(F.arrays_zip("frequent", "times")).alias("x"))
        .groupBy(F.col("x.frequent").alias("token")).agg(F.sum("x.times").alias("times"))
        .orderBy(F.desc("times"), "token").limit(FREQUENT_WINDOWS).toArrow()
    )
    token = often.column("token").to_numpy().view(U64)
    order = np.argsort(token)
    rank = len(token) - 1 - order
    frequent = token[order]
    salts = -(-often.column("times").to_numpy()[order] // HOT_ROWS)
    sets = described.where("uid is not null")
    classes = sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("uid").alias("uid"))
    reps = _side(classes.select("uid"), "reps", parts)
    sent = blocks.mapInArrow(_prefixes(k, num, den, reps, frequent, rank, salts, parts), B.SENT_SCHEMA)
    groups = sent.repartition(parts, "bucket").mapInArrow(_groups(frequent[salts > 1], salts[salts > 1]), GROUP_SCHEMA)

    def members(asked: DataFrame) -> DataFrame:
        return blocks.mapInArrow(_members(k, _side(asked, "asked", parts)), SENT_MEMBERS)

    links = linked_rows(groups, sets.select("uid", "sig", F.col("n").alias("size")), jaccard_rule(num, den), members, parts)
    return Join(sets.drop("sig", "frequent", "times"), links, whole, parts)


def linked_rows(groups: DataFrame, sig: DataFrame, rule: Rule, members: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """Links (u, v) that span all components of rows of one group that link by ``rule``.

    ``groups``: GROUP_SCHEMA; any two rows that link have a token in common for which the smaller is ``early``.
    ``sig``: (uid, sig, size). ``members`` sends the data of asked rows (tile, uid) as SENT_MEMBERS.
    """
    groups = banded(groups, rule)
    return further_links(first_links(groups, sig, rule, members, parts), groups, sig, rule, members, parts)


def banded(groups: DataFrame, rule: Rule) -> DataFrame:
    """Stored groups with their rows' bands. Sizes of a link differ by den / num at most, so they lie in one band or in two neighbouring ones."""
    band = F.floor(F.log("n") / max(math.log(rule.den / rule.num) * (1 + 1e-9), 1e-6)).cast("long")
    return _scratch.stored(groups.withColumn("band", band), "groups")


def _verified(pieces: DataFrame, rule: Rule, members: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    with _scratch.passing(pieces.sparkSession, "links"):
        return decided(pieces, members(pieces.select("tile", F.explode("uids").alias("uid"))), rule, parts)


def first_links(groups: DataFrame, sig: DataFrame | None, rule: Rule, members: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """Links of the smallest row of each band of a group with the others of it. Without ``sig`` all of these are held against each other: for
    small rows of groups that went through a word of bitmap, fetching wider ones costs more than the data of those that they would spare."""
    heads = groups.groupBy("token", "band").agg(F.min(F.struct("n", "uid")).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    heads = heads.select("token", "band", F.col("first.uid").alias("hub"), F.col("first.n").alias("hub_size"))
    pairs = groups.join(heads, ["token", "band"]).where("hub <> uid").select("hub", "uid", F.col("n").alias("size"), "hub_size").distinct()
    n, m = F.least("size", "hub_size"), F.greatest("size", "hub_size")
    differ = F.lit(0)
    if sig is not None:
        pairs = pairs.join(sig.select("uid", "sig"), "uid").join(sig.select(F.col("uid").alias("hub"), F.col("sig").alias("hub_sig")), "hub")
        width = F.least(F.size("sig"), F.size("hub_sig"))

        def folded(sig):
            halves = F.zip_with(F.slice(sig, 1, width), F.slice(sig, width + 1, width), lambda a, b: a.bitwiseXOR(b))
            return F.when(F.size(sig) > width, halves).otherwise(F.col(sig))

        differ = F.aggregate(F.zip_with(folded("sig"), folded("hub_sig"), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda a, x: a + x)
    pairs = _scratch.stored(pairs.where((m * rule.num <= n * rule.den) & rule.possible(n, m, differ)).select("hub", "uid", "size"), "pairs")
    hubs = pairs.groupBy("hub").agg(F.ceil(F.greatest(F.count("*") / HUB_ROWS, F.sum("size") / TILE_WINDOWS)).alias("tiles"))
    salt = F.abs(F.xxhash64("uid") % F.col("tiles"))
    pieces = pairs.join(hubs, "hub").groupBy("hub", salt.alias("salt")).agg(F.collect_list("uid").alias("uids"))
    pieces = pieces.select(F.shiftrightunsigned(F.xxhash64("hub", "salt"), 1).alias("tile"), F.concat(F.array("hub"), "uids").alias("uids"), F.lit(None).cast("binary").alias("pairs"))
    return _verified(_scratch.stored(pieces, "pieces"), rule, members, parts)


def further_links(links: DataFrame, groups: DataFrame, sig: DataFrame, rule: Rule, members: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """``links`` and those between rows of different components, in rounds until all pairs of one group are decided. A
    round looks at those families only that the round before it left open, and reads the groups of their tokens only."""
    spark, open_families = sig.sparkSession, None
    for limit in (PAIRS_PER_ROW, PAIRS_PER_ROW, None):
        with _scratch.passing(spark, "components"):
            comps = _scratch.stored(components(links), "components")
        labelled = groups.join(comps, groups["uid"] == comps["node"], "left").select("token", "band", "uid", "n", "early", F.coalesce("component", "uid").alias("comp"))
        placed, named = _families(labelled, open_families)
        placed = placed.join(sig.drop("size"), "uid")
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("labels") - 1)).alias("o")
        placed = placed.select("*", other).select("family", F.least("label", "o").alias("ti"), F.greatest("label", "o").alias("tj"), F.col("label").alias("t"), "uid", "n", "early", "upper", "comp", "sig")
        placed = placed.repartition(parts, "family", "ti", "tj").sortWithinPartitions("family", "ti", "tj")
        pieces = _scratch.stored(placed.mapInArrow(_tile(rule, limit), PIECE_SCHEMA), "pieces")
        if pieces.isEmpty():
            break
        links = links.union(_verified(pieces, rule, members, parts))
        open_families = _scratch.stored(pieces.where("partial").select("family").distinct(), "open")  # all pairs of others are decided
        if open_families.isEmpty():
            break
        tokens = _scratch.stored(named.join(open_families, "family", "left_semi").select("token").distinct(), "open")
        groups = _scratch.stored(groups.join(tokens, "token", "left_semi"), "groups")
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Per row of ``docs``: (doc_id, n_shingles, component_id), the last being the smallest id that
    links reach. A document with an empty set is its own component. Null ids are passed over in the
    smallest id; a component of null ids only has a null component_id."""
    found = similar_sets(docs, id_col, text_col, k, num, den)
    classes = _classes(found)
    named = classes.groupBy("comp").agg(F.min("least").alias("component_id"))
    classes = classes.join(named, "comp").select("n", "f1", "f2", "component_id")
    out = found.sets.join(classes, ["n", "f1", "f2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(found: Join) -> DataFrame:
    """The component of each class of equal sets, with the class's smallest id."""
    comps = components(found.links)
    classes = found.sets.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("uid").alias("rep"), F.min("doc_id").alias("least"))
    classes = classes.join(comps, classes["rep"] == comps["node"], "left").select("n", "f1", "f2", "least", F.coalesce("component", "rep").alias("comp"))
    return _scratch.stored(classes, "classes")


def _without(path: str, spread: bool):
    """Rows of a block but for those that are to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = Wanted(path, ["slot"])
        for block in B.each_block(batches):
            kept = np.setdiff1d(np.arange(len(block.lens)), gone.of(block.bid)[0])
            offsets = np.cumsum(block.lens + 1) - block.lens - 1
            texts = [block.data[offsets[d] : offsets[d] + block.lens[d]].tobytes() for d in kept]
            columns = [block.doc_id.cast(pa.int64()).take(pa.array(kept)), pa.array(texts, pa.binary()).view(pa.string())]
            names = ["doc_id", "text"]
            if spread:
                columns.append(block.carry.take(pa.array(kept)))
                names.append("carry")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def first_of_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, carry: list[str] | None = None) -> DataFrame:
    """``docs`` as (doc_id, text) and a struct ``carry``, with one row of each group that links join: that of the
    smallest id, null last; among rows of one id the one that the blocks hold first.

    Rows with an empty set all stay, a null text as an empty one. An empty table stays empty.
    """
    found = similar_sets(docs, id_col, text_col, k, num, den, carry)
    rows = found.sets.join(_classes(found).drop("least"), ["n", "f1", "f2"]).select("uid", "doc_id", "comp")
    first = rows.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid")).alias("first"))
    path = _side(rows.join(first, "comp").where("uid <> first.uid").select("uid"), "gone", found.parts)
    schema = "doc_id long, text string"
    if carry:
        schema += ", carry " + found.blocks.schema["carry"].dataType.elementType.simpleString()
    return found.blocks.mapInArrow(_without(path, bool(carry)), schema)
