"""Fuzzy line dedup: normalised lines, joined on keys that similar ones share, edit similarity, one occurrence per group.

Lines are normalised to words (A-Z lower-cased, ASCII other than letters and digits dropped), and equal
ones collapse. Of every connected group the occurrence with the smallest (id, line) stays, wherever the copies stand.

Two kinds of keys:

* SimHash (``most_bits``): each distinct line gets a 64-bit SimHash of its distinct words. Two SimHashes that differ in at
  most three bits agree in three of six blocks, so lines are keyed by every three blocks.
* Word pairs, in long lines three words (``most_bits=None``): an edit spoils at most two of a line's pairs of neighbouring words, so lines that are similar enough
  share one among the first few of each, in any common order. A parity bitmap of the words takes the SimHash's place as filter of short lines; it
  differs in at most two bits an edit. A line is sent under as many pairs as edits can spoil and one more, rare ones first, so no pair of lines is lost
  at any length. How rare they are is counted in cells of hashes, on a sample of blocks; counts order only.

Lines under one key that the bits allow are verified by edit similarity over words, in the rounds of ``jaccard.linked_rows``. Word pairs go
in two passes: a few keys of each line join most of what is similar into components; then all keys are sent along with the component, and the task that
gathers a key passes on those lines only that may link with one of another component. The first of the pairs that no edit spoils is
a key of both lines, so the parts before and behind it differ in length by no more than the edits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from . import _scratch
from ._text import LOWER, Words, mix
from .components import components
from .jaccard import GROUP_SCHEMA, HOT_ROWS, NO_PLACE, SENT_MEMBERS, Rule, Wanted, _groups, _side, banded, first_links, further_links, linked_rows

U64 = np.uint64
MIN_WORDS = 5
MOST_BITS = 3
_WORD = np.zeros(256, dtype=np.int8)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = 1
_WIDTHS = (11, 11, 11, 11, 10, 10)
_STARTS = np.cumsum((0, *_WIDTHS[:-1])).tolist()
#: Masks of every three of the six blocks.
MASKS = [sum(((1 << _WIDTHS[i]) - 1) << _STARTS[i] for i in c) for c in combinations(range(6), 3)]

#: For each byte its bits, one to a byte of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(U64).reshape(-1)

#: Cells of the table by which word pairs are ordered, and of how many blocks it counts the pairs. It orders only.
CELL_BITS = 23
SAMPLE_BLOCKS = 128
#: Classes of a cell are steps of a logarithm; there are 32 at most.
CLASSES_A_DOUBLING = 1.5
#: Bits of a pair's hash that tell it from others, next to 5 of its class and 20 of a line. Pairs of equal bits count as one, which loses no pair of lines.
KEY_BITS = 39
SLICES = 16
#: Lines of more words are keyed by three neighbouring words, as the pairs and words of unrelated ones agree too often. Those that may be similar
#: to shorter ones are keyed by pairs, too.
PAIR_WORDS = 40
#: Keys of a line of each kind in the first pass. They join most copies early; the second pass takes all keys.
FIRST_KEYS = 4

LINE_SCHEMA = "node long, uid long, doc_id long, line long, n long, h1 long, h2 long, sig array<long>"


class _Lines:
    """Lines of a block: their document, number in it, and words."""

    def __init__(self, block: B.Block):
        words = Words(block.data, block.lens, folded=LOWER, word_byte=_WORD)
        self.hashes = words.hashes
        starts = np.sort(np.concatenate([words.offsets[:-1], np.flatnonzero(block.data == 10) + 1]))
        self.doc = np.searchsorted(words.offsets, starts, "right") - 1
        first = np.searchsorted(starts, words.offsets[:-1], "left")
        self.line = np.arange(len(starts)) - first[self.doc]
        self.bounds = np.append(np.searchsorted(words.starts, starts), len(words.hashes))
        self.n = np.diff(self.bounds)

    def sequence_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each line's words in order."""
        factor = (U64(0x9E3779B97F4A7C15) * np.arange(1, max(2, self.n.max(initial=0) + 1), dtype=U64)) | U64(1)
        placed = mix(self.hashes + factor[np.arange(len(self.hashes)) - np.repeat(self.bounds[:-1], self.n)])
        out = []
        for x in (placed, (placed ^ (placed >> U64(29))) * U64(0xBF58476D1CE4E5B9)):
            total = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
            out.append(mix(total[self.bounds[1:]] - total[self.bounds[:-1]] + self.n.astype(U64)))
        return out[0], out[1]

    def parity(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of the words that each line has an odd number of times, as 64-bit words, and their bounds.
        They have four bits a word at least, so that unrelated lines differ in more bits than similar ones can."""
        n = np.maximum(self.n[rows], 1)
        width = 1 << np.maximum(0, np.ceil(np.log2(n / 16))).astype(np.int64)
        bounds = np.concatenate([[0], np.cumsum(width)])
        out = np.zeros(bounds[-1], U64)
        taken = np.flatnonzero(np.repeat(_flags(len(self.n), rows), self.n))
        row = np.repeat(np.arange(len(rows)), self.n[rows])
        h = self.hashes[taken]
        lane = (h & U64(0xFFFFFFFF)).astype(np.int64) & (width[row] - 1)
        np.bitwise_xor.at(out, bounds[row] + lane, U64(1) << (h >> U64(58)))
        return out, bounds

    def parity_word(self) -> np.ndarray:
        """The bitmaps of all lines, folded into one word."""
        running = np.concatenate([np.zeros(1, U64), np.bitwise_xor.accumulate(U64(1) << (self.hashes >> U64(58)))])
        return running[self.bounds[1:]] ^ running[self.bounds[:-1]]

    def grams(self, q: int, at: np.ndarray) -> np.ndarray:
        """A hash of the words at these places and the q - 1 after each."""
        out = np.full(len(at), U64(q))
        for j in range(q):
            out = mix(out * U64(0xA0761D6478BD642F) + self.hashes[at + j])
        return out

    def simhash(self, rows: np.ndarray) -> np.ndarray:
        """Majority bits over each line's distinct words, so that frequent words don't decide alone."""
        out = [np.empty(0, U64)]
        for i in range(0, len(rows), 1 << 16):
            part = rows[i : i + (1 << 16)]
            chosen = np.zeros(len(self.n), dtype=bool)
            chosen[part] = True
            number = np.cumsum(chosen) - 1
            key = np.repeat(number.astype(U64) << U64(44), self.n)[taken := np.repeat(chosen, self.n)] | (self.hashes[taken] >> U64(20))
            key.sort()
            key = key[np.append(True, key[1:] != key[:-1])]
            n = np.bincount((key >> U64(44)).astype(np.int64), minlength=len(part))
            # votes in byte lanes, of at most 255 words at a time
            pieces = -(-n // 255)
            first = np.cumsum(pieces) - pieces
            within = np.arange(pieces.sum()) - np.repeat(first, pieces)
            starts = np.repeat(np.cumsum(n) - n, pieces) + 255 * within
            bytes_ = mix(key & U64((1 << 44) - 1)).view(np.uint8).reshape(-1, 8)
            votes = [np.add.reduceat(np.add.reduceat(_LANES[bytes_[:, j]], starts).view(np.uint8).reshape(-1, 8), first, axis=0, dtype=np.int32) for j in range(8)]
            out.append(np.packbits(2 * np.concatenate(votes, axis=1) > n[:, None], axis=1, bitorder="little").view(U64).reshape(-1))
        return np.concatenate(out)


def _flags(n: int, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(n, dtype=bool)
    out[rows] = True
    return out


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _describe(min_words: int, most_bits: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        for block in B.each_block(batches, B.KEPT_BYTES):
            lines = _Lines(block)
            rows = np.flatnonzero(lines.n >= min_words)
            ids = block.doc_id.take(pa.array(lines.doc[rows]))
            h1, h2 = lines.sequence_hashes()
            sig, bounds = lines.parity(rows) if most_bits is None else (lines.simhash(rows), np.arange(len(rows) + 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(first + np.arange(len(rows))), pa.array((block.bid << 22) + lines.doc[rows]), ids, pa.array(lines.line[rows]), pa.array(lines.n[rows]),
                 _signed(h1[rows]), _signed(h2[rows]), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), _signed(sig))],
                names=["node", "uid", "doc_id", "line", "n", "h1", "h2", "sig"],
            )
            first += len(rows)

    return run


def _keys(n_buckets: int):
    """Send each line under its twenty keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sim, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(U64), batch.column(2).to_numpy()
            keys = np.concatenate([mix((sim & U64(m)) ^ U64(i * 0xBF58476D1CE4E5B9 & (2**64 - 1))) for i, m in enumerate(MASKS)])
            order = np.argsort(keys, kind="stable")
            extra = [np.tile(x, len(MASKS))[order] for x in (node, (2 * n + 1).astype(np.uint32), sim)]
            yield from B.sent_rows(int(node[0]) if len(node) else 0, keys[order], extra, n_buckets)

    return run


def _told(num: int, den: int) -> int:
    """The length of the longest line that may be similar to one of PAIR_WORDS words. Lines up to it have a word of bitmap beside their keys."""
    return PAIR_WORDS * den // num


def _kinds(n: np.ndarray, num: int, den: int) -> list[tuple[int, np.ndarray]]:
    """Lengths of grams, and which lines of ``n`` words are keyed by them. Any two that can be similar have a length in common."""
    return [(2, n <= _told(num, den)), (3, n > PAIR_WORDS)]


def _places(number: np.ndarray, n: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the grams of ``q`` words of lines with a number (others: -1) start, and these numbers."""
    words = np.repeat(number, n)
    last = words[q - 1 :]
    at = np.flatnonzero((last == words[: len(last)]) & (last >= 0))
    return at, last[at]


def _counted(num: int, den: int):
    """How many word pairs fall into each cell, in slices of cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for block in B.each_block(batches, B.KEPT_BYTES):
            lines = _Lines(block)
            count = np.zeros(1 << CELL_BITS, np.uint32) if count is None else count
            for q, of in _kinds(lines.n, num, den):
                at = _places(np.where(of & (_prefix(lines.n, num, den, q) > 0), np.arange(len(lines.n)), -1), lines.n, q)[0]
                cells = np.sort((lines.grams(q, at) >> U64(64 - CELL_BITS)).astype(np.uint32))
                if len(cells):
                    head = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
                    count[cells[head]] += np.diff(np.append(head, len(cells))).astype(np.uint32)
        if count is not None:
            parts = np.split(count, SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES)), pa.array([B.planes(x) for x in parts], pa.binary())], names=["slice", "counts"])

    return run


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A class for each cell, the higher the more pairs it has."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            total[i] = total.get(i, 0) + B.from_planes(counts, np.uint32).astype(np.int64)
    for i, counts in total.items():
        found = np.minimum(31, np.round(CLASSES_A_DOUBLING * np.log2(1 + counts))).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([found.tobytes()], pa.binary())], names=["slice", "counts"])


def _prefix(n: np.ndarray, num: int, den: int, q: int = 2) -> np.ndarray:
    """How many of its first grams of ``q`` words a line of ``n`` words is sent under: one more than edits to a
    line at least as similar as ``num / den`` can spoil. Of lengths that allow edits at all, others get none.

    Of two lines of a and b >= a words, at most e = (den - num) * b // den edits apart, the shorter has at most q e - (b - a) grams
    that the longer lacks, as an added word spoils q - 1 only; this is at most q (den - num) a / den.
    """
    longest = n * den // num
    return np.where((den - num) * longest >= den, q * (den - num) * n // den + 1, 0)


def _gram_keys(path: str, classes: np.ndarray, salts: np.ndarray, num: int, den: int, n_buckets: int, first_pass: bool):
    """Send each distinct line under the first of its grams, in the first pass under a few of these. ``classes`` has the class of each cell
    of hashes, ``salts`` over how many keys the lines of a pair of each class are dealt."""
    low = U64(64 - KEY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(path, ["slot", "line", "node", "comp"])
        for block in B.each_block(batches, B.KEPT_BYTES):
            slot, line, node, comp = wanted.of(block.bid)
            if not len(slot):
                continue
            lines = _Lines(block)
            nodes, comps = np.full(len(lines.n), -1, np.int64), np.full(len(lines.n), -1, np.int64)
            at = np.searchsorted(lines.doc, slot, "left") + line
            nodes[at], comps[at] = node, comp
            keys, rows, places = [], [], []
            for q, of in _kinds(lines.n, num, den):
                bound = _prefix(lines.n, num, den, q)
                bound = np.minimum(bound, FIRST_KEYS) if first_pass else bound
                asked = np.flatnonzero((nodes >= 0) & (bound > 0) & of)
                number = np.full(len(lines.n), -1, np.int64)
                number[asked] = np.arange(len(asked))
                at, row = _places(number, lines.n, q)
                hashed = lines.grams(q, at)
                order = classes[(hashed >> U64(64 - CELL_BITS)).astype(np.int64)].astype(U64) << U64(KEY_BITS) | hashed >> low
                for i in range(0, max(1, len(asked)), 1 << 20):
                    a, b = np.searchsorted(row, (i, i + (1 << 20)))
                    both = (row[a:b] - i).astype(U64) << U64(KEY_BITS + 5) | order[a:b]
                    by = np.argsort(both)
                    both = both[by]
                    head = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else by
                    times = np.diff(np.append(head, len(both)))
                    both, by = both[head], by[head]
                    number = (both >> U64(KEY_BITS + 5)).astype(np.int64)
                    first = np.flatnonzero(np.arange(len(number)) - np.searchsorted(number, number) < bound[asked[number + i]])
                    keys.append(both[first])
                    rows.append(asked[number[first] + i])
                    place = at[a:b][by[first]] - lines.bounds[rows[-1]]
                    places.append(np.where(times[first] > 1, NO_PLACE, np.minimum(place, NO_PLACE)).astype(np.uint16))
            key, row, place = np.concatenate(keys), np.concatenate(rows), np.concatenate(places)
            rank = (key >> U64(KEY_BITS) & U64(31)).astype(np.int64)
            key = key << low
            hot = np.flatnonzero(salts[rank] > 1)
            salt = mix(nodes[row[hot]].astype(U64)) % salts[rank[hot]].astype(U64) + U64(1)
            key[hot] = _turned(key[hot], salt) | salt
            order = np.argsort(key, kind="stable")
            row = row[order]
            extra = [nodes[row], (2 * lines.n[row] + 1).astype(np.uint32), lines.parity_word()[row], place[order]]
            if not first_pass:
                extra.append(nodes[row] ^ comps[row])
            yield from B.sent_rows(block.bid, key[order], extra, n_buckets, {2: lines.n[row] <= _told(num, den)})

    return run


def _turned(key: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Keys of one pair go to other buckets by their salt, which stands in the bits below the pair's; turned again, a key is as before."""
    shift = U64(64 - KEY_BITS)
    return key ^ np.where(salt > 0, mix(salt) >> shift << shift, U64(0))


def _plain(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys without their salt, and which have one."""
    salt = key & U64((1 << (64 - KEY_BITS)) - 1)
    return _turned(key ^ salt, salt), salt > 0


def _order(blocks: DataFrame, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The class of each cell of word pairs, and over how many keys the lines of a pair of each class are dealt."""
    every = max(1, blocks.select("bid").count() // SAMPLE_BLOCKS)
    sample = blocks.where(F.pmod(F.xxhash64("bid"), F.lit(every)) == 0)
    schema = "slice long, counts binary"
    slices = sample.mapInArrow(_counted(num, den), schema).repartition(SLICES, "slice").mapInArrow(_classes, schema).toArrow().to_pylist()
    classes = np.zeros(1 << CELL_BITS, np.uint8)
    for x in slices:
        classes.reshape(SLICES, -1)[x["slice"]] = np.frombuffer(x["counts"], np.uint8)
    return classes, np.ceil(2 ** (np.arange(32) / CLASSES_A_DOUBLING) * every / HOT_ROWS).astype(np.int64)


def _pair_links(blocks: DataFrame, places: DataFrame, sigs: DataFrame, rule: Rule, members: Callable[[DataFrame], DataFrame], parts: int) -> DataFrame:
    """Links that span all components of the distinct lines, by their word pairs. ``places``: (node, uid, line)."""
    spark = places.sparkSession
    classes, salts = _order(blocks, rule.num, rule.den)

    def groups(named: DataFrame, first_pass: bool) -> DataFrame:
        path = _side(named.select("uid", "line", "node", "comp"), "asked-lines", parts)
        sent = blocks.mapInArrow(_gram_keys(path, classes, salts, rule.num, rule.den, 2 * parts, first_pass), B.SENT_SCHEMA)
        return banded(sent.repartition(2 * parts, "bucket").mapInArrow(_groups(np.empty(0, U64), np.empty(0, np.int64), rule, _plain), GROUP_SCHEMA), rule)

    with _scratch.passing(spark, "links"):
        links = first_links(groups(places.withColumn("comp", F.col("node")), True), None, rule, members, parts)
    with _scratch.passing(spark, "groups"):
        comps = components(links).withColumnRenamed("node", "of")
        named = places.join(comps, places["node"] == comps["of"], "left").withColumn("comp", F.coalesce("component", "node"))
        rest = groups(named, False)
    return further_links(links, rest, sigs, rule, members, parts)


def edit_distance(a: list, b: list, most: int | None = None) -> int:
    """Levenshtein distance of two sequences, by bit vectors of the shorter one's length. Where it is more than ``most``, any
    number beyond that may come back."""
    i, most_equal = 0, min(len(a), len(b))
    while i < most_equal and a[i] == b[i]:
        i += 1
    a, b, most_equal, i = a[i:], b[i:], most_equal - i, 0
    while i < most_equal and a[-1 - i] == b[-1 - i]:
        i += 1
    a, b = a[: len(a) - i], b[: len(b) - i]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)  # vertical steps of +1 and -1
    # each word that is left lowers the score by one at most
    stop = len(b) + (len(a) + len(b) if most is None else most)
    for x in b:
        if score > stop:
            break
        stop -= 1
        same = where.get(x, 0)
        diagonal = ((same & up) + up ^ up) | same | down
        right_up, right_down = down | ~(diagonal | up) & full, up & diagonal
        score += bool(right_up & top) - bool(right_down & top)
        right_up, right_down = (right_up << 1 | 1) & full, right_down << 1 & full
        up, down = right_down | ~(diagonal | right_up) & full, right_up & diagonal
    return score


def _surplus(a: np.ndarray, b: np.ndarray) -> int:
    """Words of the longer sequence that have no equal in the other one, each used once; each of them takes an edit."""
    if len(a) > len(b):
        a, b = b, a
    words = np.concatenate([a, b])
    order = np.argsort(words, kind="stable")
    words = words[order]
    head = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
    more = np.add.reduceat((order >= len(a)) * 2 - 1, head)
    return int(more[more > 0].sum())


#: Bytes of the table of common words by which a piece's pairs are screened; beyond, each pair is looked at by itself.
SCREEN_BYTES = 64 << 20


def _common(sets: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray | None:
    """How many words the sequences of each pair have in common, each used once; None where the table for it would be too large."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    words, word = np.unique(np.concatenate([np.empty(0, U64), *sets]), return_inverse=True)
    order = np.lexsort((row, word))
    row, word = row[order], word[order]
    head = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1])))[: len(word)]
    nth = np.arange(len(word)) - np.repeat(head, np.diff(np.append(head, len(word))))
    _, token, times = np.unique(nth * len(words) + word, return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    width = 8 * (int(np.count_nonzero(times > 1)) // 64 + 1)
    if len(sets) * width > SCREEN_BYTES:
        return None
    shared = times[token] > 1
    row, column = row[shared], column[token[shared]]
    bits = np.zeros(len(sets) * width, np.uint8)
    np.add.at(bits, row * width + (column >> 3), (1 << (column & 7)).astype(np.uint8))
    bits = bits.view(U64).reshape(len(sets), -1)
    out = np.empty(len(u), np.int64)
    for i in np.array_split(np.arange(len(u)), len(u) * bits.shape[1] // (1 << 19) + 1):
        out[i] = np.bitwise_count(bits[u[i]] & bits[v[i]]).sum(axis=1, dtype=np.int64)
    return out


def edit_rule(num: int, den: int, most_bits: int | None) -> Rule:
    """Lines whose edit similarity over words, 1 - distance / words of the longer, is at least ``num / den``."""

    def possible(n, m, differ):
        if most_bits is not None:
            return differ <= most_bits
        edits = F.floor((den - num) * m / den) if isinstance(m, Column) else (den - num) * m // den
        return differ <= 2 * edits - (m - n)

    def linked(a: np.ndarray, b: np.ndarray) -> bool:
        most = (den - num) * max(len(a), len(b)) // den
        if len(a) == len(b) and np.count_nonzero(a != b) <= most:
            return True
        return _surplus(a, b) <= most and edit_distance(a.tolist(), b.tolist(), most) <= most

    def placed(m, apart):
        return apart <= (den - num) * m // den

    def screened(sets: list[np.ndarray], u: np.ndarray, v: np.ndarray) -> np.ndarray:
        common = _common(sets, u, v)
        if common is None:
            return np.ones(len(u), dtype=bool)
        n = np.array([len(x) for x in sets])
        longest = np.maximum(n[u], n[v])
        return longest - common <= (den - num) * longest // den

    return Rule(num, den, possible, linked, placed, _told(num, den) if most_bits is None else None, screened)


def _members(path: str):
    """Send the words of lines that tiles ask for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = Wanted(path, ["slot", "line", "node", "tile"])
        for block in B.each_block(batches, B.KEPT_BYTES):
            slot, line, node, tile = wanted.of(block.bid)
            if not len(slot):
                continue
            part, place = block.only(slot)
            lines = _Lines(part)
            row = np.searchsorted(lines.doc, place, "left") + line
            size = np.cumsum(lines.n[row] * 8) // (4 << 20)
            cut = [0, *(np.flatnonzero(np.diff(size)) + 1), len(row)]
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                words = [lines.hashes[lines.bounds[r] : lines.bounds[r + 1]].tobytes() for r in row[i:j]]
                yield pa.RecordBatch.from_arrays([pa.array(tile[i:j]), pa.array(node[i:j]), pa.nulls(j - i, pa.list_(pa.int64())), pa.array(words, pa.binary())], names=["tile", "uid", "uids", "data"])

    return run


def _removed(path: str, spread: bool):
    """Texts without the lines that are to go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = Wanted(path, ["slot", "line"])
        for block in B.each_block(batches, B.KEPT_BYTES):
            slot, line = gone.of(block.bid)
            offsets = np.concatenate([[0], np.cumsum(block.lens + 1)])
            cut = np.searchsorted(slot, np.arange(len(block.lens) + 1))
            texts, n = [], []
            for d in range(len(block.lens)):
                text = block.data[offsets[d] : offsets[d] + block.lens[d]].tobytes()
                lines = text.split(b"\n")
                n.append(len(lines))
                if cut[d] < cut[d + 1]:
                    drop = set(line[cut[d] : cut[d + 1]].tolist())
                    text = b"\n".join(x for i, x in enumerate(lines) if i not in drop)
                texts.append(text)
            columns = [block.doc_id.cast(pa.int64()), pa.array(texts, pa.binary()).view(pa.string()), pa.array(n, pa.int64()), pa.array(np.diff(cut).astype(np.int64))]
            names = ["doc_id", "text", "n_lines", "n_removed"]
            if spread:
                columns.append(block.carry)
                names.append("carry")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, min_words: int = MIN_WORDS, num: int = 80, den: int = 100, most_bits: int | None = MOST_BITS, most_keys: None = None) -> DataFrame:
    """Per row of ``docs``: (doc_id, text without the removed lines, n_lines, n_removed), and a
    struct ``carry`` of further columns, if asked for.

    Lines end at newlines. Those of fewer than ``min_words`` words always stay. Two lines link when
    their SimHashes differ in at most ``most_bits`` (three or fewer) bits and the edit similarity of their words, 1 - distance
    / words of the longer, is at least ``num / den``; with ``most_bits`` None, lines of that edit
    similarity link (it must then be at least 0.8), all of them: there is no limit to keys, ``most_keys`` must be None. Null text counts as empty. Null ids come after all others;
    equal ids, as in repeated rows, are told apart by their rows' order. An empty table stays empty.
    """
    if most_keys is not None:
        raise ValueError("a limit to keys would lose pairs")
    if most_bits is None and 5 * num < 4 * den or (most_bits or 0) > MOST_BITS:
        raise ValueError("keys don't reach so far")
    blocks, n_bytes = B.block_table(docs, id_col, text_col, carry=carry)
    plain = blocks.select("bid", "doc_id", "flag", "lens", "data")
    parts = _scratch.partitions_for(docs.sparkSession, n_bytes)
    with _scratch.passing(docs.sparkSession, "gone"):
        lines = _scratch.stored(plain.mapInArrow(_describe(min_words, most_bits), LINE_SCHEMA), "lines")
        place = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "uid", "line", "node")
        distinct = lines.groupBy("n", "h1", "h2").agg(F.min(place).alias("first"), F.first("sig").alias("sig"), F.count("*").alias("times"))
        distinct = _scratch.stored(distinct.withColumn("node", F.col("first.node")), "distinct-lines")
        places = distinct.select("node", "first.uid", "first.line")

        rule = edit_rule(num, den, most_bits)

        def members(asked: DataFrame) -> DataFrame:
            at = asked.withColumnRenamed("uid", "node").join(places, "node").select("uid", "line", "node", "tile")
            return plain.mapInArrow(_members(_side(at, "asked", parts)), SENT_MEMBERS)

        sigs = distinct.select(F.col("node").alias("uid"), "sig", F.col("n").alias("size"))
        with _scratch.passing(docs.sparkSession, "edges"):
            if most_bits is None:
                links = _pair_links(plain, places, sigs, rule, members, parts)
            else:
                sent = distinct.select("node", F.get("sig", F.lit(0)).alias("sim"), "n").mapInArrow(_keys(parts), B.SENT_SCHEMA)
                groups = sent.repartition(2 * parts, "bucket").mapInArrow(_groups(np.empty(0, U64), np.empty(0, np.int64), rule), GROUP_SCHEMA)
                links = linked_rows(groups, sigs, rule, members, parts)
            comps = components(links)

        named = distinct.join(comps, "node", "left").select("n", "h1", "h2", "first", "times", F.coalesce("component", "node").alias("comp"))
        named = _scratch.stored(named, "line-groups")
        kept = named.groupBy("comp").agg(F.min("first").alias("kept"), F.sum("times").alias("all")).where("all > 1").select("comp", "kept")
        loses = named.join(kept, "comp").select("n", "h1", "h2", "kept")
        gone = lines.join(loses, ["n", "h1", "h2"]).where((F.col("uid") != F.col("kept.uid")) | (F.col("line") != F.col("kept.line"))).select("uid", "line")
        path = _side(gone, "gone", parts)
    schema = "doc_id long, text string, n_lines long, n_removed long"
    if carry:
        schema += ", carry " + blocks.schema["carry"].dataType.elementType.simpleString()
    return blocks.mapInArrow(_removed(path, bool(carry)), schema)
