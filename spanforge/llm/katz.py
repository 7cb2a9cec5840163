"""Katz backoff language model over words, with Good-Turing discounts and exact normalisation.

Three partitioned tables are built by exchanges between blocks of documents, each keyed by a hash
range: word counts, word-pair counts, and per context the discounted mass of the pairs that it has.
Every token is then scored recursively: the discounted pair estimate where the training texts have the
pair often enough, else the context's backoff weight times the discounted word estimate.

* Word estimate: Good-Turing discounts for counts up to ``k``; the mass they free is the estimate of
  the one class of words that training never saw, so known words and that class sum to 1.
* Pairs seen fewer than ``min_count`` times are left to the backoff, their mass with them.
* Backoff weight of a context: (1 - sum of its pair estimates) / (1 - sum of the word estimates of
  the same words). Both sums run over all the context's pairs, so each context's estimates sum to 1.
  A context whose pairs would leave no mass counts one more event, which goes to the backoff.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _blocks as B
from . import _scratch
from ._text import END_OF_TEXT, START_OF_TEXT, Words, mix

U64 = np.uint64
_REP = U64(1 << 63)


def discounts(counts_of_counts: list[float], k: int, least: int = 1) -> np.ndarray:
    """Katz's discount ratios d[0..k] from the numbers of items with counts 1..k+1; 1 where the
    numbers give none (too few items, or a ratio outside (0, 1])."""
    d = np.ones(k + 1)
    n = [0.0, *counts_of_counts]
    if n[1] <= 0:
        return d
    common = (k + 1) * n[k + 1] / n[1]
    for r in range(least, k + 1):
        if n[r] > 0 and n[r + 1] > 0 and common < 1:
            ratio = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
            if 0 < ratio <= 1:
                d[r] = ratio
    return d


class Model(NamedTuple):
    """What all tasks share: a few numbers, whatever the corpus."""

    n: float  # training tokens
    v: float  # distinct training tokens
    texts: float  # training texts
    word_discount: np.ndarray
    word_total: float  # n, or n + 1 where no discount applies
    unseen: float  # estimate of the class of unseen words
    pair_discount: np.ndarray | None = None


def word_model(n: float, v: float, texts: float, counts: list[float], k: int) -> Model:
    d = discounts(counts, k)
    kept = n - sum((1 - d[r]) * r * counts[r - 1] for r in range(1, k + 1))
    total = n if n - kept > 1e-9 * max(n, 1) else n + 1
    return Model(n, v, texts, d, total, (total - kept) / total)


def word_estimate(count: np.ndarray, model: Model) -> np.ndarray:
    k = len(model.word_discount) - 1
    return np.where(count > 0, model.word_discount[np.minimum(count, k)] ** (count <= k) * count / model.word_total, model.unseen)


class _Tokens:
    """Words of a block with an end after each text; ``known`` are its distinct ones."""

    def __init__(self, block: B.Block):
        words = Words(block.data, block.lens)
        self.counts = np.diff(words.bounds) + 1
        self.bounds = np.concatenate([[0], np.cumsum(self.counts)])
        self.tokens = np.insert(words.hashes, words.bounds[1:], END_OF_TEXT)
        self.train = np.repeat(~block.flag, self.counts)
        self.distinct, self.at = np.unique(self.tokens, return_inverse=True)

    def uses(self) -> np.ndarray:
        return np.bincount(self.at, weights=self.train, minlength=len(self.distinct)).astype(np.uint32)


class _Pairs:
    """The block's distinct pairs whose words both occur often enough in training to be kept."""

    def __init__(self, t: _Tokens, words: np.ndarray, model: Model, min_count: int):
        self.first = np.zeros(len(t.tokens), dtype=bool)
        self.first[t.bounds[:-1]] = True
        previous = np.empty_like(t.tokens)
        previous[1:] = t.tokens[:-1]
        previous[self.first] = START_OF_TEXT
        count = words[t.at].astype(np.int64)
        context = np.empty_like(count)
        context[1:] = count[:-1]
        context[self.first] = int(model.texts)
        self.count, self.context, self.previous = count, context, previous
        self.asked = np.flatnonzero((count >= min_count) & (context >= min_count))
        # a pair with a word that training has once occurs once at most
        self.single = int(np.count_nonzero(t.train & (np.minimum(count, context) == 1))) if min_count > 1 else 0
        key = mix(previous[self.asked] * U64(0xA0761D6478BD642F) + mix(t.tokens[self.asked]))
        self.keys, self.head, self.at = np.unique(key, return_index=True, return_inverse=True)
        self.uses = np.bincount(self.at, weights=t.train[self.asked], minlength=len(self.keys)).astype(np.uint32)
        if not len(self.keys):  # a key without uses carries the singles
            self.keys, self.uses = np.zeros(1, U64), np.zeros(1, np.uint32)
        self.singles = np.zeros(len(self.keys), np.uint32)
        self.singles[0] = self.single


def _count(top: int, mark: bool):
    """Sum the uses of each key; the sums are uses, keys with uses, and keys with 1..top uses."""

    def answer(keys: np.ndarray, extra: list[np.ndarray], source: np.ndarray) -> tuple[np.ndarray, list]:
        order = np.argsort(keys, kind="stable")
        new = np.append(True, keys[order][1:] != keys[order][:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=extra[0][order]).astype(np.int64)
        spread = total[group].astype(U64)
        if mark:
            spread |= np.where(new, _REP, U64(0))
        out = np.empty(len(keys), U64)
        out[order] = spread
        times = [float(np.count_nonzero(total == r)) for r in range(1, top + 1)]
        if mark:
            times[0] += float(extra[1].sum(dtype=np.int64))
        return out, [float(total.sum()), float(np.count_nonzero(total)), *times]

    return answer


def _backoffs(keys: np.ndarray, extra: list[np.ndarray], source: np.ndarray) -> tuple[np.ndarray, list]:
    """The backoff weight of each context, negative where it counts one more event."""
    kept, below, seen = extra
    order = np.argsort(keys, kind="stable")
    group = np.cumsum(np.append(True, keys[order][1:] != keys[order][:-1])) - 1
    kept, below = (np.bincount(group, weights=x[order])[group] for x in (kept, below))
    seen = seen[order].astype(np.float64)
    more = seen - kept <= 1e-9 * seen
    total = seen + more
    weight = np.where(kept > 0, (total - kept) / total / np.maximum(1 - below, 1e-300), 1)
    out = np.empty(len(keys))
    out[order] = np.where(more, -weight, weight)
    return out, []


class _Contexts:
    """The block's distinct contexts that can have kept pairs, and what its own pairs add to them."""

    def __init__(self, pairs: _Pairs, answer: np.ndarray | None, model: Model, min_count: int):
        self.rows = np.flatnonzero(pairs.context >= min_count)
        self.keys, head, self.at = np.unique(mix(pairs.previous[self.rows]), return_index=True, return_inverse=True)
        self.seen = pairs.context[self.rows[head]].astype(np.uint32)
        if answer is None:
            return
        uses, speaks = (answer & ~_REP).astype(np.int64), answer >= _REP
        k = len(model.pair_discount) - 1
        mine = np.flatnonzero(speaks & (uses >= min_count))
        token = pairs.asked[pairs.head[mine]]
        where = np.searchsorted(self.keys, mix(pairs.previous[token]))
        r = uses[mine]
        self.kept = np.bincount(where, weights=r * np.where(r <= k, model.pair_discount[np.minimum(r, k)], 1), minlength=len(self.keys))
        self.words = np.bincount(where, weights=word_estimate(pairs.count[token], model), minlength=len(self.keys))


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: object = None, k: int = 5, min_count: int = 2) -> DataFrame:
    """Per row of ``docs``: (doc_id, held_out, n_tokens, n_known, train_tokens, distinct_tokens,
    base_score, score), both scores log10 probabilities of the whole text with its end.

    ``held_out`` is a boolean column: rows where it is true (or null) are scored only. ``base_score`` is the
    add-0.1 unigram estimate. Null text counts as empty: its only token is the end. Repeated rows
    all count. Null ids stay null. Without training rows every estimate is that of the unseen class.
    """
    spark = docs.sparkSession
    flag = F.coalesce(F.lit(False) if held_out is None else held_out, F.lit(True))
    blocks, n_bytes = B.block_table(docs, id_col, text_col, flag)
    buckets = _scratch.partitions_for(spark, n_bytes)
    texts = blocks.select(F.sum(F.size(F.filter("flag", lambda x: ~x)))).first()[0] or 0

    def words_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.each_block(batches):
            t = _Tokens(block)
            yield from B.sent_rows(block.bid, t.distinct, [t.uses()], buckets)

    words, rows = B.exchange(blocks.mapInArrow(words_out, B.SENT_SCHEMA), buckets, [np.uint32], _count(k + 1, False), "words")
    n, v, *counts = B.summed(spark, rows, k + 3)
    base = word_model(n, v, float(texts), counts, k)

    def pairs_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of = B.Answers(words, U64)

        def one(block: B.Block) -> Iterator[pa.RecordBatch]:
            p = _Pairs(_Tokens(block), words_of.of(block.bid), base, min_count)
            yield from B.sent_rows(block.bid, p.keys, [p.uses, p.singles], buckets)

        for block in B.each_block(batches):
            yield from one(block)

    pairs, rows = B.exchange(blocks.mapInArrow(pairs_out, B.SENT_SCHEMA), buckets, [np.uint32, np.uint32], _count(k + 1, True), "pairs")
    _, _, *counts = B.summed(spark, rows, k + 3)
    model = base._replace(pair_discount=discounts(counts, k, min_count))

    def masses_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, pairs_of = B.Answers(words, U64), B.Answers(pairs, U64)

        def one(block: B.Block) -> Iterator[pa.RecordBatch]:
            p = _Pairs(_Tokens(block), words_of.of(block.bid), model, min_count)
            c = _Contexts(p, pairs_of.of(block.bid), model, min_count)
            yield from B.sent_rows(block.bid, c.keys, [c.kept, c.words, c.seen], buckets)

        for block in B.each_block(batches):
            yield from one(block)

    backoffs, _ = B.exchange(blocks.mapInArrow(masses_out, B.SENT_SCHEMA), buckets, [np.float64, np.float64, np.uint32], _backoffs, "backoffs")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words_of, pairs_of, backoffs_of = B.Answers(words, U64), B.Answers(pairs, U64), B.Answers(backoffs, np.float64)

        def one(block: B.Block) -> pa.RecordBatch:
            t = _Tokens(block)
            p = _Pairs(t, words_of.of(block.bid), model, min_count)
            estimate = word_estimate(p.count, model)
            c = _Contexts(p, None, model, min_count)
            weight = backoffs_of.of(block.bid)[c.at]
            events = p.context.astype(np.float64)
            events[c.rows] += weight < 0  # leaves mass to the backoff
            estimate[c.rows] *= np.abs(weight)
            r = np.zeros(len(t.tokens), np.int64)
            r[p.asked] = (pairs_of.of(block.bid) & ~_REP)[p.at].astype(np.int64)
            have = np.flatnonzero(r >= min_count)
            estimate[have] = r[have] * np.where(r[have] <= k, model.pair_discount[np.minimum(r[have], k)], 1) / events[have]
            plain = np.log10((p.count + 0.1) / (model.n + 0.1 * (model.v + 1)))
            total_of = lambda x: np.add.reduceat(x, t.bounds[:-1])
            return pa.RecordBatch.from_arrays(
                [block.doc_id.cast(pa.int64()), pa.array(block.flag), pa.array(t.counts.astype(np.int64)), pa.array(total_of((p.count > 0).astype(np.int64))),
                 pa.array(np.full(len(t.counts), int(model.n))), pa.array(np.full(len(t.counts), int(model.v))), pa.array(total_of(plain)), pa.array(total_of(np.log10(estimate)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "distinct_tokens", "base_score", "score"],
            )

        for block in B.each_block(batches):
            yield one(block)

    return blocks.mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, distinct_tokens long, base_score double, score double")
