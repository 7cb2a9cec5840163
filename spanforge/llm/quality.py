"""Quality classifier by Bradley-Terry pairwise ranking.

A document's strength is linear in indicator features of its text. The weights are learned from
preference pairs (a good text, a bad text) by logistic loss on the difference of their features: all pairs of all
labelled rows. A row's pairs enter by the histogram of the other label's scores, so a Newton step is two
passes that sum over rows. Bin edges are exact quantiles of all labelled rows. A
threshold at the score quantile that leaves the training share of good texts above it turns strengths
into verdicts; strengths map to scores so that the threshold is at ``cut``.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _scratch
from ._text import PIECE_BYTES, Words

#: The loss of all pairs counts as that of so many, against the ridge term.
PAIRS = 30_000
BINS = 10
CLASSES = ("A-Z", "a-z", "0-9", " ", "\n", ".,;:", "!?", "#*$%&|<>@^~=+_{}[]\\", "|", "'\"()-")
FEATURES = 10 + len(CLASSES) + 1
SEED = 17
#: Scores' histograms: bins a unit, and the score beyond which all count as in the last bin; bins of the curvature's cross terms are wider.
FINE, FAR, COARSE = 16, 64, 4
#: Tasks that sum up over the labelled rows; each returns about 1 MB.
TASKS = 64


def _tables() -> list[np.ndarray]:
    out = []
    for c in CLASSES:
        t = np.zeros(256, dtype=np.uint8)
        if len(c) == 3 and c[1] == "-":
            t[ord(c[0]) : ord(c[2]) + 1] = 1
        else:
            t[[ord(x) for x in c]] = 1
        out.append(t)
    high = np.zeros(256, dtype=np.uint8)
    high[0xC0:] = 1
    return [*out, high]


_TABLES = _tables()


def features(texts: list[bytes]) -> np.ndarray:
    """Numbers that describe each text's form; all 0 for an empty text."""
    lens = np.array([len(x) for x in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(x + b" " for x in texts), dtype=np.uint8)
    out = np.zeros((len(texts), FEATURES), dtype=np.float32)
    if not len(texts):
        return out
    words = Words(data, lens)
    n = np.diff(words.bounds)
    size = np.maximum(lens, 1)
    first = words.offsets[:-1]
    for j, table in enumerate(_TABLES):
        out[:, j] = np.add.reduceat(table[data], first, dtype=np.int64) / size
    out[:, 3] -= 1 / size  # the space after each text
    owner = np.repeat(np.arange(len(texts)), n)
    order = np.lexsort((words.hashes, owner))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (words.hashes[order][1:] != words.hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order], weights=new, minlength=len(texts))
    head = np.flatnonzero(new)
    runs = np.diff(np.append(head, len(order)))
    top = np.zeros(len(texts))
    np.maximum.at(top, owner[order][head], runs)
    again = np.zeros(len(owner), dtype=bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (owner[1:] == owner[:-1])
    many = np.maximum(n, 1)
    lines = np.array([[len(s := x.split(b"\n")), len(set(s)), sum(y.rstrip()[-1:] in (b".", b"!", b"?") for y in s)] for x in texts], dtype=np.float64)
    k = len(_TABLES)
    for j, x in enumerate((np.log1p(n), lens / many, distinct / many, top / many, np.bincount(owner, weights=again, minlength=len(texts)) / many, np.log1p(lines[:, 0]), lines[:, 1] / lines[:, 0], lines[:, 2] / lines[:, 0], n / lines[:, 0], np.log1p(top))):
        out[:, k + j] = x
    out[lens == 0] = 0
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        held, size, start = [], 0, 0
        texts = batch.column(1)
        for i in range(batch.num_rows):
            held.append(texts[i].as_py() or b"")
            size += len(held[-1])
            if size >= PIECE_BYTES or i == batch.num_rows - 1:
                x = features(held)
                cells = pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * FEATURES), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(held)), cells], names=["doc_id", "x"])
                held, size, start = [], 0, i + 1


class Ranker(NamedTuple):
    edges: np.ndarray  # FEATURES x (BINS - 1)
    weights: np.ndarray
    threshold: float
    slope: float
    cut: float

    def indicators(self, x: np.ndarray) -> np.ndarray:
        """For each feature and bin edge, whether the value reaches it."""
        return (x[:, :, None] >= self.edges[None]).reshape(len(x), self.edges.size).astype(np.float64)

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = self.slope * (self.indicators(x) @ self.weights - self.threshold) + np.log(self.cut / (1 - self.cut))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, times: np.ndarray, ridge: float, steps: int = 12) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression without intercept over rows that count so often, by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (times * (y - p)) - ridge * w
        h = (x * (times * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _order_keys(x: np.ndarray) -> np.ndarray:
    """32-bit integers in the order of floats."""
    u = (x.astype(np.float32) + np.float32(0)).view(np.uint32)
    return np.where(u >> 31, ~u, u | np.uint32(1 << 31)).astype(np.int64)


def _from_keys(keys: np.ndarray) -> np.ndarray:
    u = keys.astype(np.uint32)
    return np.where(u >> 31, u & np.uint32((1 << 31) - 1), ~u).astype(np.uint32).view(np.float32)


def _select(total, values, ranks: np.ndarray) -> np.ndarray:
    """Exact order statistics over all rows: of column j of ``values(x, label)`` (rows not to count are NaN) those of ``ranks[j]``, digit by digit."""
    prefix, left = np.zeros(ranks.shape, np.int64), ranks.astype(np.int64).copy()
    for shift in (24, 16, 8, 0):
        known = prefix >> (shift + 8)

        def count(x: np.ndarray, label: np.ndarray, shift: int = shift, known: np.ndarray = known) -> np.ndarray:
            v = values(x, label)
            out = np.zeros((*ranks.shape, 256))
            for j in range(ranks.shape[0]):
                keys = _order_keys(v[~np.isnan(v[:, j]), j])
                for k in range(ranks.shape[1]):
                    out[j, k] = np.bincount((keys[keys >> (shift + 8) == known[j, k]] >> shift) & 255, minlength=256)
            return out

        running = np.cumsum(total(count), axis=-1)
        digit = np.minimum((running <= left[..., None]).sum(axis=-1), 255)
        left -= np.where(digit > 0, np.take_along_axis(running, np.maximum(digit - 1, 0)[..., None], -1)[..., 0], 0).astype(np.int64)
        prefix |= digit << shift
    return _from_keys(prefix)


def _bin(s: np.ndarray, fine: int) -> np.ndarray:
    return np.rint((np.clip(s, -FAR, FAR) + FAR) * fine).astype(np.int64)


def _learn(total, cut: float) -> Ranker | None:
    """The model of all rows; ``total(f)`` sums the arrays f(x, label) over parts of them. None without both labels."""
    counts = total(lambda x, label: np.array([np.sum(label == 0), np.sum(label == 1)], np.float64)).astype(np.int64)
    n_bad, n_good = int(counts[0]), int(counts[1])
    if not n_good or not n_bad:
        return None
    at = lambda n, qs: np.floor((n - 1) * np.asarray(qs) + 0.5)
    edges = _select(total, lambda x, label: x[label >= 0], np.tile(at(n_bad + n_good, np.arange(1, BINS) / BINS), (FEATURES, 1)))
    extreme = _select(total, lambda x, label: x[label == 0], np.tile(at(n_bad, [0.02, 0.98]), (FEATURES, 1)))  # where only bad texts are
    edges = np.sort(np.concatenate([edges, extreme], axis=1), axis=1)
    model = Ranker(edges, np.zeros(edges.size), 0.0, 1.0, cut)
    w = np.zeros(edges.size)
    scale = PAIRS / n_good / n_bad
    logistic = lambda t: 1 / (1 + np.exp(np.clip(t, -40, 40)))
    nodes, wide = np.arange(2 * FAR * FINE + 1) / FINE - FAR, np.arange(2 * FAR * COARSE + 1) / COARSE - FAR

    def histogram(x: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Each score counts for the nodes beside it, by its distance, so that counts change steadily with the weights."""
        place = (np.clip(model.indicators(x) @ w, -FAR, FAR) + FAR) * FINE
        at = np.minimum(place.astype(np.int64), len(nodes) - 2)
        share = place - at
        spread = lambda y: np.bincount(at[y], 1 - share[y], len(nodes)) + np.bincount(at[y] + 1, share[y], len(nodes))
        return np.stack([spread(label == 0), spread(label == 1)])

    for _ in range(25):  # Newton steps on the loss log(1 + exp(-w.(x_good - x_bad))) of all pairs
        bad, good = total(histogram)
        worse = logistic(nodes[:, None] - nodes) * scale  # of a good row's score and a bad one's
        pull = np.stack([good @ worse, worse @ bad])  # of a bad row, of a good one, by its score
        low, high = (np.bincount(_bin(nodes, COARSE), weights=c, minlength=len(wide)) for c in (bad, good))
        p = logistic(wide[:, None] - wide)
        curve = np.maximum(p * (1 - p), 1e-6) * scale
        bend = np.stack([high @ curve, curve @ low])

        def sums(x: np.ndarray, label: np.ndarray) -> np.ndarray:
            z = model.indicators(x)
            s = z @ w
            k = len(w)
            out = np.zeros((k + 1 + 2 * len(wide), k))
            for y in (0, 1):
                part, t = z[label == y], s[label == y]
                out[k] += (2 * y - 1) * (np.interp(t, nodes, pull[y]) @ part)
                b = _bin(nodes[_bin(t, FINE)], COARSE)
                out[:k] += (part * bend[y][b][:, None]).T @ part
                np.add.at(out[k + 1 + y * len(wide) : k + 1 + (y + 1) * len(wide)], b, part)
            return out

        got = total(sums)
        k = len(w)
        cross = got[k + 1 + len(wide) :].T @ curve @ got[k + 1 : k + 1 + len(wide)]
        step = np.linalg.solve(got[:k] - cross - cross.T + 20 * np.eye(k), got[k] - 0.5 * w * 20)
        w = np.rint((w + step) * 2**17) / 2**17  # so that scores are exact sums, whatever the order of rows and tasks
        if np.abs(step).max() < 1e-3:
            break
    threshold = float(_select(total, lambda x, label: (model.indicators(x) @ w)[label >= 0][:, None], np.array([[n_bad]]))[0, 0])
    bad, good = total(histogram)
    s = np.concatenate([nodes, nodes]) - threshold
    y = np.repeat([0.0, 1.0], len(nodes))
    slope = float(_logistic(np.stack([s, np.ones(len(s))], axis=1), y, np.concatenate([bad, good]), 1e-3)[0])
    return Ranker(edges, w, threshold, max(slope, 1e-3), cut)


CHUNK = 4096


def _chunked(f, x: np.ndarray, label: np.ndarray) -> np.ndarray:
    return sum(f(x[i : i + CHUNK], label[i : i + CHUNK]) for i in range(0, max(1, len(x)), CHUNK))


def fit(x: np.ndarray, label: np.ndarray, cut: float) -> Ranker | None:
    """Learn from rows and their labels (0 or 1, others don't count); None without both labels."""
    return _learn(lambda f: _chunked(f, x, label), cut)


def _total(rows: DataFrame):
    """Sums over a table (x, label), made by its tasks."""

    def total(f) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = None
            for batch in batches:
                x = batch.column(0).flatten().to_numpy().reshape(-1, FEATURES)
                got = _chunked(f, x, batch.column(1).to_numpy())
                out = got if out is None else out + got
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array([out.astype(np.float64).tobytes()], pa.binary())], names=["sums"])

        empty = f(np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int32))
        out = np.zeros(empty.shape)
        for part in rows.mapInArrow(run, "sums binary").collect():
            out += np.frombuffer(bytes(part.sums)).reshape(out.shape)
        return out

    return total


def rank(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.3) -> DataFrame:
    """Per row of ``docs``: (doc_id, held_out, score, predicted).

    Labels of rows where ``held_out`` is true, null labels and labels of unknown ids are not learned
    from. ``score`` is at least ``cut`` where the strength reaches the quantile threshold; ``predicted`` tells.
    Null text counts as empty. Without labels of both kinds every score is 0.5. Ids may
    repeat (a repeated labelled row counts as often) or be null.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    described = _scratch.stored(text.mapInArrow(_describe, "doc_id long, x array<float>"), "features")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(~held_out)
    rows = _scratch.stored(described.join(known, "doc_id").select("x", "label"), "labelled")
    model = _learn(_total(rows.coalesce(TASKS)), cut)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2).flatten().to_numpy().reshape(-1, FEATURES)
            s = np.full(len(cells), 0.5) if model is None else np.concatenate([np.empty(0), *(model.scores(cells[i : i + 2048]) for i in range(0, len(cells), 2048))])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return described.select("doc_id", held_out.alias("held_out"), "x").mapInArrow(score, "doc_id long, held_out boolean, score double, predicted int")
