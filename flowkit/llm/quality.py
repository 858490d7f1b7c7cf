"""Quality: random-indexing word vectors, pooled per document, and a two-layer network.

Random indexing (Kanerva, Kristoferson and Holst 2000): every unit has a fixed
sparse ternary index vector, and a unit's word vector is the sum of the index
vectors of its neighbours over the whole corpus. Units are hashed words and
hashed word ends. The vectors are summed in Spark over all documents into a
table of fixed size. A document is the mean of its word vectors, the spread of
its index vectors (how much it repeats itself) and its length; a two-layer
network, fitted on a bounded sample, gives a probability, whose temperature is
calibrated on training rows left out of the fit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import labelled_sample, row_weights
from .words import U64, mix, slabs, words

UNITS, DIM, NONZERO, ENDS, HIDDEN = 1 << 13, 32, 4, 3, 32
_END = ("suf", ENDS)


@lru_cache(1)
def cells() -> np.ndarray:
    """(UNITS, NONZERO): which cells of a row of 2 * DIM each unit's index vector adds one to; cells from DIM on count negatively."""
    units = np.arange(UNITS, dtype=U64)
    found = np.empty((UNITS, NONZERO), np.int64)
    for k in range(NONZERO):
        h = mix(units * U64(NONZERO) + U64(k + 1))
        found[:, k] = (h % U64(DIM)).astype(np.int64) + DIM * (h >> U64(63) == 0)
    return found


def index_vectors() -> np.ndarray:
    """The ternary index vector of every unit, from a hash of its number."""
    out = np.zeros((UNITS, 2 * DIM), np.float32)
    for k in range(NONZERO):
        out[np.arange(UNITS), cells()[:, k]] += 1
    return out[:, :DIM] - out[:, DIM:]


def _units(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit of each word, unit of each word's end, first word of each text."""
    w = words(buf, bounds, affixes=(_END,))
    half = U64(UNITS // 2)
    return (w.hash % half).astype(np.int64), (w.affix[_END] % half + half).astype(np.int64), w.first


#: Pairs of neighbours whose index vectors are summed at once.
PAIRS = 1 << 18


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts -> (unit, v0 ..): the sums of this partition."""
    sums, waiting, count = np.zeros(UNITS * 2 * DIM, np.int64), [], 0

    def add() -> None:
        unit, context = (np.concatenate(x) for x in zip(*waiting, strict=True))
        for k in range(NONZERO):
            sums[:] += np.bincount(unit * (2 * DIM) + cells()[context, k], minlength=len(sums))
        waiting.clear()

    for batch in batches:
        for _, _, buf, bounds in slabs(batch.column(0)):
            whole, end, first = _units(buf, bounds)
            inside = np.ones(max(len(whole) - 1, 0), bool)
            cuts = first[1:-1]
            inside[cuts[(cuts > 0) & (cuts < len(whole))] - 1] = False
            at = np.flatnonzero(inside)
            for here, there in ((at, at + 1), (at + 1, at)):
                waiting += (whole[here], end[there]), (end[here], end[there])
                count += 2 * len(at)
            if count > PAIRS:
                add()
                count = 0
    if waiting:
        add()
    table = sums.reshape(UNITS, 2 * DIM)
    table = (table[:, :DIM] - table[:, DIM:]).astype(float)
    some = np.flatnonzero(np.abs(table).sum(1))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), *(pa.array(table[some, d]) for d in range(DIM))], ["unit", *(f"v{d}" for d in range(DIM))])


def word_vectors(docs: DataFrame, text_column: str = "text") -> np.ndarray:
    """The unit vectors, each of length 1, summed over all texts; a table of UNITS by DIM whatever the corpus."""
    columns = [f"v{d}" for d in range(DIM)]
    parts = docs.select(text_column).mapInArrow(_gathered, f"unit int, {', '.join(c + ' double' for c in columns)}")
    found = parts.groupBy("unit").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
    table = np.zeros((UNITS, DIM), np.float32)
    if found.num_rows:
        rows = np.stack([found[c].to_numpy() for c in columns], 1)
        table[found["unit"].to_numpy()] = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    return table


@dataclass
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, texts: pa.Array) -> np.ndarray:
        z = self.logits(pooled(texts, self.vectors)) / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


#: Texts whose units are counted at once.
TEXTS = 128


def pooled(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(texts, 2 * DIM + 3) features."""
    out, half = [np.zeros((0, 2 * DIM + 3))], UNITS // 2
    both = np.concatenate([vectors, index_vectors()], 1)
    for _, _, buf, bounds in slabs(texts):
        whole, end, first = _units(buf, bounds)
        for lo in range(0, len(bounds) - 1, TEXTS):
            cuts = first[lo : lo + TEXTS + 1]
            n = np.diff(cuts)
            owner = np.repeat(np.arange(len(n)) * half, n)
            sums = []
            # a text's sum of vectors is its count of each unit times the table
            for unit, shift in ((whole, 0), (end, half)):
                counts = np.bincount(owner + unit[cuts[0] : cuts[-1]] - shift, minlength=len(n) * half)
                sums.append(counts.astype(np.float32).reshape(len(n), half) @ both[shift : shift + half] / np.maximum(n, 1)[:, None])
            spread = [np.log((s[:, DIM:] ** 2).sum(1) / NONZERO + 1e-4) for s in sums]
            out.append(np.column_stack([sums[0][:, :DIM], sums[1][:, :DIM], *spread, np.log1p(n)]))
    return np.concatenate(out)


def _adam(params: list[np.ndarray], gradients, steps: int, rate: float) -> None:
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, m, v in zip(params, gradients(), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def fit(rows: pa.Table, sizes: dict[int, int], vectors: np.ndarray, steps: int = 1500, seed: int = 3) -> Model:
    """Fitted on (text, y, part); parts 0 and 1 calibrate the temperature. Without two classes, the score is the share of ones."""
    x, y = pooled(rows["text"].combine_chunks() if rows.num_rows else pa.array([], pa.string()), vectors), np.asarray(rows["y"].to_numpy(), np.int64)
    rng = np.random.default_rng(seed)
    width = 2 * DIM + 3
    if len(set(y.tolist())) < 2:
        return Model(vectors, np.zeros(width), np.ones(width), np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 4.0 if len(y) and y[0] else -4.0 if len(y) else 0.0)
    part, weight = rows["part"].to_numpy(), row_weights(y, sizes)
    train = part > 1
    train = train if len(set(y[train].tolist())) == 2 else np.ones(len(y), bool)
    held = part <= 1 if (part <= 1).any() else train
    mean, scale = x[train].mean(0), x[train].std(0) + 1e-6
    a, t, w = (x[train] - mean) / scale, y[train], weight[train] / weight[train].sum()
    w1, b1 = rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)

    def gradients():
        h = np.tanh(a @ w1 + b1)
        g = w * (1 / (1 + np.exp(-np.clip(h @ w2 + b2, -40, 40))) - t)
        back = g[:, None] * w2 * (1 - h * h)
        return a.T @ back + 1e-4 * w1, back.sum(0), h.T @ g + 1e-4 * w2, np.array([g.sum()])

    _adam([w1, b1, w2, b2], gradients, steps, 0.01)
    model = Model(vectors, mean, scale, w1, b1, w2, float(b2[0]))
    z, t, w = model.logits(x[held]), y[held], weight[held]
    grid = np.exp(np.linspace(-2, 3, 101))
    model.temperature = float(min(grid, key=lambda k: (w * np.logaddexp(0, np.where(t == 1, -z, z) / k)).sum()))
    return model


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality") -> Model:
    """Word vectors over all of ``docs`` and a network fitted on a bounded sample of its labelled rows."""
    return fit(*labelled_sample(docs, labels, label, learn), word_vectors(docs))


def score(model: Model):
    """Column function: text -> quality from 0 to 1; null and empty texts are scored as having no words."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(texts), pa.float64())

    return score
