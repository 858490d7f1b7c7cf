"""Toxicity: a convolutional text classifier in numpy.

A word's embedding is the sum of trained embeddings of its hash and of the
hashes of its ends of several lengths, so that forms of a stem that training
never met are known by their beginning. Filters one, two and three words wide
run over the whole text, their largest answers feed a logistic output. The
decision threshold is calibrated for each language on training rows left out
of the fit (a missed toxic text weighs as MISS false alarms), and moved to 0.5; the language is guessed from function words of
the text itself. Training reads a bounded sample; scoring reads whole texts in
blocks of bounded size.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .samples import labelled_sample, row_weights
from .words import U64, mix, slabs, words

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
AFFIXES = (("pre", 4), ("pre", 5), ("pre", 6), ("suf", 5))
#: False alarms that weigh as much as one missed toxic text when thresholds are set.
MISS = 3.0
REACH = max(WIDTHS) - 1
PAD = REACH + 1
# Function words by which a language is guessed.
FUNCTION_WORDS = {"en": "the and of to in is that for with this", "fr": "le la les des et un une que qui dans", "de": "der die und das ein ist von mit für auf", "es": "el los las y una por con del se para"}


def _hashes(text: str) -> np.ndarray:
    buf = np.frombuffer(text.encode(), np.uint8)
    return words(buf, np.array([0, len(buf)]), lower=True).hash


_LANGUAGE_WORDS = [np.sort(_hashes(x)) for x in FUNCTION_WORDS.values()]


def _inputs(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature ids per position (each text followed by PAD empty ones), text starts and the end, language per text.

    Windows may begin at a text's words and at its first empty position; the
    last REACH positions of a text would reach into the next one.
    """
    w = words(buf, bounds, lower=True, affixes=AFFIXES)
    n = len(bounds) - 1
    counts = np.diff(w.first)
    starts = w.first[:-1] + PAD * np.arange(n)
    ids = np.full((len(w.hash) + PAD * n + REACH, 1 + len(AFFIXES)), BUCKETS, np.int32)
    at = np.arange(len(w.hash)) + PAD * np.repeat(np.arange(n), counts)
    for k, h in enumerate((w.hash, *w.affix.values())):
        ids[at, k] = mix(h + U64(k)) >> U64(48)
    owner = np.repeat(np.arange(n), counts)
    hits = np.zeros((n, len(_LANGUAGE_WORDS) + 1))
    hits[:, -1] = 0.5  # none of them
    for k, known in enumerate(_LANGUAGE_WORDS):
        hits[:, k] = np.bincount(owner[np.isin(w.hash, known)], minlength=n)
    return ids, np.append(starts, len(w.hash) + PAD * n), hits.argmax(1)


@dataclass
class Network:
    table: np.ndarray
    filters: list[np.ndarray]  # per width: (width, DIM, FILTERS)
    bias: np.ndarray  # all filters
    out: np.ndarray
    shift: float = 0.0
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(len(FUNCTION_WORDS) + 1))

    @classmethod
    def new(cls, seed: int = 5) -> Network:
        """Small random embeddings; the first dimension is what filters listen to at first, for and against."""
        rng = np.random.default_rng(seed)
        table = rng.normal(0, 0.02, (BUCKETS + 1, DIM)).astype(np.float32)
        table[-1] = 0
        filters = [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in filters:
            f[:, 0] = 1 / len(f)
        n = FILTERS * len(WIDTHS)
        return cls(table, filters, np.zeros(n, np.float32), np.abs(rng.normal(0, 0.3, n)).astype(np.float32))

    def listen(self, batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Begin with the smoothed log odds of each hash among toxic and other texts: (ids, starts, y) of batches."""
        seen, sizes = np.zeros((2, BUCKETS + 1)), np.zeros(2)
        for ids, starts, y in batches:
            for a, b, t in zip(starts[:-1], starts[1:], y, strict=True):
                seen[t, np.unique(ids[a:b])] += 1
                sizes[t] += 1
        odds = np.log((seen[1] + 5) / (seen[0] * sizes[1] / sizes[0] + 5))
        self.table[:-1, 0] += odds[:-1] / (1 + len(AFFIXES))

    def embedded(self, ids: np.ndarray) -> np.ndarray:
        e = self.table[ids[:, 0]]
        for k in range(1, ids.shape[1]):
            e += self.table[ids[:, k]]
        return e

    def answers(self, e: np.ndarray) -> list[np.ndarray]:
        """Per width: (positions, FILTERS)."""
        n = len(e) - REACH
        return [sum(e[j : n + j] @ f[j] for j in range(len(f))) for f in self.filters]

    def logits(self, ids: np.ndarray, starts: np.ndarray, chunk: int = 1 << 15) -> np.ndarray:
        """Per text; positions are worked through ``chunk`` at a time, so memory does not grow with a text."""
        starts, end = starts[:-1], int(starts[-1])
        pooled = np.full((len(starts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
        for lo in range(0, end, chunk):
            hi = min(end, lo + chunk)
            z = np.concatenate(self.answers(self.embedded(ids[lo : hi + REACH])), axis=1)
            a, b = np.searchsorted(starts, lo, "right") - 1, np.searchsorted(starts, hi)
            for back in range(1, REACH + 1):
                dead = np.append(starts[a + 1 : b + 1], end) - back - lo
                z[dead[(dead >= 0) & (dead < hi - lo)]] = -np.inf
            pooled[a:b] = np.maximum(pooled[a:b], np.maximum.reduceat(z, np.maximum(starts[a:b] - lo, 0), axis=0))
        return np.maximum(pooled + self.bias, 0) @ self.out + self.shift

    def scores(self, texts: pa.Array) -> np.ndarray:
        found = [np.zeros(0)]
        for _, _, buf, bounds in slabs(texts):
            ids, starts, languages = _inputs(buf, bounds)
            found.append(self.logits(ids, starts) - self.thresholds[languages])
        return 1 / (1 + np.exp(-np.clip(np.concatenate(found), -40, 40)))


def _parts(rows: pa.Table, batch: int):
    texts = rows["text"].combine_chunks()
    for lo in range(0, len(texts), batch):
        piece = texts[lo : lo + batch]
        data = list(slabs(piece, 1 << 40))
        if data:
            yield *_inputs(data[0][2], data[0][3]), slice(lo, lo + len(piece))


def _step(net: Network, ids: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray, seen: dict, rate: float) -> None:
    """One Adagrad step; only the positions that won a maximum pass gradients on."""
    e = net.embedded(ids)
    n = len(starts) - 1
    best = np.concatenate([np.stack([a + z[a : b - REACH].argmax(0) for a, b in zip(starts[:-1], starts[1:], strict=True)]) for z in net.answers(e)], axis=1)
    pooled = np.empty(best.shape, np.float32)
    for i, f in enumerate(net.filters):
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        pooled[:, cols] = sum(np.einsum("dfe,ef->df", e[best[:, cols] + j], f[j]) for j in range(len(f)))
    pooled += net.bias
    active = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.shift, -40, 40)))
    g = ((p - y) * weight / n).astype(np.float32)
    dz = g[:, None] * net.out * (pooled > 0)

    def update(name, values, grad):
        grad = grad + 1e-5 * values
        seen[name] = seen.get(name, 1e-8) + grad * grad
        return (values - rate * grad / np.sqrt(seen[name])).astype(np.float32)

    rows_at, grads = [], []
    new_filters = []
    for i, f in enumerate(net.filters):
        cols = slice(i * FILTERS, (i + 1) * FILTERS)
        df = np.empty_like(f)
        for j in range(len(f)):
            at = best[:, cols] + j
            df[j] = np.einsum("dfe,df->ef", e[at], dz[:, cols])
            rows_at.append(at.ravel())
            grads.append((dz[:, cols, None] * f[j].T[None]).reshape(-1, DIM))
        new_filters.append(update(f"f{i}", f, df))
    at, grad = np.concatenate(rows_at), np.concatenate(grads)
    some = np.abs(grad).sum(1) > 0
    at, grad = ids[at[some]], grad[some]
    cells, inverse = np.unique(at, return_inverse=True)
    total = np.zeros((len(cells), DIM), np.float32)
    np.add.at(total, inverse.reshape(at.shape), grad[:, None, :])
    history = seen.setdefault("table", np.full((BUCKETS + 1, 1), 1e-8, np.float32))
    total[cells == BUCKETS] = 0
    history[cells] += (total * total).mean(1, keepdims=True)
    net.table[cells] -= rate * total / np.sqrt(history[cells])
    net.bias, net.out = update("bias", net.bias, dz.sum(0)), update("out", net.out, active.T @ g)
    net.shift = float(update("shift", np.array([net.shift]), np.array([g.sum()]))[0])
    net.filters = new_filters


def best_threshold(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Where errors weigh least; of equal places the middle of the widest gap."""
    order = np.argsort(logit)
    z, w, t = logit[order], weight[order], y[order]
    below = np.concatenate([[0], np.cumsum(w * t)])  # toxic rows that a cut here misses
    above = np.concatenate([[0], np.cumsum(w * (1 - t))])
    cost = below + above[-1] - above
    edges = np.concatenate([[z[0] - 1], z, [z[-1] + 1]])
    gap = np.diff(edges)
    ok = np.flatnonzero(cost <= cost.min() + 1e-9)
    at = ok[gap[ok].argmax()]
    return float((edges[at] + edges[at + 1]) / 2)


def fit(rows: pa.Table, sizes: dict[int, int], epochs: int = 12, batch: int = 64, rate: float = 0.1, seed: int = 5) -> Network:
    """A network fitted on (text, y, part); part 0 and 1 calibrate. Without rows, one that rejects nothing."""
    net = Network.new(seed)
    y = np.asarray(rows["y"].to_numpy(), np.int64)
    if len(set(y.tolist())) < 2:
        net.out[:], net.shift = 0, 4.0 if len(y) and y[0] else -4.0
        return net
    part = rows["part"].to_numpy()
    train, held = np.flatnonzero(part > 1), np.flatnonzero(part <= 1)
    train = train if len(set(y[train].tolist())) == 2 else np.arange(len(y))
    weight = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-9), 0.5 / max(1 - y[train].mean(), 1e-9))
    rng, seen = np.random.default_rng(seed), {}
    order = rng.permutation(train)
    batches = [(ids, starts, order[where]) for ids, starts, _, where in _parts(rows.take(pa.array(order)), batch)]
    net.listen([(ids, starts, y[chosen]) for ids, starts, chosen in batches])
    for epoch in range(epochs):
        for i in rng.permutation(len(batches)):
            ids, starts, chosen = batches[i]
            _step(net, ids, starts, y[chosen], weight[chosen], seen, rate / (1 + epoch / 4))
    held = held if len(held) else train
    logit, language = (np.concatenate(x) for x in zip(*((net.logits(ids, starts), spoken) for ids, starts, spoken, _ in _parts(rows.take(pa.array(held)), 256)), strict=True))
    shares = (row_weights(y, sizes) * np.where(y == 1, MISS, 1))[held]
    overall = best_threshold(logit, y[held], shares)
    for k in range(len(net.thresholds)):
        own = language == k
        enough = min(y[held][own].sum(), (1 - y[held][own]).sum()) >= 20
        net.thresholds[k] = best_threshold(logit[own], y[held][own], shares[own]) if enough else overall
    return net


def fitted(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "toxic") -> Network:
    """A network fitted on a bounded sample of the labelled rows of ``docs`` for which ``learn`` holds."""
    return fit(*labelled_sample(docs, labels, label, learn))


def score(net: Network):
    """Column function: text -> toxicity from 0 to 1; null and empty texts are scored as having no words."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(net.scores(texts), pa.float64())

    return score
