"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are normalised: A-Z lower-cased, every run of other ASCII
characters that are not letters or digits made one space. An item occurs from
word border to word border: it is searched with a space on either side, in the
text with a space on either side. An item of m bytes may occur with up to k =
m/12 - 1 edits, about 8 %. It is split into k + 1 pieces of 12 bytes or more; k
edits leave one of them untouched, so each occurrence holds an exact piece. One
Aho-Corasick pass finds the pieces of a block of items in whole texts, and
Myers' bit-parallel algorithm verifies the stretch around each hit. Where many
items share a piece, those go first that lack more bytes in the stretch than
edits could change. Edits are counted in bytes of UTF-8.

The items are worked through in blocks of bounded size, one after the other,
each over all documents: its hits are written before the next block is read, so
a benchmark of any size passes through the driver, and through the workers,
only in parts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written
from .words import slabs

#: Least bytes of a piece; an edit is allowed for each piece but one.
PIECE = 12
#: Most bytes of items in one block.
BLOCK_BYTES = 8 << 20
#: Items that share a piece from which on they are sieved by their bytes.
MANY = 16
_PLAIN = np.full(256, 32, np.uint8)
_PLAIN[48:58], _PLAIN[97:123], _PLAIN[65:91], _PLAIN[128:] = np.arange(48, 58), np.arange(97, 123), np.arange(97, 123), np.arange(128, 256)


def normalised(buf: np.ndarray) -> np.ndarray:
    plain = _PLAIN[buf]
    blank = plain == 32
    keep = ~blank
    keep[1:] |= blank[1:] & ~blank[:-1]
    keep[:1] |= blank[:1]
    return plain[keep]


def budget(m: int) -> int:
    return max(0, m // PIECE - 1)


def split(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """``item`` as k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def distance(item: bytes, text: bytes, limit: int) -> tuple[int, int] | None:
    """(least distance of ``item`` to a substring of ``text``, its end), if at most ``limit`` (Myers 1999)."""
    at = text.find(item)
    if at >= 0:
        return 0, at + len(item)
    m = len(item)
    full, top = (1 << m) - 1, 1 << (m - 1)
    masks: dict[int, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    plus, minus, score, best = full, 0, m, (m, 0) if m <= limit else None
    for i, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph, mh = minus | ~(xh | plus) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        plus, minus = mh | ~(xv | ph) & full, ph & xv
        if score <= limit and (best is None or score < best[0]):
            best = score, i + 1
    return best


def distances(items: list[bytes], text: bytes, limit: np.ndarray) -> list[tuple[int, int] | None]:
    """``distance`` of many items to one text: the same recurrence, on words of 64 bits of all items at once."""
    size = np.array([len(x) for x in items])
    width = -(-int(size.max()) // 64)
    letters = np.zeros((len(items), width * 64), np.uint8)
    for row, x in zip(letters, items, strict=True):
        row[: len(x)] = np.frombuffer(x, np.uint8)
    rows, word, bit = np.arange(len(items)), (size - 1) // 64, ((size - 1) % 64).astype(np.uint64)
    one, high = np.uint64(1), np.uint64(63)
    # outside an item's own bits anything may stand: carries and shifts only go up
    plus, minus = np.full((len(items), width), ~np.uint64(0)), np.zeros((len(items), width), np.uint64)
    score, best, stop = size.copy(), size.copy(), np.zeros(len(items), np.int64)
    masks: dict[int, np.ndarray] = {}

    def raised(x: np.ndarray) -> np.ndarray:
        up = x << one
        up[:, 1:] |= x[:, :-1] >> high
        return up

    for i, c in enumerate(text):
        if c not in masks:
            masks[c] = np.packbits(letters == c, axis=1, bitorder="little").view(np.uint64)
        eq = masks[c]
        a = eq & plus
        total = a + plus
        carry = total < a
        for w in range(1, width):
            total[:, w] += carry[:, w - 1]
            carry[:, w] |= carry[:, w - 1] & (total[:, w] == 0)
        xv, xh = eq | minus, (total ^ plus) | eq
        ph, mh = minus | ~(xh | plus), plus & xh
        score += (ph[rows, word] >> bit & one).astype(np.int64) - (mh[rows, word] >> bit & one).astype(np.int64)
        ph, mh = raised(ph), raised(mh)
        plus, minus = mh | ~(xv | ph), ph & xv
        better = score < best
        best, stop = np.where(better, score, best), np.where(better, i + 1, stop)
    return [(d, e) if d <= k else None for d, e, k in zip(best.tolist(), stop.tolist(), limit.tolist(), strict=True)]


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple[int, bytes]]):
        names: dict[bytes, list[int]] = {}
        for i, x in items:
            if x.strip():
                names.setdefault(x, []).append(i)
        # equal items are searched once
        self.items = [(sorted(ids), b" " + x + b" ", budget(len(x))) for x, ids in names.items()]
        self.bytes = np.stack([_counts(x) for _, x, _ in self.items]) if self.items else np.zeros((0, 64), np.int32)
        self.size = np.array([len(x) for _, x, _ in self.items], np.int64)
        self.budget = np.array([k for _, _, k in self.items], np.int64)
        wanted: dict[bytes, list[tuple[int, int]]] = {}
        for n, (_, item, k) in enumerate(self.items):
            for at, piece in split(item, k):
                wanted.setdefault(piece, []).append((n, at))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in wanted.items():
            self.automaton.add_word(piece.decode("latin-1"), (len(piece), np.array(uses, np.int64)))
        if wanted:
            self.automaton.make_automaton()

    def find(self, text: bytes) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item that occurs: its best occurrence."""
        if not self.items:
            return []
        text = b" " + text.strip() + b" "
        stretches: dict[int, list[list[int]]] = {}
        for end, (size, uses) in self.automaton.iter(text.decode("latin-1")):
            n, at = uses[:, 0], uses[:, 1]
            lo = np.maximum(0, end + 1 - size - at - self.budget[n])
            hi = np.minimum(len(text), end + 1 - size - at + self.size[n] + self.budget[n])
            if len(n) >= MANY:
                missing = np.maximum(self.bytes[n] - _counts(text[lo.min() : hi.max()]), 0).sum(1)
                some = missing <= self.budget[n]
                n, lo, hi = n[some], lo[some], hi[some]
            for i, a, b in zip(n.tolist(), lo.tolist(), hi.tolist(), strict=True):
                last = stretches.setdefault(i, [])
                if last and a <= last[-1][1]:
                    last[-1] = [min(a, last[-1][0]), max(b, last[-1][1])]
                else:
                    last.append([a, b])
        found: dict[int, tuple[int, int]] = {}
        for batch in _nearby([(lo, hi, n) for n, spans in stretches.items() for lo, hi in spans]):
            lo, which = batch[0][0], [n for *_, n in batch]
            stretch = text[lo : max(hi for _, hi, _ in batch)]
            if len(batch) < MANY:
                got = [distance(self.items[n][1], stretch, self.items[n][2]) for n in which]
            else:
                got = distances([self.items[n][1] for n in which], stretch, self.budget[which])
            for n, d in zip(which, got, strict=True):
                if d:
                    found[n] = min(found.get(n, (len(text), 0)), (d[0], lo + d[1]))
        return sorted((i, best, max(0, stop - 2)) for n, (best, stop) in found.items() for i in self.items[n][0])


def _nearby(spans: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The stretches (begin, end, item) in batches that begin within 64 bytes and whose ends are not far apart."""
    batch: list[tuple[int, int, int]] = []
    for span in sorted(spans):
        if batch and (span[0] > batch[0][0] + 64 or not 2 * batch[0][1] - batch[0][0] >= span[1] - 64):
            yield batch
            batch = []
        batch.append(span)
    if batch:
        yield batch


def _counts(text: bytes) -> np.ndarray:
    """How often each residue of bytes modulo 64 occurs."""
    return np.bincount(np.frombuffer(text, np.uint8) & 63, minlength=64).astype(np.int32)


def _blocks(benchmark: DataFrame, id_column: str, text_column: str) -> Iterator[tuple[bool, list[tuple[int, bytes]]]]:
    """(whether it is the only one, items) of each block: normalised items of about BLOCK_BYTES, by a hash."""
    items = benchmark.select(F.col(id_column).cast("long").alias("i"), F.col(text_column).cast("string").alias("t")).filter("i is not null and t is not null")
    total = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = total // BLOCK_BYTES + 1
    for b in range(n):
        block = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b).toArrow()
        yield n == 1, [(i, normalised(np.frombuffer(t.encode(), np.uint8)).tobytes().strip()) for i, t in zip(block["i"].to_pylist(), block["t"].to_pylist(), strict=True)]


#: The matcher of the block that a worker searches, under the block's name: built once a worker.
_BUILT: dict[str, Matcher] = {}


def _matches(name: str, items: list[tuple[int, bytes]]):
    """Column function: text -> array<struct<item_id, distance, stop>> of the items of one block that occur in it."""

    @F.arrow_udf("array<struct<item_id:long,distance:int,stop:long>>")
    def matches(texts: pa.Array) -> pa.Array:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Matcher(items)
        out = []
        for _, _, buf, bounds in slabs(texts):
            for i in range(len(bounds) - 1):
                plain = normalised(buf[bounds[i] : bounds[i + 1]]).tobytes()
                out.append([{"item_id": a, "distance": d, "stop": e} for a, d, e in _BUILT[name].find(plain)])
        return pa.array(out, pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("stop", pa.int64())])))

    return matches


def matches(docs: DataFrame, benchmark: DataFrame, item_column: str = "item_id", item_text: str = "text", id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, distance, stop) of every item that occurs in a document; stop is its end in the normalised text.

    Null and empty texts hold none, and null or blank items occur nowhere. Items
    under 24 bytes must occur exactly. An item id that repeats stands for each of
    its texts. Rows that repeat a document give its items as often; other columns
    are not read. With one block of items the result is lazy, else it is read from
    what the blocks wrote.
    """
    docs = docs.select(F.col(id_column), F.col(text_column).cast("string").alias(text := free_name(docs, "searched")))
    found = []
    for alone, items in _blocks(benchmark, item_column, item_text):
        hits = docs.select(id_column, F.explode(_matches(uuid.uuid4().hex, items)(text)).alias("m")).select(id_column, "m.item_id", "m.distance", "m.stop")
        found.append(hits if alone else written(hits, "hits"))
    return reduce(DataFrame.union, found)


def clean(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The documents in which no item occurs, with all their columns; null and empty texts stay."""
    for alone, items in _blocks(benchmark, "item_id", "text"):
        docs = docs.filter(F.size(_matches(uuid.uuid4().hex, items)(F.col(text_column).cast("string"))) == 0)
        docs = docs if alone else written(docs, "clean")
    return docs
