"""Vectorised word and n-gram hashing over Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Hashes of short
words and of n-grams are 64-bit polynomial hashes taken from prefix sums, so the
cost per byte does not depend on the n-gram length, and long texts are worked
through in blocks. Polynomials modulo 2**64 are weak on long sequences of two
values in Thue-Morse order; so words over LONG bytes and whole texts are hashed
by BLAKE2 instead, and n-grams are meant for some dozens of words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes of texts that are worked through at once, and of those the bytes that are hashed at once.
SLAB, CHUNK = 1 << 18, 1 << 17
#: Bytes beyond which a word is hashed by BLAKE2.
LONG = 32
_BYTE_BASE = 0x9E3779B97F4A7C15
_WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


@lru_cache(4)
def _byte_values(lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=U64) * U64(_BYTE_BASE))
    if lower:
        table = table.copy()
        table[65:91] = table[97:123]
    return table


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; tables are kept up to a few MB."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 16), base, U64)
        step[0] = 1
        have = np.cumprod(step, dtype=U64)
        if len(have) <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def inverse_powers(base: int, n: int) -> np.ndarray:
    return powers(pow(base, -1, 1 << 64), n)


class Words(NamedTuple):
    hash: np.ndarray  # uint64 per word
    start: np.ndarray  # byte offsets in the slab
    end: np.ndarray
    first: np.ndarray  # per document (n + 1): index of its first word
    affix: dict  # (side, n) -> uint64 per word


def slabs(texts: pa.Array, limit: int = SLAB) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(lo, hi, bytes, offsets) of consecutive rows of about ``limit`` bytes; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def words(buf: np.ndarray, bounds: np.ndarray, lower: bool = False, affixes: tuple = ()) -> Words:
    """Words of the texts ``buf[bounds[i]:bounds[i+1]]``; affixes: ("pre" or "suf", bytes) to hash too."""
    solid = ~_SPACE[buf]
    before, after = np.zeros(len(buf), bool), np.zeros(len(buf), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    inner = bounds[(bounds > 0) & (bounds < len(buf))]
    before[inner], after[inner - 1] = False, False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    out = np.empty(len(start), U64)
    affix = {a: np.empty(len(start), U64) for a in affixes}
    values = _byte_values(lower)
    lo = 0
    while lo < len(start):
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + CHUNK)))
        a, b = int(start[lo]), int(end[hi - 1])
        sums = np.zeros(b - a + 1, U64)
        np.cumsum(values[buf[a:b]] * powers(_BYTE_BASE, b - a), out=sums[1:])
        s, e = start[lo:hi] - a, end[lo:hi] - a
        back = inverse_powers(_BYTE_BASE, b - a)
        out[lo:hi] = mix((sums[e] - sums[s]) * back[s] + (e - s).astype(U64))
        for (side, n), into in affix.items():
            s2, e2 = (s, np.minimum(s + n, e)) if side == "pre" else (np.maximum(e - n, s), e)
            into[lo:hi] = mix((sums[e2] - sums[s2]) * back[s2] + U64(n + (101 if side == "suf" else 0)))
        lo = hi
    for i in np.flatnonzero(end - start > LONG).tolist():
        word = buf[start[i] : end[i]].tobytes()
        out[i] = int.from_bytes(blake2b(word.lower() if lower else word, digest_size=8).digest(), "little")
    return Words(out, start, end, np.searchsorted(start, bounds), affix)


def grams(hashes: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of each ``n`` consecutive words, by start; documents are the caller's matter."""
    m = len(hashes)
    if m < n or not n:
        return np.zeros(0, U64)
    base = _WORD_BASES[which]
    sums = np.zeros(m + 1, U64)
    np.cumsum(hashes * powers(base, m), out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * inverse_powers(base, m)[: m - n + 1] + U64(n))


def shingle_sets(texts: pa.Array, n: int, lower: bool = True) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``n``-word shingles; shorter texts are one shingle."""
    for _, _, buf, bounds in slabs(texts):
        w = words(buf, bounds, lower)
        all_grams = grams(w.hash, n)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(all_grams[a : b - n + 1])
            elif b > a:
                yield grams(w.hash[a:b], b - a)
            else:
                yield np.zeros(0, U64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))
