"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before encoding, at places where the pre-splitting pattern
always ends a match: before an ASCII space or newline that follows a character
which is not white space. No match of the pattern reaches from a non-space to a
space, and its only look-ahead stays inside a run of white space, so the pieces
encode exactly as the whole text does while memory and time per call stay
bounded. A run of white space longer than a piece, on which the pattern's
look-ahead would exhaust the library's stack, is one match up to its last
character (to its end at the end of a text), and is encoded as that one match.
Decoding concatenates raw bytes, so token boundaries inside a character do no
harm.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import functions as F

PIECE = 1 << 16
# The characters of Unicode's property White_Space.
_SPACES = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@lru_cache(4)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(4)
def whole(bpe: tiktoken.Encoding) -> tiktoken.Encoding:
    """The same ranks, with any text one match."""
    return tiktoken.Encoding("whole", pat_str=r"[\s\S]+", mergeable_ranks=bpe._mergeable_ranks, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at safe boundaries, each at or after ``size`` characters."""
    out, lo = [], 0
    while len(text) - lo > size:
        at = lo + size
        while at < len(text) and not (text[at] in " \n" and not text[at - 1].isspace()):
            at += 1
        out.append(text[lo:at])
        lo = at
    return [*out, text[lo:]]


def parts(text: str, size: int = PIECE) -> Iterator[tuple[bool, str]]:
    """``text`` in parts that encode separately: (True, one match of white space) or (False, a piece to split by the pattern)."""
    lo = 0
    for run in re.finditer(f"{_SPACES}{{{size + 1},}}", text):
        if run.start() > lo:
            yield from ((False, x) for x in pieces(text[lo : run.start()], size))
        lo = run.end() - (run.end() < len(text))  # the last blank may belong to the word behind it
        yield True, text[run.start() : lo]
    if lo < len(text):
        yield from ((False, x) for x in pieces(text[lo:], size))


def token_ids(bpe: tiktoken.Encoding, text: str, size: int = PIECE) -> np.ndarray:
    """The ids of a text as little-endian 32-bit integers; special-token strings are ordinary text."""
    if len(text) <= size:
        return np.array(bpe.encode_ordinary(text), "<u4")
    found = [np.array((whole(bpe) if one else bpe).encode_ordinary(x), "<u4") for one, x in parts(text, size)]
    return np.concatenate(found)


def encode(path: str, pattern: str, size: int = PIECE):
    """Column function: text -> struct<n_tokens: long, ids: binary>. A null or empty text has no tokens."""

    @F.arrow_udf("struct<n_tokens:long,ids:binary>")
    def encode(texts: pa.Array) -> pa.Array:
        bpe = encoding(path, pattern)
        ids = [token_ids(bpe, x.as_py() or "", size) for x in texts]
        return pa.StructArray.from_arrays([pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], ["n_tokens", "ids"])

    return encode


def round_trip(path: str, pattern: str, size: int = PIECE):
    """Column function: text -> struct<n_tokens, ids, decoded>: ``encode`` and ``decode`` in one pass, with one set of workers."""

    @F.arrow_udf("struct<n_tokens:long,ids:binary,decoded:binary>")
    def round_trip(texts: pa.Array) -> pa.Array:
        bpe = encoding(path, pattern)
        counts, ids, decoded = [], [], []
        for x in texts:
            found = token_ids(bpe, x.as_py() or "", size)
            counts.append(len(found))
            ids.append(found.tobytes())
            decoded.append(bpe.decode_bytes(np.frombuffer(ids[-1], "<u4").tolist()))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["n_tokens", "ids", "decoded"])

    return round_trip


def decode(path: str, pattern: str):
    """Column function: ids (as from ``encode``) -> the bytes of their tokens; null: no bytes."""

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        bpe = encoding(path, pattern)
        return pa.array([bpe.decode_bytes(np.frombuffer(x.as_buffer(), "<u4").tolist()) if x.is_valid else b"" for x in ids], pa.binary())

    return decode
