"""Dedup of repeated byte strings by sparse suffix arrays.

A string of SPAN bytes counts as repeated if it starts at two places or more,
of one document or of several. Of every SPAN-byte window the minimizer is the
hash of its least K-byte gram, so equal windows have theirs at the same offset.
Consecutive windows with one minimizer form a segment; only segments of the
same minimizer can share a window. Equal segments are counted as one. Where a
minimizer has several segments, two suffix arrays are made of them, of what
follows the minimizer's start and of what precedes it read backwards, by
deep-shallow sorting (``suffixes``). A window that begins o bytes before the
minimizer is repeated if another segment shares at least o bytes backwards and
SPAN - o bytes forwards: suffixes that do so are neighbours in both arrays, so
one running count over common prefixes gives the classes of each offset.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_keys, written
from .substring import with_spans as with_spans
from .suffixes import deep_shallow
from .words import U64, inverse_powers, mix, powers, slabs

#: Distinct segments of one minimizer that are sorted in one task; of more, windows are counted one by one.
LIMIT = 4096
#: Segments that a task sorts at once, and bytes that it hashes at once.
SORTED, CHUNK = 8192, 1 << 16
#: The base of the gram hash, and bits that a position takes beside a hash.
_BASE, _PLACE = 0x9E3779B97F4A7C15, 32
_VALUES = mix(np.arange(1, 257, dtype=U64) * U64(0xD6E8FEB86659FD93))


def gram(span: int) -> int:
    """Bytes of a minimizer for windows of ``span`` bytes."""
    return max(1, span // 3)


def _grams(part: np.ndarray, k: int) -> np.ndarray:
    sums = np.zeros(len(part) + 1, U64)
    np.cumsum(_VALUES[part] * powers(_BASE, len(part)), out=sums[1:])
    return mix((sums[k:] - sums[:-k]) * inverse_powers(_BASE, len(part))[: len(part) - k + 1])


def minimizers(buf: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, position of the gram) of the minimizer of every window of ``buf``, the leftmost if grams are equal."""
    k, n = gram(span), len(buf) - span + 1
    hashes, places = np.zeros(max(n, 0), U64), np.zeros(max(n, 0), np.int64)
    mask = U64((1 << _PLACE) - 1)
    for lo in range(0, n, CHUNK):
        hi = min(lo + CHUNK, n)
        h = _grams(buf[lo : hi + span - 1], k)
        least = (h & ~mask) | np.arange(len(h), dtype=U64)
        reach, wide = 1, span - k + 1  # least[i] covers ``reach`` grams from i on
        while reach < wide:
            more = min(reach, wide - reach)
            least = np.minimum(least[: len(least) - more], least[more:])
            reach += more
        at = (least & mask).astype(np.int64)
        places[lo:hi], hashes[lo:hi] = at + lo, h[at]
    return hashes, places


def _segments(span: int):
    """(doc, text) -> (h, d, ahead, n, doc, starts): each distinct segment of a document and where it starts.

    h is the minimizer, d a 64-bit BLAKE2 hash of the bytes, n the number of
    windows, ahead the offset of the minimizer from the start.
    """

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for lo, _, buf, bounds in slabs(batch.column(1)):
                if len(buf) < span:
                    continue
                hashes, places = minimizers(buf, span)
                owner = np.searchsorted(bounds, np.arange(len(places)), "right") - 1
                inside = np.arange(len(places)) + span <= bounds[owner + 1]
                opens = inside.copy()
                opens[1:] &= (places[1:] != places[:-1]) | ~inside[:-1] | (owner[1:] != owner[:-1])
                begin = np.flatnonzero(opens)
                if not len(begin):
                    continue
                # a run ends before the next one opens or where windows leave their document
                n = np.add.reduceat(inside.astype(np.int64), begin)
                doc, raw = owner[begin], buf.tobytes()
                digest = np.frombuffer(b"".join(blake2b(raw[a : a + m + span - 1], digest_size=8).digest() for a, m in zip(begin.tolist(), n.tolist(), strict=True)), np.int64)
                h, at = hashes[begin].view(np.int64), begin - bounds[doc]
                order = np.lexsort((at, digest, h, doc))
                h, digest, doc, at = h[order], digest[order], doc[order], at[order]
                ahead, n = (places[begin] - begin)[order], n[order]
                first = np.r_[True, (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (digest[1:] != digest[:-1])]
                f = np.flatnonzero(first)
                starts = pa.ListArray.from_arrays(pa.array(np.append(f, len(at)).astype(np.int32)), pa.array(at.astype(np.int32)))
                columns = [pa.array(h[f]), pa.array(digest[f]), pa.array(ahead[f].astype(np.int32)), pa.array(n[f].astype(np.int32)), pa.array(ids[lo + doc[f]]), starts]
                yield pa.RecordBatch.from_arrays(columns, ["h", "d", "ahead", "n", "doc", "starts"])

    return segments


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, segments: list of (h, d, ahead, at, length)) -> (h, d, ahead, bytes)."""
    for batch in batches:
        lists = batch.column(1)
        fields = dict(zip(("h", "d", "ahead", "at", "length"), lists.flatten().flatten(), strict=True))
        at, length, sizes = np.asarray(fields["at"]), np.asarray(fields["length"]), np.diff(np.asarray(lists.offsets))
        cut, i = [], 0
        for text, m in zip(batch.column(0), sizes.tolist(), strict=True):
            raw = text.as_buffer()
            cut += [raw[a : a + n].to_pybytes() for a, n in zip(at[i : i + m].tolist(), length[i : i + m].tolist(), strict=True)]
            i += m
        yield pa.RecordBatch.from_arrays([fields["h"], fields["d"], fields["ahead"], pa.array(cut, pa.binary())], ["h", "d", "ahead", "bytes"])


def _repeated(h: np.ndarray, ahead: np.ndarray, parts: list[bytes], span: int) -> np.ndarray:
    """For each segment (rows) and offset o (columns): whether its window o bytes before the minimizer is in another segment."""
    k, wide = gram(span), span - gram(span) + 1
    forward = [p[a:] for p, a in zip(parts, ahead.tolist(), strict=True)]
    backward = [p[:a][::-1] for p, a in zip(parts, ahead.tolist(), strict=True)]
    # the gram itself, not its hash, makes a group; what is sorted then follows it
    named: dict[tuple[int, bytes], int] = {}
    group = np.array([named.setdefault((x, f[:k]), len(named)) for x, f in zip(h.tolist(), forward, strict=True)], np.int64)
    right = deep_shallow([f[k:] for f in forward], group, span - k)
    left = deep_shallow(backward, group, wide - 1)
    after, before = np.array([len(f) for f in forward]), np.array([len(b) for b in backward])
    out, s = np.zeros((len(parts), wide), bool), len(parts)
    ahead_class, behind_class = np.zeros(s, np.int64), np.zeros(s, np.int64)
    for o in range(wide):
        ahead_class[right.order] = np.cumsum(right.lcp < span - o - k)
        behind_class[left.order] = np.cumsum(left.lcp < o)
        at = np.flatnonzero((before >= o) & (after >= span - o))
        if len(at) < 2:
            continue
        _, which, count = np.unique(ahead_class[at] * (s + 1) + behind_class[at], return_inverse=True, return_counts=True)
        out[at, o] = count[which] > 1
    return out


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.r_[0, flags.astype(np.int8), 0]))
    return [{"begin": int(a), "stop": int(b)} for a, b in edge.reshape(-1, 2)]


_RUNS = pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())]))


def _sorted(span: int):
    """(h, d, ahead, bytes) sorted by h -> (h, d, runs of repeated windows within the segment); groups are whole and bounded."""

    def judge(h, d, ahead, parts):
        found = _repeated(h, ahead, parts, span)
        some = np.flatnonzero(found.any(axis=1))
        runs = [_runs(found[i, : ahead[i] + 1][::-1]) for i in some.tolist()]
        return pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(d[some]), pa.array(runs, _RUNS)], ["h", "d", "runs"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for batch in batches:
            waiting += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            if len(waiting) >= SORTED:
                last = len(waiting)
                while last and waiting[last - 1][0] == waiting[-1][0]:
                    last -= 1  # the group that may go on
                if last:
                    h, d, ahead, parts = zip(*waiting[:last], strict=True)
                    yield judge(np.array(h), np.array(d), np.array(ahead), list(parts))
                    waiting = waiting[last:]
        if waiting:
            h, d, ahead, parts = zip(*waiting, strict=True)
            yield judge(np.array(h), np.array(d), np.array(ahead), list(parts))

    return sort


def _windows(span: int):
    """(h, d, bytes) -> (w: 128-bit BLAKE2 hash of a window, h, d, at), for segments of a hot minimizer."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, d = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for i, part in enumerate(batch.column(3)):
                raw = part.as_py()
                n = len(raw) - span + 1
                w = pa.array([blake2b(raw[a : a + span], digest_size=16).digest() for a in range(n)], pa.binary())
                yield pa.RecordBatch.from_arrays([w, pa.array(np.repeat(h[i], n)), pa.array(np.repeat(d[i], n)), pa.array(np.arange(n, dtype=np.int32))], ["w", "h", "d", "at"])

    return windows


def _merged():
    """Column function: byte ranges in any order -> disjoint ones in order."""

    @F.arrow_udf("array<struct<begin:int,stop:int>>")
    def merged(spans: pa.Array) -> pa.Array:
        out = []
        for x in spans:
            begin, stop = (np.asarray(f) for f in x.values.flatten())
            order = np.argsort(begin, kind="stable")
            begin, stop = begin[order], np.maximum.accumulate(stop[order])
            opens = np.flatnonzero(np.r_[True, begin[1:] > stop[:-1]])
            last = np.r_[opens[1:] - 1, len(begin) - 1]
            out.append([{"begin": int(a), "stop": int(b)} for a, b in zip(begin[opens], stop[last], strict=True)])
        return pa.array(out, _RUNS)

    return merged


def _one_row_each(docs: DataFrame) -> DataFrame:
    """(doc, text) with one row for each doc: of a repeated one the least text. Texts are shuffled only where ids do repeat."""
    repeated = docs.groupBy("doc").count().filter("count > 1").select("doc")
    if repeated.isEmpty():
        return docs
    return docs.join(repeated, "doc", "left_anti").union(docs.join(repeated, "doc", "left_semi").groupBy("doc").agg(F.min("text").alias("text")))


def repeated_bytes(docs: DataFrame, span: int = 200, id_column: str = "doc_id", text_column: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, spans: array<struct<begin, stop>>) of documents that hold repeated strings of ``span`` bytes.

    Spans are byte ranges of the UTF-8 text, disjoint, not touching and in
    order: all bytes covered by a string that starts at another place too, in
    this document or another, overlapping or not. Every copy is covered, the
    first included. Null, empty and shorter texts, empty tables and rows without
    an id have none. An id names one text: rows that repeat it are one document.
    ``span`` is 3 at least. Minimizers of more than ``limit`` distinct segments
    have the windows of those counted by 128-bit hashes in place of suffix
    arrays, so that no group in a task is larger.
    """
    if span < 3:
        raise ValueError("span must be 3 bytes or more")
    docs = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text"))
    docs = _one_row_each(docs.filter(F.col("doc").isNotNull() & (F.octet_length("text") >= span)))
    every = written(docs.mapInArrow(_segments(span), "h long, d long, ahead int, n int, doc long, starts array<int>"), "segments")
    # a hot minimizer's or segment's rows lie right below the joins, where Spark can split them; what they meet has one row a key
    recurring = written(every.groupBy("h").agg(F.sum(F.size("starts")).alias("times")).filter("times > 1").select("h"), "minimizers")
    found = written(every.join(recurring, "h"), "recurring")
    discard(every, recurring)
    distinct = found.groupBy("h", "d").agg(F.sum(F.size("starts")).alias("times"), F.min(F.struct("doc", F.element_at("starts", 1).alias("at"), "ahead", "n")).alias("x"))
    distinct = written(distinct.select("h", "d", "times", "x.*"), "distinct")
    several = written(distinct.groupBy("h").agg(F.count("*").alias("k")).filter("k > 1"), "several")
    wanted = distinct.join(several.select("h"), "h").groupBy("doc").agg(F.collect_list(F.struct("h", "d", "ahead", "at", (F.col("n") + span - 1).alias("length"))).alias("segments"))
    wanted = written(wanted, "wanted")
    some = docs.join(small_keys(wanted.select("doc")), "doc", "left_semi")
    parts = written(some.join(wanted, "doc").select("text", "segments").mapInArrow(_slices, "h long, d long, ahead int, bytes binary"), "parts")
    hot = several.filter(F.col("k") > limit).select("h")
    runs_type = "array<struct<begin:int,stop:int>>"
    runs = parts.join(hot, "h", "left_anti").repartition("h").sortWithinPartitions("h", "d").mapInArrow(_sorted(span), f"h long, d long, runs {runs_type}")
    if not hot.isEmpty():
        windows = written(parts.join(hot, "h", "left_semi").mapInArrow(_windows(span), "w binary, h long, d long, at int"), "windows")
        twice = windows.groupBy("w").count().filter("count > 1").select("w")
        ones = windows.join(twice, "w").groupBy("h", "d").agg(F.collect_list(F.struct(F.col("at").alias("begin"), (F.col("at") + 1).alias("stop"))).cast(runs_type).alias("runs"))
        runs = runs.union(ones)
    whole = distinct.filter("times > 1").select("h", "d", F.array(F.struct(F.lit(0).alias("begin"), F.col("n").alias("stop"))).cast(runs_type).alias("runs"))
    verdicts = written(runs.union(whole), "verdicts")
    placed = f"flatten(transform(starts, s -> transform(runs, r -> struct(s + r.begin as begin, s + r.stop + {span - 1} as stop))))"
    spans = found.join(verdicts, ["h", "d"]).select("doc", F.expr(placed).alias("spans")).groupBy("doc").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    return spans.select(F.col("doc").alias(id_column), _merged()("spans").alias("spans"))


def cut_bytes():
    """Column function: (text, spans) -> struct<n_bytes, n_removed, n_spans, kept: binary>: the other bytes, which need not be UTF-8."""

    @F.arrow_udf("struct<n_bytes:long,n_removed:long,n_spans:long,kept:binary>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        counts, removed, kept = [], [], []
        for text, drop in zip(texts, spans, strict=True):
            raw, at, left = text.as_buffer().to_pybytes() if text.is_valid else b"", 0, []
            for x in drop.as_py() or []:
                left.append(raw[at : x["begin"]])
                at = x["stop"]
            kept.append(b"".join([*left, raw[at:]]))
            counts.append(len(raw))
            removed.append(len(raw) - len(kept[-1]))
        ranges = pa.array([len(x) if x.is_valid else 0 for x in spans], pa.int64())
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), ranges, pa.array(kept, pa.binary())], ["n_bytes", "n_removed", "n_spans", "kept"])

    return cut
