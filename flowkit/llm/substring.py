"""Substring dedup by difference-cover anchors.

D is a difference cover modulo V: for any two positions i and j some shift
below V takes both into D. Two documents that share SPAN words, at any places,
thus both have an anchor - the hash of SPAN - V + 1 words at a position of D
modulo V - at the same place of the shared passage. Anchors met in two or more
documents are extended: every window of SPAN words that holds one is hashed in
128 bits, and a window is a repeat if a smaller document has it too. Anchors
are about a fifth as many as windows, and windows are hashed only where
passages do recur.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_keys, written
from .words import U64, grams, mix, signed, slabs, words

#: A perfect difference set; every residue modulo 31 is a difference of two of them.
COVER, PERIOD = (1, 5, 11, 24, 25, 27), 31


def text_keys():
    """Column function: text -> struct<n_words, hi, lo: 128-bit BLAKE2 hash of its words, joined by one space>."""

    @F.arrow_udf("struct<n_words:long,hi:long,lo:long>")
    def keys(texts: pa.Array) -> pa.Array:
        counts, hashes = [], []
        for text in texts:
            found = text.as_buffer().to_pybytes().split() if text.is_valid else []
            counts.append(len(found))
            hashes.append(blake2b(b" ".join(found), digest_size=16).digest())
        halves = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), *(pa.array(np.ascontiguousarray(halves[:, i])) for i in (0, 1))], ["n_words", "hi", "lo"])

    return keys


def _by_text(hashes: list[np.ndarray], owner: np.ndarray, place: np.ndarray, ids: np.ndarray) -> list[pa.Array]:
    """(hashes .., document, list of places): a row for each hash of a document, so that periodic texts make no hot keys."""
    order = np.lexsort((place, *hashes[::-1], owner))
    hashes, owner, place = [h[order] for h in hashes], owner[order], place[order]
    opens = np.ones(len(owner), bool)
    opens[1:] = np.any([x[1:] != x[:-1] for x in (owner, *hashes)], axis=0)
    at = np.flatnonzero(opens)
    lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(owner)).astype(np.int32)), pa.array(place.astype(np.int32)))
    return [*(signed(h[at]) for h in hashes), pa.array(ids[owner[at]]), lists]


def _flat(doc: np.ndarray, lists: pa.ListArray, take: np.ndarray) -> pa.RecordBatch:
    """(doc, at) of every place of the rows taken."""
    lists = lists.filter(pa.array(take))
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(doc[take], np.diff(np.asarray(lists.offsets)))), lists.flatten()], ["doc", "at"])


def _anchors(span: int):
    length = span - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for lo, _, buf, bounds in slabs(batch.column(1)):
                w = words(buf, bounds)
                hashes = grams(w.hash, length)
                counts = np.diff(w.first)
                place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], counts)
                last = np.repeat(counts, counts) - length
                at = np.flatnonzero((place <= last) & in_cover[place % PERIOD] & (np.repeat(counts, counts) >= span))
                owner = np.repeat(np.arange(len(counts)), counts)
                yield pa.RecordBatch.from_arrays(_by_text([hashes[at]], owner[at], place[at], ids[lo:]), ["h", "doc", "at"])

    return anchors


def _recurring(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc, at) sorted by h, doc -> (doc, at) of those whose h is in two documents or more.

    Of a group that goes on in the next batch only rows of its first document
    wait; later rows show by themselves that it recurs.
    """
    waiting = None
    lone_h = None  # a group known to recur that goes on
    for batch in batches:
        if waiting is not None:
            batch = pa.Table.from_batches([waiting, batch]).combine_chunks().to_batches()
            batch = batch[0] if batch else waiting
        if not batch.num_rows:
            continue
        h, doc, at = np.asarray(batch.column(0)), np.asarray(batch.column(1)), batch.column(2)
        opens = np.r_[True, h[1:] != h[:-1]]
        group = np.cumsum(opens) - 1
        begin = np.flatnonzero(opens)
        end = np.r_[begin[1:], len(h)] - 1
        shared = doc[begin] != doc[end]
        if lone_h is not None and h[0] == lone_h:
            shared[0] = True
        waits = not shared[-1]
        take = shared[group]
        if take.any():
            yield _flat(doc, at, take)
        lone_h = None if waits else h[-1]
        waiting = batch.slice(begin[-1]) if waits else None


def _windows(span: int):
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, places = np.asarray(batch.column(0)), batch.column(2)
            for lo, _, buf, bounds in slabs(batch.column(1)):
                w = words(buf, bounds)
                both = [grams(w.hash, span, k) for k in (0, 1)]
                marks = np.zeros(len(w.hash) + 1, np.int64)
                for i, (a, b) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    found = np.asarray(places[lo + i].values)
                    found = found[found < b - a]
                    if b - a >= span and len(found):
                        np.add.at(marks, a + np.maximum(found - PERIOD + 1, 0), 1)
                        np.add.at(marks, a + np.minimum(found + 1, b - a - span + 1), -1)
                at = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
                owner = np.searchsorted(w.first, at, "right") - 1
                yield pa.RecordBatch.from_arrays(_by_text([x[at] for x in both], owner, at - w.first[owner], ids[lo:]), ["h", "h2", "doc", "at"])

    return windows


def _repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, h2, doc, at) sorted -> (doc, at) of those that a smaller document has too."""
    last = None  # (h, h2, first document) of the group that is open
    for batch in batches:
        h, h2, doc = (np.asarray(batch.column(i)) for i in range(3))
        if not len(h):
            continue
        opens = np.r_[True, (h[1:] != h[:-1]) | (h2[1:] != h2[:-1])]
        begin = np.maximum.accumulate(np.where(opens, np.arange(len(h)), 0))
        first = doc[begin]
        if last and last[:2] == (h[0], h2[0]):
            first[begin == 0] = last[2]
        take = doc > first
        last = (h[-1], h2[-1], first[-1])
        if take.any():
            yield _flat(doc, batch.column(3), take)


def _merged(span: int):
    """Column function: starts of repeated windows -> disjoint word ranges that they cover."""

    @F.arrow_udf("array<struct<begin:int,stop:int>>")
    def merged(starts: pa.Array) -> pa.Array:
        out = []
        for x in starts:
            s = np.unique(np.asarray(x.values))
            gap = np.flatnonzero(np.diff(s) > span)
            begin, stop = s[np.r_[0, gap + 1]], s[np.r_[gap, len(s) - 1]] + span
            out.append([{"begin": int(a), "stop": int(b)} for a, b in zip(begin, stop, strict=True)])
        return pa.array(out, pa.list_(pa.struct([("begin", pa.int32()), ("stop", pa.int32())])))

    return merged


def repeated_spans(docs: DataFrame, span: int = 50, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, spans: array<struct<begin, stop>>) of documents with words that a smaller document repeats.

    Spans are word ranges, disjoint and in order, each covered by windows of
    ``span`` words whose word sequence a document with a smaller id also has.
    Texts shorter than ``span`` words, null or empty ones and rows without an
    id have none. A doc_id names one text; rows that repeat it are one
    document. Equal texts are one class, of which the smallest id is compared
    and the others are covered whole. ``span`` must be PERIOD at least.
    """
    if span < PERIOD:
        raise ValueError(f"span must be {PERIOD} words or more")
    docs = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text")).filter("doc is not null and text is not null")
    keyed = written(docs.select("doc", text_keys()("text").alias("k")).select("doc", "k.*").filter(F.col("n_words") >= span), "texts")
    least = keyed.groupBy("n_words", "hi", "lo").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).filter("least < last").drop("last")
    # written, so that the join has plain shuffles below it and Spark can split a class that holds many rows
    copies = written(keyed.join(written(least, "copied"), ["n_words", "hi", "lo"]).filter("least < doc").select("doc", "n_words").distinct(), "copies")
    docs = docs.join(small_keys(copies.select("doc")), "doc", "left_anti")
    anchors = docs.mapInArrow(_anchors(span), "h long, doc long, at array<int>")
    found = written(anchors.repartition("h").sortWithinPartitions("h", "doc").mapInArrow(_recurring, "doc long, at int"), "anchors")
    places = found.groupBy("doc").agg(F.collect_set("at").alias("places"))
    with_any = docs.join(small_keys(written(found.select("doc").distinct(), "ids")), "doc", "left_semi")
    windows = with_any.join(places, "doc").select("doc", "text", "places").mapInArrow(_windows(span), "h long, h2 long, doc long, at array<int>")
    repeats = windows.repartition("h").sortWithinPartitions("h", "h2", "doc").mapInArrow(_repeats, "doc long, at int")
    spans = repeats.groupBy("doc").agg(F.collect_list("at").alias("starts")).select("doc", _merged(span)("starts").alias("spans"))
    whole = copies.select("doc", F.array(F.struct(F.lit(0).alias("begin"), F.col("n_words").cast("int").alias("stop"))).alias("spans"))
    return spans.union(whole).withColumnRenamed("doc", id_column)


def with_spans(docs: DataFrame, spans: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """``docs`` with the column ``spans`` (empty where there are none); only texts that have some are shuffled, if ids are few."""
    spans = written(spans, "spans")
    ids = small_keys(spans.select(id_column))
    bare = docs.join(ids, id_column, "left_anti").withColumn("spans", F.array().cast("array<struct<begin:int,stop:int>>"))
    return bare.unionByName(docs.join(ids, id_column, "left_semi").join(spans, id_column))


def cut():
    """Column function: (text, spans) -> struct<n_words, n_removed, kept>: the other words, joined by one space."""

    @F.arrow_udf("struct<n_words:long,n_removed:long,kept:string>")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        counts, removed, kept = [], [], []
        for text, drop in zip(texts, spans, strict=True):
            found = text.as_buffer().to_pybytes().split() if text.is_valid else []
            counts.append(len(found))
            for x in reversed(drop.as_py() or []):
                del found[x["begin"] : x["stop"]]
            removed.append(counts[-1] - len(found))
            kept.append(b" ".join(found))
        return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept"])

    return cut
