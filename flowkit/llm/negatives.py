"""Hard negatives from Hilbert-ordered blocks with zone maps.

Vectors become integers. Rows are sorted by label and by their place on a
Hilbert curve through all dimensions, cut into blocks of BLOCK rows of one label
and written as Parquet, a block a row, with the least and largest component of
each dimension: its zone map. Interval arithmetic on a zone map bounds the score
of an anchor with every row of the block from both sides; a block is read for
an anchor only if those bounds meet a window of scores that the anchor is after.
Positives: from the fifth best score within the anchor's own block up. Negatives:
the scores that each positive admits. Blocks are searched by matrix products, a
run of SUPER blocks in a task at a time, against anchors in chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: Rows of a block; blocks that one task searches together; anchors of a chunk; zone maps that are bounded together.
BLOCK, SUPER, CHUNK, ZONES = 1024, 32, 512, 256
#: Bits of each dimension on the curve, and sizes of steps in standard deviations.
BITS, STEP = 2, 0.75
NONE = np.iinfo(np.int64).min


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) with coordinates below 2**bits, as rows of bytes in order.

    Coordinates are turned into the transposed index by undoing, from the
    highest bit down, the reflections and exchanges of axes of each level; then
    Gray decoded. Bits are taken across dimensions, highest first.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in reversed(range(1, bits)):
        low = (1 << level) - 1
        for i in range(n):
            flip = (x[i] >> level & 1).astype(bool)
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0]) if n else np.zeros(len(cells), np.int64)
    for level in reversed(range(1, bits)):
        turn ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0) if n else 0
    x ^= turn
    planes = [(x[i] >> b & 1).astype(np.uint8) for b in reversed(range(bits)) for i in range(n)]
    return np.packbits(np.stack(planes, axis=1), axis=1) if planes else np.zeros((len(cells), 0), np.uint8)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of rows: in floating point where no sum can reach 2**53."""
    most = a.shape[1] * int(np.abs(a.astype(np.int64)).max(initial=0)) * int(np.abs(b.astype(np.int64)).max(initial=0))
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most >= 1 << 63:
        raise OverflowError("scores do not fit 64 bits")
    return a.astype(np.int64) @ b.T.astype(np.int64)


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least, largest) score that each anchor can have with a row of each zone: sums of the ends of the products' intervals."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return products(up, low) + products(down, high), products(up, high) + products(down, low)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of int32 from binary values of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int32).reshape(len(column), -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(v: array<int>) -> (i, n, x, xx): for each dimension the rows that have it, their sum and sum of squares."""
    n, x, xx = (np.zeros(0) for _ in range(3))
    for batch in batches:
        length = np.diff(np.asarray(batch.column(0).offsets))
        at = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        v = np.asarray(batch.column(0).flatten()).astype(np.float64)
        dim = max(len(n), int(length.max(initial=0)))
        n, x, xx = (np.pad(old, (0, dim - len(old))) + np.bincount(at, weights, dim) for old, weights in ((n, None), (x, v), (xx, v * v)))
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n), pa.array(x), pa.array(xx)], ["i", "n", "x", "xx"])


def _placed(dim: int, mean: np.ndarray, spread: np.ndarray):
    """(label, vec_id, v: array<int>) -> (label, vec_id, place on the curve, v as int32 bytes, padded by zeros)."""

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            length = np.diff(np.asarray(lists.offsets))
            v = np.zeros((len(lists), dim), np.int32)
            v[np.arange(dim) < length[:, None]] = np.asarray(lists.flatten())
            cells = np.clip((v - mean) / spread + (1 << BITS) / 2, 0, (1 << BITS) - 1).astype(np.int64)
            place = [x.tobytes() for x in hilbert(cells)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(place, pa.binary()), pa.array([x.tobytes() for x in v], pa.binary())], ["label", "vec_id", "place", "v"])

    return placed


def _blocks(dim: int, every: int, positives: int):
    """Rows in order -> blocks of one label, with zone maps and, of the anchors in them, the window their block already sets."""

    def block(number: int, label: int, rows: list[tuple]) -> pa.RecordBatch:
        ids = np.array([r[0] for r in rows], np.int64)
        v = np.frombuffer(b"".join(r[1] for r in rows), np.int32).reshape(len(rows), dim)
        at = np.flatnonzero(ids % every == 0)
        scores = products(v[at], v)
        scores[np.arange(len(at)), at] = NONE  # an anchor is no positive of its own
        least = np.sort(scores, axis=1)[:, -positives] if len(rows) > positives else np.full(len(at), NONE)
        values = [number, label, len(rows), ids.tobytes(), v.tobytes(), v.min(axis=0).tobytes(), v.max(axis=0).tobytes(), at.astype(np.int32).tobytes(), least.astype(np.int64).tobytes()]
        return pa.RecordBatch.from_pylist([dict(zip(_BLOCK.names, values, strict=True))], _BLOCK)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, label, rows = TaskContext.get().partitionId() << 32, None, []
        for batch in batches:
            for of, i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if rows and (of != label or len(rows) >= BLOCK):
                    yield block(number, label, rows)
                    number, rows = number + 1, []
                label = of
                rows.append((i, v))
        if rows:
            yield block(number, label, rows)

    return blocks


_BLOCK = pa.schema([("block", pa.int64()), ("label", pa.int32()), ("n", pa.int64()), ("ids", pa.binary()), ("vectors", pa.binary()), ("low", pa.binary()), ("high", pa.binary()), ("anchors", pa.binary()), ("least", pa.binary())])
_BLOCK_DDL = "block long, label int, n long, ids binary, vectors binary, low binary, high binary, anchors binary, least binary"
_CHUNK = pa.schema([("chunk", pa.int64()), ("label", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("least", pa.binary())])
_CHUNK_DDL = "chunk long, label int, ids binary, vectors binary, least binary"


def _chunks(dim: int):
    """Blocks -> their anchors, up to CHUNK of one label together; a chunk is named by its least vec_id."""

    def chunk(label: int, ids: list, v: list, least: list) -> pa.RecordBatch:
        ids = np.concatenate(ids)
        row = dict(zip(_CHUNK.names, [int(ids.min()), label, ids.tobytes(), np.concatenate(v).tobytes(), np.concatenate(least).tobytes()], strict=True))
        return pa.RecordBatch.from_pylist([row], _CHUNK)

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, ids, v, least = None, [], [], []
        for batch in batches:
            for row in batch.to_pylist():
                at = np.frombuffer(row["anchors"], np.int32)
                for lo in range(0, len(at), CHUNK):
                    part = at[lo : lo + CHUNK]
                    if ids and (row["label"] != label or sum(map(len, ids)) + len(part) > CHUNK):
                        yield chunk(label, ids, v, least)
                        ids, v, least = [], [], []
                    label = row["label"]
                    ids.append(np.frombuffer(row["ids"], np.int64)[part])
                    v.append(np.frombuffer(row["vectors"], np.int32).reshape(-1, dim)[part])
                    least.append(np.frombuffer(row["least"], np.int64)[lo : lo + CHUNK])
        if ids:
            yield chunk(label, ids, v, least)

    return chunks


def _windows(row: dict, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which anchor, least, largest score) of each window of a chunk."""
    return np.frombuffer(row["who"], np.int32), np.frombuffer(row["from"], np.int64), np.frombuffer(row["to"], np.int64)


def _chosen(dim: int, same_label: bool):
    """Chunks with their windows beside a bunch of zone maps -> (super, chunk, blocks that a window meets)."""

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                zones = [z for z in row["zones"] if (z["label"] == row["label"]) == same_label]
                if not zones:
                    continue
                low, high = (np.frombuffer(b"".join(z[k] for z in zones), np.int32).reshape(-1, dim) for k in ("low", "high"))
                least, most = bounds(np.frombuffer(row["vectors"], np.int32).reshape(-1, dim), low, high)
                who, begin, end = _windows(row, len(least))
                meets = ((least[who] <= end[:, None]) & (most[who] >= begin[:, None])).any(axis=0)
                needed = np.array([z["block"] for z in zones], np.int64)[meets]
                for s in np.unique(needed // SUPER).tolist():
                    yield pa.RecordBatch.from_pydict({"super": pa.array([s], pa.int64()), "chunk": pa.array([row["chunk"]], pa.int64()), "needed": pa.array([needed[needed // SUPER == s].tolist()], pa.list_(pa.int64()))})

    return chosen


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[int, int]]:
    """The ``k`` largest scores with their ids, ties by id."""
    if len(scores) > 4 * k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        scores, ids = scores[keep], ids[keep]
    by = np.lexsort((ids, -scores))[:k]
    return list(zip(scores[by].tolist(), ids[by].tolist(), strict=True))


def _searched(dim: int, k: int):
    """Of each super first its blocks, then the chunks that need some of them -> the best ``k`` rows of each window there."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, blocks = None, {}
        for batch in batches:
            for row in batch.to_pylist():
                if row["super"] != now:
                    now, blocks = row["super"], {}
                if row["chunk"] is None:
                    blocks[row["block"]] = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int32).reshape(-1, dim)
                    continue
                anchors, v = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vectors"], np.int32).reshape(-1, dim)
                who, begin, end = _windows(row, len(anchors))
                found: list[list] = [[] for _ in who]
                begin = begin.copy()
                for b in row["needed"]:
                    ids, vectors = blocks[b]
                    scores = products(v, vectors)
                    for w, (i, lo, hi) in enumerate(zip(who.tolist(), begin.tolist(), end.tolist(), strict=True)):
                        mine = np.flatnonzero((scores[i] >= lo) & (scores[i] <= hi) & (ids != anchors[i]))
                        if len(mine):
                            found[w] = sorted([*found[w], *_best(scores[i][mine], ids[mine], k)], key=lambda x: (-x[0], x[1]))[:k]
                            if len(found[w]) == k:
                                begin[w] = found[w][-1][0]  # what is below can not be among the best
                flat = [(int(anchors[i]), w_rank, s, x) for (i, w_rank), hits in zip(zip(who.tolist(), np.frombuffer(row["rank"], np.int32).tolist(), strict=True), found, strict=True) for s, x in hits]
                if flat:
                    anchor, rank, score, other = zip(*flat, strict=True)
                    yield pa.RecordBatch.from_pydict({"chunk": pa.array([row["chunk"]] * len(flat), pa.int64()), "anchor_id": pa.array(anchor, pa.int64()), "window": pa.array(rank, pa.int32()), "score": pa.array(score, pa.int64()), "other_id": pa.array(other, pa.int64())})

    return searched


def _open_ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks with the windows of their positives: one for each anchor, from its block's ``least`` up."""
    for batch in batches:
        n = [len(x) // 8 for x in batch.column(2).to_pylist()]
        who = pa.array([np.arange(m, dtype=np.int32).tobytes() for m in n], pa.binary())
        rank = pa.array([np.ones(m, np.int32).tobytes() for m in n], pa.binary())
        most = pa.array([np.full(m, np.iinfo(np.int64).max).tobytes() for m in n], pa.binary())
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), who, rank, batch.column(4), most], _WINDOWED)


def _admitted(low: tuple[int, int], high: tuple[int, int]):
    """Chunks with lists of (anchor_id, rank, score) of their positives -> with the windows that these admit."""

    def admitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for row in batch.to_pylist():
                at = {x: i for i, x in enumerate(np.frombuffer(row["ids"], np.int64).tolist())}
                # num * positive <= den * negative: whole numbers from the ceiling; up to the floor
                some = [(at[p["anchor_id"]], p["window"], -(-low[0] * p["score"] // low[1]), high[0] * p["score"] // high[1]) for p in row["found"]]
                some = [x for x in some if x[2] <= x[3]]
                parts.append([np.array([x[i] for x in some], kind).tobytes() for i, kind in enumerate((np.int32, np.int32, np.int64, np.int64))])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), *(pa.array([p[i] for p in parts], pa.binary()) for i in range(4))], _WINDOWED)

    return admitted


_WINDOWED = ["chunk", "label", "ids", "vectors", "who", "rank", "from", "to"]
_WINDOWED_DDL = "chunk long, label int, ids binary, vectors binary, who binary, rank binary, `from` binary, `to` binary"
_FOUND = "chunk long, anchor_id long, window int, score long, other_id long"


def _search(chunks: DataFrame, blocks: DataFrame, dim: int, k: int, same_label: bool) -> DataFrame:
    """The best ``k`` rows of each window of the chunks, over the blocks that its zone maps admit."""
    n = max(1, -(-blocks.count() // ZONES))
    number = F.pmod(F.xxhash64("block"), F.lit(n))
    zones = blocks.select("block", "label", "low", "high").groupBy(number.alias("zone")).agg(F.collect_list(F.struct("block", "label", "low", "high")).alias("zones"))  # some ZONES each
    beside = chunks.withColumn("zone", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))).join(zones, "zone")
    needs = beside.select("chunk", "label", "vectors", "who", "from", "to", "zones").mapInArrow(_chosen(dim, same_label), "super long, chunk long, needed array<long>")
    needs = written(needs.groupBy("super", "chunk").agg(F.flatten(F.collect_list("needed")).alias("needed")), "needs")
    asked = needs.join(chunks, "chunk").select("super", "chunk", F.lit(None).cast("long").alias("block"), "needed", "ids", "vectors", "who", "rank", "from", "to")
    held = blocks.select(F.expr(f"block div {SUPER}").alias("super"), F.lit(None).cast("long").alias("chunk"), "block", F.lit(None).cast("array<long>").alias("needed"), "ids", "vectors", *(F.lit(None).cast("binary").alias(c) for c in ("who", "rank", "from", "to")))
    stream = held.join(needs.select("super").distinct(), "super", "left_semi").unionByName(asked).repartition("super").sortWithinPartitions("super", F.col("chunk").asc_nulls_first())
    found = written(stream.mapInArrow(_searched(dim, k), _FOUND), "found")
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "other_id")
    return found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)


def hard_negatives(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: tuple[int, int] = (50, 100), high: tuple[int, int] = (95, 100)) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from ``rows`` (vec_id, label, embedding).

    A component x counts as floor(256 x); scores are inner products of these.
    Anchors are rows whose vec_id is divisible by ``every``; an anchor's
    positives are its first ``positives`` other rows of the same label, and of
    each positive the first ``negatives`` rows of other labels are returned whose
    score lies between low and high (numerator, denominator) times the
    positive's. First means larger score, then smaller vec_id.

    Rows with a null vec_id, label or vector, or a null or non-finite component,
    take no part. A vec_id names one row: of rows that repeat it the least (by
    label, then vector) counts. Shorter vectors are taken as filled up with
    zeros, empty ones included. An empty table, anchors without positives and
    positives that admit nothing give no rows. Components of 2**23 or more in
    size, and scores beyond 64 bits, raise an error.
    """
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding")
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & whole)
    rows = rows.select("label", "vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * 256).cast("int")).alias("v"))
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("x.label", "vec_id", "x.v")
    # a row for each dimension; only the order of rows depends on it, so floating point will do
    stats = rows.select("v").mapInArrow(_sums, "i int, n double, x double, xx double").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("n", "x", "xx"))).orderBy("i").collect()
    dim = max(len(stats), 1)
    n, x, xx = np.array([(r["n"], r["x"], r["xx"]) for r in stats] or [(1, 0, 0)], float).T
    mean, spread = x / n, np.sqrt(np.maximum(xx / n - (x / n) ** 2, 1)) * STEP
    placed = rows.mapInArrow(_placed(dim, mean, spread), "label int, vec_id long, place binary, v binary")
    blocks = placed.repartitionByRange("label", "place", "vec_id").sortWithinPartitions("label", "place", "vec_id").mapInArrow(_blocks(dim, every, positives), _BLOCK_DDL)
    blocks = written(blocks, "blocks")
    chunks = written(blocks.select("label", "ids", "vectors", "anchors", "least").filter(F.octet_length("anchors") > 0).mapInArrow(_chunks(dim), _CHUNK_DDL), "chunks")
    near = _search(chunks.mapInArrow(_open_ended, _WINDOWED_DDL), blocks, dim, positives, same_label=True)
    near = written(near.select("chunk", "anchor_id", F.col("place").alias("window"), "score", "other_id"), "positives")
    after = near.groupBy("chunk").agg(F.collect_list(F.struct("anchor_id", "window", "score")).alias("found"))  # a chunk has CHUNK anchors at most
    windowed = written(chunks.join(after, "chunk").select("chunk", "label", "ids", "vectors", "found").mapInArrow(_admitted(low, high), _WINDOWED_DDL), "windows")
    far = _search(windowed, blocks, dim, negatives, same_label=False)
    discard(chunks)
    far = far.select("anchor_id", "window", F.col("place").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    near = near.select("anchor_id", "window", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return far.join(near, ["anchor_id", "window"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
