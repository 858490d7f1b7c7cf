"""Source divergence audit: where sources of a language differ in their use of words.

The terms that a language keeps are sorted and become minimal acyclic
transducers (``transducer``), a shard of SHARD terms each. Texts are streamed
through them to count each term by source; what a text gives is an ordinal, its
term's place in byte order, which also breaks ties. Shards pass through the
driver and to the tasks in waves of at most WAVE bytes, one job each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_keys, written
from .transducer import Transducer
from .words import slabs

#: Terms of a shard; bytes of the shards that are sent to tasks at once; terms and places that a task counts before it hands them on.
SHARD, WAVE, ENTRIES, HELD = 1 << 16, 32 << 20, 400_000, 1 << 20
#: Terms and sources of one block of the comparison of pairs.
TERMS, TILE = 4096, 32
#: Most groups whose sizes are broadcast.
GROUPS = 20_000
UNIT = 1_000_000_000
#: Bytes of terms with A-Z in lower case; of others, a space.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_PARTS = "key binary, target binary, before binary, final binary"


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text) -> (lang, term, documents): how many documents of the batch rows so far hold it."""
    seen: dict[str, Counter] = {}

    def flushed():
        for lang, counts in seen.items():
            terms = pa.array(list(counts), pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(counts), pa.string()), terms, pa.array(counts.values(), pa.int64())], ["lang", "term", "documents"])
        seen.clear()

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            seen.setdefault(lang, Counter()).update(set(text.as_buffer().to_pybytes().translate(_LOWER).split()))
        if sum(map(len, seen.values())) > ENTRIES:
            yield from flushed()
    yield from flushed()


def _shard(lang: str, terms: list[str]) -> pa.RecordBatch:
    parts = [pa.array([x.tobytes()], pa.binary()) for x in Transducer.of(x.encode() for x in terms)]
    named = [pa.array([lang], pa.string()), pa.array(terms[:1], pa.string()), pa.array([len(terms)], pa.int64()), pa.array([terms], pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(named + parts, ["lang", "first", "n", "terms", "key", "target", "before", "final"])


def _shards(most: int):
    """(lang, term) in order -> (lang, first, n, terms, transducer) of up to ``most`` terms each."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang, terms = None, []
        for batch in batches:
            for of, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if terms and (of != lang or len(terms) >= most):
                    yield _shard(lang, terms)
                    terms = []
                lang = of
                terms.append(term)
        if terms:
            yield _shard(lang, terms)

    return shards


def _read(row) -> tuple[str, int, Transducer]:
    return row["lang"], row["base"], Transducer(np.frombuffer(row["key"], np.int64), np.frombuffer(row["target"], np.int32), np.frombuffer(row["before"], np.int32), np.frombuffer(row["final"], bool))


_IN_TERM = np.frombuffer(_LOWER, np.uint8) != 32


def _terms(buf: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the terms of the texts ``buf[bounds[i]:bounds[i+1]]``, which are in lower case."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = _IN_TERM[buf]
    opens, closes = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = bounds[(bounds > 0) & (bounds < len(buf))]
    opens[cut] |= inside[1:-1][cut]
    closes[cut - 1] |= inside[1:-1][cut - 1]
    return np.flatnonzero(opens), np.flatnonzero(closes) + 1


def _recount(shards: list[tuple[str, int, Transducer]]):
    """(lang, source, text) -> (lang, source, ordinal, n) of the terms of these shards."""
    lower = np.frombuffer(_LOWER, np.uint8)
    of: dict[str, list[tuple[int, Transducer]]] = {}
    for lang, base, t in shards:
        of.setdefault(lang, []).append((base, t))

    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []  # (group << 40 | ordinal, n)

        def merged():
            key, which = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            return key, np.bincount(which, np.concatenate([h[1] for h in held]), len(key)).astype(np.int64)

        def flushed():
            if held:
                key, n = merged()
                group = pa.array((key >> 40).astype(np.int32))
                lang, source = (pa.DictionaryArray.from_arrays(group, pa.array([g[i] for g in groups], pa.string())).cast(pa.string()) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([lang, source, pa.array(key & ((1 << 40) - 1)), pa.array(n)], ["lang", "source", "ordinal", "n"])
            held.clear()
            groups.clear()

        for batch in batches:
            langs, sources = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in set(langs) & set(of):
                rows = [i for i, x in enumerate(langs) if x == lang]
                mine = np.array([groups.setdefault((lang, sources[i]), len(groups)) for i in rows], np.int64)
                for lo, _, buf, bounds in slabs(batch.column(2).take(pa.array(rows))):
                    buf = lower[buf]
                    start, end = _terms(buf, bounds)
                    owner = mine[lo + np.searchsorted(bounds, start, "right") - 1] << 40
                    for base, t in of[lang]:
                        place = t.ordinals(buf, start, end)
                        hit = place >= 0
                        held.append(np.unique(owner[hit] | place[hit] + base, return_counts=True))
            if sum(len(h[0]) for h in held) > HELD:
                held[:] = [merged()]
                if len(held[0][0]) > HELD // 2:
                    yield from flushed()
        yield from flushed()

    return recount


def _share(count: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * count / total), for 0 <= count <= total < 2**53: three digits to the base 1000, so nothing overflows."""
    share, rest = np.zeros(len(count), np.int64), count
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        share = share * 1000 + digit
    return share + 1


def _pairs(block: pd.DataFrame) -> pd.DataFrame:
    """One block of terms and one or two tiles of sources -> (lang, i, j, value) of the pairs i < j that it compares."""
    lang, number, a, b = block[["lang", "block", "a", "b"]].iloc[0]
    block = block.sort_values("idx", ignore_index=True)
    v = int(block["v"].iloc[0])
    width = max(0, min(TERMS, v - number * TERMS))
    shares = np.zeros((len(block), width), np.int64)
    for r, (places, counts, total) in enumerate(zip(block["places"], block["counts"], block["total"], strict=True)):
        row = np.full(width, 2, np.int64)
        if places is not None and width:
            row[np.asarray(places, np.int64) - number * TERMS] += np.asarray(counts, np.int64)
        shares[r] = _share(row, int(total) + 2 * v) if width else 0
    idx, tile = block["idx"].to_numpy(), block["idx"].to_numpy() // TILE
    out = []
    for r in np.flatnonzero(tile == a):
        others = np.flatnonzero((tile == b) & (idx > idx[r]))
        apart = shares[others] - shares[r]
        value = (apart * apart // (shares[others] + shares[r])).sum(axis=1) if width else np.zeros(len(others), np.int64)
        out.append(pd.DataFrame({"lang": lang, "i": idx[r], "j": idx[others], "value": value}))
    return pd.concat(out, ignore_index=True)


def _ranked(df: DataFrame, part: str, item: str, top: int | None = None) -> DataFrame:
    """Ranks within (lang, source) by value, largest first, then by ``item``."""
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), item)
    df = df.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit(part))
    return df if top is None else df.filter(F.col("rank") <= top)


def audit(docs: DataFrame, min_documents: int = 10, top: int = 10, shard: int = SHARD, wave: int = WAVE) -> DataFrame:
    """(lang, source, part, item, value: long, rank: int): how the sources of each language diverge in their words.

    Terms are runs of ASCII letters and characters beyond ASCII, with A-Z in
    lower case. A language keeps the terms in at least ``min_documents`` of its
    documents (rows). Each group (lang, source) and each language gives a kept
    term p = 1 + floor(10**9 * (count + 2) / (N + 2 V)), with N the counts of all
    V kept terms. f = floor((p - q)**2 / (p + q)). Part "pair": f summed over all
    kept terms against each other source of the language. Part "term": the
    ``top`` kept terms that a group uses (p) more than its language (q). Ranks
    go by value, then by the item's bytes.

    Null texts, languages and sources are ''. Groups without terms take part
    with counts of 0; a language that keeps none has pairs of value 0. Rows that
    repeat are documents of their own; other columns are not looked at; an empty
    table gives no rows. Texts are read whole, once to choose the terms and once
    for each ``wave`` bytes of transducers. Counts are exact up to 2**53.
    """
    spark = docs.sparkSession
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    groups = written(docs.select("lang", "source").distinct(), "groups")
    kept = docs.mapInArrow(_frequencies, "lang string, term string, documents long").groupBy("lang", "term").agg(F.sum("documents").alias("documents")).filter(F.col("documents") >= min_documents)
    kept = written(kept.select("lang", "term"), "kept")
    shards = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(_shards(shard), f"lang string, first string, n long, terms array<string>, {_PARTS}")
    shards = written(shards, "shards")
    # a row for each ``shard`` terms: those of a language are few enough for a window
    bases = shards.select("lang", "first", "n").withColumn("base", F.sum("n").over(Window.partitionBy("lang").orderBy("first")) - F.col("n"))
    based = written(shards.join(bases.drop("n"), ["lang", "first"]).withColumn("size", F.expr("octet_length(key) + octet_length(target) + octet_length(before) + octet_length(final)")), "based")
    counts = []
    for sent in _waves(based, wave):
        tables = [_read(r) for r in based.join(F.broadcast(spark.createDataFrame(sent, "lang string, first string")), ["lang", "first"]).select("lang", "base", "key", "target", "before", "final").collect()]
        langs = sorted({lang for lang, _ in sent})
        counts.append(written(docs.filter(F.col("lang").isin(langs)).mapInArrow(_recount(tables), "lang string, source string, ordinal long, n long").groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")), "counts"))
    counts = reduce(DataFrame.union, counts, spark.createDataFrame([], "lang string, source string, ordinal long, n long"))

    vocabulary = based.groupBy("lang").agg(F.sum("n").alias("v"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(vocabulary, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["v", "total"])
    groups = groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang")))
    groups = groups.withColumn("idx", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = written(groups.withColumn("tiles", F.expr(f"count(*) over (partition by lang) div {TILE} + 1")), "groups")

    terms = _top_terms(counts, groups, top).join(based.select("lang", "base", F.posexplode("terms").alias("pos", "item")).select("lang", (F.col("base") + F.col("pos")).alias("ordinal"), "item"), ["lang", "ordinal"])
    columns = ["lang", "source", "part", "item", "value", "rank"]
    return _pair_values(counts, groups).select(columns).union(terms.select(columns))


def _waves(based: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """(lang, first) of shards, as many at once as ``most`` bytes hold, one at least."""
    wave, size = [], 0
    for r in based.select("lang", "first", "size").orderBy("lang", "base").collect():  # a row for each shard
        if wave and size + r["size"] > most:
            yield wave
            wave, size = [], 0
        wave.append((r["lang"], r["first"]))
        size += r["size"]
    if wave:
        yield wave


def _top_terms(counts: DataFrame, groups: DataFrame, top: int) -> DataFrame:
    share = lambda n, total: F.expr(f"1 + cast({UNIT} as decimal(10, 0)) * (cast({n} as decimal(20, 0)) + 2) div ({total} + 2 * v)")
    every = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n"))
    of_group = small_keys(groups.select("lang", "source", "v", "total", "lang_total"), GROUPS)  # few keys, each of many rows
    used = counts.join(every, ["lang", "ordinal"]).join(of_group, ["lang", "source"])
    used = used.withColumn("p", share("n", "total")).withColumn("q", share("lang_n", "lang_total")).filter("p > q")
    return _ranked(used.withColumn("value", F.expr("(p - q) * (p - q) div (p + q)")), "term", "ordinal", top)


def _pair_values(counts: DataFrame, groups: DataFrame) -> DataFrame:
    sparse = counts.withColumn("block", F.expr(f"cast(ordinal div {TERMS} as int)")).groupBy("lang", "source", "block").agg(F.collect_list(F.struct("ordinal", "n")).alias("x"))
    dense = groups.withColumn("block", F.explode(F.expr(f"sequence(0, cast(greatest((v - 1) div {TERMS}, 0) as int))")))
    dense = dense.join(sparse, ["lang", "source", "block"], "left").withColumn("tile", F.expr(f"idx div {TILE}"))
    dense = dense.withColumn("u", F.explode(F.expr("sequence(0, tiles - 1)"))).withColumn("a", F.least("tile", "u")).withColumn("b", F.greatest("tile", "u"))
    dense = dense.select("lang", "block", "a", "b", "idx", "v", "total", F.col("x.ordinal").alias("places"), F.col("x.n").alias("counts"))
    sums = dense.groupBy("lang", "block", "a", "b").applyInPandas(_pairs, "lang string, i int, j int, value long").groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    both = sums.union(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    named = groups.select("lang", "idx", "source")
    both = both.join(named.withColumnRenamed("idx", "i"), ["lang", "i"]).join(named.withColumnsRenamed({"idx": "j", "source": "item"}), ["lang", "j"])
    return _ranked(both, "pair", "item")
