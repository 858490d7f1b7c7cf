"""N-gram Jaccard join by PartEnum signatures.

Sets are grouped in size bands [l, floor(l/t)], so that two sets of similarity
t or more lie in the same band or in neighbours. Band i and the band below it
form one instance, in which such sets differ in at most k elements. The
instance cuts the feature domain (64-bit shingle hashes) into n > k ranges: at
least n - k of them hold the same elements in both sets, so the sets share the
signature (instance, range, elements in it) of one of them. A range that is
empty in both sets would make a signature that links strangers; therefore n
exceeds k by enough that hardly any set has n - k empty ranges, sets that do
are signed again over a second, independent cut, and only sets that fail both
cuts emit signatures for their empty ranges. No linked pair is lost.

Equal sets are one class and are compared once. Rows of one signature are met
in sorted order and stream through with constant memory. In a group of up to
NEAR + 1 every pair is a candidate; in a larger one each row is paired with the
first and with the one before it, which joins most true groups to components;
where a task signs many sets of one signature it pairs most of them itself.
Groups that are then still of several components are completed. First on parity
sketches: bit i of a sketch tells whether range i of the domain holds an odd
number of elements, so two sets differ in no fewer elements than their sketches
differ in bits. Members that this bound keeps from every member of another
component drop out. The others come with their sets: pairs of different
components that the bounds admit are tested exactly, and each link found joins
its two components at once, so fewer links leave a group than it has members. A task
holds two blocks of a group; larger groups are compared block against block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import exp, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, small_keys, written
from .components import components
from .words import U64, mix, shingle_sets, signed

NEAR = 4
#: Most members of a group whose sketches, and most bytes of members' sets, make one block; a task holds two.
BLOCK, BLOCK_BYTES = 1 << 11, 1 << 24
_SECOND_CUT = U64(0x5851F42D4C957F2D)


@lru_cache(8)
def bands(num: int, den: int, largest: int) -> list[tuple[int, int]]:
    """(l, r) of each size band for the similarity num/den, up to a size of ``largest``."""
    out, lo = [], 1
    while not out or out[-1][1] < largest:
        out.append((lo, lo * den // num))
        lo = out[-1][1] + 1
    return out


@lru_cache(4096)
def ranges(lo: int, hi: int, num: int, den: int) -> tuple[int, int, np.ndarray]:
    """k, n and the range starts of the instance for sets of ``lo`` to ``hi`` elements.

    100*I >= t*U and I + U = S give a difference U - I of at most S*(1-t)/(1+t).
    """
    k = (den - num) * 2 * hi // (den + num)
    n = k + 2
    for _ in range(4):
        empty = n * exp(-lo / n)
        n = k + 2 + int(empty + 4 * sqrt(empty))
    starts = np.array([(i << 64) // n for i in range(n)], U64)
    return k, n, starts


def _cut(u: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per range of the sorted hashes ``u``: a hash of its elements, and whether it is empty."""
    sums = np.zeros(len(u) + 1, U64)
    np.cumsum(mix(u + U64(1)), out=sums[1:])
    at = np.append(np.searchsorted(u, starts), len(u))
    return sums[at[1:]] - sums[at[:-1]], at[1:] == at[:-1]


def signatures(u: np.ndarray, num: int, den: int) -> np.ndarray:
    """PartEnum signatures of a set, given as sorted distinct uint64."""
    size = len(u)
    all_bands = bands(num, den, max(64, 2 * size))
    own = next(i for i, (lo, hi) in enumerate(all_bands) if lo <= size <= hi)
    out = []
    for i in (own, own + 1):
        lo, hi = all_bands[i]
        k, n, starts = ranges(all_bands[i - 1][0] if i else lo, hi, num, den)
        if not k:
            continue  # only equal sets are similar
        for cut, v in enumerate((u, None, None)):
            v = v if cut == 0 else np.sort(mix(u ^ _SECOND_CUT))
            content, empty = _cut(v, starts)
            seed = U64((i * 4 + cut + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            sig = mix(content + mix(np.arange(n, dtype=U64) + seed))
            if cut == 2:
                out.append(sig[empty])
                break
            out.append(sig[~empty])
            if empty.sum() < n - k:
                break
    return np.concatenate(out) if out else np.zeros(0, U64)


def set_keys(n: int):
    """Column function: text -> struct<n: size of its shingle set, hi, lo: 128-bit hash of the set>."""

    @F.arrow_udf("struct<n:long,hi:long,lo:long>")
    def keys(texts: pa.Array) -> pa.Array:
        rows = [(len(u), int(mix(u).sum(dtype=U64)), int(mix(u ^ _SECOND_CUT).sum(dtype=U64))) for u in shingle_sets(texts, n)]
        cols = np.array(rows, U64).reshape(-1, 3)
        return pa.StructArray.from_arrays([signed(cols[:, i]) for i in range(3)], ["n", "hi", "lo"])

    return keys


def sketch(u: np.ndarray) -> np.ndarray:
    """Parity sketch of a set: a power of two of bits, 256 or more and at least one per element."""
    bits = max(256, 1 << (len(u) - 1).bit_length())
    return np.packbits(np.bincount((u % U64(bits)).astype(np.int64), minlength=bits) % 2 == 1, bitorder="little")


def _folded(x: np.ndarray, size: int) -> np.ndarray:
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def set_facts(n: int):
    """Column function: text -> struct<set: shingle hashes, sorted, 8 bytes each; size; sketch>."""

    @F.arrow_udf("struct<set:binary,size:long,sketch:binary>")
    def facts(texts: pa.Array) -> pa.Array:
        sets = list(shingle_sets(texts, n))
        return pa.StructArray.from_arrays(
            [pa.array([u.tobytes() for u in sets], pa.binary()), pa.array([len(u) for u in sets], pa.int64()), pa.array([sketch(u).tobytes() for u in sets], pa.binary())], ["set", "size", "sketch"]
        )

    return facts


def plausible(num: int, den: int):
    """Column function: (size, sketch, size, sketch) -> whether the bounds admit a link."""

    @F.arrow_udf("boolean")
    def plausible(n1: pa.Array, s1: pa.Array, n2: pa.Array, s2: pa.Array) -> pa.Array:
        out = []
        for a, b, x, y in zip(n1.to_pylist(), n2.to_pylist(), s1, s2, strict=True):
            x, y = (np.frombuffer(v.as_buffer(), np.uint8) for v in (x, y))
            size = min(len(x), len(y))
            apart = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
            out.append(den * min(a, b) >= num * max(a, b) and apart <= (den - num) * (a + b) // (den + num))
        return pa.array(out, pa.bool_())

    return plausible


def similar(num: int, den: int):
    """Column function: (set, set) -> whether their Jaccard similarity is num/den or more."""

    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right, strict=True):
            a, b = (np.frombuffer(x.as_buffer(), U64) for x in (a, b))
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(bool(both) and den * both >= num * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return similar


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows sorted by their first ``keys`` columns -> (those columns, the others of all rows that share them)."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def _sides(block: np.ndarray, key: tuple) -> tuple[np.ndarray, np.ndarray]:
    """The rows of block x and those of block y; all pairs of a block where both are the same."""
    _, x, y = key
    return np.flatnonzero(block == x), np.flatnonzero(block == y)


def _hopeful(num: int, den: int):
    """Rows (sig, x, y, block, doc, component, size, sketch) sorted by sig, x, y -> (sig, doc, component) of members
    that the bounds admit to a link with a member of another component: no more rows than were read."""

    def chosen(key: tuple, rows: list[tuple]) -> np.ndarray:
        block, comp, size = (np.array([r[i] for r in rows], np.int64) for i in (0, 2, 3))
        width = min(len(r[4]) for r in rows)
        bits = np.stack([_folded(np.frombuffer(r[4], np.uint8), width) for r in rows]).view(U64)
        left, right = _sides(block, key)
        found = np.zeros(len(rows), bool)
        # rows of the commonest component meet only the others
        values, counts = np.unique(comp, return_counts=True)
        main = comp == values[counts.argmax()]
        for some, others in ((left[~main[left]], right), (left[main[left]], right[~main[right]])):
            step = max(1, (1 << 19) // max(1, len(others) * bits.shape[1]))
            for i in range(0, len(some) if len(others) else 0, step):
                at = some[i : i + step]
                apart = np.bitwise_count(bits[at][:, None] ^ bits[others][None]).sum(2, dtype=np.int64)
                ok = _admitted(apart, size[at][:, None], size[others][None], num, den) & (comp[at][:, None] != comp[others][None])
                found[at] |= ok.any(1)
                found[others] |= ok.any(0)
        return found

    def hopeful(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, 3):
            found = [rows[i] for i in np.flatnonzero(chosen(key, rows)).tolist()]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]] * len(found)), pa.array([r[1] for r in found]), pa.array([r[2] for r in found])], ["sig", "doc", "component"])

    return hopeful


def _uniting(num: int, den: int):
    """Rows (sig, x, y, block, doc, component, set) sorted by sig, x, y -> links (a, b), fewer than members.

    Every pair of members of different components is either tested exactly or
    becomes one component by links that are given.
    """

    def links(key: tuple, rows: list[tuple]) -> list[tuple[int, int]]:
        block, doc, root = (np.array([r[i] for r in rows], np.int64) for i in range(3))
        sets = [np.frombuffer(r[3], U64) for r in rows]
        size = np.array([len(u) for u in sets])
        bits = [sketch(u) for u in sets]
        width = min(len(x) for x in bits)
        bits = np.stack([_folded(x, width) for x in bits]).view(U64)
        left, right = _sides(block, key)
        found = []
        for i in left.tolist():
            others = right[root[right] != root[i]]
            apart = np.bitwise_count(bits[i] ^ bits[others]).sum(1, dtype=np.int64)
            others = others[_admitted(apart, size[i], size[others], num, den)]
            while len(others):
                now, others = others[:64], others[64:]
                both = _shared(sets[i], [sets[j] for j in now.tolist()])
                for j in now[den * both >= num * (size[i] + size[now] - both)].tolist():
                    if root[i] != root[j]:
                        found.append((int(doc[i]), int(doc[j])))
                        root[root == root[j]] = root[i]
                others = others[root[others] != root[i]]
        return found

    def uniting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, rows in _groups(batches, 3):
            found = np.array(links(key, rows), np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found.min(1)), pa.array(found.max(1))], ["a", "b"])

    return uniting


def _admitted(apart, size, other, num: int, den: int):
    """Whether the bounds by sketch bits that differ and by sizes admit a link."""
    return (apart <= (den - num) * (size + other) // (den + num)) & (den * np.minimum(size, other) >= num * np.maximum(size, other))


def _shared(u: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted set ``u`` each of the sets (none empty) has."""
    flat = np.concatenate(others)
    at = np.minimum(np.searchsorted(u, flat), len(u) - 1)
    return np.add.reduceat(u[at] == flat, np.cumsum([0, *(len(v) for v in others[:-1])]), dtype=np.int64)


def _signed_rows(n: int, num: int, den: int):
    """(doc, text) -> (sig, doc, head): the signatures of each set.

    Of a signature that more than NEAR + 2 sets of a batch have, only the first
    NEAR + 2 go on as they are, enough to show below that the group is large;
    the others already name the document before them as ``head``, and need not
    meet the rest of their group.
    """

    def made(sig: np.ndarray, doc: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(sig, kind="stable")
        at = np.arange(len(sig))
        s = sig[order]
        rank = at - np.maximum.accumulate(np.where(np.r_[True, s[1:] != s[:-1]], at, 0))
        late = np.flatnonzero(rank >= NEAR + 2)
        head = np.zeros(len(sig), np.int64)
        head[order[late]] = doc[order[late - 1]]
        bare = np.ones(len(sig), bool)
        bare[order[late]] = False
        return pa.RecordBatch.from_arrays([signed(sig), pa.array(doc), pa.array(head, mask=bare)], ["sig", "doc", "head"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, held, owners, count = np.asarray(batch.column(0)), [], [], 0
            for i, u in zip(ids.tolist(), shingle_sets(batch.column(1), n), strict=True):
                s = signatures(u, num, den) if len(u) else u
                held.append(s)
                owners.append(np.full(len(s), i, np.int64))
                count += len(s)
                if count > 50_000:
                    yield made(np.concatenate(held), np.concatenate(owners))
                    held, owners, count = [], [], 0
            if count:
                yield made(np.concatenate(held), np.concatenate(owners))

    return sign


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, doc, head) sorted -> (sig null, a, b) for pairs; (sig, doc, null) for members of large groups."""
    sig, doc = np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, skipped = 0, 0  # of the group that is still open: its first document, rows before those kept
    for batch in batches:
        if batch.num_rows > batch.column(2).null_count:
            # met in the task that signed them
            known = batch.filter(batch.column(2).is_valid())
            none, (far, here, head) = pa.nulls(known.num_rows, pa.int64()), known.columns
            differ = np.asarray(here) != np.asarray(head)
            yield pa.RecordBatch.from_arrays([none.slice(0, int(differ.sum())), head.filter(pa.array(differ)), here.filter(pa.array(differ))], ["sig", "a", "b"])
            yield pa.RecordBatch.from_arrays([far, here, none], ["sig", "a", "b"])
            batch = batch.filter(batch.column(2).is_null())
        old = len(sig)
        sig, doc = np.concatenate([sig, np.asarray(batch.column(0))]), np.concatenate([doc, np.asarray(batch.column(1))])
        if not len(sig):
            continue
        at = np.arange(len(sig))
        begins = np.maximum.accumulate(np.where(np.r_[True, sig[1:] != sig[:-1]], at, 0))
        rank = at - begins + np.where(begins == 0, skipped, 0)
        heads = doc[begins]
        if old:
            heads[begins == 0] = first
        new = at >= old
        left, right = [], []
        for lag in range(1, NEAR + 1):
            hit = at[(at >= max(lag, old)) & (rank >= lag) & ((rank <= NEAR) | (lag == 1))]
            if not len(hit):
                break
            left.append(doc[hit - lag])
            right.append(doc[hit])
        far = at[new & (rank > NEAR)]
        left.append(heads[far])
        right.append(doc[far])
        left, right = np.concatenate(left), np.concatenate(right)
        differ = left != right
        left, right = left[differ], right[differ]
        large = [far]
        for i in at[new & (rank == NEAR + 1)].tolist():
            large.append(np.arange(i - NEAR - 1, i))
        large = np.concatenate(large)
        if len(left) or len(large):
            none = pa.nulls(len(left), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([none, pa.array(sig[large])]), pa.array(np.concatenate([left, doc[large]])), pa.concat_arrays([pa.array(right), pa.nulls(len(large), pa.int64())])],
                ["sig", "a", "b"],
            )
        keep = max(int(begins[-1]), len(sig) - NEAR - 2)
        first, skipped = int(heads[-1]), int(rank[keep])
        sig, doc = sig[keep:], doc[keep:]


class JaccardJoin:
    """Links documents whose ``n``-word shingle sets have a Jaccard similarity of num/den or more."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text"):
        self.docs = docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).cast("string").alias("text")).filter("doc is not null")
        self.n, self.num, self.den = n, num, den
        self.used: list[DataFrame] = []

    def kept(self, df: DataFrame, name: str) -> DataFrame:
        """Written, until ``linked`` has its links."""
        self.used.append(written(df, name))
        return self.used[-1]

    def facts(self, ids: DataFrame) -> DataFrame:
        """(doc, set, size, sketch) of these documents."""
        found = self.docs.join(small_keys(ids), "doc", "left_semi")
        return self.kept(found.select("doc", set_facts(self.n)("text").alias("f")).select("doc", "f.*"), "sets")

    def those(self, facts: DataFrame, ids: DataFrame) -> DataFrame:
        """Facts of these documents alone, so that no other set is shuffled for a join with them."""
        return facts.join(small_keys(self.kept(ids.distinct(), "ids")), "doc", "left_semi")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are linked: first by their sketches, then by their sets."""
        pairs = self.kept(pairs.distinct(), "pairs")
        facts = self.facts(self.kept(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "ids"))

        def joined(pairs: DataFrame, *columns: str) -> DataFrame:
            for side in ("a", "b"):
                pairs = pairs.join(facts.select(F.col("doc").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in columns)), side)
            return pairs

        left = joined(pairs, "size", "sketch").filter(plausible(self.num, self.den)("size_a", "sketch_a", "size_b", "sketch_b"))
        left = self.kept(left.select("a", "b"), "pairs")
        facts = self.those(facts, left.select(F.explode(F.array("a", "b")).alias("doc")))
        return joined(left, "set").filter(similar(self.num, self.den)("set_a", "set_b")).select("a", "b")

    def classes(self) -> DataFrame:
        """(doc, size, class): class is the smallest id with an equal set; null for empty sets."""
        keyed = written(self.docs.select("doc", set_keys(self.n)("text").alias("k")).select("doc", "k.*"), "keys")
        some = keyed.filter("n > 0")
        least = some.groupBy("n", "hi", "lo").agg(F.min("doc").alias("least"), F.max("doc").alias("last")).filter("least < last").drop("last")
        # written, so that the join has plain shuffles below it and Spark can split a class that holds many rows
        named = some.join(written(least, "copied"), ["n", "hi", "lo"], "left")
        return named.select("doc", F.col("n").alias("size"), F.coalesce("least", "doc").alias("class")).union(keyed.filter("n = 0").select("doc", "n", F.lit(None).cast("long")))

    def blocks(self, members: DataFrame, load: str, most: int) -> DataFrame:
        """``members`` (sig, doc, ..) as (sig, x, y, block, ..): a row for each pair of blocks x <= y that holds its block.

        A group has a block for each ``most`` of the sum of ``load``; which one
        a document is in, its hash says. Groups of one block are not exploded.
        """
        sizes = members.groupBy("sig").agg(F.ceil(F.sum(load) / most).cast("int").alias("n"), F.count("*").alias("k")).filter("k > 1").drop("k")
        placed = members.join(sizes, "sig").withColumn("block", F.pmod(F.xxhash64("doc"), F.col("n")).cast("int"))
        others = F.when(F.col("n") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("n") - 1))
        placed = placed.withColumn("other", F.explode(others))
        rest = [c for c in members.columns if c != "sig"]
        return placed.select("sig", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", *rest)

    def unlike(self, groups: DataFrame) -> DataFrame:
        """``groups`` (sig, doc, ..) without those that have the same members as another: these are compared once."""
        alike = groups.groupBy("sig").agg(F.count("*").alias("k"), *(F.bit_xor(F.xxhash64("doc", F.lit(i))).alias(f"h{i}") for i in (0, 1)))
        return groups.join(alike.groupBy("k", "h0", "h1").agg(F.min("sig").alias("sig")).select("sig"), "sig")

    def completed(self, groups: DataFrame) -> DataFrame:
        """Links (a, b) that join what can be joined of these groups (sig, doc, component) of several components."""
        # sketches and sets join rows that have their blocks, and are shuffled to these alone
        groups = self.kept(self.unlike(groups), "unlike")
        facts = self.facts(self.kept(groups.select("doc").distinct(), "ids"))
        by_block = ("sig", "x", "y")
        rows = self.blocks(groups.withColumn("one", F.lit(1)), "one", BLOCK).drop("one").join(facts.select("doc", "size", "sketch"), "doc")
        rows = rows.select(*by_block, "block", "doc", "component", "size", "sketch")
        left = rows.repartition(*by_block).sortWithinPartitions(*by_block).mapInArrow(_hopeful(self.num, self.den), "sig long, doc long, component long")
        left = self.kept(self.unlike(self.kept(left.distinct(), "hopeful")), "unlike")
        facts = self.those(facts, left.select("doc"))
        rows = self.blocks(left.join(facts.select("doc", (F.col("size") * 8).alias("bytes")), "doc"), "bytes", BLOCK_BYTES).drop("bytes").join(facts.select("doc", "set"), "doc")
        rows = rows.select(*by_block, "block", "doc", "component", "set")
        return rows.repartition(*by_block).sortWithinPartitions(*by_block).mapInArrow(_uniting(self.num, self.den), "a long, b long").distinct()

    def linked(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(classes, links between class representatives, components of the representatives)."""
        classes = written(self.classes(), "classes")
        others = classes.filter("class is null or class <> doc").select("doc")
        sets = self.docs.join(small_keys(others), "doc", "left_anti")
        signed_docs = sets.mapInArrow(_signed_rows(self.n, self.num, self.den), "sig long, doc long, head long")
        # rows that know their head need no meeting: dealt out by document, they make no hot key
        met = signed_docs.repartition("sig", F.when(F.col("head").isNotNull(), F.col("doc"))).sortWithinPartitions("sig", "doc")
        met = self.kept(met.mapInArrow(_paired, "sig long, a long, b long"), "met")
        links = written(self.verified(met.filter("sig is null").select("a", "b")), "links")
        comps = written(components(links), "components")
        groups = met.filter("sig is not null").select("sig", F.col("a").alias("doc")).distinct()
        named = groups.join(comps.withColumnRenamed("node", "doc"), "doc", "left").withColumn("component", F.coalesce("component", "doc"))
        split = named.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y")
        split = self.kept(named.join(split.select("sig"), "sig"), "groups")
        if not split.isEmpty():
            links = written(links.union(self.completed(split)), "links")
            comps = written(components(links), "components")
        discard(*self.used)
        self.used.clear()
        return classes, links, comps


def jaccard_components(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document; the smallest id of a component names it.

    Null or empty texts have no shingles, link with nothing and are components
    of their own; so are rows without an id (component null). A doc_id names
    one text: rows that repeat it come back as often, with one component.
    Other columns of ``docs`` are not read. An empty table gives no rows.
    """
    join = JaccardJoin(docs, n, num, den, id_column, text_column)
    classes, _, comps = join.linked()
    named = classes.join(comps.select(F.col("node").alias("class"), "component"), "class", "left")
    named = named.select(F.col("doc").alias(id_column), F.col("size").alias("n_shingles"), F.coalesce("component", "class", "doc").alias("component_id"))
    nameless = docs.filter(F.col(id_column).isNull()).select(F.col(id_column).cast("long"), set_keys(n)(F.col(text_column).cast("string")).getField("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return named.union(nameless)
