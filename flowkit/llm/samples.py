"""Bounded, labelled samples for the classifiers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that a classifier is fitted on, and the longest text among them.
PER_CLASS = 3000
LONGEST = 49_152


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int = PER_CLASS, longest: int = LONGEST) -> tuple[pa.Table, dict[int, int]]:
    """(text, y, part) of at most ``per_class`` labelled rows of each class, and the class sizes over all labels.

    Rows are taken in the order of a hash of doc_id among those for which
    ``learn`` holds and whose text has at most ``longest`` bytes; part is
    a second hash, 0 to 9. A document with several labels counts with the largest.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & learn).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    order = F.xxhash64("doc_id", F.lit(7))
    picked = [known.filter(F.col("y") == y).orderBy(order, "doc_id").limit(per_class) for y in (0, 1)]
    ids = F.broadcast(picked[0].union(picked[1]))  # 2 * per_class rows
    found = docs.select("doc_id", "text").filter(F.octet_length(F.coalesce("text", F.lit(""))) <= longest).join(ids, "doc_id")
    found = found.select(F.coalesce("text", F.lit("")).alias("text"), "y", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(10)).alias("part"), "doc_id")
    return found.orderBy(order, "doc_id").limit(2 * per_class).select("text", "y", "part").toArrow(), sizes


def row_weights(y, sizes: dict[int, int]):
    """Weights that give the sampled classes their shares among all labels."""
    import numpy as np

    drawn = np.bincount(y, minlength=2)
    known = np.array([max(sizes.get(0, 1), 1), max(sizes.get(1, 1), 1)], float)
    return (known / known.sum() / np.maximum(drawn / max(len(y), 1), 1e-9))[y]
