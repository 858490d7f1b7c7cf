"""Rows by a set of keys that is found first, so that wide rows are shuffled only where they are wanted."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .basic import name
from .selection import _written as written

__all__ = ["of_keys", "written"]

#: Key sets of at most this many rows are broadcast; larger ones are joined by a shuffle.
FEW = 500_000


def of_keys(df: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi", few: int = FEW, nulls: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``on`` is in ``keys``, or with ``left_anti`` those whose is not.

    ``keys`` is a written table, counted here: up to ``few`` rows it is broadcast
    and ``df`` is not shuffled. Null keys are in no set, unless ``nulls``.
    """
    run = uuid.uuid4().hex[:8]
    other = keys.select(*(name(k).alias(f"{k}_{run}") for k in on))
    other = F.broadcast(other) if keys.count() <= few else other
    same = F.lit(True)
    for k in on:
        one = name(f"{k}_{run}")
        same = same & (name(k).eqNullSafe(one) if nulls else name(k) == one)
    return df.join(other, same, how)
