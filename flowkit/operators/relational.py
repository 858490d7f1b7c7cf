"""Relational operators that Spark SQL has no direct form for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def right_semi(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``right`` with a match in ``left``."""
    return right.join(left, on, "left_semi")


def right_anti(left: DataFrame, right: DataFrame, on) -> DataFrame:
    """Rows of ``right`` without a match in ``left``."""
    return right.join(left, on, "left_anti")


def mark(left: DataFrame, right: DataFrame, keys: list[str], flag: str = "matched") -> DataFrame:
    """``left`` with a flag that tells whether ``right`` has its keys; rows are not multiplied."""
    known = right.select(*keys).distinct().withColumn(flag, F.lit(True))
    return left.join(known, keys, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def distinct_on(df: DataFrame, keys: list[str], order_by: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return top_per_group(df, keys, order_by, 1)


def top_per_group(df: DataFrame, keys: list[str], order_by: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key; Spark prunes groups before it shuffles (WindowGroupLimit)."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by))).filter(F.col("__rank") <= n).drop("__rank")


def running_total(df: DataFrame, order: str, value: Column, bucket: Column, total: str = "running") -> DataFrame:
    """(order, total): the sum of ``value`` up to each distinct ``order``, peers included.

    A window without partitions would run in one task. ``bucket`` is a monotone
    coarse form of ``order``: bucket totals are few and are accumulated alone;
    within buckets the windows run in parallel.
    """
    sums = df.groupBy(F.col(order), bucket.alias("__bucket")).agg(F.sum(value).alias("__sum"))
    totals = sums.groupBy("__bucket").agg(F.sum("__sum").alias("__all"))
    before = totals.select("__bucket", (F.sum("__all").over(Window.orderBy("__bucket")) - F.col("__all")).alias("__before"))
    inside = F.sum("__sum").over(Window.partitionBy("__bucket").orderBy(order))
    return sums.join(before, "__bucket").select(order, (F.col("__before") + inside).alias(total))


def group_frame_sum(df: DataFrame, keys: list[str], order: str, value: str, before: int, after: int, out: str) -> DataFrame:
    """A GROUPS frame: peers of ``order`` count as one step; dense ranks make it a range frame."""
    rank = F.dense_rank().over(Window.partitionBy(*keys).orderBy(order))
    frame = Window.partitionBy(*keys).orderBy("__group").rangeBetween(-before, after)
    return df.withColumn("__group", rank).withColumn(out, F.sum(value).over(frame)).drop("__group")


def same_tables(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row: how many rows are only left or only right, counting repeats, and whether none is."""
    only = [a.exceptAll(b).agg(F.count("*").alias(n)) for a, b, n in ((left, right, "only_left"), (right, left, "only_right"))]
    both = only[0].select("only_left", F.lit(0).cast("long").alias("only_right")).union(only[1].select(F.lit(0).cast("long"), "only_right"))
    return both.agg(F.sum("only_left").alias("only_left"), F.sum("only_right").alias("only_right")).withColumn("equal", (F.col("only_left") + F.col("only_right")) == 0)
