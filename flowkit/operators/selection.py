"""Exact order statistics of large groups by distributed selection, and running totals over all rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import shared_dir

#: Groups of at most this many rows are left to the built-in aggregate, which holds a group in one task.
SMALL = 10_000
#: Parts into which the span of a group's candidates is cut in a round.
PARTS = 4096


def _written(df: DataFrame, name: str) -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _same(left: str, right: str, keys: list[str]) -> Column:
    """Keys are equal, or both null."""
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def median(df: DataFrame, keys: list[str], column: str, out: str = "median", small: int = SMALL) -> DataFrame:
    """(keys, out: double): the exact median of each group; nulls do not count, a group of nothing else has null.

    Groups of at most ``small`` rows go to the built-in aggregate. Of larger
    ones, of which there are few, each round counts the candidates in PARTS
    equal parts of their span; running counts tell which parts hold the middle
    ranks, and only those stay candidates. When a group's are ``small`` or all
    equal they are counted by value. No task gets a group's values. NaN is larger
    than any number. Numbers are taken as doubles.
    """
    keys_now = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, keys_now, strict=True)), F.col(column).cast("double").alias("v"))
    sizes = rows.groupBy(*keys_now).agg(F.count("v").alias("n"))
    sizes = _written(sizes, "sizes")
    large = sizes.filter(F.col("n") > small)
    few = rows.join(large.select(*keys_now, F.lit(1).alias("l")).alias("g"), [rows[k].eqNullSafe(F.col(f"g.{k}")) for k in keys_now] or F.lit(True), "left_anti")
    found = few.groupBy(*keys_now).agg(F.median("v").alias(out))
    if not large.isEmpty():
        found = found.union(_selected(rows, large, keys_now, small).select(*keys_now, F.col("m").alias(out)))
    if not keys:  # one row of all, whichever way it went
        found = found.agg(F.max(out).alias(out))
    return found.toDF(*keys, out)


def _selected(rows: DataFrame, large: DataFrame, keys: list[str], small: int) -> DataFrame:
    """Medians of the groups ``large`` (keys, n), by narrowing their candidates."""
    # ranks from 1 of the two middle values, one for odd sizes, among the candidates; ``which`` stays what it was at first
    ranks = F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    wanted = large.select(*keys, F.explode(F.array_distinct(ranks)).alias("rank")).withColumn("which", F.col("rank"))
    joined = rows.filter("v is not null").alias("r").join(F.broadcast(large).alias("g"), _same("r", "g", keys), "left_semi")  # a row for each ``small`` rows at most
    wanted = wanted.withColumn("low", F.lit(float("-inf"))).withColumn("high", F.lit(float("nan")))
    done = None
    while True:
        # a group's candidates for a rank are its values from low to high, NaN being the largest value
        at = joined.alias("r").join(F.broadcast(wanted).alias("w"), _same("r", "w", keys) & (F.col("r.v") >= F.col("w.low")) & (F.col("r.v") <= F.col("w.high")))
        at = at.select(*(F.col(f"w.{k}").alias(k) for k in keys), "w.rank", "w.which", "r.v")
        spans = at.groupBy(*keys, "rank", "which").agg(F.min("v").alias("least"), F.max("v").alias("most"), F.count("*").alias("left"), F.max(F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))).alias("top"), F.min(F.when(~F.isnan("v") & (F.abs("v") < float("inf")), F.col("v"))).alias("base"))
        spans = _written(spans, "spans")
        ended = (F.col("left") <= small) | F.col("least").eqNullSafe(F.col("most"))
        last, going = spans.filter(ended), spans.filter(~ended)
        part = _written(_ranked(at, last, keys, F.col("a.v")), "ranked").select(*keys, F.col("cell").alias("v"))
        done = part if done is None else done.union(part)
        if going.isEmpty():
            return done.groupBy(*keys).agg(F.avg("v").alias("m"))
        # -inf, the finite ones in equal parts, inf, NaN; halves keep the span of the largest doubles finite
        width = (F.col("top") / 2 - F.col("base") / 2) / (PARTS / 2)
        cell = F.when(F.isnan("a.v"), PARTS + 3).when(F.col("a.v") == float("inf"), PARTS + 2).when(F.col("a.v") == float("-inf"), -1).when(width == 0, 0).otherwise(F.floor((F.col("a.v") / 2 - F.col("base") / 2) / (width / 2))).cast("double")
        wanted = _written(_ranked(at, going, keys, cell).select(*keys, F.col("rest").alias("rank"), "which", F.col("from").alias("low"), F.col("to").alias("high")), "wanted")


def _ranked(at: DataFrame, spans: DataFrame, keys: list[str], cell: Column) -> DataFrame:
    """(keys, cell, rest, kept, from, to): the cell of each span that holds its rank, the rank within, and the values there."""
    found = at.alias("a").join(F.broadcast(spans).alias("s"), _same("a", "s", keys) & (F.col("a.which") == F.col("s.which")))
    cells = found.select(*(F.col(f"s.{k}").alias(k) for k in keys), "s.rank", "s.which", cell.alias("cell"), "a.v").groupBy(*keys, "rank", "which", "cell").agg(F.count("*").alias("kept"), F.min("v").alias("from"), F.max("v").alias("to"))
    upto = F.sum("kept").over(Window.partitionBy(*keys, "which").orderBy("cell"))
    return cells.withColumn("upto", upto).filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("kept") < F.col("rank"))).withColumn("rest", F.col("rank") - (F.col("upto") - F.col("kept")))


def running_total(df: DataFrame, order: str, value: Column, total: str = "running", partitions: int | None = None) -> DataFrame:
    """(order, total): the sum of ``value`` up to each distinct ``order``, peers included; null orders come first, as in Spark.

    Rows are added up by ``order`` and dealt to ranges of it, which are written
    so that they stay as they are. Each range's total is a row; those are
    accumulated in one task, and within ranges windows run in parallel.
    """
    sums = df.groupBy(F.col(order)).agg(F.sum(value).alias("__sum"))
    ranged = sums.repartitionByRange(partitions, order) if partitions else sums.repartitionByRange(order)
    ranged = _written(ranged.withColumn("__range", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("__range").agg(F.sum("__sum").alias("__all"))
    before = totals.select("__range", (F.sum("__all").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1))).alias("__before"))
    inside = F.sum("__sum").over(Window.partitionBy("__range").orderBy(order))
    both = F.when(F.col("__before").isNull(), inside).when(inside.isNull(), F.col("__before")).otherwise(F.col("__before") + inside)
    return ranged.join(F.broadcast(before), "__range").select(order, both.alias(total))  # a row for each range
