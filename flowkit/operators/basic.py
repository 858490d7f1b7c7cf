"""The transforms of a pipeline: projection, rows, aggregation and free SQL over named inputs."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ConfigError
from ..schema import require, same_shape


#: Spark's limit to the rows of a recursive query.
RECURSION_ROWS = "spark.sql.cteRecursionRowLimit"


def name(column: str) -> Column:
    """The column of exactly this name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def stack(inputs: dict[str, DataFrame]) -> DataFrame:
    """All rows of inputs of one shape, by position."""
    if not inputs:
        raise ConfigError("no input")
    same_shape(inputs)
    return reduce(DataFrame.union, inputs.values())


def select(df: DataFrame, columns: list[str]) -> DataFrame:
    """These columns in this order."""
    if not columns:
        raise ConfigError("select needs a column")
    require(df, columns)
    return df.select(*map(name, columns))


def rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Old to new names, all at once (names may be swapped); positions stay."""
    require(df, columns)
    return df.select(*(name(c).alias(columns.get(c, c)) for c in df.columns))


def where(df: DataFrame, predicate: str) -> DataFrame:
    """Rows for which the SQL predicate is true, not null."""
    return df.filter(F.expr(predicate))


def derive(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """New columns from SQL expressions, appended by name; they see the input, not each other."""
    if taken := sorted({c for c in columns if c in df.columns}):
        raise ConfigError(f"columns exist already: {', '.join(taken)}")
    for e in columns.values():
        df.select(F.expr(e))  # fails unless the input alone resolves it: Spark would also take a sibling's name
    return df.withColumns({c: F.expr(e) for c, e in sorted(columns.items())})


def aggregate(df: DataFrame, aggregates: dict[str, str], group_by: list[str] | None = None) -> DataFrame:
    """Group columns as written, then aggregates by alias; without groups one row, also of no input."""
    if not aggregates:
        raise ConfigError("aggregate needs an aggregate")
    require(df, group_by or [])
    made = [F.expr(e).alias(a) for a, e in sorted(aggregates.items())]
    return df.groupBy(*map(name, group_by)).agg(*made) if group_by else df.agg(*made)


def limit(df: DataFrame, rows: int, order_by: list[Column] | None = None) -> DataFrame:
    """Some ``rows`` rows; the first ones only if an order is given."""
    if rows < 0:
        raise ConfigError("rows must be 0 or more")
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def sql(inputs: dict[str, DataFrame], query: str, table: str = "input") -> DataFrame:
    """A query over the inputs by name; a lone input is also called ``table``.

    The text must be a query. Views exist only while it is analysed. A recursive
    one may give any number of rows: Spark would stop at a million, unless the
    session says otherwise. Its limit of levels still ends what never ends.
    """
    if not inputs:
        raise ConfigError("sql needs an input")
    spark = next(iter(inputs.values())).sparkSession
    views = dict(inputs)
    if len(inputs) == 1:
        views.setdefault(table, next(iter(inputs.values())))
    if query.lstrip(" \n(").split(None, 1)[0].lower() not in ("select", "with", "values", "from", "table"):
        raise ConfigError("only queries are accepted")
    before = {v.name for v in spark.catalog.listTables() if v.isTemporary}
    if clash := before & set(views):
        raise ConfigError(f"temporary views exist already: {', '.join(sorted(clash))}")
    try:
        if re.search(r"\brecursive\b", query, re.I) and RECURSION_ROWS not in spark.conf.getAll:
            spark.conf.set(RECURSION_ROWS, "-1")  # read when a job starts, so it stays
        for view, df in views.items():
            df.createOrReplaceTempView(f"`{view}`")
        found = spark.sql(query)
    finally:
        for view in views:
            spark.catalog.dropTempView(view)
    return found
