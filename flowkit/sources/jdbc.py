"""Database tables and queries over JDBC."""

from __future__ import annotations

import datetime
import decimal
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..operators.basic import select, where


def jdbc(
    spark: SparkSession,
    url: str,
    query: str | None = None,
    table: str | None = None,
    columns: list[str] | None = None,
    predicate: str | None = None,
    fetch_size: int = 10_000,
    split_by: tuple[str, object, object, int] | tuple[str, int] | None = None,
    sample: str | None = None,
    exact_numbers: list[str] | None = None,
    options: dict[str, str] | None = None,
) -> DataFrame:
    """A query, or a table with ``columns`` and a ``predicate``; Spark pushes both to the database.

    ``split_by`` is (column, lower, upper, partitions) for a parallel read of a
    table in equal spans, or (column, partitions) for one in parts of about equal
    numbers of rows, whatever the column's spread; see ``even_parts``.
    ``exact_numbers`` are numeric columns to carry as text.
    """
    if (query is None) == (table is None):
        raise ConfigError("give a query or a table")
    if query is not None and (columns or predicate or split_by):
        raise ConfigError("columns, predicate and split_by go with a table")
    if sample is not None and (split_by is None or len(split_by) != 2):
        raise ConfigError("sample goes with split_by=(column, partitions)")
    read = spark.read.format("jdbc").options(url=url, fetchsize=fetch_size, **(options or {}))
    if exact_numbers:
        read = read.option("customSchema", ", ".join(f"{c} STRING" for c in exact_numbers))
    if query is not None:
        return read.option("query", query).load()
    if split_by and len(split_by) == 2:
        parts = even_parts(spark, url, table, *split_by, sample, fetch_size, options)
        properties = {k: str(v) for k, v in (options or {}).items()} | {"fetchsize": str(fetch_size)}
        df = read.jdbc(url, table, predicates=parts, properties=properties)
    elif split_by:
        column, lower, upper, parts = split_by
        read = read.options(partitionColumn=column, lowerBound=str(lower), upperBound=str(upper), numPartitions=parts)
        df = read.option("dbtable", table).load()
    else:
        df = read.option("dbtable", table).load()
    df = where(df, predicate) if predicate else df
    return select(df, columns) if columns else df


def _literal(spark: SparkSession, url: str, value: object) -> str:
    """A number, date or time in the database's words, as Spark has them when it pushes a filter down."""
    sql = spark._jvm.java.sql
    if isinstance(value, datetime.datetime):
        value = sql.Timestamp.valueOf(value.isoformat(sep=" "))
    elif isinstance(value, datetime.date):
        value = sql.Date.valueOf(value.isoformat())
    elif isinstance(value, decimal.Decimal):
        return f"{value:f}"
    return str(spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).compileValue(value))


def even_parts(spark: SparkSession, url: str, table: str, column: str, parts: int, sample: str | None = None, fetch_size: int = 10_000, options: dict[str, str] | None = None) -> list[str]:
    """Conditions that cut a table into at most ``parts`` parts of about equal numbers of rows; each row meets one.

    Borders are quantiles of ``sample``, a query in the database's own words that
    gives the column of some rows; without it the column alone is read, in
    ``parts`` equal spans, and Spark takes the quantiles. Nulls go with the first
    part. A value that many rows share stays in one part, so there may be fewer.
    The column is a number, a date or a time; of text, give ``split_by`` another column.
    """
    if parts < 1:
        raise ConfigError("parts must be 1 or more")
    quoted = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(column)
    read = lambda: spark.read.format("jdbc").options(url=url, fetchsize=fetch_size, **(options or {}))  # noqa: E731 (a reader keeps its options)
    one = read().option("query", f"SELECT {quoted} FROM {table} WHERE 1 = 0").load().schema[0]
    if not isinstance(one.dataType, T.NumericType | T.DateType | T.TimestampType | T.TimestampNTZType):
        raise ConfigError(f"{column} is neither a number nor a date nor a time")
    if sample is not None:
        values = read().option("query", sample).load()
    else:
        least, most = read().option("query", f"SELECT MIN({quoted}) AS least, MAX({quoted}) AS most FROM {table}").load().first()
        if least is None:
            return ["1 = 1"]
        values = read().option("dbtable", f"(SELECT {quoted} FROM {table}) t")
        if least != most and parts > 1 and not isinstance(one.dataType, T.FractionalType):
            values = values.options(partitionColumn=column, lowerBound=str(least), upperBound=str(most), numPartitions=parts)
        values = values.load()
    value = F.col(f"`{values.columns[0]}`")
    if isinstance(one.dataType, T.TimestampNTZType):
        value = value.cast("timestamp")
    cuts = values.agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 100 * parts)).first()[0] if parts > 1 else None
    borders = sorted({c for c in cuts or [] if not isinstance(c, float) or math.isfinite(c)})
    if not borders:
        return ["1 = 1"]
    said = [_literal(spark, url, b) for b in borders]
    inner = [f"{quoted} >= {a} AND {quoted} < {b}" for a, b in zip(said, said[1:], strict=False)]
    return [f"{quoted} < {said[0]} OR {quoted} IS NULL", *inner, f"{quoted} >= {said[-1]}"]
