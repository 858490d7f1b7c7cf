"""JSON payload columns: records out of them, values at a path, and rows into them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .basic import name
from ..errors import ConfigError


def _steps(path: str) -> list[str]:
    return [p for p in path.split(".") if p]


def json_path(path: str) -> str:
    """A dotted path as a JSON path; empty parts count for nothing."""
    return "$" + "".join("['" + p.replace("'", "\\'") + "']" for p in _steps(path))


def json_records(df: DataFrame, column: str, path: str, schema: T.StructType, keep: list[str] | None = None, on_error: str = "fail") -> DataFrame:
    """A row for each record of the list at ``path`` in the payloads, with ``keep`` columns beside it.

    A null list or a null payload gives no rows. An absent path or a value that
    is no list fails with the payload's beginning, or drops the payload if
    ``on_error`` is "drop". Records are read with ``schema``; missing fields are null.
    """
    if on_error not in ("fail", "drop"):
        raise ConfigError("on_error must be fail or drop")
    payload = F.try_parse_json(name(column))
    found = F.try_variant_get(payload, json_path(path), "variant")
    kind = F.schema_of_variant(found)
    fine = kind.isNotNull() & (F.startswith(kind, F.lit("ARRAY")) | (kind == "VOID"))
    problem = F.concat(F.lit(f"no list at {path!r}; the payload begins "), F.substring(name(column), 1, 200))
    text = F.to_json(F.try_variant_get(found, "$", "array<variant>"))
    text = F.when(name(column).isNull() | (fine & (kind == "VOID")), F.lit(None)).when(fine, text)
    text = text.otherwise(F.lit(None) if on_error == "drop" else F.raise_error(problem).cast("string"))
    rows = df.select(*map(name, keep or []), F.explode(F.from_json(text, T.ArrayType(schema))).alias("__record"))
    return rows.select(*map(name, keep or []), "__record.*")


def json_string_at(column: str, path: str) -> Column:
    """A string or number at ``path`` as text, else null."""
    value = F.try_variant_get(F.try_parse_json(name(column)), json_path(path), "variant")
    kind = F.schema_of_variant(value)
    scalar = kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(scalar, F.try_variant_get(value, "$", "string"))


def infer_schema(df: DataFrame, column: str, sample_rows: int | None = 1000) -> T.StructType:
    """The schema of JSON objects in a column, from at most ``sample_rows`` of them (None: all, in one distributed pass)."""
    lines = df.select(name(column).alias("line")).filter("line is not null")
    if sample_rows is not None:
        lines = lines.limit(sample_rows)
    return df.sparkSession.read.json(lines.rdd.map(lambda r: r.line)).schema


def json_chunks(df: DataFrame, rows: int, order_by: list[str], keys: list[str] | None = None, form: str = "json_array", wrap_in: str | None = None) -> DataFrame:
    """(keys, chunk, n_rows, body): rows as JSON arrays, wrapped arrays or lines, ``rows`` of a key to a chunk.

    Rows are numbered within their key, so chunks form in parallel; a chunk
    holds ``rows`` rows at most, whatever the key's size.
    """
    if form not in ("json_array", "ndjson") or wrap_in and form == "ndjson":
        raise ConfigError("form must be json_array or ndjson; lines cannot be wrapped")
    from pyspark.sql.window import Window

    keys = keys or []
    numbered = df.select(*map(name, keys), F.row_number().over(Window.partitionBy(*map(name, keys)).orderBy(*map(name, order_by))).alias("__n"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("__line"))
    grouped = numbered.groupBy(*map(name, keys), F.floor((F.col("__n") - 1) / rows).alias("chunk")).agg(F.count("*").alias("n_rows"), F.sort_array(F.collect_list(F.struct("__n", "__line"))).alias("__rows"))
    lines = F.transform("__rows", lambda r: r["__line"])
    text = F.concat(F.array_join(lines, "\n"), F.lit("\n")) if form == "ndjson" else F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))
    text = F.concat(F.lit(f'{{"{wrap_in}":'), text, F.lit("}")) if wrap_in else text
    return grouped.select(*map(name, keys), "chunk", "n_rows", text.alias("body"))
