"""Declared schemas, checks of columns and of schema equality."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import ConfigError

# Type names that a declared schema may use.
TYPES = {
    **dict.fromkeys(("int64", "bigint", "long"), T.LongType()),
    **dict.fromkeys(("int32", "int", "integer"), T.IntegerType()),
    **dict.fromkeys(("float64", "double"), T.DoubleType()),
    **dict.fromkeys(("float32", "float"), T.FloatType()),
    **dict.fromkeys(("utf8", "string", "text"), T.StringType()),
    **dict.fromkeys(("bool", "boolean"), T.BooleanType()),
    "date": T.DateType(),
    "timestamp": T.TimestampNTZType(),
}


def declared(columns: Iterable[dict]) -> T.StructType:
    """[{name, type, nullable=True}] as a schema, in that order."""
    fields = []
    for c in columns:
        if unknown := set(c) - {"name", "type", "nullable"}:
            raise ConfigError(f"unknown keys in a declared column: {', '.join(sorted(unknown))}")
        if c["type"] not in TYPES:
            raise ConfigError(f"column {c['name']}: unknown type {c['type']!r}; known are {', '.join(TYPES)}")
        fields.append(T.StructField(c["name"], TYPES[c["type"]], c.get("nullable", True)))
    return T.StructType(fields)


def require(df: DataFrame, columns: Iterable[str]) -> None:
    """Raise unless every column exists, by its exact name."""
    if absent := [c for c in columns if c not in df.columns]:
        raise ConfigError(f"no column {', '.join(absent)}; there are {', '.join(df.columns)}")


def shape(df: DataFrame) -> list[tuple[str, str]]:
    """Names and types; whether a column may be null is advice that file sources drop."""
    return [(f.name, f.dataType.simpleString()) for f in df.schema]


def same_shape(frames: dict[str, DataFrame]) -> None:
    """Raise unless all inputs have the same columns in the same order."""
    first, *rest = frames
    for name in rest:
        if shape(frames[name]) != shape(frames[first]):
            raise ConfigError(f"inputs {first!r} and {name!r} differ: {shape(frames[first])} and {shape(frames[name])}")


def widened(df: DataFrame) -> DataFrame:
    """Inferred INT columns as LONG."""
    return df.select(*(F.col(f"`{f.name}`").cast("long").alias(f.name) if isinstance(f.dataType, T.IntegerType) else F.col(f"`{f.name}`") for f in df.schema))
