"""Functions that other SQL dialects have under another name, as Spark columns.

The rest of the library speaks Spark SQL. Where the meaning differs, this is
the way: ``/`` divides integers exactly (int_div cuts), ASC puts nulls first
(ascending and descending give the other order), day_of_week counts from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of other dialects and Spark's.
NAMES = {
    "strpos": "instr",
    "regexp_match": "regexp_extract",
    "make_array": "array",
    "array_length": "size",
    "array_has": "array_contains",
    "array_to_string": "array_join",
    "unnest": "explode",
    "generate_series": "sequence",
    "to_timestamp_micros": "timestamp_micros",
    "approx_distinct": "approx_count_distinct",
    "arg_max": "max_by",
    "arg_min": "min_by",
    "sha256": "sha2(x, 256)",
}


def strpos(text: Column, part: str) -> Column:
    return F.instr(text, part)


def int_div(a: Column, b: Column) -> Column:
    """Integer division, cut towards zero; null where ``b`` is 0."""
    return F.when(b != 0, (a - a % b) / b).cast("long")


def date_bin(width_us: int, at: Column, origin: str = "1970-01-01 00:00:00") -> Column:
    """The start of the bin of ``width_us`` microseconds that holds a timestamp without zone."""
    start = F.lit(origin).cast("timestamp_ntz")
    gone = F.timestamp_diff("MICROSECOND", start, at)
    return F.timestamp_add("MICROSECOND", gone - F.pmod(gone, F.lit(width_us)), start)


def micros(at: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def at_micros(us: Column) -> Column:
    """The timestamp without zone of these microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def day_of_week(at: Column) -> Column:
    """0 for Sunday to 6."""
    return F.dayofweek(at) - 1


def ascending(column: str) -> Column:
    return F.col(column).asc_nulls_last()


def descending(column: str) -> Column:
    return F.col(column).desc_nulls_first()
