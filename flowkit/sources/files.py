"""CSV and Parquet files, generated rows and rows from memory."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from ..errors import ConfigError
from ..operators.basic import select
from ..schema import widened
from .records import broken_records, header


def one_character(delimiter: str) -> str:
    if len(delimiter) != 1 or not delimiter.isascii():
        raise ConfigError(f"delimiter must be one ASCII character, not {delimiter!r}")
    return delimiter


def csv(spark: SparkSession, path: str, has_header: bool = True, delimiter: str = ",", infer_rows: int = 1000, line_breaks: bool = True) -> DataFrame:
    """CSV files as RFC 4180 has them: quotes within quotes are doubled, quoted fields may hold line breaks and delimiters.

    Types come from the first ``infer_rows`` records (0: all); a record that does
    not fit them fails the read. An empty field is null, a quoted one an empty
    text; blanks are kept; blank lines are no records. Every file has the header
    if ``has_header``. Line breaks are looked for in a pass over the files; where
    there are any, splits are still read in parallel. ``line_breaks`` off saves
    that pass for files known to have none. A file of no records has text columns.
    """
    options = {"sep": one_character(delimiter), "escape": '"'}
    broken = broken_records(spark, path, has_header, delimiter) if line_breaks else None
    if broken is None:
        options["header"] = str(has_header).lower()
        if infer_rows:
            sample = spark.read.options(**options).option("inferSchema", "true").csv(_first(spark.read.text(path), infer_rows + has_header))
        else:
            sample = spark.read.options(**options).option("inferSchema", "true").csv(path)
    else:
        head = _first(broken, infer_rows) if infer_rows else broken.rdd.map(lambda r: r[0])
        sample = spark.read.options(**options).option("inferSchema", "true").csv(head)
        if has_header:
            names = _distinct(header(spark, path, delimiter))
            sample = sample.toDF(*names) if sample.columns else spark.createDataFrame([], StructType([StructField(n, StringType()) for n in names]))
    if not has_header:
        sample = sample.toDF(*(f"column_{i + 1}" for i in range(len(sample.columns))))
    schema = widened(sample).schema
    # read as text, since only text columns tell an empty text from null; "mode" still refuses records of another width
    options |= {"mode": "FAILFAST", "nullValue": _NO_TEXT, "emptyValue": ""}
    texts = StructType([StructField(f"c{i}", StringType()) for i in range(len(schema))])
    if broken is None:
        rows = spark.read.options(**options).option("enforceSchema", "true").schema(texts).csv(path)
    else:
        rows = broken.filter(F.trim("record") != "").select(F.from_csv("record", ", ".join(f"{n} string" for n in texts.names), options).alias("r")).select("r.*")
    return rows.select(*(_typed(c, f.dataType).alias(f.name) for c, f in zip(texts.names, schema, strict=True)))


def _first(lines: DataFrame, n: int) -> RDD[str]:
    """The first ``n`` lines in the order of their splits. The driver holds them: a limit within a plan shuffles, and takes lines of any split first."""
    return lines.sparkSession.sparkContext.parallelize([r[0] for r in lines.take(n)], 1)


#: Stands for null where a text can not be empty and null at once; no field is this.
_NO_TEXT = "\x00\x01null"


def _typed(column: str, kind: DataType) -> Column:
    return F.col(column) if isinstance(kind, StringType) else F.nullif(F.col(column), F.lit("")).cast(kind)


def _distinct(names: list[str]) -> list[str]:
    """Empty names become _c and their place; names that differ in case alone at most get their place too."""
    lower = [n.lower() for n in names]
    return [f"_c{i}" if not n else f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet files; ``columns`` projects in the requested order, and only those are read."""
    df = spark.read.parquet(path)
    return select(df, columns) if columns else df


def generator(spark: SparkSession, rows: int, with_text: bool = True) -> DataFrame:
    """id = 0 .. rows-1, value = id * 1.5 and, with text, label = "row-" + id."""
    df = spark.range(rows).select("id", (F.col("id") * 1.5).alias("value"))
    return df.withColumn("label", F.concat(F.lit("row-"), F.col("id").cast("string"))) if with_text else df


def memory(spark: SparkSession, data: pa.Table | pd.DataFrame) -> DataFrame:
    """Rows that the caller holds."""
    return spark.createDataFrame(data)
