"""Files published all or nothing, dry runs and small results in memory."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..errors import ConfigError
from ..sources.files import one_character

CODECS = {"snappy": "snappy", "zstd": "zstd", "gzip": "gzip", "lz4": "lz4", "none": "uncompressed"}


def publish(spark: SparkSession, path: str, write: Callable[[str], None], create_dirs: bool = True) -> None:
    """Let ``write`` fill a folder beside ``path``, then put it in place of what was there.

    If writing fails, the old result stays and the new one is removed. A folder
    cannot be renamed over another in one step: between two renames there is no
    result for a moment. Stores without a rename of folders copy instead.
    """
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    parent = target.getParent()
    if not create_dirs and parent is not None and not files.exists(parent):
        raise ConfigError(f"folder {parent} does not exist")
    run = uuid.uuid4().hex[:12]
    fresh, old = (jvm.org.apache.hadoop.fs.Path(parent, f".{target.getName()}.{what}-{run}") for what in ("tmp", "old"))
    try:
        write(fresh.toString())
        replaced = files.exists(target)
        if replaced and not files.rename(target, old):
            raise OSError(f"{path} could not be moved away")
        if not files.rename(fresh, target):
            if replaced:
                files.rename(old, target)
            raise OSError(f"{path} could not be put in place")
        if replaced:
            files.delete(old, True)
    except BaseException:
        files.delete(fresh, True)
        raise


def csv(df: DataFrame, path: str, has_header: bool = True, delimiter: str = ",", create_dirs: bool = True, single_file: bool = False) -> None:
    """A folder of CSV files, or of one file if ``single_file``, as RFC 4180 has them.

    Null is an empty field, an empty text is quoted; quotes are doubled; fields
    with quotes, delimiters or line breaks are quoted; blanks are kept.
    """
    df = df.coalesce(1) if single_file else df
    options = {"header": str(has_header).lower(), "sep": one_character(delimiter), "emptyValue": '""', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    publish(df.sparkSession, path, lambda to: df.write.options(**options).csv(to), create_dirs)


def parquet(df: DataFrame, path: str, compression: str = "snappy", create_dirs: bool = True, row_group_bytes: int | None = None, partition_by: list[str] | None = None) -> None:
    """A folder of Parquet files; also of no rows it keeps the schema."""
    if compression not in CODECS:
        raise ConfigError(f"compression must be one of {', '.join(CODECS)}")

    def write(to: str) -> None:
        out = df.write.option("compression", CODECS[compression])
        out = out.option("parquet.block.size", row_group_bytes) if row_group_bytes else out
        (out.partitionBy(*partition_by) if partition_by else out).parquet(to)

    publish(df.sparkSession, path, write, create_dirs)


def null(df: DataFrame) -> None:
    """Compute every row and keep none."""
    df.write.format("noop").mode("overwrite").save()


def memory(df: DataFrame) -> pa.Table:
    """A small result as an Arrow table."""
    return df.toArrow()
