"""Upserts and deletes in a folder of Parquet files that write again only the files they touch.

The new files are made in a hidden folder inside the table. A journal, put in
place by one rename, then says which files come and which go; moving and
deleting follow it and can be repeated. A driver that dies before the journal
leaves the old table, one that dies after it a table that ``recover`` completes;
every call here begins with that. Readers between the journal and the end may
see rows of a touched file twice. One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import ConfigError
from ..operators.basic import name
from ..operators.keysets import of_keys, written
from .files import parquet

STAGING, JOURNAL = "_change-", "_journal-"
#: Types whose smallest and largest values Parquet keeps for each part of a file.
ORDERED = (T.IntegralType, T.DateType, T.TimestampType, T.StringType, T.DecimalType)


class _Folder:
    """A folder of the session's file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.Path = spark, spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = self.fs.makeQualified(self.Path(path)).toString()

    def at(self, *parts: str):
        out = self.Path(self.path)
        for p in parts:
            out = self.Path(out, p)
        return out

    def names(self, *parts: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(*parts)))

    def exists(self, *parts: str) -> bool:
        return self.fs.exists(self.at(*parts))

    def read(self, *parts: str) -> str:
        stream = self.fs.open(self.at(*parts))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, text: str, *parts: str) -> None:
        stream = self.fs.create(self.at(*parts), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()


def recover(spark: SparkSession, path: str) -> None:
    """Complete what a journal says, or remove what was made without one; nothing to do for a whole table."""
    folder = _Folder(spark, path)
    if not folder.exists():
        return
    for journal in (n for n in folder.names() if n.startswith(JOURNAL)):
        said = json.loads(folder.read(journal))
        for n in said["come"]:
            if folder.exists(said["from"], n) and not folder.fs.rename(folder.at(said["from"], n), folder.at(n)):
                raise OSError(f"{n} could not be moved into {path}")
        for n in said["go"]:
            folder.fs.delete(folder.at(n), False)
        folder.fs.delete(folder.at(journal), False)
    for n in folder.names():
        if n.startswith(STAGING):
            folder.fs.delete(folder.at(n), True)


def _replace(spark: SparkSession, path: str, go: list[str], rows: DataFrame | None) -> None:
    """Put files of ``rows`` in place of the files ``go``."""
    folder, run = _Folder(spark, path), uuid.uuid4().hex[:12]
    staging, come = f"{STAGING}{run}", []
    if rows is not None:
        rows.write.parquet(folder.at(staging).toString())
        come = [n for n in folder.names(staging) if n.endswith(".parquet")]
    else:
        folder.fs.mkdirs(folder.at(staging))
    folder.write(json.dumps({"from": staging, "come": come, "go": go}), staging, "_journal")
    if not folder.fs.rename(folder.at(staging, "_journal"), folder.at(f"{JOURNAL}{run}")):
        raise OSError(f"the change of {path} could not be put in place")
    recover(spark, path)


def _files(spark: SparkSession, path: str, found: DataFrame) -> list[str]:
    """Names of the files that ``found`` (file) holds; a driver that reads a folder has their list in any case."""
    folder, names = _Folder(spark, path), []
    for (file,) in found.distinct().collect():
        at = folder.Path(unquote(file))
        if at.getParent().toUri().getPath() != folder.at().toUri().getPath():
            raise ConfigError(f"{path} has folders in it: only a folder of files can be changed in place")
        names.append(at.getName())
    return sorted(names)


def _of(spark: SparkSession, path: str, names: list[str], schema: T.StructType) -> DataFrame:
    folder = _Folder(spark, path)
    return spark.read.schema(schema).parquet(*(folder.at(n).toString() for n in names))


def upsert(df: DataFrame, path: str, keys: list[str]) -> list[str]:
    """Put the rows of ``df`` in place of those of the same ``keys``; the names of the files that were written again.

    As ``history.upsert``: all rows of ``df`` are kept, and a null key replaces
    nothing. Only keys are read to find the files, and of those only what lies
    between the smallest and the largest new key. Columns are cast to the table's
    types; columns that it does not have, or that ``df`` lacks, are an error. A
    table that does not exist is created; no new rows change nothing.
    """
    spark = df.sparkSession
    if not _Folder(spark, path).exists():
        parquet(df, path)
        return []
    recover(spark, path)
    stored = spark.read.parquet(path)
    if sorted(df.columns) != sorted(stored.columns) or not set(keys) <= set(df.columns):
        raise ConfigError(f"{path} has the columns {', '.join(stored.columns)}")
    fresh = written(df.select(*(name(f.name).cast(f.dataType).alias(f.name) for f in stored.schema)), "fresh")
    if fresh.isEmpty():
        return []
    changed = written(fresh.select(*map(name, keys)).distinct(), "changed")
    held = stored.select(*map(name, keys), F.col("_metadata.file_path").alias("__file"))
    ends = [k for k in keys if isinstance(stored.schema[k].dataType, ORDERED)]
    if ends:
        row = changed.agg(*(e for k in ends for e in (F.min(name(k)), F.max(name(k))))).first()
        for i, k in enumerate(ends):
            if row[2 * i] is not None:
                held = held.filter(name(k).between(row[2 * i], row[2 * i + 1]))
    names = _files(spark, path, of_keys(held, changed, keys).select("__file"))
    rows = of_keys(_of(spark, path, names, stored.schema), changed, keys, "left_anti").unionByName(fresh) if names else fresh
    _replace(spark, path, names, rows)
    return names


def keep(spark: SparkSession, path: str, condition: Column | str) -> list[str]:
    """Keep the rows for which ``condition`` is true; the names of the files that were written again or deleted.

    Only files with a row to go are touched. A table of which no row is left keeps an empty file.
    """
    recover(spark, path)
    stored = spark.read.parquet(path)
    true = F.coalesce(F.expr(condition) if isinstance(condition, str) else condition, F.lit(False))
    names = _files(spark, path, stored.filter(~true).select(F.col("_metadata.file_path").alias("__file")))
    if names:
        _replace(spark, path, names, _of(spark, path, names, stored.schema).filter(true))
    return names
