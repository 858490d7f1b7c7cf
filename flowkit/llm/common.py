"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ConfigError

#: Most keys that may be broadcast: about 16 MB as a hash table of longs.
BROADCAST_KEYS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: the session's checkpoint folder. Only a local session may do without one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="flowkit-"))
    return sc.getCheckpointDir()


#: Arrow batches of texts end at 500 rows or 4 MB, so that Python workers stay small.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches where the session has no setting of its own: Spark reads it when a job starts, so it stays."""
    own = spark.conf.getAll
    for key, value in BATCHES.items():
        if key not in own:
            spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` gave and that nothing needs any more."""
    for df in tables:
        jvm, top = df.sparkSession._jvm, shared_dir(df.sparkSession)
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            if path.getParent().getName() == top.rpartition("/")[2]:
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def small_keys(keys: DataFrame, limit: int = BROADCAST_KEYS) -> DataFrame:
    """``keys`` marked for broadcast if they number at most ``limit``, else as they are (a shuffle join)."""
    return F.broadcast(keys) if keys.limit(limit + 1).count() <= limit else keys


def fold(id_column: str, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % mod


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

