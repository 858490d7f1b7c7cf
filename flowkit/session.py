"""A session with the settings that the operators count on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .errors import ConfigError

SETTINGS = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def session(name: str = "flowkit", **settings: str) -> SparkSession:
    """The active session, or a new one with SETTINGS; ``settings`` go last."""
    return SparkSession.builder.appName(name).config(map=SETTINGS | settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster shares. Only a local session may do without one, and gets one of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ConfigError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="flowkit-"))
    return sc.getCheckpointDir()
