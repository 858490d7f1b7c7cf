"""Tables, and queries stated as SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators.basic import sql
from ..session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, names: str) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names.split()}


def stated(names: str, text: str) -> Query:
    """A query of free SQL over these tables as ports."""
    return lambda spark, sf_dir: sql(tables(spark, sf_dir, names), text)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that the cluster shares."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
