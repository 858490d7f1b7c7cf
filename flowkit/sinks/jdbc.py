"""Database tables, written all or nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..errors import ConfigError
from ..operators.basic import name
from ..schema import require


def jdbc(df: DataFrame, url: str, table: str, columns: list[str] | None = None, truncate: bool = False, batch_size: int = 10_000, options: dict[str, str] | None = None) -> None:
    """Append ``columns`` (all) to an existing table, or replace its rows.

    Spark commits each partition for itself; so the rows go to a staging table
    first, and one transaction moves them. Columns are cast to the table's
    types. If anything fails, the table is as it was. Empty texts stay empty,
    nulls null.
    """
    spark, options = df.sparkSession, options or {}
    columns = columns or df.columns
    require(df, columns)
    target = spark.read.format("jdbc").options(url=url, query=f"SELECT * FROM {table} WHERE 1 = 0", **options).load().schema
    types = {f.name.lower(): f for f in target}
    if absent := [c for c in columns if c.lower() not in types]:
        raise ConfigError(f"table {table} has no column {', '.join(absent)}")
    staging = f"{table}_stage_{uuid.uuid4().hex[:8]}"
    fields = [types[c.lower()] for c in columns]
    rows = df.select(*(name(c).cast(f.dataType).alias(f.name) for c, f in zip(columns, fields, strict=True)))
    driver = spark._jvm.java.sql.DriverManager
    properties = spark._jvm.java.util.Properties()
    for k, v in options.items():
        properties.setProperty(k, v)
    quoted = ", ".join(f'"{f.name}"' for f in fields)
    connection = driver.getConnection(url, properties)
    try:
        # Spark makes the staging table; a database may know its texts as large objects, so they are cast back
        about = connection.createStatement().executeQuery(f"SELECT {quoted} FROM {table} WHERE 1 = 0").getMetaData()
        moved = ", ".join(
            f'CAST("{f.name}" AS {about.getColumnTypeName(i)}({about.getPrecision(i)}))' if "CHAR" in about.getColumnTypeName(i).upper() and 0 < about.getPrecision(i) < 1 << 20 else f'"{f.name}"'
            for i, f in enumerate(fields, 1)
        )
        rows.write.format("jdbc").mode("error").options(url=url, dbtable=staging, batchsize=batch_size, **options).save()
        connection.setAutoCommit(False)
        try:
            statement = connection.createStatement()
            if truncate:
                statement.executeUpdate(f"DELETE FROM {table}")
            statement.executeUpdate(f"INSERT INTO {table} ({quoted}) SELECT {moved} FROM {staging}")
            connection.commit()
        except BaseException:
            connection.rollback()
            raise
        finally:
            connection.setAutoCommit(True)
    finally:
        try:
            if connection.getMetaData().getTables(None, None, staging.upper(), None).next() or connection.getMetaData().getTables(None, None, staging, None).next():
                connection.createStatement().executeUpdate(f"DROP TABLE {staging}")
        finally:
            connection.close()
