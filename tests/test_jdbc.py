import pytest

from flowkit.errors import ConfigError
from flowkit.sinks.jdbc import jdbc as write
from flowkit.sources.jdbc import jdbc as read

DRIVER = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}


@pytest.fixture(scope="module")
def url(spark, tmp_path_factory):
    url = f"jdbc:derby:{tmp_path_factory.mktemp('db')}/x;create=true"
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    c.createStatement().executeUpdate('CREATE TABLE t ("id" BIGINT, "name" VARCHAR(20), "amount" DECIMAL(20,4))')
    c.createStatement().executeUpdate("INSERT INTO t VALUES (1, 'a', 1.5), (2, '', 12345678901234.5678), (3, NULL, NULL)")
    c.close()
    return url


def test_table_projection_and_pushdown(spark, url):
    df = read(spark, url, table="t", columns=["name", "id"], predicate="id >= 2", options=DRIVER)
    assert df.columns == ["name", "id"] and df.count() == 2
    assert "GreaterThanOrEqual(id,2)" in df._jdf.queryExecution().executedPlan().toString()


def test_query_or_table(spark, url):
    assert read(spark, url, query='SELECT "id" FROM t', options=DRIVER).count() == 3
    with pytest.raises(ConfigError):
        read(spark, url, options=DRIVER)
    with pytest.raises(ConfigError):
        read(spark, url, query="SELECT 1", columns=["a"], options=DRIVER)


def test_exact_numbers_as_text(spark, url):
    df = read(spark, url, table="t", exact_numbers=["amount"], options=DRIVER)
    assert df.filter("id = 2").first().amount == "12345678901234.5678"


def test_split_read(spark, url):
    df = read(spark, url, table="t", split_by=("id", 1, 4, 3), options=DRIVER)
    assert df.rdd.getNumPartitions() == 3 and df.count() == 3


def test_sink_appends_replaces_and_keeps(spark, url, rows):
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    c.createStatement().executeUpdate('CREATE TABLE s ("k" INTEGER NOT NULL, "v" VARCHAR(5))')
    c.close()
    df = spark.createDataFrame([(1, ""), (2, None)], "k long, v string")
    write(df, url, "s", options=DRIVER)
    write(df, url, "s", options=DRIVER)
    back = lambda: rows(read(spark, url, table="s", options=DRIVER))
    assert back() == [(1, ""), (1, ""), (2, None), (2, None)]
    bad = spark.createDataFrame([(7, "x"), (None, "y")], "k long, v string")
    with pytest.raises(Exception):  # noqa: B017
        write(bad, url, "s", truncate=True, options=DRIVER)
    assert len(back()) == 4
    write(df, url, "s", truncate=True, options=DRIVER)
    assert len(back()) == 2
    with pytest.raises(ConfigError):
        write(df.withColumn("z", df.k), url, "s", options=DRIVER)


@pytest.mark.parametrize("column, sql", [("n", "DECIMAL(12,2)"), ("n", "BIGINT"), ("n", "DOUBLE"), ("d", None), ("t", None)])
def test_even_parts_of_a_skewed_column(spark, tmp_path, column, sql, rows):
    """Values are crowded at one end, some are null, and one is shared by many: parts are even, and each row comes once."""
    url = f"jdbc:derby:{tmp_path}/even;create=true"
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    c.createStatement().executeUpdate(f'CREATE TABLE e ("id" BIGINT, "n" {sql or "BIGINT"}, "d" DATE, "t" TIMESTAMP)')
    c.close()
    df = spark.range(600).selectExpr("id", f"CASE WHEN id % 20 > 0 THEN id * id * id END AS n", "CASE WHEN id % 20 > 0 THEN date_add(date'2000-01-01', CAST(id * id / 100 AS INT)) END AS d", "CASE WHEN id % 20 > 0 THEN timestamp_seconds(id * id * id) END AS t")
    df.withColumn("n", df.n.cast("decimal(12,2)") if sql == "DECIMAL(12,2)" else df.n.cast("double") if sql == "DOUBLE" else df.n).write.format("jdbc").options(url=url, dbtable="e", batchsize=1000, **DRIVER).mode("append").save()
    whole = read(spark, url, table="e", options=DRIVER)
    split = read(spark, url, table="e", split_by=(column, 4), options=DRIVER)
    assert rows(split) == rows(whole) and whole.count() == 600
    sizes = split.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)
    if column == "n":
        few = read(spark, url, table="e", split_by=("n", 4), sample='SELECT "n" FROM e WHERE MOD("id", 3) = 1', options=DRIVER, columns=["id"], predicate="id < 300")
        assert sorted(r.id for r in few.collect()) == list(range(300))
        many = read(spark, url, table="e", split_by=("n", 4), sample="SELECT 5 AS n FROM e", options=DRIVER)
        assert many.count() == 600 and many.rdd.getNumPartitions() == 2


def test_even_parts_of_nothing_and_of_text(spark, url):
    with pytest.raises(ConfigError):
        read(spark, url, table="t", split_by=("name", 4), options=DRIVER)
    with pytest.raises(ConfigError):
        read(spark, url, table="t", split_by=("id", 1, 4, 3), sample="SELECT 1", options=DRIVER)
    c = spark._jvm.java.sql.DriverManager.getConnection(url)
    c.createStatement().executeUpdate('CREATE TABLE z ("id" BIGINT)')
    assert read(spark, url, table="z", split_by=("id", 4), options=DRIVER).count() == 0
    c.createStatement().executeUpdate("INSERT INTO z VALUES (NULL)")
    c.close()
    assert read(spark, url, table="z", split_by=("id", 4), options=DRIVER).count() == 1
