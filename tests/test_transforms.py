import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException

from flowkit.errors import ConfigError
from flowkit.operators import basic, relational
from flowkit.schema import declared, widened


@pytest.fixture(scope="module")
def customers(spark):
    return spark.createDataFrame([(1, "Piet", "Bergen", 840.0), (2, "Runa", "Narvik", 415.0), (3, "Sten", "Bergen", 1760.0), (4, "Oda", None, 612.0), (5, "Tove", "Molde", 275.0)], "id long, name string, city string, spend double")


def test_select_keeps_order_and_names_what_is_missing(customers):
    assert basic.select(customers, ["spend", "id"]).columns == ["spend", "id"]
    with pytest.raises(ConfigError, match="no column nope; there are id, name, city, spend"):
        basic.select(customers, ["nope"])
    with pytest.raises(ConfigError):
        basic.select(customers, [])


def test_rename_swaps(customers):
    swapped = basic.rename(customers, {"name": "city", "city": "name"})
    assert swapped.columns == ["id", "city", "name", "spend"]
    assert swapped.filter("id = 1").first()["city"] == "Piet"
    with pytest.raises(ConfigError):
        basic.rename(customers, {"nope": "x"})


def test_filter_drops_null(customers):
    assert basic.where(customers, "city <> 'Narvik'").count() == 3


def test_derive_is_by_name_and_blind_to_siblings(customers):
    out = basic.derive(customers, {"b": "spend * 2", "a": "id + 1"})
    assert out.columns[-2:] == ["a", "b"]
    with pytest.raises(AnalysisException):
        basic.derive(customers, {"a": "id + 1", "b": "a + 1"})
    with pytest.raises(ConfigError):
        basic.derive(customers, {"spend": "1"})


def test_aggregate(customers, rows):
    out = basic.aggregate(customers, {"total": "sum(spend)", "n": "count(*)"}, ["city"])
    assert out.columns == ["city", "n", "total"]
    assert ("Bergen", 2, 2600.0) in rows(out)
    assert rows(basic.aggregate(customers.limit(0), {"n": "count(*)", "most": "max(spend)"})) == [(None, 0)]


def test_limit(customers):
    assert basic.limit(customers, 0).count() == 0
    assert [r.name for r in basic.limit(customers, 2, [customers.spend.desc()]).collect()] == ["Sten", "Piet"]
    with pytest.raises(ConfigError):
        basic.limit(customers, -1)


def test_stack_needs_one_shape(customers):
    assert basic.stack({"a": customers, "b": customers}).count() == 10
    with pytest.raises(ConfigError, match="differ"):
        basic.stack({"a": customers, "b": customers.drop("city")})


def test_sql_ports(customers, spark, rows):
    orders = spark.createDataFrame([(1, 72.0), (1, 31.0), (2, 220.0), (44, 9.0)], "customer_id long, amount double")
    q = "SELECT name, sum(amount) AS total FROM people JOIN sales ON id = customer_id GROUP BY name"
    assert rows(basic.sql({"people": customers, "sales": orders}, q)) == [("Piet", 103.0), ("Runa", 220.0)]
    assert basic.sql({"x": customers}, "SELECT count(*) AS n FROM input").first().n == 5
    assert not [t for t in spark.catalog.listTables() if t.isTemporary]
    with pytest.raises(ConfigError):
        basic.sql({"x": customers}, "DROP TABLE x")
    # the only input may be read twice
    assert basic.sql({"x": customers}, "SELECT a.id FROM x a JOIN x b ON a.id < b.id").count() == 10


def test_chained_and_fused_agree(spark, rows):
    from flowkit.sources.files import generator

    g = generator(spark, 1000, with_text=False)
    chained = basic.aggregate(basic.derive(basic.where(g, "id >= 500"), {"bucket": "id % 10"}), {"n": "count(*)", "s": "sum(value)"}, ["bucket"])
    fused = basic.sql({"input": g}, "SELECT id % 10 AS bucket, count(*) AS n, sum(value) AS s FROM input WHERE id >= 500 GROUP BY 1")
    assert rows(chained) == rows(fused)


def test_declared_schema(spark):
    s = declared([{"name": "a", "type": "bigint"}, {"name": "t", "type": "timestamp", "nullable": False}])
    assert s.simpleString() == "struct<a:bigint,t:timestamp_ntz>" and not s["t"].nullable
    with pytest.raises(ConfigError, match="known are"):
        declared([{"name": "a", "type": "money"}])
    assert widened(spark.range(1).selectExpr("CAST(id AS INT) AS i")).dtypes == [("i", "bigint")]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(-5, 5)), max_size=30))
def test_running_total(spark, data):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(data, "k long, v long")
    got = {r.k: r.running for r in relational.running_total(df, "k", F.col("v"), F.floor(F.col("k") / 10)).collect()}
    assert got == {k: sum(v for o, v in data if o <= k) for k, _ in data}


def test_mark_does_not_multiply(spark, rows):
    left, right = spark.createDataFrame([(1,), (2,), (None,)], "k long"), spark.createDataFrame([(1,), (1,), (None,)], "k long")
    assert rows(relational.mark(left, right, ["k"])) == [(1, True), (2, False), (None, False)]


def test_json_infer_sees_every_row(spark, tmp_path):
    from flowkit.queries.transforms import QUERIES

    props = ['{"k": 1}'] * 1500 + ['{"k": 2.5}', '{"k": 3, "late": "x"}', None]
    spark.createDataFrame(list(enumerate(props)), "event_id long, props string").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    out = {r.event_id: r for r in QUERIES["json_infer"](spark, str(tmp_path)).filter("event_id = 0 or event_id >= 1500").collect()}
    assert [(out[i].k, out[i].late) for i in sorted(out)] == [(1.0, None), (2.5, None), (3.0, "x"), (None, None)]


def test_csv_roundtrip_writes_a_file_per_partition(spark, tmp_path, monkeypatch):
    from flowkit.queries import transforms
    from flowkit.sinks import files as sinks

    parts = spark.range(40).selectExpr("id AS p_partkey", "concat('part ', id) AS p_name").repartition(4, "p_partkey")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr(transforms, "scratch", lambda *_: f"{tmp_path}/out")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert transforms.QUERIES["snk_csv_roundtrip"](spark, str(tmp_path)).count() == 40
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(list((tmp_path / "out").rglob("part-*.csv"))) > 1
    sinks.csv(parts, f"{tmp_path}/one", single_file=True)
    assert len(list((tmp_path / "one").rglob("part-*.csv"))) == 1


def test_recursion_gives_more_than_a_million_rows(spark):
    q = "WITH RECURSIVE up(place) AS (SELECT id FROM input UNION ALL SELECT place + 600000 FROM up WHERE place < 600000) SELECT count(*) AS n FROM up"
    assert basic.sql({"input": spark.range(600_000)}, q).first().n == 1_200_000
