"""Diffs by digests, and loads into a store of texts, against their plain forms."""

import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowkit.operators import diff, history, keysets

FEW = settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
SCHEMA = "k long, a string, b double, c array<int>"
ROW = st.tuples(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1), st.integers(0, 12)), st.sampled_from([None, "", "x", "null"]), st.sampled_from([None, 0.0, 1.5]), st.sampled_from([None, [], [1, None]]))
UNIQUE = st.lists(ROW, max_size=12, unique_by=lambda r: r[0])


@FEW
@given(UNIQUE, UNIQUE)
def test_digests_find_what_a_full_join_finds(spark, rows, left, right):
    both = left[: len(left) // 2]  # rows that both have
    right = both + [r for r in right if r[0] not in {k for k, *_ in both}]
    before, after = spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA).withColumnRenamed("b", "key")
    assert rows(diff.keyed_by_digests(before, after, "k", ranges=4)) == rows(diff.keyed(before, after, "k"))


@pytest.mark.parametrize("key", ["cast(k as int)", "cast(k as tinyint)", "cast(k as string)", "date_add(date'2020-01-01', cast(k as int))", "timestamp_micros(k)", "cast(k as double)", "cast(k as decimal(9,2))"])
def test_keys_of_any_type(spark, rows, key):
    t = spark.range(100).withColumnRenamed("id", "k").selectExpr(f"{key} AS key", "CAST(k % 7 AS STRING) AS v", "1 AS __key")
    before, after = t.filter("v <> '1'"), t.filter("v <> '2'").withColumn("v", F.when(F.col("v") == "3", "new").otherwise(F.col("v")))
    found = rows(diff.keyed_by_digests(before, after, "key"))
    assert found == rows(diff.keyed(before, after, "key")) and {r[1] for r in found} == {"added", "removed", "changed"}


def test_nulls_shift_and_repeats(spark, rows):
    t = lambda *r: spark.createDataFrame(list(r), "k long, a string, b string")
    assert rows(diff.keyed_by_digests(t((1, "x", None)), t((1, None, "x")), "k")) == [(1, "changed", "a", "x", None), (1, "changed", "b", None, "x")]
    twice = t((1, "x", "y"), (1, "x", "z"), (2, "p", "q"))
    assert rows(diff.keyed_by_digests(twice, twice, "k")) == []
    assert rows(diff.keyed_by_digests(twice, t((1, "x", "y"), (2, "p", "q")), "k")) == [(1, "changed", "b", "z", "y")]
    assert rows(diff.keyed_by_digests(t((None, "x", "y")), t((None, "x", "y")), "k")) == [(None, "added", None, None, None), (None, "removed", None, None, None)]
    assert rows(diff.keyed_by_digests(t(), t(), "k")) == []


def test_equal_tables_shuffle_no_text(spark, tmp_path):
    """What is left to join of equal tables is nothing; of others, rows of changed keys, by a broadcast set of keys."""
    spark.range(2000).selectExpr("id AS k", "repeat('word ', 500) || id AS text").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    same = diff.keyed_by_digests(t, t, "k")
    assert same.count() == 0
    plan = same._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "rightHint=(strategy=broadcast)" in plan
    late = diff.keyed_by_digests(t, t.withColumn("text", F.when(F.col("k") == 1999, "new").otherwise(F.col("text"))), "k")
    assert [(r.key, r.field) for r in late.collect()] == [(1999, "text")]
    assert "GreaterThanOrEqual(k,1999)" in late._jdf.queryExecution().executedPlan().toString()  # the scan skips the rest


def test_a_second_load_adds_nothing(spark, rows):
    load = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, ""), (5, "b")], "id long, text string")
    store = spark.createDataFrame([], "hash string, text string")
    first = history.new_texts(store, load, "text", "id")
    assert rows(first.select("text", "first", "copies")) == [("", 4, 1), ("a", 1, 2), ("b", 5, 1)]
    assert rows(first) == rows(history.dedup_by_hash(load, "text", "id"))
    assert rows(history.new_texts(first, load, "text", "id")) == []
    more = load.union(spark.createDataFrame([(9, "c"), (8, "c")], load.schema))
    assert rows(history.new_texts(first, more, "text", "id").select("text", "first", "copies")) == [("c", 8, 2)]
    assert rows(history.new_texts(first, load.limit(0), "text", "id")) == []


def test_first_may_be_null(spark, rows):
    load = spark.createDataFrame([(None, "a"), (None, "a")], "id long, text string")
    assert rows(history.new_texts(spark.createDataFrame([], "hash string"), load, "text", "id").select("text", "first", "copies")) == [("a", None, 2)]


@pytest.mark.parametrize("few", [0, 10])
def test_key_sets_broadcast_or_not(spark, rows, few):
    df = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "k long, v string")
    keys = spark.createDataFrame([(1,), (None,)], "k long")
    assert rows(keysets.of_keys(df, keys, ["k"], few=few)) == [(1, "x")]
    assert rows(keysets.of_keys(df, keys, ["k"], few=few, nulls=True)) == [(1, "x"), (None, "z")]
    assert rows(keysets.of_keys(df, keys, ["k"], "left_anti", few=few)) == [(2, "y"), (None, "z")]
    at = datetime.date(2020, 1, 1)
    assert keysets.of_keys(df.withColumn("d", F.lit(at)), keys, ["k"], few=few).first().d == at
