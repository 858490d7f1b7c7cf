import csv
import glob
import os
import random

import pyarrow as pa
import pytest

from flowkit.errors import ConfigError
from flowkit.sinks import files as sinks
from flowkit.sources import files


def test_generator(spark):
    r = files.generator(spark, 3).collect()
    assert [tuple(x) for x in r] == [(0, 0.0, "row-0"), (1, 1.5, "row-1"), (2, 3.0, "row-2")]
    assert files.generator(spark, 0, with_text=False).columns == ["id", "value"]


def test_csv_roundtrip(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a;b", 1.5), (2, "", None), (3, None, 2.0)], "i int, s string, d double")
    sinks.csv(df, f"{tmp_path}/out", delimiter=";", single_file=True)
    assert len(glob.glob(f"{tmp_path}/out/part-*")) == 1
    back = files.csv(spark, f"{tmp_path}/out", delimiter=";")
    assert back.dtypes == [("i", "bigint"), ("s", "string"), ("d", "double")]
    assert rows(back.select("i", "d")) == [(1, 1.5), (2, None), (3, 2.0)]
    with pytest.raises(ConfigError):
        files.csv(spark, f"{tmp_path}/out", delimiter="ab")


def test_csv_row_that_does_not_fit_fails(spark, tmp_path):
    (tmp_path / "x.csv").write_text("a,b\n" + "".join(f"{i},1\n" for i in range(20)) + "oops,2\n")
    with pytest.raises(Exception, match="(?s)MALFORMED|oops"):
        files.csv(spark, f"{tmp_path}/x.csv", infer_rows=5).collect()
    assert files.csv(spark, f"{tmp_path}/x.csv", infer_rows=0).dtypes[0] == ("a", "string")


def test_csv_without_header(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,x\n2,y\n")
    df = files.csv(spark, f"{tmp_path}/x.csv", has_header=False)
    assert df.columns == ["column_1", "column_2"] and df.count() == 2


def test_parquet_projection_and_empty(spark, tmp_path):
    sinks.parquet(files.generator(spark, 5), f"{tmp_path}/p", compression="zstd", row_group_bytes=1 << 20)
    assert files.parquet(spark, f"{tmp_path}/p", ["label", "id"]).columns == ["label", "id"]
    sinks.parquet(files.generator(spark, 0), f"{tmp_path}/e")
    assert files.parquet(spark, f"{tmp_path}/e").columns == ["id", "value", "label"]
    with pytest.raises(ConfigError):
        sinks.parquet(files.generator(spark, 1), f"{tmp_path}/q", compression="rar")


def test_failed_write_keeps_the_old_result(spark, tmp_path):
    out = f"{tmp_path}/p"
    sinks.parquet(files.generator(spark, 5), out)
    bad = files.generator(spark, 5).selectExpr("CASE WHEN id = 3 THEN raise_error('stop') ELSE id END AS id")
    with pytest.raises(Exception, match="stop"):
        sinks.parquet(bad, out)
    assert spark.read.parquet(out).count() == 5
    assert os.listdir(tmp_path) == ["p"]
    sinks.parquet(files.generator(spark, 7), out)
    assert spark.read.parquet(out).count() == 7 and os.listdir(tmp_path) == ["p"]
    with pytest.raises(ConfigError):
        sinks.parquet(files.generator(spark, 1), f"{tmp_path}/no/such", create_dirs=False)


def test_memory_and_null(spark):
    df = files.memory(spark, pa.table({"a": [1, 2]}))
    assert sinks.memory(df).num_rows == 2
    sinks.null(df)


def test_filter_reaches_the_scan(spark, tmp_path):
    from flowkit.operators.basic import select, where

    sinks.parquet(files.generator(spark, 100), f"{tmp_path}/p")
    plan = select(where(files.parquet(spark, f"{tmp_path}/p"), "id > 90"), ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,90)]" in plan and "ReadSchema: struct<id:bigint>" in plan


def quoted(value):
    """A field as RFC 4180 has it; null is nothing, an empty text two quotes."""
    if value is None:
        return ""
    return '"' + value.replace('"', '""') + '"' if value == "" or set(value) & set('",\n\r') else value


@pytest.fixture
def small_splits(spark):
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    yield lambda size: [spark.conf.set("spark.sql.files.maxPartitionBytes", size), spark.conf.set("spark.sql.files.openCostInBytes", 1)]
    for k, v in was.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("seed", "size"), [(1, 150), (2, 1000), (3, 1 << 20), (4, 400)])
def test_csv_in_many_splits(spark, tmp_path, small_splits, seed, size):
    """Records as Python's csv writes and reads them: quotes, delimiters, breaks of every kind, blanks, empty against null."""
    r = random.Random(seed)
    parts = ["a", "b", '"', ",", "\n", " ", "é", '""', "\r\n", "x\ny\nz", '",\n"']
    text = lambda n: "".join(r.choice(parts) for _ in range(r.randrange(n)))
    expected = [(i, text(6) or None, r.choice([None, "", text(25)])) for i in range(150)] + [(150, "q" * 3000 + "\n" * 50, "spans splits")]
    names = ["id", 'first\n"name"', "c"]
    with open(f"{tmp_path}/x.csv", "w", newline="") as f:
        for row in [names, *((str(i), s, t) for i, s, t in expected)]:
            f.write(",".join(map(quoted, row)) + r.choice(["\n", "\r\n"]))
    with open(f"{tmp_path}/x.csv", newline="") as f:
        assert [[x or "" for x in row[1:]] for row in expected] == [row[1:] for row in list(csv.reader(f))[1:]]
    small_splits(size)
    df = files.csv(spark, f"{tmp_path}/x.csv")
    assert df.dtypes == [("id", "bigint"), (names[1], "string"), ("c", "string")]
    assert sorted(map(tuple, df.collect())) == expected
    sinks.csv(df.repartition(3), f"{tmp_path}/out", delimiter=";")
    assert sorted(map(tuple, files.csv(spark, f"{tmp_path}/out", delimiter=";").collect())) == expected
    written = [row for p in glob.glob(f"{tmp_path}/out/part-*") for row in list(csv.reader(open(p, newline=""), delimiter=";"))[1:]]  # noqa: SIM115
    assert sorted((int(a), b, c) for a, b, c in written) == [(a, b or "", c or "") for a, b, c in expected]


def test_csv_quotes_inside_unquoted_fields_are_letters(spark, tmp_path, small_splits):
    """A quote opens a field only at its beginning; the same text is read alike in one split and in many."""
    lines = ["id,size,note"] + [f'{i},{i}" pipe,"{"one" if i % 3 else "two" + chr(10) + "lines"}"' for i in range(60)]
    (tmp_path / "x.csv").write_text("\n".join(lines))
    expected = [(i, f'{i}" pipe', "one" if i % 3 else "two\nlines") for i in range(60)]
    for size in (100, 1 << 20):
        small_splits(size)
        assert sorted(map(tuple, files.csv(spark, f"{tmp_path}/x.csv").collect())) == expected


def test_csv_keeps_blanks_and_quoted_numbers(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,b,c\n"1"," pad ","say ""hi"""\n"",\'x,"x ""y"", z"\n3,,""\n')
    df = files.csv(spark, f"{tmp_path}/x.csv")
    assert df.dtypes[0] == ("a", "bigint")
    assert [tuple(x) for x in df.collect()] == [(1, " pad ", 'say "hi"'), (None, "'x", 'x "y", z'), (3, None, "")]
    sinks.csv(df, f"{tmp_path}/out", single_file=True)
    assert [tuple(x) for x in files.csv(spark, f"{tmp_path}/out", line_breaks=False).collect()] == [tuple(x) for x in df.collect()]


def test_csv_without_records(spark, tmp_path):
    (tmp_path / "x.csv").write_text('a,"b\nc"\n')
    df = files.csv(spark, f"{tmp_path}/x.csv")
    assert df.count() == 0 and len(df.columns) == 2


def test_types_come_from_the_first_lines_without_a_shuffle(spark, tmp_path):
    # a limit that shuffles takes lines of any split first, which then pass for the header
    (tmp_path / "x.csv").write_text("a;b\n" + "".join(f"{i};{i / 4}\n" for i in range(4000)))
    sc, most = spark.sparkContext, spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        sc.setJobGroup("first lines", "")
        df = files.csv(spark, f"{tmp_path}/x.csv", delimiter=";", line_breaks=False)
        stages = [len(sc.statusTracker().getJobInfo(j).stageIds) for j in sc.statusTracker().getJobIdsForGroup("first lines")]
        assert stages and set(stages) == {1}
        assert df.dtypes == [("a", "bigint"), ("b", "double")] and df.count() == 4000
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.files.maxPartitionBytes", most)
