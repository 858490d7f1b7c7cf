"""Changes of a folder of files in place, against their plain forms."""

import os

import pytest

from flowkit.errors import ConfigError
from flowkit.operators import history
from flowkit.sinks import merge


@pytest.fixture
def path(spark, tmp_path):
    """1000 rows in ten files by ranges of k, in a folder whose name needs escapes."""
    path = f"{tmp_path}/a table%"
    spark.range(1000).selectExpr("id AS k", "CAST(id % 3 AS INT) AS part", "'old' AS v").repartitionByRange(10, "k").write.parquet(path)
    return path


def files(path):
    return {n for n in os.listdir(path) if n.endswith(".parquet")}


def test_other_files_stay(spark, path, rows):
    old, before = spark.read.parquet(path).collect(), files(path)
    new = spark.range(300, 310).selectExpr("'new' AS v", "id AS k", "5L AS part")
    expected = rows(history.upsert(spark.createDataFrame(old, "k long, part int, v string"), new.select("k", "part", "v"), ["k"]))
    gone = merge.upsert(new, path, ["k"])
    assert 1 <= len(gone) <= 2 and before - files(path) == set(gone)
    assert rows(spark.read.parquet(path)) == expected and len(expected) == 1000
    assert merge.upsert(new.limit(0), path, ["k"]) == [] and rows(spark.read.parquet(path)) == expected
    assert not [n for n in os.listdir(path) if n.startswith((merge.STAGING, merge.JOURNAL))]


def test_several_keys_nulls_and_new_ones(spark, path, rows):
    new = spark.createDataFrame([(4, 1, "both"), (4, 2, "not there"), (None, 1, "null"), (5000, 1, "far")], "k long, part int, v string")
    merge.upsert(new, path, ["k", "part"])
    merge.upsert(new, path, ["k", "part"])
    got = spark.read.parquet(path)
    assert got.count() == 1000 + 2 + 2  # a null key replaces nothing, so it came twice
    assert rows(got.filter("k = 4").select("part", "v")) == [(1, "both"), (2, "not there")]


def test_a_new_table_and_other_columns(spark, tmp_path, path):
    merge.upsert(spark.range(3), f"{tmp_path}/fresh", ["id"])
    merge.upsert(spark.range(2, 5), f"{tmp_path}/fresh", ["id"])
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/fresh").collect()) == [0, 1, 2, 3, 4]
    with pytest.raises(ConfigError):
        merge.upsert(spark.range(3), path, ["id"])
    spark.range(9).selectExpr("id", "id % 2 AS p").write.partitionBy("p").parquet(f"{tmp_path}/parts")
    with pytest.raises(ConfigError):
        merge.upsert(spark.range(3).selectExpr("id", "0 AS p"), f"{tmp_path}/parts", ["id"])


def test_keep(spark, path, rows):
    before = files(path)
    gone = merge.keep(spark, path, "k >= 150 OR k IS NULL")
    assert len(gone) == 2 and before - files(path) == set(gone)
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(150, 1000))
    merge.keep(spark, path, "v = 'none'")
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["k", "part", "v"]


@pytest.mark.parametrize("fail_at", ["journal", "rename 1", "rename 2", "delete 1"])
def test_a_driver_that_dies(spark, path, rows, monkeypatch, fail_at):
    """Before the journal the old rows stay, after it the new ones come; ``recover`` leaves either whole."""
    old = rows(spark.read.parquet(path))
    new = spark.range(95, 105).selectExpr("id AS k", "1 AS part", "'new' AS v").repartition(2)
    expected = rows(history.upsert(spark.createDataFrame(old, "k long, part int, v string"), new, ["k"]))
    count, real = [0], merge._Folder.__init__

    class Dies:
        def __init__(self, fs):
            self.fs = fs

        def __getattr__(self, what):
            return getattr(self.fs, what)

        def act(self, what, *args):
            step = f"{what} {count[0]}"
            if (fail_at == "journal" and step == "rename 0") or step == fail_at:
                raise KeyboardInterrupt
            count[0] += 1
            return getattr(self.fs, what)(*args)

        def rename(self, *args):
            return self.act("rename", *args)

        def delete(self, *args):
            if fail_at.startswith("delete") and args[0].getName().endswith(".parquet"):
                raise KeyboardInterrupt
            return self.fs.delete(*args)

    def dying(self, *args):
        real(self, *args)
        self.fs = Dies(self.fs)

    monkeypatch.setattr(merge._Folder, "__init__", dying)
    with pytest.raises(KeyboardInterrupt):
        merge.upsert(new, path, ["k"])
    monkeypatch.setattr(merge._Folder, "__init__", real)
    merge.recover(spark, path)
    assert rows(spark.read.parquet(path)) == (old if fail_at == "journal" else expected)
    assert not [n for n in os.listdir(path) if n.startswith((merge.STAGING, merge.JOURNAL))]
