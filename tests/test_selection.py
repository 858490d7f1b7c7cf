"""Medians by selection and running totals without buckets, against plain Python."""

import math
import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from flowkit.operators import selection

INF, NAN = float("inf"), float("nan")


def middle(values):
    """The median of values that are not null, NaN being the largest."""
    v = sorted((x for x in values if x is not None), key=lambda x: (math.isnan(x), x))
    return None if not v else (v[(len(v) - 1) // 2] + v[len(v) // 2]) / 2


def same(a, b):
    return a == b or (a is not None and b is not None and (math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-12)))


@pytest.mark.parametrize("small", [20, 10_000])
def test_median(spark, small):
    """Skewed, tied, far apart and odd values; a hot group, a null group, groups of nulls and of one value."""
    r = random.Random(small)
    groups = {
        "hot": [r.gauss(0, 1) for _ in range(900)],
        "far": [10.0 ** r.randrange(-30, 30) * r.choice([-1, 1]) for _ in range(40)],
        "tied": [float(r.randrange(3)) for _ in range(101)],
        "same": [7.0] * 50,
        "odd": [INF, -INF, NAN, None, 1.0, 2.0, 3.0, NAN, 5.0] * 9,
        "most": [NAN] * 29 + [1.0],
        "wide": [-1.7e308, 1.7e308, 0.0, 1.0, 2.0, 3.0, 1e308] * 5,
        "none": [None, None],
        None: [float(i * i) for i in range(40)],
        "two": [1.0, 4.0],
    }
    rows = [(k, "x", v) for k, vs in groups.items() for v in vs]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, k0 string, v double")
    found = {x.g: x.m for x in selection.median(df, ["g"], "v", "m", small).collect()}
    assert set(found) == set(groups) and all(same(found[k], middle(vs)) for k, vs in groups.items()), found
    whole = selection.median(df.filter("g = 'hot'"), [], "v", small=small).collect()
    assert len(whole) == 1 and math.isclose(whole[0][0], median(groups["hot"]), rel_tol=1e-12)
    assert [tuple(x) for x in selection.median(df.limit(0), [], "v", small=small).collect()] == [(None,)] and selection.median(df.limit(0), ["g"], "v", small=small).count() == 0


@pytest.mark.parametrize("partitions", [1, 7, None])
def test_running_total(spark, partitions):
    """Skewed and null orders, null values, more ranges than orders."""
    r = random.Random(9)
    rows = [(r.choice([None, 5, 5, 5, r.randrange(40)]), r.choice([None, r.randrange(-9, 9)])) for _ in range(300)] + [(99, None)]
    df = spark.createDataFrame(rows, "o int, v long")
    got = {x.o: x.running for x in selection.running_total(df, "o", F.col("v"), partitions=partitions).collect()}
    expected, total = {}, None
    for o in sorted({o for o, _ in rows}, key=lambda o: (o is not None, o)):
        own = [v for x, v in rows if x == o and v is not None]
        total = total if not own else (total or 0) + sum(own)
        expected[o] = total
    assert got == expected
    plan = selection.running_total(df, "o", F.col("v"), partitions=partitions)._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan
    assert selection.running_total(df.limit(0), "o", F.col("v")).count() == 0
