import itertools
import math
import random

import numpy as np
import pytest

from flowkit.llm import negatives

NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(("dim", "bits"), [(2, 1), (2, 2), (2, 4), (3, 2), (3, 3), (4, 2), (6, 1)])
def test_hilbert_visits_every_cell_by_steps_of_one(dim, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dim)))
    place = [x.tobytes() for x in negatives.hilbert(cells, bits)]
    path = cells[sorted(range(len(cells)), key=place.__getitem__)]
    assert len(set(place)) == len(cells) and (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_and_are_met():
    r = np.random.default_rng(1)
    anchors, rows = r.integers(-300, 300, (20, 5)).astype(np.int32), r.integers(-300, 300, (40, 5)).astype(np.int32)
    low, high = rows.min(axis=0, keepdims=True), rows.max(axis=0, keepdims=True)
    least, most = negatives.bounds(anchors, low, high)
    corners = np.array(list(itertools.product(*zip(low[0], high[0], strict=True))))
    scores = negatives.products(anchors, corners.astype(np.int32))
    assert (least[:, 0] == scores.min(axis=1)).all() and (most[:, 0] == scores.max(axis=1)).all()


def test_products_are_exact_at_any_size():
    big = np.array([[2**31 - 1, 2**30 + 7, 5], [-(2**31), 3, 1]], np.int32)
    with pytest.raises(OverflowError):
        negatives.products(np.repeat(big, 2, axis=1), np.repeat(big, 2, axis=1))
    big //= 2
    assert negatives.products(big, big).tolist() == [[sum(int(x) * int(y) for x, y in zip(a, b, strict=True)) for b in big] for a in big]


def brute(rows, every, positives, count, low, high):
    one = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            new = (label, [math.floor(256 * x) for x in v])
            one[i] = min(one.get(i, new), new)
    out = []
    for a, (label, v) in one.items():
        if a % every == 0:
            score = lambda i: sum(x * y for x, y in zip(v, one[i][1], strict=False))  # noqa: B023, E731
            ranked = sorted((i for i in one if i != a), key=lambda i: (-score(i), i))  # noqa: B023
            for p in [i for i in ranked if one[i][0] == label][:positives]:
                fits = [i for i in ranked if one[i][0] != label and low * score(p) <= 100 * score(i) <= high * score(p)][:count]
                out += [(a, p, k + 1, i, score(p), score(i)) for k, i in enumerate(fits)]
    return sorted(out)


def found(spark, rows, every, positives, count, low, high):
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], "vec_id long, embedding array<double>, label int, block int, chunk string, score double")
    return sorted(tuple(r) for r in negatives.hard_negatives(df, every, positives, count, (low, 100), (high, 100)).collect())


@pytest.mark.parametrize(("every", "positives", "count", "low", "high", "hot"), [(50, 5, 3, 50, 95, 0.3), (7, 2, 4, 0, 100, 0.9), (3, 9, 1, -50, 20, 0.1)])
def test_against_brute_force(spark, every, positives, count, low, high, hot):
    """Clusters, copies with tied scores, a hot label, negative scores, short vectors, nulls and what is not finite."""
    r = random.Random(every)
    centres = [[r.gauss(0, 0.3) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(400):
        v = [round(x + r.gauss(0, 0.1), 2) for x in r.choice(centres)]
        rows.append((i, v if r.random() < 0.9 else rows[-1][1] if rows else v, 0 if r.random() < hot else r.randrange(4)))
    rows += [(400, None, 1), (401, [0.1] * 6, None), (402, [NAN] * 6, 1), (403, [INF, 0.0], 1), (404, [None, 0.1], 2), (None, [0.3] * 6, 1), (405, [], 1), (406, [0.7, 0.2], 2), (350, [1.0] * 6, 9)]
    rows += [rows[100], rows[0], (450, centres[0], 8)]  # an anchor without another row of its label
    assert found(spark, rows, every, positives, count, low, high) == brute(rows, every, positives, count, low, high)


def test_more_blocks_and_chunks_than_one(spark):
    """Rows in several blocks of one label, anchors in several chunks, vectors that repeat."""
    r = np.random.default_rng(5)
    v = np.round(r.normal(0, 0.3, (4000, 4)), 2)
    v[3000:] = v[:1000]
    rows = [(i, x, int(i % 10 == 3)) for i, x in enumerate(v.tolist())]
    assert found(spark, rows, 40, 5, 3, 50, 95) == brute(rows, 40, 5, 3, 50, 95)


def test_empty_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert negatives.hard_negatives(spark.createDataFrame([], schema)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(50, None, 1), (0, [], 1)], schema)).count() == 0
