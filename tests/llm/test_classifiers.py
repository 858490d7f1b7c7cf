import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowkit.llm import quality, samples, toxicity
from flowkit.llm.common import fold


def corpus(n, seed=1):
    """Texts whose class shows in word ends (quality) and in a family of words (toxic)."""
    r, out = random.Random(seed), []
    for i in range(n):
        words = [f"{r.choice('bdfgklm')}{r.choice('aeiou')}{r.choice('bdfgklm')}{r.choice('aeiou')}{r.randrange(50)}" for _ in range(r.randrange(5, 60))]
        good, toxic = r.random() < 0.6, r.random() < 0.3
        if not good:
            words = [w + "%%%" for w in words] if r.random() < 0.5 else words[:1] * 40
        if toxic:
            words.insert(r.randrange(len(words)), f"zarg{r.randrange(1000)}")
        out.append((i, " ".join(words), int(good), int(toxic)))
    return out


@pytest.fixture(scope="module")
def tables(spark, docs_of):
    rows = corpus(900)
    labels = spark.createDataFrame([(i, q, t, "x") for i, _, q, t in rows] + [(None, 1, 1, "x"), (5, None, None, "x"), (10**6, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    return docs_of(spark, [(i, t) for i, t, _, _ in rows]), labels, {i: (q, t) for i, _, q, t in rows}


def accuracy(scored, truth, label):
    held = [(r.score >= 0.5, truth[r.doc_id][label]) for r in scored if r.held]
    return sum(p == bool(t) for p, t in held) / len(held), len(held)


def test_quality(tables):
    docs, labels, truth = tables
    model = quality.fitted(docs, labels, fold("doc_id", 3) != 1)
    scored = docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held"), quality.score(model)("text").alias("score")).collect()
    share, n = accuracy(scored, truth, 0)
    assert n > 200 and share > 0.95
    assert all(0 <= r.score <= 1 for r in scored)


def test_toxicity(tables):
    docs, labels, truth = tables
    net = toxicity.fitted(docs, labels, fold("doc_id", 5) != 0)
    scored = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held"), toxicity.score(net)("text").alias("score")).collect()
    share, n = accuracy(scored, truth, 1)
    assert n > 120 and share > 0.95


def test_sample_is_bounded_and_leaves_the_fold_out(tables):
    docs, labels, truth = tables
    rows, sizes = samples.labelled_sample(docs, labels, "toxic", fold("doc_id", 5) != 0, per_class=50)
    assert rows.num_rows == 100 and sum(rows["y"].to_pylist()) == 50
    assert sizes[0] + sizes[1] == labels.filter("doc_id is not null and toxic is not null").filter(fold("doc_id", 5) != 0).select("doc_id").distinct().count()
    again, _ = samples.labelled_sample(docs, labels, "toxic", fold("doc_id", 5) != 0, per_class=50)
    assert again.equals(rows)


def test_scores_ignore_blocks_and_order(tables, odd_texts):
    texts = pa.array([*odd_texts, *(t for _, t, _, _ in corpus(40, 9)), "zarg5 " + "badu1 " * 3000])
    rows = pa.table({"text": [t for _, t, _, _ in corpus(300)], "y": pa.array([t for *_, t in corpus(300)], pa.int32()), "part": pa.array([i % 10 for i in range(300)])})
    sizes = {0: 200, 1: 100}
    net = toxicity.fit(rows, sizes, epochs=2)
    model = quality.fit(rows, sizes, np.random.default_rng(0).normal(size=(quality.UNITS, quality.DIM)).astype(np.float32), steps=50)
    for scores in (net.scores, model.scores):
        whole = scores(texts)
        assert np.isfinite(whole).all() and len(whole) == len(texts)
        assert np.allclose(whole, np.concatenate([scores(texts[i : i + 1]) for i in range(len(texts))]), atol=1e-5)
    ids, starts, _ = toxicity._inputs(*[x for x in toxicity.slabs(texts, 1 << 30)][0][2:])
    assert np.allclose(net.logits(ids, starts, 64), net.logits(ids, starts, 1 << 20), atol=1e-4)


def test_word_vectors_cover_all_texts_and_no_borders(spark):
    df = spark.createDataFrame([("aa bb", 1), ("cc", 2), (None, 3), ("dd", 4)], "text string, unit int").repartition(3)
    table = quality.word_vectors(df)
    some = np.flatnonzero(np.abs(table).sum(1))
    assert len(some) == 4  # the two words of the only pair, and their ends
    assert np.allclose(np.linalg.norm(table[some], axis=1), 1)


def test_without_labels_or_rows(spark, tables):
    docs, labels, _ = tables
    net, model = toxicity.fitted(docs, labels.limit(0), F.lit(True)), quality.fitted(docs, labels.limit(0), F.lit(True))
    assert (net.scores(pa.array(["a", None])) < 0.5).all() and np.allclose(model.scores(pa.array(["a", None])), 0.5)
    assert quality.score(model) and docs.limit(0).select(quality.score(model)("text"), toxicity.score(net)("text")).count() == 0
    one = labels.filter("toxic = 1")
    assert (toxicity.fitted(docs, one, F.lit(True)).scores(pa.array(["a"])) > 0.5).all()


def test_threshold():
    z, y = np.array([-3.0, -1.0, 1.0, 5.0]), np.array([0, 0, 1, 1])
    assert toxicity.best_threshold(z, y, np.ones(4)) == 0.0
