import random
import re

import numpy as np
import pytest

from flowkit.llm import jaccard
from flowkit.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(texts, n, num, den):
    sets, root = {i: shingles(t, n) for i, t in texts.items()}, {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), find(i)) for i in ids}


def changed(text, r, share):
    return " ".join(f"q{r.randrange(10**6)}" if r.random() < share else w for w in text.split())


@pytest.mark.parametrize("n, num", [(4, 85), (5, 80)])
def test_against_brute_force(spark, docs_of, sentence, odd_texts, n, num):
    r = random.Random(1)
    texts = dict(enumerate(odd_texts + odd_texts))
    for base in range(12):
        t = sentence(base, r.choice([6, 9, 15, 40, 120]))
        for share in (0, 0.01, 0.02, 0.05, 0.1):
            texts[len(texts)] = changed(t, r, share)
            texts[len(texts)] = t.upper()
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs_of(spark, texts), n, num, 100).collect()}
    assert got == brute(texts, n, num, 100)


def test_large_group_of_unlinked_copies(spark, docs_of, sentence, monkeypatch):
    """Groups beyond NEAR + 1 are completed, in one block or in several."""
    r, base = random.Random(2), sentence(99, 100)
    texts = {i: changed(base, r, r.choice([0.01, 0.03, 0.06])) for i in range(90)}
    expected = brute(texts, 4, 85, 100)
    assert len({c for _, c in expected.values()}) > 5
    for block in (1 << 14, 7):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs_of(spark, texts), 4, 85, 100).collect()} == expected


def test_empty_table_null_ids_and_repeated_rows(spark, docs_of):
    assert jaccard.jaccard_components(docs_of(spark, [(1, "x")]).limit(0)).count() == 0
    rows = jaccard.jaccard_components(docs_of(spark, [(None, "a b"), (3, "a b"), (3, "a b"), (2, "A B")])).collect()
    assert sorted((tuple(x) for x in rows), key=repr) == [(2, 1, 2), (3, 1, 2), (3, 1, 2), (None, 1, None)]


def test_similar_sets_share_a_signature():
    r = random.Random(3)
    rng = np.random.default_rng(3)
    for _ in range(300):
        m = r.choice([6, 7, 8, 13, 20, 50, 200, 900])
        a = rng.integers(0, 2**64, m, dtype=np.uint64)
        out, new = r.randrange(m), r.randrange(m)
        b = np.concatenate([a[: m - out], rng.integers(0, 2**64, new, dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both) and both < max(len(a), len(b)):
            assert len(np.intersect1d(jaccard.signatures(a, 85, 100), jaccard.signatures(b, 85, 100)))
            x, y = jaccard.sketch(a), jaccard.sketch(b)
            size = min(len(x), len(y))
            apart = np.bitwise_count(jaccard._folded(x, size) ^ jaccard._folded(y, size)).sum()
            assert apart <= len(a) + len(b) - 2 * both


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (None, 3), (200, 150), (200, 151), (200, 152)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 150: 150, 151: 150, 152: 150, 200: 150}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
