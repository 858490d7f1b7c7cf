import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from flowkit.llm import decontam


def least(item, text):
    """Plain dynamic programming: least edit distance of item to a substring of text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


@settings(max_examples=300, deadline=None)
@given(st.binary(min_size=1, max_size=12), st.binary(max_size=25), st.integers(0, 4))
def test_myers(item, text, limit):
    item, text = bytes(b % 3 for b in item), bytes(b % 3 for b in text)
    d, found = least(item, text), decontam.distance(item, text, limit)
    assert (found is None) if d > limit else found[0] == d and least(item, text[: found[1]]) == d


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=150), min_size=1, max_size=6), st.binary(max_size=90))
def test_many_at_once(items, text):
    items, text = [bytes(b % 3 for b in x) for x in items], bytes(b % 3 for b in text)
    expected = [(least(x, text), len(x)) for x in items]
    for limit in (0, 2, 200):
        got = decontam.distances(items, text, np.full(len(items), limit))
        for x, d, (e, m) in zip(items, got, expected, strict=True):
            assert (d is None) if e > limit else d[0] == e and least(x, text[: d[1]]) == e


def plain(text):
    return decontam.normalised(np.frombuffer(text.encode(), np.uint8)).tobytes()


def test_normal_form():
    assert plain("A--b\n\nÉ  3!") == b"a b " + "É".encode() + b" 3 "
    assert plain("") == b""


def test_against_brute_force(sentence):
    r = random.Random(6)
    items = [(k, plain(sentence(k, n)).strip()) for k, n in enumerate((4, 8, 12, 20, 40, 60))]
    matcher = decontam.Matcher(items)
    for trial in range(60):
        name, item = r.choice(items)
        edited = bytearray(item)
        for _ in range(r.randrange(9)):
            at = r.randrange(len(edited))
            kind = r.randrange(3)
            if kind == 0:
                edited[at] = r.randrange(97, 123)
            elif kind == 1:
                del edited[at]
            else:
                edited.insert(at, r.randrange(97, 123))
        text = plain(sentence(900 + trial, 10)) + b" " + bytes(edited) + b" " + plain(sentence(800 + trial, 10))
        assert {(i, d) for i, d, _ in matcher.find(text)} == brute(items, text)


def brute(items, text):
    """(id, distance) of all items that occur between word borders."""
    text = b" " + text.strip() + b" "
    return {(i, d) for i, x in items if x.strip() and (d := least(b" " + x + b" ", text)) <= decontam.budget(len(x))}


def test_word_borders():
    matcher = decontam.Matcher([(1, b"cat"), (2, b"the cat sat"), (3, b"cat")])
    assert matcher.find(b"concatenate") == []
    assert matcher.find(b"a cat") == [(1, 0, 5), (3, 0, 5)]
    assert matcher.find(b"the cat sat on") == [(1, 0, 7), (2, 0, 11), (3, 0, 7)]


def test_items_of_one_template(sentence):
    """Many items share their pieces: results stay those of brute force, and a text costs little."""
    import time

    r = random.Random(9)
    names = sorted({"".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randrange(5, 12))) for _ in range(3200)})[:3000]
    items = [(i, f"which river flows through the town of {x} and where does it end".encode()) for i, x in enumerate(names)]
    matcher, alone = decontam.Matcher(items), decontam.Matcher([(i, plain(sentence(i, 12)).strip()) for i in range(3000)])
    text = b"tell me " + items[7][1] + b" please"
    few = items[:40]
    assert {x[:2] for x in decontam.Matcher(few).find(text)} == brute(few, text)
    assert (7, 0) in {x[:2] for x in matcher.find(text)}

    def cost(m, texts):
        t = time.perf_counter()
        for x in texts:
            m.find(x)
        return time.perf_counter() - t

    texts = [f"so which river flows through the town of {sentence(k, 1)}{k} and where does it end".encode() for k in range(40)]
    assert cost(matcher, texts) / 40 < 0.02 and cost(alone, texts) < cost(matcher, texts)


def test_columns(spark, docs_of, odd_texts, sentence, monkeypatch):
    bench = [(1, sentence(1, 30)), (2, None), (3, ""), (4, "..."), (None, "x y"), (5, sentence(2, 3)), (6, sentence(3, 30))]
    b = spark.createDataFrame(bench, "item_id long, text string")
    texts = dict(enumerate([*odd_texts, f"so {bench[0][1].upper()}! end", f"{bench[5][1]} and {bench[6][1][:-1]}", sentence(8, 50)]))
    n = len(odd_texts)
    expected = {n: [(1, 0)], n + 1: [(5, 0), (6, 1)]}
    docs = docs_of(spark, texts)
    for size in (8 << 20, 64):  # one block, or many
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        got = {}
        for r in decontam.matches(docs, b).collect():
            got.setdefault(r.doc_id, []).append((r.item_id, r.distance))
        assert {k: sorted(v) for k, v in got.items()} == expected
        left = decontam.clean(docs, b)
        assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(texts) - set(expected)
    assert decontam.matches(docs, b.limit(0)).count() == 0 and decontam.clean(docs, b.limit(0)).count() == len(texts)
    assert decontam.matches(docs.limit(0), b).count() == 0


def test_blocks_are_held_one_at_a_time(spark, docs_of, sentence, monkeypatch):
    """No block is read before the hits of the one before it are written."""
    b = spark.createDataFrame([(i, sentence(i, 30)) for i in range(12)], "item_id long, text string")
    monkeypatch.setattr(decontam, "BLOCK_BYTES", 600)
    order = []
    blocks, write = decontam._blocks, decontam.written

    def seen(*args):
        for items in blocks(*args):
            order.append("block")
            yield items

    monkeypatch.setattr(decontam, "_blocks", seen)
    monkeypatch.setattr(decontam, "written", lambda df, name: order.append("hits") or write(df, name))
    found = decontam.matches(docs_of(spark, {i: "so " + sentence(i, 30) for i in range(12)}), b)
    assert len(order) > 4 and order == ["block", "hits"] * (len(order) // 2)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(i, i) for i in range(12)}
