import random
from collections import Counter

import numpy as np
import pytest

from flowkit.llm import suffixdedup
from flowkit.llm.suffixes import blind_order, deep_shallow


def shared(a, b):
    return next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


@pytest.mark.parametrize("seed", range(40))
def test_deep_shallow_against_sorted(seed):
    """Groups of suffixes with long common prefixes, NULs, equal ones and ones that are prefixes of others."""
    r = random.Random(seed)
    base = bytes(r.choice(b"ab\0") for _ in range(200))
    parts = []
    for _ in range(r.randrange(60)):
        x = bytearray(base[r.randrange(3) :][: r.randrange(80)])
        if x and r.random() < 0.5:
            x[r.randrange(len(x))] = r.choice(b"ab\0")
        parts.append(bytes(x))
    group = np.array([r.randrange(4) for _ in parts], np.int64)
    found = deep_shallow(parts, group, 80)
    rows = [(int(group[i]), parts[i]) for i in found.order]
    assert rows == sorted(rows) and sorted(found.order.tolist()) == list(range(len(parts)))
    assert found.lcp[1:].tolist() == [shared(a[1], b[1]) if a[0] == b[0] else -1 for a, b in zip(rows, rows[1:], strict=False)]


def test_blind_trie_keeps_the_order_of_equal_suffixes():
    assert blind_order([b"b", b"", b"ab", b"b", b"a", b""]) == [1, 5, 4, 2, 0, 3]
    assert blind_order([]) == []


def brute(texts, span):
    raw = {i: (t or "").encode() for i, t in texts.items()}
    times = Counter(b[k : k + span] for b in raw.values() for k in range(len(b) - span + 1))
    out = {}
    for i, b in raw.items():
        gone = bytearray(len(b))
        for k in range(len(b) - span + 1):
            if times[b[k : k + span]] > 1:
                gone[k : k + span] = b"\1" * span
        out[i] = (len(b), sum(gone), sum(x and not (k and gone[k - 1]) for k, x in enumerate(gone)), bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def run(docs, span, **more):
    docs = docs.select("doc_id", "text")
    cut = suffixdedup.with_spans(docs, suffixdedup.repeated_bytes(docs, span, **more)).select("doc_id", suffixdedup.cut_bytes()("text", "spans").alias("c"))
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in cut.select("doc_id", "c.*").collect()}


def corpus(seed, span, odd_texts):
    """Passages just shorter and longer than the span at any place, periodic texts, copies, and half of the texts with one passage."""
    r = random.Random(seed)
    letters = "abcdé ü"
    piece = lambda n: "".join(r.choice(letters) for _ in range(n))
    passages = [piece(n) for n in (span // 2, span * 3 // 4, span - 1, span, span + 1, span * 2, span * 5)]
    texts = {i: "".join(x for p in r.sample(passages, 2) for x in (piece(r.randrange(span)), p)) + piece(r.randrange(30)) for i in range(50)}
    hot = piece(span + 40)
    texts |= {i: piece(r.randrange(9)) + hot + piece(r.randrange(9)) for i in range(50, 90)}
    texts |= {90: "ab" * span, 91: "a" * (span * 3), 92: texts[3], 93: texts[3] + "x", 94: "a" * span, 95: "ü" * span}
    return texts | {100 + k: t for k, t in enumerate(odd_texts)}


@pytest.mark.parametrize(("span", "limit"), [(200, 4096), (200, 3), (64, 4096), (7, 5), (3, 4096)])
def test_against_brute_force(spark, docs_of, odd_texts, span, limit):
    """With a small limit many minimizers count as hot; the rows are the same."""
    texts = corpus(span + limit, span, odd_texts)
    assert run(docs_of(spark, texts), span, limit=limit) == brute(texts, span)


def test_minimizers_do_not_depend_on_the_place_or_on_blocks(monkeypatch):
    buf = np.frombuffer(random.Random(1).randbytes(5000), np.uint8)
    whole = suffixdedup.minimizers(buf, 200)
    monkeypatch.setattr(suffixdedup, "CHUNK", 333)
    assert all((a == b).all() for a, b in zip(whole, suffixdedup.minimizers(buf, 200), strict=True))
    part = suffixdedup.minimizers(buf[1234:], 200)
    assert (part[0] == whole[0][1234:]).all() and (part[1] + 1234 == whole[1][1234:]).all()
    assert len(suffixdedup.minimizers(buf[:199], 200)[0]) == 0


def test_empty_table_repeated_rows_and_null_ids(spark, docs_of):
    r = random.Random(2)
    t = "".join(r.choice("abcdefgh") for _ in range(300))
    assert run(docs_of(spark, [(1, "x")]).limit(0), 200) == {}
    assert run(docs_of(spark, [(1, t), (1, t)]), 200) == {1: (300, 0, 0, t.encode())}
    assert run(docs_of(spark, [(1, t), (1, t), (2, t + "?")]), 200) == {1: (300, 300, 1, b""), 2: (301, 300, 1, b"?")}
    assert run(docs_of(spark, [(None, t), (2, t)]), 200) == {None: (300, 0, 0, t.encode()), 2: (300, 0, 0, t.encode())}
    with pytest.raises(ValueError, match="3 bytes"):
        suffixdedup.repeated_bytes(docs_of(spark, {1: t}), 2)
