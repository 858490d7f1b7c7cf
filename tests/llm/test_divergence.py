import random
import re
from collections import Counter

import numpy as np
import pytest

from flowkit.llm import divergence
from flowkit.llm.transducer import Transducer, minimal

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def reachable(steps):
    seen, stack = {0}, [0]
    while stack:
        new = set(steps[stack.pop()].values()) - seen
        seen |= new
        stack += new
    return len(seen)


@pytest.mark.parametrize("seed", range(30))
def test_transducer(seed):
    """Ordinals are places in byte order, and there is one state for each set of endings."""
    r = random.Random(seed)
    word = lambda least: bytes(r.choice(b"abc\xc3\xff") for _ in range(r.randrange(least, 7)))
    terms = sorted({word(seed % 2) for _ in range(r.randrange(80))})
    probes = terms + [word(0) for _ in range(100)]
    end = np.cumsum([len(p) for p in probes])
    found = Transducer.of(terms).ordinals(np.frombuffer(b"".join(probes) + b"x", np.uint8), end - [len(p) for p in probes], end)
    assert found.tolist() == [terms.index(p) if p in terms else -1 for p in probes]
    heads = {t[:k] for t in terms for k in range(len(t) + 1)}
    endings = {frozenset(t[len(h) :] for t in terms if t.startswith(h)) for h in heads}
    assert reachable(minimal(terms)[0]) == max(1, len(endings))


def test_shares_are_exact():
    r = random.Random(3)
    for _ in range(300):
        total = r.randrange(1, 2 ** r.randrange(1, 53))
        count = r.randrange(total + 1)
        assert divergence._share(np.array([count]), total)[0] == 1 + 10**9 * count // total


def brute(rows, least, top):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOWER))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        within = [d for d in docs if d[0] == lang]
        often = Counter(t for _, _, terms in within for t in set(terms))
        kept = sorted((t for t, n in often.items() if n >= least), key=str.encode)
        counts = {s: Counter(t for _, source, terms in within if source == s for t in terms) for s in {d[1] for d in within}}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[k] for k in kept) + 2 * len(kept)) for t in kept}
        q = share(sum(counts.values(), Counter()))
        p = {s: share(c) for s, c in counts.items()}
        apart = lambda x, y: (x - y) ** 2 // (x + y)
        for s in p:
            pairs = sorted(((-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in p if o != s))
            own = sorted((-apart(p[s][t], q[t]), t.encode(), t) for t in kept if counts[s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, k + 1) for part, found in (("pair", pairs), ("term", own)) for k, (v, _, item) in enumerate(found)]
    return sorted(out)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "lang string, source string, text string, n int, term string, rank int")
    return sorted(tuple(r) for r in divergence.audit(docs, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def corpus(seed, odd_texts, sources, words):
    """Rows with ties, a source that holds a third of them, nulls, odd texts and repeated rows."""
    r = random.Random(seed)
    vocabulary = [("zß"[k % 2] if k % 7 == 0 else "") + "".join(chr(97 + int(x)) for x in str(k)) for k in range(words)]
    rows = []
    for _ in range(200):
        source = "hot" if r.random() < 0.35 else f"s{r.randrange(sources)}"
        text = " ".join(r.choice(vocabulary).upper() if r.random() < 0.2 else r.choice(vocabulary) for _ in range(r.randrange(40))).replace(" ", r.choice(" 1-\x00\n"))
        rows.append((r.choice(["de", "en", None]), source, text))
    rows += [("xx", None, None), ("xx", "only", "!"), ("yy", "alone", "word"), ("en", "Ü", "1 2 3")]
    rows += [(r.choice(["de", "en"]), "odd", t) for t in odd_texts] * 2
    return rows + rows[:5]


@pytest.mark.parametrize(("least", "shard", "wave", "sources", "words"), [(10, 1 << 16, 1 << 25, 5, 40), (3, 15, 1, 5, 40), (1, 1 << 16, 1 << 25, 70, 9000), (10**6, 5, 5, 3, 9)])
def test_against_brute_force(spark, odd_texts, least, shard, wave, sources, words):
    """In one wave or one shard a wave; several tiles of sources and blocks of terms; nothing kept."""
    rows = corpus(words, odd_texts, sources, words)
    assert found(spark, rows, min_documents=least, shard=shard, wave=wave) == brute(rows, least, 10)


def test_empty_table(spark):
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).count() == 0
