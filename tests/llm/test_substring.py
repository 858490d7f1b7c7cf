import random
import re

import pytest

from flowkit.llm import substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(texts, span):
    first, out = {}, {}
    for i in sorted(texts):
        w = WORD.findall(texts[i] or "")
        windows = [tuple(w[k : k + span]) for k in range(len(w) - span + 1)]
        gone = {k + j for k, x in enumerate(windows) if first.get(x, i) < i for j in range(span)}
        for x in windows:
            first.setdefault(x, i)
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out


def run(docs, span):
    docs = docs.select("doc_id", "text")
    cut = substring.with_spans(docs, substring.repeated_spans(docs, span)).select("doc_id", substring.cut()("text", "spans").alias("c")).select("doc_id", "c.*")
    return {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in cut.collect()}


def test_cover():
    assert {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER} == set(range(substring.PERIOD))


@pytest.mark.parametrize("span", [50, 31, 64])
def test_against_brute_force(spark, docs_of, sentence, odd_texts, span):
    r, texts = random.Random(span), {}
    passages = [sentence(1000 + k, n) for k, n in enumerate((49, 50, 51, 63, 64, 80, 200, 30, 31))]
    for i in range(60):
        parts = [sentence(i, r.randrange(60))] + [x for p in r.sample(passages, 2) for x in (p, sentence(500 + i, r.randrange(9)))]
        texts[i * 3 % 61] = " ".join(parts).replace(" ", r.choice([" ", "\n", " \t"]))
    texts[70], texts[71] = "der " * 400, "der " * 60
    texts[72] = texts[1]
    texts |= {100 + k: t for k, t in enumerate(odd_texts)}
    assert run(docs_of(spark, texts), span) == brute(texts, span)


def test_empty_table_repeated_rows_and_null_ids(spark, docs_of, sentence):
    assert run(docs_of(spark, [(1, "x")]).limit(0), 50) == {}
    t = sentence(5, 90)
    docs = docs_of(spark, [(1, t), (1, t), (2, t + " end")])
    assert run(docs, 50) == {1: (90, 0, t), 2: (91, 90, "end")}
    assert substring.repeated_spans(docs_of(spark, [(None, t), (4, t)]), 50).count() == 0
    with pytest.raises(ValueError):
        substring.repeated_spans(docs, 30)


def thue_morse(a, b, n):
    return [(a, b)[bin(i).count("1") % 2] for i in range(n)]


def test_sequences_on_which_polynomial_hashes_collide(spark, docs_of):
    """Texts, and words, of two values in Thue-Morse order and its complement share nothing."""
    texts = {1: " ".join(f"u{i}{x}" for i, x in enumerate(thue_morse("a", "b", 8192))), 2: " ".join(f"u{i}{x}" for i, x in enumerate(thue_morse("b", "a", 8192)))}
    words = ["".join(thue_morse(a, b, 4096)) for a, b in ("ab", "ba")]
    texts |= {3 + k: " ".join(f"{w} t{i}" for i in range(40)) for k, w in enumerate(words)}
    assert {i: n for i, (_, n, _) in run(docs_of(spark, texts), 50).items()} == dict.fromkeys(texts, 0)
