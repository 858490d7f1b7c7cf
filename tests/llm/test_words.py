import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from flowkit.llm.words import grams, shingle_sets, slabs, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
texts = st.lists(st.one_of(st.none(), st.text(alphabet="abAB \n\tßé\x1c", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts, st.booleans())
def test_words_are_the_patterns(data, lower):
    seen = {}
    for lo, _, buf, bounds in slabs(pa.array(data, pa.string()), 16):
        w = words(buf, bounds, lower, (("pre", 2), ("suf", 2)))
        for i in range(len(bounds) - 1):
            expected = WORD.findall((data[lo + i] or "").encode())
            at = range(w.first[i], w.first[i + 1])
            assert [bytes(buf[w.start[k] : w.end[k]]) for k in at] == expected
            for k, word in zip(at, expected, strict=True):
                word = bytes(c + 32 if lower and 65 <= c <= 90 else c for c in word)
                assert seen.setdefault(("w", word), w.hash[k]) == w.hash[k]
                assert seen.setdefault(("p", word[:2]), w.affix["pre", 2][k]) == w.affix["pre", 2][k]
                assert seen.setdefault(("s", word[-2:]), w.affix["suf", 2][k]) == w.affix["suf", 2][k]
    whole = [h for (kind, _), h in seen.items() if kind == "w"]
    assert len(set(whole)) == len(whole)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 6))
def test_grams(data, n):
    h = np.array(data, np.uint64) * np.uint64(0x123456789ABCDEF1)
    got, seen = grams(h, n), {}
    assert len(got) == max(0, len(data) - n + 1)
    for i, g in enumerate(got):
        assert seen.setdefault(tuple(data[i : i + n]), g) == g
    assert len(set(seen.values())) == len(seen)


def test_long_words_and_blocks():
    long = "a" * (3 << 20)
    a, b = shingle_sets(pa.array([long + " b c d", "x " + long]), 4)
    assert len(a) == 1 and len(b) == 1 and a[0] != b[0]


def test_sliced_array():
    arr = pa.array(["skip", "a b", None, "c"])[1:]
    assert [len(u) for u in shingle_sets(arr, 2)] == [1, 0, 1]


def test_long_words_keep_their_case_apart():
    """Words over LONG bytes go by the same rules as short ones."""
    word = "Thue-Morse/" * 9
    same, lower, cut = (words(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])).hash[0] for x in (word, word.lower(), word[:-1]))
    assert len({same, lower, cut}) == 3
    assert words(np.frombuffer(word.encode(), np.uint8), np.array([0, len(word)]), lower=True).hash[0] == lower
