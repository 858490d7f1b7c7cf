import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of():
    """(spark, {id: text} or pairs) -> a documents table, with columns whose names operators use inside."""

    def made(spark, texts):
        pairs = list(texts.items()) if isinstance(texts, dict) else list(texts)
        rows = [(i, t, "en", "src0", len(t or ""), 0.5, "x", 1) for i, t in pairs]
        return spark.createDataFrame(rows, SCHEMA + ", score double, sig string, doc long")

    return made


@pytest.fixture(scope="session")
def sentence():
    """A maker of random sentences: (seed, words) -> text."""

    def made(seed, n, vocabulary=4000):
        r = random.Random(seed)
        return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))

    return made


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, blanks, one word, no spaces, control and wide characters, repeats."""
    return [None, "", " \t\n", "one", "One", "a b c", "x" * 5000, "ß ü \x1c naïve 😀", "der " * 300, "a\x0bb\x0cc\rd"]
