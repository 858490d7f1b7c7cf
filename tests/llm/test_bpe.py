import random

import pytest

from flowkit.llm import bpe
from flowkit.llm.queries import tokenizer


@pytest.fixture(scope="module")
def reference():
    return bpe.encoding(*tokenizer())


def test_pieces_encode_as_the_whole(reference):
    r = random.Random(4)
    alphabet = ["a", "B", "é", "1", " ", " ", "\n", "\t", " ", " ", "\x1c", "\x85", "'", "s", ".", "😀", "中", "\r\n"]
    for size in (1, 2, 7, 50):
        for _ in range(60):
            text = "".join(r.choice(alphabet) for _ in range(r.randrange(200)))
            cut = bpe.pieces(text, size)
            assert "".join(cut) == text
            assert [t for p in cut for t in reference.encode_ordinary(p)] == reference.encode_ordinary(text)


def test_long_white_space_is_one_match(reference):
    """Runs longer than a piece, against the library on runs that it can take whole."""
    r = random.Random(7)
    blanks = [" ", "\n", "\t", "\xa0", "\u2028", "\r\n", "\x1c"]
    for _ in range(150):
        text = "".join(r.choice(["word", "7", "'s", "é", "!?", "\x1c", ""]) + r.choice(blanks) * r.randrange(12) + r.choice([*blanks, ""]) for _ in range(6))
        for size in (1, 3, 8):
            assert bpe.token_ids(reference, text, size).tolist() == reference.encode_ordinary(text)
    for blank in " \n\t":
        run = blank * 200_000
        for text in (run, f"a{run}b", f"{run}  {run}!"):
            assert bpe.token_ids(reference, text).tolist() == reference.encode_ordinary(text)
        # beyond what the library takes: the tokens of a run do not depend on what is far from them
        long = bpe.token_ids(reference, f"a{blank * 2_000_000}b")
        assert reference.decode_bytes(long.tolist()) == b"a" + blank.encode() * 2_000_000 + b"b"
        short = reference.encode_ordinary(f"a{blank * 2000}b")
        assert long[:10].tolist() == short[:10] and long[-2:].tolist() == short[-2:]


def test_columns_round_trip(spark, docs_of, odd_texts, reference):
    import numpy as np

    texts = dict(enumerate([*odd_texts, "<|endoftext|> is text", "word " * 40_000, "z" * 100_000]))
    path, pattern = tokenizer()
    docs = docs_of(spark, texts)
    out = docs.select("doc_id", bpe.encode(path, pattern, 1000)("text").alias("e")).select("doc_id", "e.*").withColumn("back", bpe.decode(path, pattern)("ids"))
    both = {r.doc_id: r.e for r in docs.select("doc_id", bpe.round_trip(path, pattern, 1000)("text").alias("e")).collect()}
    for r in out.collect():
        assert both[r.doc_id] == (r.n_tokens, r.ids, r.back)
        ids = reference.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.back)) == (len(ids), ids, (texts[r.doc_id] or "").encode())
    assert docs.limit(0).select(bpe.encode(path, pattern)("text")).count() == 0
