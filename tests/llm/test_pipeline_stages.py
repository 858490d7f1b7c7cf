import re

import pytest

import corpus_pipeline
from flowkit.llm import decontam, jaccard, pii
from flowkit.llm.queries import QUERIES, pii_key, tokenizer

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES] == list(range(1, 11))


def test_stages(spark, tmp_path, sentence):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    more = [(10_001, f"{sentence(1, 30)} {leak} {sentence(2, 30)}"), (10_002, sentence(3, 80)), (10_003, sentence(3, 80) + " more"), (10_004, "mail jo.doe77@mail1.example.com or 4111111111111111"), (10_005, None), (10_006, "")]
    kept, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        before, kept = kept, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            assert kept.count() > 0.8 * docs.count()
            kept = kept.unionByName(spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in more], docs.schema))
        seen[name] = {r.doc_id: r for r in kept.collect()}
        if name != "bpe":
            assert kept.columns == docs.columns
        # each decision against brute force
        texts = {r.doc_id: r.text for r in before.collect()}
        if name == "near_duplicates":
            sets = {i: set(s.tolist()) for i, s in zip(texts, jaccard.shingle_sets(__import__("pyarrow").array(list(texts.values())), 5), strict=True)}
            for i in set(texts) - set(seen[name]):
                assert any(j < i and len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) for j in texts)
            left = [i for i in seen[name] if sets[i]]
            assert not any(len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) for i in left for j in left if i < j)
        if name == "decontamination":
            norm = lambda t: decontam.normalised(__import__("numpy").frombuffer((t or "").encode(), "u1")).tobytes()
            bench = [norm(r.text).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            gone = {i for i, t in texts.items() if any(b in norm(t) for b in bench)}
            assert gone <= set(texts) - set(seen[name]) and 10_001 in gone
        if name == "pii":
            assert all(r.n_chars == len(r.text) for r in seen[name].values() if r.text is not None)
            assert seen[name].keys() == texts.keys() and "jo.doe77" not in seen[name][10_004].text and "4111111111111111" not in seen[name][10_004].text
            assert seen[name][10_004].text == pii.replaced(texts[10_004], pii.blake2b(pii_key(spark).encode()).digest())[0]
    assert 10_002 in seen["near_duplicates"] and 10_003 not in seen["near_duplicates"]
    assert {10_005, 10_006} <= set(seen["bpe"]) and all(r.text == (seen["pii"][i].text or "") for i, r in seen["bpe"].items())
    assert tokenizer()[0].endswith(".tiktoken")


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 100 and set(out.columns) == {"doc_id", "lang", "source", "n_tokens", "ids", "text"}


def test_key(spark):
    """A key of one's own, or a random one for the application; never a public one."""
    drawn = pii_key(spark)
    assert len(drawn) == 64 and drawn == pii_key(spark)
    spark.conf.set("spark.flowkit.pii.key", "mine")
    assert pii_key(spark) == "mine"
    spark.conf.unset("spark.flowkit.pii.key")
    with pytest.raises(ValueError):
        pii.pseudonymise("")
