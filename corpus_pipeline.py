"""A training corpus in five stages, each a Spark job over all that the stage before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowkit.llm import bpe, decontam, jaccard, pii, toxicity
from flowkit.llm.common import bounded_batches, fold, free_name, small_keys, table, written
from flowkit.llm.queries import pii_key, tokenizer

#: Stages that SQL cannot state are tested against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    net = toxicity.fitted(docs, table(spark, sf_dir, "labels"), fold("doc_id", 5) != 0)
    return docs.filter(toxicity.score(net)("text") < 0.5)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of five-word shingle sets 80 % alike."""
    bounded_batches(spark)
    found = jaccard.jaccard_components(docs, n=5, num=80, den=100)
    others = written(found.filter("component_id <> doc_id").select("doc_id").distinct(), "others")
    return docs.join(small_keys(others), "doc_id", "left_anti").select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms for personal data; n_chars follows the new text."""
    bounded_batches(spark)
    new = free_name(docs, "new")
    docs = docs.withColumn(new, pii.pseudonymise(pii_key(spark))("text"))
    docs = docs.withColumn("text", F.col(f"{new}.text")).drop(new)
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text that decoding them gives."""
    bounded_batches(spark)
    path, pattern = tokenizer()
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    ids = docs.select(*kept, bpe.round_trip(path, pattern)("text").alias("e"))
    return ids.select(*kept, "e.n_tokens", "e.ids", F.decode("e.decoded", "UTF-8").alias("text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", hide_personal_data),
    ("bpe", tokenise),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over ``documents``; what a stage keeps is written to the shared folder for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
