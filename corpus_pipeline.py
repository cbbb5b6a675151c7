"""Raw documents to training tokens: five stages, each written as Parquet and read by the next.

`run(spark, sf_dir)` applies them to `documents`. A stage takes (spark, docs, sf_dir); all but the last
return the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.llm import bpe, exact, jaccard, mixing, toxicity
from riskframe.llm.queries import table, vocabulary
from riskframe.session import step


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go. The classifier learns from the labelled rows among `docs`.

    In every stage null and empty texts are texts without words, repeated rows are rows like any other until a
    dedup stage keeps one, and an empty table stays empty.
    """
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id stays."""
    return exact.drop_exact_duplicates(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8 or more), the smallest doc_id stays."""
    return jaccard.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order; as often as their source's target asks."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.tokenise(docs, *vocabulary())


STAGES = [("toxicity", clean), ("exact dedup", distinct), ("near dedup", dissimilar), ("mixing", mixed), ("tokens", tokens)]

# The first stage is a trained classifier, which SQL cannot express; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = step(spark, lambda: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
