"""Token counts as rollups that are maintained by signed changes.

A batch holds signed rows: a document inserted (+1), deleted (-1), or counted anew (the old count -1,
the new count +1). It is summed by source, language and tokenizer version and written to a folder of
its own number, so a batch that is written again replaces itself and totals never count it
twice. Totals are the sum of all batches: documents are read once, when their batch comes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm.bpe import file_of, load_ranks, share
from riskframe.session import durable, scratch_path

KEYS = ("source", "lang", "version")
BATCH = "batch string, source string, lang string, version string, documents bigint, tokens bigint"


@lru_cache(maxsize=4)
def _encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def token_counts(docs: DataFrame, paths: dict[str, str], pattern: str) -> DataFrame:
    """(doc_id, source, lang, version, n_tokens): the tokens of every whole text by each vocabulary.

    Null text has none. Repeated rows count each.
    """
    files = {version: share(docs.sparkSession, path) for version, path in paths.items()}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encodings = {version: _encoding(file_of(path), pattern) for version, path in files.items()}
        for batch in batches:
            texts = batch.pop("text")
            for version, encoding in encodings.items():
                yield batch.assign(version=version, n_tokens=[len(encoding.encode_ordinary(t or "")) for t in texts])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"),
                       docs["lang"].cast("string").alias("lang"), docs["text"].alias("text"))
    return rows.mapInPandas(count, "doc_id bigint, source string, lang string, version string, n_tokens bigint")


def inserted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, "n_tokens", F.lit(1).alias("sign"))


def deleted(counts: DataFrame) -> DataFrame:
    return counts.select(*KEYS, "n_tokens", F.lit(-1).alias("sign"))


def revised(old: DataFrame, new: DataFrame) -> DataFrame:
    """The old counts go, the new ones come."""
    return deleted(old).unionByName(inserted(new))


class Rollup:
    """Batches under one folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or scratch_path(spark, "rollup")

    def commit(self, batch: str, changes: DataFrame) -> None:
        """Write the sums of the signed changes (source, lang, version, n_tokens, sign) as batch `batch`.

        Sums are combined before the shuffle, so a source that holds most rows is no burden. Null
        source, language or version is a group of its own; a null count adds a document and no tokens.
        Writing the same batch again, whole or after a failure, leaves the same totals. An empty batch
        is a batch.
        """
        sums = changes.groupBy(*KEYS).agg(
            F.sum("sign").cast("bigint").alias("documents"),
            F.sum(F.col("sign") * F.coalesce("n_tokens", F.lit(0))).cast("bigint").alias("tokens"))
        sums.filter("documents <> 0 OR tokens <> 0").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")

    def batches(self) -> DataFrame:
        return self.spark.read.schema(BATCH).option("basePath", self.path).parquet(self.path)

    def totals(self) -> DataFrame:
        """(source, lang, version, documents, tokens) of what is there after all batches."""
        sums = self.batches().groupBy(*KEYS).agg(F.sum("documents").alias("documents"), F.sum("tokens").alias("tokens"))
        return sums.filter("documents <> 0 OR tokens <> 0")


def stored_counts(docs: DataFrame, paths: dict[str, str], pattern: str) -> DataFrame:
    """The token counts as a table, so that several batches read them without tokenising again."""
    return durable(token_counts(docs, paths, pattern), "token-counts")
