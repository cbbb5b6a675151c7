"""Words, row keys and row selection shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: a word is a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall


def id_key(doc_id: Column | str = "doc_id") -> Column:
    """A key that is equal for equal ids, null included, so that plain equi-joins keep null ids."""
    return F.coalesce(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string"), F.lit("null"))


def keyed(docs: DataFrame) -> DataFrame:
    """(row, key, digest): the whole row as one struct, so that no extra column can clash."""
    return docs.select(F.struct("*").alias("row"), id_key(docs["doc_id"]).alias("key"),
                       F.xxhash64(docs["text"]).alias("digest"))


def keep_rows(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of `docs` that `chosen` (doc_id, digest = xxhash64(text)) names; of repeated rows, one."""
    names = chosen.select(id_key("doc_id").alias("key"), "digest").distinct()
    found = keyed(docs).join(names, ["key", "digest"], "left_semi")
    first = F.row_number().over(Window.partitionBy("key", "digest").orderBy("key", "digest"))
    return found.withColumn("nth", first).filter("nth = 1").select("row.*")
