"""Exact deduplication by content-defined chunk recipes.

A text is cut at places its own content names (a sentence or line end, 512 characters or more after
the last cut), so copied passages give equal chunks wherever they stand. Chunks are deduplicated
byte by byte; a chunk's identifier is its 64-bit hash, verified to belong to one chunk text only, or
hash and rank where it does not. Texts are equal when their ordered identifier lists are equal, so
after the one pass over the chunks only these short lists move, never a document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import keep_rows
from riskframe.session import durable

MIN_CHUNK, MAX_CHUNK = 512, 4096


def hash64(chunk: Column) -> Column:
    return F.xxhash64(chunk)


def cut(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The chunks of a text in order: `least` characters up to the next sentence or line end, or `most`."""
    pattern = rf"(?s).{{{least},{most}}}?(?<=[.!?\n])|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    return docs.select(docs["doc_id"].alias("doc_id"), text.alias("text"), F.xxhash64(docs["text"]).alias("digest"))


def shared_identifiers(rows: DataFrame, identify: Callable[[Column], Column], least: int, most: int) -> DataFrame:
    """(id, chunk, rank) of the hashes that two or more chunk texts share; empty but for collisions."""
    chunks = rows.select(F.explode(cut(F.col("text"), least, most)).alias("chunk"))
    distinct = chunks.select(identify(F.col("chunk")).alias("id"), "chunk").distinct()
    shared = durable(distinct.groupBy("id").count().filter("count > 1").select("id"), "shared-ids")
    if shared.isEmpty():
        return shared.selectExpr("id", "'' AS chunk", "0 AS rank")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("chunk"))
    return durable(distinct.join(shared, "id").withColumn("rank", rank), "chunk-ids")


def recipes(docs: DataFrame, identify: Callable[[Column], Column] = hash64,
            least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """(doc_id, digest, text_sha256, recipe, copy): one row per input row; equal recipes mean equal texts.

    `copy` numbers repeated rows (same id, same text) from 1.
    """
    rows = _rows(docs)
    shared = shared_identifiers(rows, identify, least, most)
    cuts = rows.select("doc_id", "digest", F.sha2("text", 256).alias("text_sha256"),
                       cut(F.col("text"), least, most).alias("chunks"))
    copy = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy("doc_id"))
    if shared.isEmpty():
        plain = cuts.select("doc_id", "digest", "text_sha256", F.transform("chunks", identify).alias("recipe"))
        return plain.withColumn("copy", copy)
    # The chunks of hashes with several texts carry their rank; the lists are gathered again.
    numbered = cuts.withColumn("copy", copy)
    parts = numbered.select("doc_id", "digest", "text_sha256", "copy", F.posexplode_outer("chunks").alias("at", "chunk"))
    ranked = parts.withColumn("id", identify(F.col("chunk"))).join(shared, ["id", "chunk"], "left")
    listed = F.sort_array(F.collect_list(F.struct("at", "id", F.coalesce("rank", F.lit(0)).alias("rank"))))
    return ranked.groupBy("doc_id", "digest", "text_sha256", "copy").agg(listed.alias("recipe"))


def exact_duplicates(docs: DataFrame, identify: Callable[[Column], Column] = hash64,
                     least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> DataFrame:
    """One row per row of `docs` (doc_id, text): keep_id, group_size, kept, text_sha256, digest.

    Null text counts as empty. Of equal texts the row with the largest doc_id stays; null ids are
    smallest; of repeated rows one stays. Other columns are ignored. An empty table gives no rows.
    """
    lists = durable(recipes(docs, identify, least, most), "recipes")
    groups = durable(lists.groupBy("recipe").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "recipe-groups")
    # Both sides are read from tables, so a group that holds most rows is split by adaptive execution.
    return lists.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256", "digest")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of `docs` that stay, with all their columns."""
    return keep_rows(docs, exact_duplicates(docs).filter("kept").select("doc_id", "digest"))
