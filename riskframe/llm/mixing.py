"""Mixing sources to target weights over a time-varying curriculum.

Every source gets a target of words by its weight, at most `cap` times what it has. A source's rate
of words over the training time 0..1 is a ramp whose integral is its target; the words that precede a
document in its source, found on the inverse of that integral, give the document's time, and the
integral of all sources at that time its training position. Documents are sorted by position.

All running sums are cut in two: sums per slice of a source (a slice is a prefix of the document's
hash, so slices are even), then sums within a slice. No task holds a source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.llm.common import WORD, id_key, keyed
from riskframe.session import durable

# By the order of the sources, repeating: weights, and ramps (0.5: half as much again at the start, half at the end).
WEIGHTS = (3, 1, 2)
RAMPS = (5, 0, -5)  # tenths
SHARE, CAP = 1.5, 2
SLICE_DIGITS = 3  # 4,096 slices a source


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, bucket, at, slice, size): `bucket` orders sources by code point, null last."""
    key = F.md5(F.coalesce(docs["doc_id"].cast("string"), docs["text"], F.lit("")))
    return docs.select(
        docs["doc_id"].alias("doc_id"), F.xxhash64(docs["text"]).alias("digest"),
        F.coalesce(F.concat(F.lit("a"), docs["source"]), F.lit("b")).alias("bucket"), key.alias("at"),
        F.substring(key, 1, SLICE_DIGITS).alias("slice"),
        F.coalesce(F.regexp_count(docs["text"], F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"))


def _cycled(values: Sequence[int], rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (rank % len(values) + 1).cast("int")).cast("bigint")


def targets(sources: DataFrame, weights: Sequence[int], ramps: Sequence[int], share: float, cap: int) -> DataFrame:
    """(bucket, source_size) -> with target, demand (whole words) and ramp of each source.

    Giving the excess of capped sources to the others until none is above its cap ends where the
    sources with the smallest cap per weight are capped and the rest share by weight; one pass over
    the sources in that order finds them. One row per source: a small table by nature.
    """
    rank = F.row_number().over(Window.orderBy("bucket")) - 1
    every = Window.partitionBy()
    before = Window.orderBy(F.col("most") / F.col("weight"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranked = sources.withColumn("rank", rank).select(
        "bucket", "source_size", _cycled(weights, F.col("rank")).cast("double").alias("weight"),
        _cycled(ramps, F.col("rank")).alias("ramp"), (F.col("source_size") * float(cap)).alias("most"))
    left = ranked.select(
        "*", (F.sum("source_size").over(every) * share).alias("words"), F.sum("weight").over(every).alias("weights"),
        F.coalesce(F.sum("most").over(before), F.lit(0.0)).alias("given"),
        F.coalesce(F.sum("weight").over(before), F.lit(0.0)).alias("spent"))
    full = (F.col("most") * (F.col("weights") - F.col("spent"))) <= ((F.col("words") - F.col("given")) * F.col("weight"))
    marked = left.withColumn("full", full)
    rest = marked.withColumn("rest", F.col("words") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(every)) \
        .withColumn("open", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(every))
    target = F.when(F.col("full"), F.col("most")).otherwise(F.col("rest") * F.col("weight") / F.col("open"))
    return rest.select("bucket", "source_size", "ramp", target.alias("target"), F.floor(target).alias("demand"))


def _time(done: Column, demand: Column, ramp: Column) -> Column:
    """Inverse of the integral (1 + a) t - a t^2 of a ramp at the share `done / demand`."""
    a, x = ramp / F.lit(10.0), done / demand
    return F.when(ramp == 0, x).otherwise(
        ((1.0 + a) - F.sqrt((1.0 + a) * (1.0 + a) - 4.0 * a * x)) / (2.0 * a))


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, ramps: Sequence[int] = RAMPS,
        share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per row of `docs` (doc_id, text, source), in training order.

    size, source_size, target, taken; `position`, the word of the training run where the document
    first starts, and `again`, where it is repeated (both null if not taken); `passes`, how often it
    is taken. A source is gone through in hash order, twice where its target is above its size; the
    last document of a source may be taken in part. Null text has no words and is taken only with the
    words around it; null source is a source of its own; repeated rows count each.
    """
    rows = durable(sizes(docs), "mix-sizes")
    slices = rows.groupBy("bucket", "slice").agg(F.sum("size").alias("words"))
    sources = slices.groupBy("bucket").agg(F.sum("words").alias("source_size"))
    aims = targets(sources, weights, ramps, share, cap)
    every = Window.partitionBy()
    aims = aims.select(
        "*", F.sum(F.col("demand") * (10 + F.col("ramp"))).over(every).alias("rise"),
        F.sum(F.col("demand") * F.col("ramp")).over(every).alias("bend"))
    earlier = Window.partitionBy("bucket").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(slices.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
                      .drop("words").join(aims, "bucket"), "mix-offsets")
    within = Window.partitionBy("bucket", "slice").orderBy("at", "doc_id", "digest") \
        .rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.join(offsets, ["bucket", "slice"]).withColumn(
        "start", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    def words(start: Column) -> Column:
        return F.least(F.col("size"), F.greatest(F.lit(0), F.col("demand") - start))

    def position(start: Column) -> Column:
        time = _time(start, F.col("demand"), F.col("ramp"))
        at = F.col("rise") / F.lit(10.0) * time - F.col("bend") / F.lit(10.0) * time * time
        return F.when(start < F.col("demand"), F.round(at).cast("bigint"))

    first, second = F.col("start"), F.col("start") + F.col("source_size")
    return placed.select(
        "doc_id", "size", "source_size", "target", (words(first) + words(second)).alias("taken"),
        position(first).alias("position"), position(second).alias("again"), "digest",
    ).orderBy(F.asc_nulls_last("position"), "doc_id")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The rows of `docs` in training order: those of no pass dropped, those of two passes twice.

    A document stays whole, also the last of a source, which is taken in part.
    """
    copy = F.row_number().over(Window.partitionBy("key", "digest").orderBy("key", "digest"))
    starts = F.filter(F.array("position", "again"), lambda s: s.isNotNull())
    plan = mix(docs, **options).select(id_key("doc_id").alias("key"), "digest", starts.alias("starts"))
    rows = keyed(docs).withColumn("copy", copy).join(plan.withColumn("copy", copy), ["key", "digest", "copy"])
    return rows.select("row", F.explode("starts").alias("start")).orderBy("start", "row.doc_id").select("row.*")
