"""Work inside groups of any size: numbering, carrying values, bounded collections.

Rows are range-partitioned on (keys, order), so a hot group spreads over many tasks, and
one small summary row per (group, slice) links the slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import durable

MAX_ITEMS = 1_000


def _slices(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    ranged = df.repartitionByRange(*keys, *order)
    return durable(ranged.withColumn("_slice", F.spark_partition_id()))


def _link(pinned: DataFrame, summary: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the summary of its group and slice; null keys are a group like any other."""
    named = summary.withColumnsRenamed({c: f"_of_{c}" for c in (*keys, "_slice")})
    on = F.col("_slice") == F.col("_of__slice")
    for key in keys:
        on = on & F.col(key).eqNullSafe(F.col(f"_of_{key}"))
    return pinned.join(named, on)


def number_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Add the 1-based position of each row in its group. (keys, order) must be unique."""
    # A slice is sorted when it is stored, so its rows are numbered there and a group's rows in it have neighbouring numbers.
    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    pinned = durable(ranged.withColumns({"_slice": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pinned.groupBy(*keys, "_slice").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select(
        *keys, "_slice", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    return (
        _link(pinned, offsets, keys)
        .withColumn(out, F.col("_before") + F.col("_at") - F.col("_first") + 1)
        .select(*df.columns, out)
    )


def carry_previous(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Add the last non-null `value` among the rows before this one in its group."""
    pinned = _slices(df, keys, order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        pinned.groupBy(*keys, "_slice")
        .agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end"))
    )
    carried = ends.select(
        *keys, "_slice", F.last("_end", ignorenulls=True).over(before).alias("_carried")
    )
    inside = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        _link(pinned.withColumn("_local", F.last(value, ignorenulls=True).over(inside)), carried, keys)
        .withColumn(out, F.coalesce("_local", "_carried"))
        .select(*df.columns, out)
    )


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
               rank: str = "_rank") -> DataFrame:
    """The first `k` rows of each group. Spark cuts every map task's output to `k` rows
    per group before the shuffle, so a hot group stays small."""
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)
    return kept.drop(rank) if rank == "_rank" else kept


def collect_parts(df: DataFrame, keys: Sequence[str], item: str, out: str, max_items: int = MAX_ITEMS) -> DataFrame:
    """Collect `item` per group into sorted arrays: (keys, part, parts, out).

    Equal items are collapsed and come with their number of `copies`, combined before the first shuffle.
    A group has one part per `max_items` different items and is spread over its parts by item hash, so
    no array grows with the group and nothing is cut. The plan is the same at every size; null keys are
    a group of their own.
    """
    items = df.groupBy(*keys, item).agg(F.count("*").alias("copies"))
    sizes = items.groupBy(*keys).agg(F.ceil(F.count("*") / F.lit(max_items)).cast("bigint").alias("parts"))
    named = sizes.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys]
    tagged = items.join(named, on).withColumn("part", F.pmod(F.xxhash64(item), F.col("parts"))).select(
        *keys, "part", "parts", F.struct(F.col(item).alias("item"), "copies").alias("_item"))
    # Dealt out by part, so that the tasks of a large group are as many as its parts.
    return tagged.repartition(*keys, "part").groupBy(*keys, "part", "parts").agg(
        F.sort_array(F.collect_list("_item")).alias(out))
