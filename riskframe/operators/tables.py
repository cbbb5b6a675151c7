"""Upkeep of the stored tables as functions of old and new rows (H1-H9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.operators.groups import first_rows

PACKAGE_KEY = ("name", "version", "ecosystem")
ADVISORY_KEY = ("package_id", "source", "external_id")
MAINTAINER_KEY = ("package_name", "ecosystem")
DIFF_KEY = ("package_id", "from_version", "to_version", "change_type")


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_rows(df, keys, [F.col(c).asc() for c in order], 1)


def dedup_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return first_rows(df, keys, [F.col(c).desc() for c in order], 1)


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], updated: Sequence[str]) -> DataFrame:
    """Insert new keys; for known keys take `updated` from the new row, the rest from the old.

    Both sides hold one row per key. A null in the new row replaces the old value.
    """
    o = old.withColumn("_old", F.lit(True)).alias("o")
    n = new.withColumn("_new", F.lit(True)).alias("n")
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]

    def pick(column: str) -> Column:
        if column in keys:
            return F.coalesce(f"o.{column}", f"n.{column}")
        keep_old = F.col("_new").isNull() if column in updated else F.col("_old").isNotNull()
        return F.when(keep_old, F.col(f"o.{column}")).otherwise(F.col(f"n.{column}"))

    return o.join(n, same, "full").select(*(pick(c).alias(c) for c in old.columns))


def upsert_packages(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(old, new, PACKAGE_KEY, ("registry_url", "checksum"))


def upsert_advisories(old: DataFrame, new: DataFrame) -> DataFrame:
    return upsert(
        old, new, ADVISORY_KEY,
        ("title", "description", "severity", "cvss_score", "patched_versions", "fetched_at"),
    )


def upsert_maintainer(old: DataFrame, new: DataFrame) -> DataFrame:
    kept = {*MAINTAINER_KEY, "id"}
    return upsert(old, new, MAINTAINER_KEY, [c for c in old.columns if c not in kept])


def insert_version_diffs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Add changes whose key is not stored yet; stored ones stay as they are.

    Of new rows with one key, the first in the order of their other columns is added.
    """
    fresh = new.join(old, list(DIFF_KEY), "left_anti").select(*old.columns)
    rest = [c for c in old.columns if c not in DIFF_KEY]
    return old.unionByName(dedup_first(fresh, DIFF_KEY, rest) if rest else fresh.distinct())


def _stale(as_of: Column, ttl_seconds: int) -> Column:
    return F.col("fetched_at") < as_of - F.make_dt_interval(secs=F.lit(ttl_seconds))


def expire(rows: DataFrame, as_of: Column, ttl_seconds: int, package_id=None) -> DataFrame:
    """Drop rows fetched before `as_of - ttl`, of one package or of all."""
    stale = _stale(as_of, ttl_seconds)
    if package_id is not None:
        stale = stale & (F.col("package_id") == package_id)
    return rows.filter(~F.coalesce(stale, F.lit(False)))


def expired_count(rows: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    return rows.agg(F.count_if(_stale(as_of, ttl_seconds)).alias("expired"))


def delete_cascade(tables: dict[str, DataFrame], deleted: DataFrame) -> dict[str, DataFrame]:
    """Remove packages and everything that hangs on them.

    `tables` may hold: packages, dependencies (parent_id, child_id), scan_packages,
    advisories, version_diffs, risk_scores, detected_patterns (pattern_id) and
    mitre_mappings (pattern_id). `deleted` is a list of package_id.
    """
    gone = deleted.select("package_id").distinct()
    out = {}
    for name, table in tables.items():
        if name == "dependencies":
            for end in ("parent_id", "child_id"):
                table = table.join(gone.withColumnRenamed("package_id", end), end, "left_anti")
        elif name == "mitre_mappings":
            dead = tables["detected_patterns"].join(gone, "package_id", "left_semi").select("pattern_id")
            table = table.join(dead, "pattern_id", "left_anti")
        else:
            table = table.join(gone, "package_id", "left_anti")
        out[name] = table
    return out


def toggle_ignored(ignored: DataFrame, toggled: DataFrame) -> DataFrame:
    """Add the listed packages to each project's ignore list, or take them off it."""
    both = ignored.distinct().unionByName(toggled.distinct())
    return both.groupBy(*ignored.columns).count().filter("count = 1").drop("count")


def fresh_source(cached: DataFrame, as_of: Column, ttl_seconds: int) -> DataFrame:
    """Source trees no older than the ttl (whole seconds)."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("modified_at").cast("timestamp"))
    return cached.filter(age <= ttl_seconds)


def append_by_date(rows: DataFrame, path: str, ts: str = "scanned_at") -> None:
    """Append rows to a table partitioned by day."""
    dated = rows.withColumn("scan_date", F.to_date(ts))
    dated.write.mode("append").partitionBy("scan_date").parquet(path)
