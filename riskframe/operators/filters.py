"""Row filters over packages, risks and the blocklist."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.seeds import LOCK_FILES


def limit_depth(packages: DataFrame, depth: int | None) -> DataFrame:
    return packages if depth is None else packages.filter(F.col("depth") <= depth)


def exclude_dev(packages: DataFrame) -> DataFrame:
    return packages.filter(~F.coalesce(F.col("is_dev"), F.lit(False)))


def direct_packages(packages: DataFrame) -> DataFrame:
    return packages.filter("is_direct")


def filter_severity(risks: DataFrame, levels: Sequence[str] | None = None,
                    default_levels: Sequence[str] = ()) -> DataFrame:
    """Keep the requested levels, else the default ones, else everything."""
    wanted = [level.upper() for level in (levels or default_levels)]
    return risks.filter(F.upper("severity").isin(wanted)) if wanted else risks


def search(risks: DataFrame, text: str = "", direct_only: bool = False) -> DataFrame:
    found = risks.filter("is_direct") if direct_only else risks
    return found.filter(F.contains(F.lower("name"), F.lit(text.lower()))) if text else found


def split_ignored(risks: DataFrame, ignored: DataFrame, on: Sequence[str] = ("name",)) -> DataFrame:
    """Flag rows whose package is on the ignore list."""
    marks = ignored.select(*on).distinct().withColumn("_hit", F.lit(True))
    return risks.join(marks, list(on), "left").withColumn(
        "is_ignored", F.coalesce("_hit", F.lit(False))
    ).drop("_hit")


def filter_blocklist(blocklist: DataFrame, ecosystem: str | None = None,
                     severity: str | None = None) -> DataFrame:
    for column, value in (("ecosystem", ecosystem), ("severity", severity)):
        if value is not None:
            blocklist = blocklist.filter(F.lower(column) == value.lower())
    return blocklist


def drop_ignored_advisories(advisories: DataFrame, ignored: DataFrame) -> DataFrame:
    """Drop advisories suppressed for a project by (project_id, external_id)."""
    return advisories.join(ignored, ["project_id", "external_id"], "left_anti")


def advisories_of_projects(packages: DataFrame, advisories: DataFrame, ignored: DataFrame) -> DataFrame:
    """(project_id, package_id, external_id) for every package of a project and advisory of it that the project does not suppress.

    `packages`: project_id, package_id; `advisories`: package_id, external_id; `ignored`: project_id, external_id. Only the
    three tables are shuffled, never the far larger result: each package carries the suppressed ids of its own
    advisories, no more than the project's list has, and the join on the package leaves them out.
    """
    marks = ignored.select("project_id", "external_id").distinct()
    hits = advisories.select("package_id", "external_id").join(marks, "external_id").distinct()
    lists = packages.select("project_id", "package_id").distinct().join(hits, ["project_id", "package_id"]).groupBy(
        "project_id", "package_id").agg(F.collect_list("external_id").alias("_ignored"))
    carrying = packages.select("project_id", "package_id").join(lists, ["project_id", "package_id"], "left")
    shown = F.coalesce(~F.array_contains("_ignored", F.col("external_id")), F.lit(True))
    return carrying.join(advisories.select("package_id", "external_id"), "package_id").filter(shown).select(
        "project_id", "package_id", "external_id")


def lock_events(files: DataFrame) -> DataFrame:
    """Keep arrivals of known lock files; works on batches and streams."""
    return files.filter(F.col("file_name").isin(*LOCK_FILES))
