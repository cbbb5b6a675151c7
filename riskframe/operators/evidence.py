"""Evidence of a package reduced to scores and counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.severity import severity_from_rank, severity_rank, severity_score
from riskframe.operators.filters import split_ignored
from riskframe.seeds import SEVERITY_SCORES


def _advisory_score(cvss: Column, score: Column) -> Column:
    """A tenth of the highest positive CVSS, else the highest severity score."""
    return F.when(cvss > 0, cvss / 10).otherwise(F.coalesce(score, F.lit(0.0)))


def _mean_score(scores: Column) -> Column:
    """Mean of one-digit scores; summed as decimals so that row order cannot matter."""
    exact = scores.cast("decimal(3,1)")
    return F.least(F.coalesce(F.sum(exact).cast("double") / F.count(exact), F.lit(0.0)), F.lit(1.0))


def advisory_score(advisories: DataFrame) -> DataFrame:
    return advisories.groupBy("package_id").agg(
        _advisory_score(F.max("cvss_score"), F.max(severity_score(F.col("severity")))).alias("advisory_score")
    )


def pattern_score(detections: DataFrame) -> DataFrame:
    return detections.groupBy("package_id").agg(
        F.coalesce(F.max("confidence"), F.lit(0.0)).alias("pattern_score")
    )


def version_change_score(diffs: DataFrame) -> DataFrame:
    return diffs.groupBy("package_id").agg(
        _mean_score(severity_score(F.col("severity"))).alias("version_change_score")
    )


def community_score(reports: DataFrame) -> DataFrame:
    return reports.groupBy("package_id").agg(
        F.coalesce(F.max(severity_score(F.col("severity"))), F.lit(0.0)).alias("community_score")
    )


def evidence_scores(advisories: DataFrame, detections: DataFrame, diffs: DataFrame,
                    reports: DataFrame) -> DataFrame:
    """All four scores and counts per package from one aggregate.

    The four tables are narrowed, stacked and combined before the shuffle, so each map
    task sends one row per package and a hot package costs no more than any other.
    """
    score = severity_score(F.col("severity"))
    stacked = None
    for kind, table, value, cvss in (
        ("advisory", advisories, score, F.col("cvss_score")),
        ("detection", detections, F.col("confidence"), None),
        ("change", diffs, score, None),
        ("report", reports, score, None),
    ):
        rows = table.select(
            "package_id", F.lit(kind).alias("kind"), value.alias("value"),
            (F.lit(None) if cvss is None else cvss).cast("double").alias("cvss"),
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)

    def of(kind: str) -> Column:
        return F.when(F.col("kind") == kind, F.col("value"))

    return stacked.groupBy("package_id").agg(
        _advisory_score(F.max("cvss"), F.max(of("advisory"))).alias("advisory_score"),
        F.coalesce(F.max(of("detection")), F.lit(0.0)).alias("pattern_score"),
        _mean_score(of("change")).alias("version_change_score"),
        F.coalesce(F.max(of("report")), F.lit(0.0)).alias("community_score"),
        *(F.count_if(F.col("kind") == kind).alias(name) for kind, name in (
            ("advisory", "advisory_count"), ("detection", "detection_count"),
            ("change", "change_count"), ("report", "report_count"),
        )),
    )


def severity_counts(risks: DataFrame, keys: Sequence[str] = ("project_id",),
                    total: str = "total_packages") -> DataFrame:
    """Packages in total and per severity."""
    return risks.groupBy(*keys).agg(F.count("*").alias(total), *severity_count_columns())


def severity_count_columns() -> list[Column]:
    return [
        F.count_if(F.col("severity") == level).alias(f"{level}_count")
        for level in reversed(SEVERITY_SCORES)
    ]


def active_counts(risks: DataFrame, ignored: DataFrame) -> DataFrame:
    """`severity_counts` without each project's ignored packages, and the length of its list."""
    lists = ignored.select("project_id", "name").distinct()
    flagged = split_ignored(risks, lists, ["project_id", "name"])
    counted = flagged.withColumn("severity", F.when(~F.col("is_ignored"), F.col("severity"))).groupBy(
        "project_id"
    ).agg(F.count("severity").alias("total_packages"), *severity_count_columns())
    sizes = lists.groupBy("project_id").agg(F.count("*").alias("ignored_count"))
    return counted.join(sizes, "project_id", "left").na.fill(0, ["ignored_count"])


def scan_ecosystems(packages: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    """Distinct ecosystems per scan as one sorted, comma-joined text."""
    return packages.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_set("ecosystem")), ",").alias("ecosystems")
    )


def worst_severity(risks: DataFrame, keys: Sequence[str] = ("project_id",)) -> DataFrame:
    worst = F.coalesce(F.max(severity_rank(F.col("severity"))), F.lit(0))
    return risks.groupBy(*keys).agg(severity_from_rank(worst).alias("worst_severity"))


def evidence_counts(scores: DataFrame) -> DataFrame:
    """How many pieces of evidence of each of the four kinds every package has."""
    return scores.select("package_id", "advisory_count", "detection_count", "change_count", "report_count")


def repo_activity(releases: DataFrame, contributors: DataFrame, as_of: Column, page: int | None = None) -> DataFrame:
    """Per repository: releases of the last 365 days and contributors; with `page`, each up to that many."""
    def upto(count: Column) -> Column:
        return count if page is None else F.least(count, F.lit(page))

    year = F.count_if(F.col("published_at") >= as_of - F.expr("INTERVAL 365 DAYS"))
    recent = releases.groupBy("owner", "repo").agg(upto(year).alias("releases_last_year"))
    people = contributors.groupBy("owner", "repo").agg(upto(F.count("*")).alias("contributor_count"))
    return recent.join(people, ["owner", "repo"], "full").na.fill(0)


def tree_counts(packages: DataFrame) -> DataFrame:
    return packages.groupBy("project_id").agg(
        F.count("*").alias("package_count"), F.count_if("is_direct").alias("direct_count")
    )


def blocklist_info(blocklist: DataFrame) -> DataFrame:
    return blocklist.groupBy("list_version").agg(F.count("*").alias("entry_count"))
