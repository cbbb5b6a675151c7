"""What a rescan stores: the scores of every package of the changed projects, and a summary per project (L2, H7)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.identity import package_key
from riskframe.operators.matching import match_blocklist, match_osv
from riskframe.operators.published import Table
from riskframe.plans.reports import save_scan
from riskframe.plans.risk import score_packages
from riskframe.session import durable

NO_DETECTIONS = "package_id STRING, confidence DOUBLE"
NO_CHANGES = "package_id STRING, severity STRING"
NO_METRICS = ("package_id STRING, days_since_push INT, releases_last_year INT, open_issues INT, stars INT, "
              "contributor_count INT")
FIELDS = ("advisory_score", "community_score", "final_score", "severity", "advisory_count", "report_count")


def assess(packages: DataFrame, affected: DataFrame, blocklist: DataFrame, detections: DataFrame | None = None,
           changes: DataFrame | None = None, metrics: DataFrame | None = None) -> DataFrame:
    """Every package of every project with its scores.

    `packages` is what `resolve_packages` gives. A package that many projects hold is matched and scored once, by
    (name, version, ecosystem). `affected` is as in `match_osv`; detections, changes and metrics
    come with the `package_id` that `package_key` gives, and may be left out. The resolved packages are stored once: matching
    and scoring use them many times, and each use would read and parse all manifests anew.
    """
    spark = packages.sparkSession
    packages = durable(packages.select("project_id", "name", "version", "ecosystem", "is_direct", "is_dev", "depth"), "resolved")
    key = package_key(F.col("name"), F.col("version"), F.col("ecosystem")).alias("package_id")
    held = durable(packages.select("name", "version", "ecosystem").distinct(), "held")
    advisories = durable(match_osv(held, affected).select(key, "severity", "cvss_score"), "matched")
    reports = match_blocklist(held, blocklist).select(key, "severity")
    detections, changes, metrics = (
        spark.createDataFrame([], schema) if given is None else given
        for given, schema in ((detections, NO_DETECTIONS), (changes, NO_CHANGES), (metrics, NO_METRICS)))
    risks = score_packages(held.select(key, "name", "version", "ecosystem"), advisories, detections, changes, metrics, reports)
    rows = packages.select("project_id", "name", "version", "ecosystem", "is_direct", "is_dev", "depth", key)
    return rows.join(risks.select("package_id", *FIELDS), "package_id")


def scan_summaries(risks: DataFrame, as_of: Column) -> DataFrame:
    """One summary per project; its id is a hash of project and time, so that a repeated scan has the same one."""
    at = risks.withColumns({"project_path": F.col("project_id").cast("string"), "scanned_at": as_of})
    digest = F.sha2(F.concat_ws("\u0001", "project_path", F.col("scanned_at").cast("string")), 256)
    parts = [F.substring(digest, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return save_scan(at.withColumn("scan_id", F.concat_ws("-", *parts)))


def scored_scan(packages_of: Callable[[DataFrame], DataFrame], as_of: Column,
                **evidence: DataFrame) -> Callable[[DataFrame], dict[str, Table]]:
    """A scan for `publish_rescans`: tables `risks` and `scans` of the projects that a batch names."""
    def scan(batch: DataFrame) -> dict[str, Table]:
        return {"risks": assess(packages_of(batch), **evidence), "scans": lambda written: scan_summaries(written["risks"], as_of)}

    return scan
