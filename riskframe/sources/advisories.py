"""Advisory dumps as tables: OSV, GitHub and NVD records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.severity import github_severity, nvd_cvss, nvd_severity, osv_cvss, osv_severity

_REFS = "ARRAY<STRUCT<url: STRING>>"
OSV = (
    "STRUCT<id: STRING, summary: STRING, details: STRING, published: STRING, "
    "severity: ARRAY<STRUCT<score: STRING>>, "
    "affected: ARRAY<STRUCT<package: STRUCT<name: STRING, ecosystem: STRING>, versions: ARRAY<STRING>, "
    "ranges: ARRAY<STRUCT<events: ARRAY<STRUCT<introduced: STRING, fixed: STRING>>>>>>, "
    f"references: {_REFS}>"
)
GITHUB = (
    "STRUCT<advisory: STRUCT<ghsaId: STRING, summary: STRING, description: STRING, publishedAt: STRING, "
    "severity: STRING>, package: STRUCT<name: STRING>, vulnerableVersionRange: STRING, patchedVersions: STRING>"
)
_METRIC = "ARRAY<STRUCT<cvssData: STRUCT<baseScore: DOUBLE>>>"
NVD = (
    "STRUCT<cve: STRUCT<id: STRING, published: STRING, descriptions: ARRAY<STRUCT<lang: STRING, value: STRING>>, "
    f"metrics: STRUCT<cvssMetricV31: {_METRIC}, cvssMetricV30: {_METRIC}, cvssMetricV2: {_METRIC}>, "
    f"references: {_REFS}>>"
)


def _urls(references: Column) -> Column:
    return F.coalesce(F.transform(references, lambda r: r["url"]), F.array().cast("array<string>"))


def _parsed(raw: DataFrame, schema: str) -> DataFrame:
    """Each record parsed once: `explode` keeps later filters from parsing it again."""
    return raw.select(*_keys(raw), F.explode(F.array(F.from_json("json", schema))).alias("v"))


def _keys(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c != "json"]


def _row(raw: DataFrame, **columns: Column) -> list[Column]:
    return [*map(F.col, _keys(raw)), *(value.alias(name) for name, value in columns.items())]


def osv_advisories(raw: DataFrame) -> DataFrame:
    """One advisory per OSV record; other columns of `raw` are kept."""
    score = F.get("v.severity", F.lit(0))["score"]
    events = F.flatten(F.transform("v.affected", lambda a: F.flatten(
        F.transform(F.coalesce(a["ranges"], F.array()), lambda r: F.coalesce(r["events"], F.array()))
    )))
    introduced = F.array_compact(F.transform(events, lambda e: e["introduced"]))
    return _parsed(raw, OSV).filter("v.id IS NOT NULL").select(*_row(
        raw, source=F.lit("osv"), external_id=F.col("v.id"), title=F.coalesce("v.summary", "v.id"),
        description=F.coalesce("v.details", F.lit("")), severity=osv_severity(score),
        cvss_score=osv_cvss(score), affected_versions=F.coalesce(F.array_join(introduced, ", "), F.lit("")),
        patched_versions=F.lit(None).cast("string"), published_at=F.try_to_timestamp("v.published"),
        references=_urls(F.col("v.references")),
    ))


def osv_ranges(raw: DataFrame) -> DataFrame:
    """(external_id, ecosystem, name, introduced, fixed, versions): one row per interval.

    Events pair up as listed: each `introduced` with the next `fixed` after it. Packages
    that list exact versions give one more row with them.
    """
    records = _parsed(raw, OSV).select(
        F.col("v.id").alias("external_id"), F.explode("v.affected").alias("a")
    ).select("external_id", F.col("a.package.ecosystem").alias("ecosystem"), F.col("a.package.name").alias("name"),
             F.col("a.ranges").alias("ranges"), F.col("a.versions").alias("versions"))
    keys = ["external_id", "ecosystem", "name"]
    events = records.select(*keys, F.explode("ranges").alias("r")).select(*keys, F.col("r.events").alias("e"))
    intervals = events.select(*keys, F.posexplode("e").alias("i", "start"), "e").filter(
        "start.introduced IS NOT NULL"
    ).select(
        *keys, F.col("start.introduced").alias("introduced"),
        F.get(F.filter(F.slice("e", F.col("i") + 2, F.greatest(F.size("e") - F.col("i") - 1, F.lit(0))),
                       lambda x: x["fixed"].isNotNull()), F.lit(0))["fixed"].alias("fixed"),
        F.lit(None).cast("array<string>").alias("versions"),
    )
    listed = records.filter(F.size("versions") > 0).select(
        *keys, F.lit(None).cast("string").alias("introduced"), F.lit(None).cast("string").alias("fixed"), "versions"
    )
    return intervals.unionByName(listed)


def github_advisories(raw: DataFrame) -> DataFrame:
    """One advisory per vulnerability node; no CVSS and no references there."""
    return _parsed(raw, GITHUB).filter("v.advisory.ghsaId IS NOT NULL").select(*_row(
        raw, source=F.lit("github"), external_id=F.col("v.advisory.ghsaId"),
        title=F.coalesce("v.advisory.summary", "v.advisory.ghsaId"),
        description=F.coalesce("v.advisory.description", F.lit("")),
        severity=github_severity(F.col("v.advisory.severity")), cvss_score=F.lit(None).cast("double"),
        affected_versions=F.coalesce("v.vulnerableVersionRange", F.lit("")),
        patched_versions=F.col("v.patchedVersions"), published_at=F.try_to_timestamp("v.advisory.publishedAt"),
        references=F.array().cast("array<string>"),
    ))


def nvd_advisories(raw: DataFrame) -> DataFrame:
    """One advisory per CVE: first English text, newest CVSS version present."""
    english = F.get(F.filter("v.cve.descriptions", lambda d: d["lang"] == "en"), F.lit(0))["value"]
    cvss = nvd_cvss(*(
        F.get(f"v.cve.metrics.{m}", F.lit(0))["cvssData"]["baseScore"]
        for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
    ))
    return _parsed(raw, NVD).filter("v.cve.id IS NOT NULL").select(*_row(
        raw, source=F.lit("nvd"), external_id=F.col("v.cve.id"), title=F.col("v.cve.id"),
        description=F.coalesce(english, F.lit("")), severity=nvd_severity(cvss), cvss_score=cvss,
        affected_versions=F.lit(""), patched_versions=F.lit(None).cast("string"),
        published_at=F.try_to_timestamp("v.cve.published"), references=_urls(F.col("v.cve.references")),
    ))
