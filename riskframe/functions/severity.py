"""Severity scale, score bands and the labels derived from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.seeds import SEVERITY_RANKS, SEVERITY_SCORES

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def lookup(key: Column, table: dict, default=None) -> Column:
    """`table[key]` as one CASE expression; stays inside generated code."""
    out = None
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)) if out is None else out.when(key == name, F.lit(value))
    return out.otherwise(F.lit(default))


def severity_rank(severity: Column) -> Column:
    """0 (safe) to 4 (critical); order by this, never by the text."""
    return lookup(F.lower(severity), SEVERITY_RANKS)


def severity_score(severity: Column) -> Column:
    return lookup(F.lower(severity), SEVERITY_SCORES)


def severity_label(severity: Column) -> Column:
    return F.upper(severity)


def severity_from_rank(rank: Column) -> Column:
    return lookup(rank, {rank_: name for name, rank_ in SEVERITY_RANKS.items()}, "safe")


def score_to_severity(score: Column) -> Column:
    return (
        F.when(score >= 0.9, "critical").when(score >= 0.7, "high")
        .when(score >= 0.4, "medium").when(score > 0, "low").otherwise("safe")
    )


def _cvss_band(score: Column, at_or_below_zero: str) -> Column:
    return (
        F.when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium")
        .when(score > 0, "low").otherwise(at_or_below_zero)
    )


def osv_cvss(score_text: Column) -> Column:
    """The first severity entry's score as a number; vector text gives null."""
    return F.when(score_text.rlike(NUMBER), score_text.try_cast("double"))


def osv_severity(score_text: Column) -> Column:
    """No score: medium. Text that is no number counts as 0, hence low."""
    band = _cvss_band(F.coalesce(osv_cvss(score_text), F.lit(0.0)), "low")
    return F.when(score_text.isNull(), "medium").otherwise(band)


def nvd_cvss(v31: Column, v30: Column, v2: Column) -> Column:
    """Base score of the newest metric version present."""
    return F.coalesce(v31, v30, v2)


def nvd_severity(cvss: Column) -> Column:
    return _cvss_band(F.coalesce(cvss, F.lit(0.0)), "medium")


def github_severity(level: Column) -> Column:
    return lookup(
        level, {"CRITICAL": "critical", "HIGH": "high", "MODERATE": "medium", "LOW": "low"}, "medium"
    )


def detection_severity(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "HIGH").when(confidence >= 0.5, "MEDIUM").otherwise("LOW")


def maintainer_label(risk: Column) -> Column:
    return (
        F.when(risk < 0.3, "LOW RISK").when(risk < 0.6, "MODERATE RISK").otherwise("HIGH RISK")
    )


def status_label(worst: Column) -> Column:
    return F.when(worst == "safe", "passing").otherwise(worst)


def exit_code(worst: Column) -> Column:
    return lookup(worst, {"safe": 0, "low": 0, "medium": 1, "high": 2, "critical": 3})


def gate_fails(code: Column, threshold: str) -> Column:
    """True when the exit code reaches the threshold; an unknown word means `high`."""
    if threshold == "none":
        return F.lit(False)
    return code >= {"medium": 1, "high": 2, "critical": 3}.get(threshold, 2)
