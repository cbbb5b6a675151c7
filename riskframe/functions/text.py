"""Report text: snippets, labels and one-line summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.identity import strip
from riskframe.functions.severity import lookup, severity_label

SNIPPET_LENGTH = 120


def script_snippet(script: Column) -> Column:
    return F.substring(script, 1, SNIPPET_LENGTH)


def code_snippet(line: Column) -> Column:
    return strip(F.substring(line, 1, SNIPPET_LENGTH))


def truncate_label(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("…"))).otherwise(text)


def advisory_issue_text(external_id, severity, name, version, patched) -> Column:
    return F.concat(
        external_id, F.lit(" ("), severity_label(severity), F.lit(") — "), name, F.lit("@"), version,
        F.lit(" — fix: "), F.coalesce(patched, F.lit("unknown")),
    )


def detection_issue_text(description, file_path, line_number, name, version) -> Column:
    place = F.coalesce(
        F.concat(F.lit(" @ "), file_path, F.lit(":"), line_number.cast("string")),
        F.concat(F.lit(" @ "), file_path),
        F.lit(""),
    )
    return F.concat(description, place, F.lit(" — "), name, F.lit("@"), version)


def sbom_ref(name: Column, version: Column) -> Column:
    return F.concat(name, F.lit("-"), version)


def sbom_version_id(name: Column, from_version: Column, to_version: Column) -> Column:
    parts = [F.replace(v, F.lit("."), F.lit("_")) for v in (from_version, to_version)]
    return F.concat_ws("-", F.lit("RISKFRAME-VER"), name, *parts)


def source_label(source: Column) -> Column:
    return lookup(source, {"osv": "OSV", "github": "GitHub", "nvd": "NVD", "mitre": "MITRE"})


def sbom_severity(severity: Column) -> Column:
    return F.when(severity == "safe", "none").otherwise(severity)


def short_id(scan_id: Column) -> Column:
    return F.left(scan_id, F.lit(8))


def format_scan_time(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def staleness_text(days_since_push: Column) -> Column:
    return F.when(days_since_push >= 9999, "unknown").otherwise(
        F.concat(days_since_push.cast("string"), F.lit("d ago"))
    )


def percent(score: Column) -> Column:
    return F.floor(score * 100).cast("int")
