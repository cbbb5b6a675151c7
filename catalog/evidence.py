"""Evidence aggregates and the risk score."""

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import query
from catalog.detection import DETECTED_SQL, detections
from catalog.functions import RANK, SCORE
from catalog.health import BANDS, HEALTH
from catalog.matching import BLOCKLIST_SQL, MATCHED_SQL
from riskframe.functions.severity import score_to_severity
from riskframe.operators import evidence
from riskframe.operators.groups import carry_previous
from riskframe.operators.matching import match_blocklist
from riskframe.plans.risk import score_packages
from riskframe.session import durable
from riskframe.sources.files import bundled_blocklist

ADVISORY_SCORE = f"""
    SELECT package_id, CASE WHEN max(cvss_score) > 0 THEN max(cvss_score) / 10 ELSE max({SCORE}) END AS advisory_score,
           count(*) AS advisory_count FROM {{advisories}} GROUP BY package_id"""


@query(f"SELECT package_id, round(advisory_score, 6) AS advisory_score FROM ({ADVISORY_SCORE}) AS x")
def advisory_scores(d):
    return evidence.advisory_score(d.adapter("advisories")).withColumn("advisory_score", F.round("advisory_score", 6))


@query(f"SELECT package_id, max(confidence) AS pattern_score FROM ({DETECTED_SQL}) AS x GROUP BY package_id")
def pattern_scores(d):
    return evidence.pattern_score(detections(d))


# License changes between a customer's consecutive orders stand in for version changes.
CHANGES = """
    SELECT package AS package_id, from_version, to_version, 'license_changed' AS change_type,
           concat('License changed from ', old_license, ' to ', license) AS description,
           CASE WHEN to_version % 3 = 0 THEN 'medium' WHEN to_version % 3 = 1 THEN 'low' ELSE 'high' END AS severity
    FROM (SELECT o_custkey AS package, o_orderkey AS to_version, o_orderpriority AS license,
                 lag(o_orderkey) OVER w AS from_version, lag(o_orderpriority) OVER w AS old_license
          FROM {orders} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) AS s
    WHERE old_license <> license"""


def version_changes(d):
    orders = d.table("orders").selectExpr(
        "o_custkey AS package_id", "o_orderkey AS to_version", "o_orderdate AS released_at", "o_orderpriority AS license",
        "struct(o_orderkey AS version, o_orderpriority AS license) AS entry",
    )
    # The earlier version travels with its license, so no join has to look it up.
    placed = carry_previous(orders, ["package_id"], ["released_at", "to_version"], "entry", "old")
    return placed.filter("old.license <> license").selectExpr(
        "package_id", "old.version AS from_version", "to_version", "'license_changed' AS change_type",
        "concat('License changed from ', old.license, ' to ', license) AS description",
        "CASE WHEN to_version % 3 = 0 THEN 'medium' WHEN to_version % 3 = 1 THEN 'low' ELSE 'high' END AS severity",
    )


@query(f"SELECT package_id, round(least(avg({SCORE}), 1), 6) AS version_change_score FROM ({CHANGES}) AS c GROUP BY package_id")
def version_change_scores(d):
    return evidence.version_change_score(version_changes(d)).withColumn(
        "version_change_score", F.round("version_change_score", 6)
    )


def reports(d):
    return match_blocklist(d.adapter("packages"), bundled_blocklist(d.spark))


@query(f"WITH {BLOCKLIST_SQL} SELECT package_id, max({SCORE}) AS community_score FROM ({MATCHED_SQL}) AS m GROUP BY package_id")
def community_scores(d):
    return evidence.community_score(reports(d))


SCORED = f"""
    {BLOCKLIST_SQL}, a AS ({ADVISORY_SCORE}),
    det AS (SELECT package_id, max(confidence) AS pattern_score, count(*) AS detection_count FROM ({DETECTED_SQL}) AS x GROUP BY package_id),
    chg AS (SELECT package_id, least(avg({SCORE}), 1) AS version_change_score, count(*) AS change_count FROM ({CHANGES}) AS c GROUP BY package_id),
    com AS (SELECT package_id, max({SCORE}) AS community_score, count(*) AS report_count FROM ({MATCHED_SQL}) AS m GROUP BY package_id),
    rep AS (SELECT *, 1 - {HEALTH} AS reputation_score FROM (SELECT *, {BANDS} FROM {{maintainer_metrics}}) AS b),
    joined AS (
        SELECT p.*, coalesce(advisory_score, 0) AS adv, coalesce(pattern_score, 0) AS pat, coalesce(version_change_score, 0) AS ver,
               coalesce(reputation_score, 0) AS rep, coalesce(community_score, 0) AS com,
               coalesce(advisory_count, 0) AS advisory_count, coalesce(detection_count, 0) AS detection_count,
               coalesce(change_count, 0) AS change_count, coalesce(report_count, 0) AS report_count,
               days_since_push, releases_last_year, stars
        FROM {{packages}} AS p LEFT JOIN a USING (package_id) LEFT JOIN det USING (package_id) LEFT JOIN chg USING (package_id)
        LEFT JOIN rep USING (package_id) LEFT JOIN com USING (package_id)),
    final AS (
        SELECT *, CASE WHEN com >= 8e-1 THEN least(com, 1) WHEN pat = 0 AND ver = 0 AND rep = 0 AND com = 0 THEN adv
                  ELSE least(adv * 4e-1 + pat * 2e-1 + ver * 15e-2 + rep * 15e-2 + com * 1e-1, 1) END AS final_score FROM joined),
    risks AS (
        SELECT *, CASE WHEN round(final_score, 9) >= 9e-1 THEN 'critical' WHEN round(final_score, 9) >= 7e-1 THEN 'high'
                  WHEN round(final_score, 9) >= 4e-1 THEN 'medium' WHEN round(final_score, 9) > 0 THEN 'low' ELSE 'safe' END AS severity
        FROM final)"""


class Evidence(NamedTuple):
    """The four kinds of evidence, in the order the scoring functions take them."""

    advisories: DataFrame
    detections: DataFrame
    changes: DataFrame
    reports: DataFrame


def evidence_once(d):
    """Evidence for a single use: everything stays one lazy plan."""
    return Evidence(d.adapter("advisories"), detections(d), version_changes(d), reports(d))


def evidence_stored(d):
    """Evidence for several uses: what is costly to find is written once and read back."""
    once = evidence_once(d)
    return once._replace(detections=durable(once.detections), changes=durable(once.changes))


def scored(d, found=None):
    """Every package scored from all five kinds of evidence."""
    e = found or evidence_once(d)
    return score_packages(
        d.adapter("packages"), e.advisories, e.detections, e.changes, d.adapter("maintainer_metrics"), e.reports
    )


@query(f"""
    WITH {SCORED}
    SELECT package_id, name, version, ecosystem, severity, round(adv, 6) AS advisory_score, round(pat, 6) AS pattern_score,
           round(ver, 6) AS version_change_score, round(rep, 6) AS reputation_score, round(com, 6) AS community_score,
           round(final_score, 6) AS final_score, advisory_count, detection_count, change_count, report_count
    FROM risks""")
def package_risk(d):
    scores = ("advisory_score", "pattern_score", "version_change_score", "reputation_score", "community_score", "final_score")
    return scored(d).select(
        "package_id", "name", "version", "ecosystem", "severity", *(F.round(s, 6).alias(s) for s in scores),
        "advisory_count", "detection_count", "change_count", "report_count",
    )


@query(f"""
    WITH s AS ({ADVISORY_SCORE}), r AS (
        SELECT project_id, CASE WHEN advisory_score >= 9e-1 THEN 'critical' WHEN advisory_score >= 7e-1 THEN 'high'
               WHEN advisory_score >= 4e-1 THEN 'medium' WHEN advisory_score > 0 THEN 'low' ELSE 'safe' END AS severity
        FROM {{project_packages}} LEFT JOIN s USING (package_id))
    SELECT project_id, count(*) AS total_packages, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
           count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count,
           count(*) FILTER (WHERE severity = 'low') AS low_count, count(*) FILTER (WHERE severity = 'safe') AS safe_count
    FROM r GROUP BY project_id""")
def project_severity_counts(d):
    return evidence.severity_counts(advisory_risks(d))


def advisory_risks(d):
    """Fleet rows with a severity from advisories alone."""
    scores = evidence.advisory_score(d.adapter("advisories"))
    fleet = d.adapter("project_packages").join(scores, "package_id", "left")
    return fleet.withColumn("severity", score_to_severity(F.coalesce("advisory_score", F.lit(0.0))))


IGNORED_IDS = "SELECT DISTINCT l_orderkey AS project_id, l_partkey AS name FROM {lineitem} WHERE l_tax = 0"


@query(f"""
    WITH s AS ({ADVISORY_SCORE}), ig AS ({IGNORED_IDS}), r AS (
        SELECT project_id, package_id, CASE WHEN advisory_score >= 9e-1 THEN 'critical' WHEN advisory_score >= 7e-1 THEN 'high'
               WHEN advisory_score >= 4e-1 THEN 'medium' WHEN advisory_score > 0 THEN 'low' ELSE 'safe' END AS severity
        FROM {{project_packages}} LEFT JOIN s USING (package_id)),
    m AS (SELECT r.*, ig.name IS NOT NULL AS ignored FROM r LEFT JOIN ig ON ig.project_id = r.project_id AND ig.name = r.package_id)
    SELECT project_id, count(*) FILTER (WHERE NOT ignored) AS total_packages,
           count(*) FILTER (WHERE NOT ignored AND severity = 'critical') AS critical_count,
           count(*) FILTER (WHERE NOT ignored AND severity = 'safe') AS safe_count,
           (SELECT count(*) FROM ig WHERE ig.project_id = m.project_id) AS ignored_count
    FROM m GROUP BY project_id""")
def active_severity_counts(d):
    risks = advisory_risks(d).withColumnRenamed("package_id", "name")
    return evidence.active_counts(risks, d.sql(IGNORED_IDS)).select(
        "project_id", "total_packages", "critical_count", "safe_count", "ignored_count"
    )


@query("""
    SELECT project_id, string_agg(DISTINCT ecosystem, ',' ORDER BY ecosystem) AS ecosystems
    FROM {project_packages} JOIN {packages} USING (package_id) GROUP BY project_id""")
def ecosystems_per_scan(d):
    return evidence.scan_ecosystems(d.adapter("project_packages").join(d.adapter("packages"), "package_id"))


@query(f"""
    WITH r AS (SELECT project_id, max({RANK}) AS worst FROM {{risk_events}} GROUP BY project_id)
    SELECT project_id, ['safe', 'low', 'medium', 'high', 'critical'][worst + 1] AS worst_severity FROM r""")
def worst_severities(d):
    return evidence.worst_severity(d.adapter("risk_events"))


@query(f"""
    WITH {SCORED} SELECT package_id, advisory_count, detection_count, change_count, report_count FROM risks
    WHERE advisory_count + detection_count + change_count + report_count > 0""")
def counted_evidence(d):
    scores = evidence.evidence_scores(
        d.adapter("advisories"), detections(d), version_changes(d), reports(d)
    )
    known = d.adapter("packages").select("package_id")
    return evidence.evidence_counts(scores).join(known, "package_id", "left_semi")


@query("""
    SELECT project_id, count(*) AS package_count, count(*) FILTER (WHERE is_direct) AS direct_count
    FROM {project_packages} GROUP BY project_id""")
def package_tree_counts(d):
    return evidence.tree_counts(d.adapter("project_packages"))


@query(f"WITH {BLOCKLIST_SQL} SELECT '2024.1' AS list_version, count(*) AS entry_count FROM ({MATCHED_SQL}) AS m")
def blocklist_information(d):
    return evidence.blocklist_info(reports_with_version(d))


def reports_with_version(d):
    """Matched entries with their list's version, so that the count grows with the packages."""
    entries = bundled_blocklist(d.spark)
    versions = entries.select(F.col("package_name").alias("listed_name"), "list_version")
    return reports(d).join(versions, "listed_name")
