"""Filters (C1-C9)."""

from catalog.base import query
from catalog.matching import BLOCKLIST_SQL, MATCHED_SQL
from riskframe.operators import filters
from riskframe.operators.matching import match_blocklist
from riskframe.sources.files import bundled_blocklist

NAMED = "SELECT * FROM {project_packages} JOIN {packages} USING (package_id)"


@query("SELECT project_id, package_id, depth FROM {project_packages} WHERE depth <= 2")
def depth_limit(d):
    return filters.limit_depth(d.adapter("project_packages"), 2).select("project_id", "package_id", "depth")


@query("SELECT project_id, package_id FROM {project_packages} WHERE NOT is_dev")
def without_dev(d):
    return filters.exclude_dev(d.adapter("project_packages")).select("project_id", "package_id")


@query("SELECT project_id, package_id FROM {project_packages} WHERE is_direct")
def direct_only(d):
    return filters.direct_packages(d.adapter("project_packages")).select("project_id", "package_id")


@query("SELECT package_id, external_id, severity FROM {advisories} WHERE severity IN ('critical', 'high')")
def severity_filter(d):
    kept = filters.filter_severity(d.adapter("advisories"), ["High", "CRITICAL"], ["low"])
    return kept.select("package_id", "external_id", "severity")


@query(f"SELECT project_id, package_id, name FROM ({NAMED}) AS x WHERE is_direct AND contains(lower(name), 'not')")
def package_search(d):
    return filters.search(d.sql(NAMED), "NoT", direct_only=True).select("project_id", "package_id", "name")


IGNORED = "SELECT DISTINCT l_orderkey AS project_id, concat('pkg-', CAST(l_partkey AS STRING)) AS name FROM {lineitem} WHERE l_tax = 0"


@query(f"""
    WITH ig AS ({IGNORED})
    SELECT n.project_id, n.package_id, ig.name IS NOT NULL AS is_ignored
    FROM ({NAMED}) AS n LEFT JOIN ig ON n.project_id = ig.project_id AND n.name = ig.name""")
def ignored_split(d):
    return filters.split_ignored(d.sql(NAMED), d.sql(IGNORED), ["project_id", "name"]).select(
        "project_id", "package_id", "is_ignored"
    )


@query(f"WITH {BLOCKLIST_SQL}, hits AS ({MATCHED_SQL}) SELECT package_id, listed_name FROM hits WHERE severity = 'high'")
def blocklist_filter(d):
    entries = filters.filter_blocklist(bundled_blocklist(d.spark), "NPM", "High")
    return match_blocklist(d.adapter("packages"), entries).select("package_id", "listed_name")


SUPPRESSED = """
    SELECT o_orderkey AS project_id, concat('ADV-', CAST(o_orderkey AS STRING), '-1') AS external_id
    FROM {orders} WHERE o_orderstatus = 'F'"""
PROJECT_ADVISORIES = """
    SELECT project_id, package_id, external_id FROM {project_packages} JOIN {advisories} USING (package_id)"""


@query(f"""
    WITH s AS ({SUPPRESSED})
    SELECT a.project_id, a.package_id, a.external_id FROM ({PROJECT_ADVISORIES}) AS a
    WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.project_id = a.project_id AND s.external_id = a.external_id)""")
def suppressed_advisories(d):
    return filters.advisories_of_projects(d.adapter("project_packages"), d.adapter("advisories"), d.sql(SUPPRESSED))


ARRIVALS = """
    SELECT event_id, CASE event_id % 12 WHEN 0 THEN 'Cargo.lock' WHEN 1 THEN 'package-lock.json' WHEN 2 THEN 'yarn.lock'
           WHEN 3 THEN 'pnpm-lock.yaml' WHEN 4 THEN 'bun.lockb' WHEN 5 THEN 'go.sum' WHEN 6 THEN 'poetry.lock'
           WHEN 7 THEN 'Pipfile.lock' WHEN 8 THEN 'bun.lock' WHEN 9 THEN 'package.json' WHEN 10 THEN 'go.mod'
           ELSE event_type END AS file_name
    FROM {events}"""


@query(f"SELECT event_id, file_name FROM ({ARRIVALS}) AS x WHERE event_id % 12 < 8")
def lock_arrivals(d):
    return filters.lock_events(d.sql(ARRIVALS)).select("event_id", "file_name")
