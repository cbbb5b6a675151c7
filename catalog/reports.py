"""Reports and views."""

from pyspark.sql import functions as F

from catalog.base import query
from catalog.detection import DETECTED_SQL
from catalog.evidence import CHANGES, SCORED, evidence_once, evidence_stored, reports, scored, version_changes
from catalog.functions import RANK
from catalog.matching import BLOCKLIST_SQL, MATCHED_SQL, TECHNIQUE_SQL
from riskframe.plans import reports as views
from riskframe.plans import risk
from riskframe.session import scratch_path
from riskframe.sources.files import bundled_blocklist

ADVICE_SQL = f"""
    {SCORED}, hits AS ({MATCHED_SQL}), advice AS (
        SELECT package_id, 1 AS section, reason AS sort_key, 0 AS step, concat('KNOWN MALICIOUS [', upper(severity), ']: ', reason) AS text FROM hits
        UNION ALL SELECT package_id, 1, reason, 1, concat('Reference: ', refs[1]) FROM hits WHERE len(refs) > 0
        UNION ALL SELECT package_id, 2, external_id, 0, concat('Upgrade to ', patched_versions, ' to patch ', external_id)
                  FROM {{advisories}} WHERE patched_versions IS NOT NULL
        UNION ALL SELECT package_id, 3, description, 0, concat('Review code: ', description) FROM ({DETECTED_SQL}) AS dd
        UNION ALL SELECT package_id, 4, description, 0, concat('Inspect version change (', CAST(from_version AS STRING), ' → ',
                         CAST(to_version AS STRING), '): ', description) FROM ({CHANGES}) AS cc
        UNION ALL SELECT package_id, 5, '', 0, concat('Maintainer inactive for ', CAST(days_since_push AS STRING),
                         ' days — consider a fork or alternative') FROM risks WHERE days_since_push > 730
        UNION ALL SELECT package_id, 5, '', 1, 'No releases in the past year — package may be abandoned' FROM risks WHERE releases_last_year = 0
        UNION ALL SELECT package_id, 6, '', 0, 'Consider replacing this dependency with a safer alternative' FROM risks WHERE severity IN ('critical', 'high')
        UNION ALL SELECT package_id, 6, '', 1, 'Isolate in a sandboxed environment if removal is not possible' FROM risks WHERE severity IN ('critical', 'high')
        UNION ALL SELECT package_id, 6, '', 2, 'Monitor for updates and plan upgrade within next sprint' FROM risks WHERE severity = 'medium')"""


def _advice(d, found=None):
    e = found or evidence_stored(d)
    return risk.recommendations(scored(d, e), *e)


@query(f"WITH {ADVICE_SQL} SELECT package_id, section, step, text FROM advice")
def advice_texts(d):
    return _advice(d).select("package_id", "section", "step", "text")


TOP_ADVICE = """
    top AS (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY section, sort_key, step, text) AS place FROM advice),
    best AS (SELECT package_id, string_agg(text, ' | ' ORDER BY place) AS recommendations FROM top WHERE place <= 3 GROUP BY package_id)"""


@query(f"WITH {ADVICE_SQL}, {TOP_ADVICE} SELECT package_id, recommendations FROM best")
def top_advice(d):
    return risk.top_recommendations(_advice(d)).select(
        "package_id", F.array_join("recommendations", " | ").alias("recommendations")
    )


ISSUE_SQL = f"""
    adv AS (SELECT package_id, external_id, row_number() OVER (PARTITION BY package_id ORDER BY {RANK} DESC,
                   coalesce(cvss_score, -1) DESC, external_id) AS rn FROM {{advisories}}),
    fnd AS (SELECT package_id, min(description) AS description FROM ({DETECTED_SQL}) AS dd GROUP BY package_id),
    iss AS (SELECT p.package_id, coalesce(adv.external_id, fnd.description, 'none') AS issue FROM {{packages}} AS p
            LEFT JOIN adv ON adv.package_id = p.package_id AND rn = 1 LEFT JOIN fnd ON fnd.package_id = p.package_id)"""


@query(f"""
    WITH {SCORED}, {ISSUE_SQL}
    SELECT package_id, upper(severity) AS severity, left(name, 20) AS package, left(version, 10) AS version, left(issue, 32) AS issue,
           name AS full_package, version AS full_version, issue AS full_issue
    FROM risks JOIN iss USING (package_id)""")
def summary_rows(d):
    e = evidence_stored(d)
    risks = scored(d, e)
    return views.summary_table(risks, risk.primary_issue(risks, e.advisories, e.detections))


@query(f"""
    WITH {ADVICE_SQL}, {TOP_ADVICE}, {TECHNIQUE_SQL},
    ids AS (SELECT package_id, technique_id, count(*) AS n FROM ({DETECTED_SQL}) AS dd JOIN technique USING (pattern_type) GROUP BY 1, 2),
    lists AS (SELECT package_id, string_agg(concat(technique_id, ' ×', CAST(n AS STRING)), ', ' ORDER BY technique_id) AS technique_ids
              FROM ids GROUP BY package_id)
    SELECT r.package_id, upper(severity) AS severity, report_count > 0 AS is_malicious, name, advisory_count, detection_count,
           coalesce(technique_ids, '') AS technique_ids, coalesce(recommendations, '') AS recommendations,
           CASE WHEN days_since_push IS NULL THEN '—' ELSE concat('stars ', CAST(stars AS STRING), ', ', CAST(days_since_push AS STRING), 'd ago') END AS maintainer
    FROM risks AS r LEFT JOIN lists USING (package_id) LEFT JOIN best USING (package_id)""")
def report_table(d):
    e = evidence_stored(d)
    rows = views.report_rows(scored(d, e), e.detections, risk.top_recommendations(_advice(d, e)))
    # The risk percentage is cut, not rounded, so it is left to the tests.
    return rows.select(
        "package_id", "severity", "is_malicious", "name", "advisory_count", "detection_count", "technique_ids",
        F.array_join("recommendations", " | ").alias("recommendations"),
        F.regexp_replace("maintainer", ", risk .*$", "").alias("maintainer"),
    )


@query(f"""
    WITH {SCORED},
    counts AS (
        SELECT package_id, count(DISTINCT ROW(source, external_id, cvss_score, severity, patched_versions, title, reference, published_at, fetched_at)) AS advisories
        FROM {{advisories}} GROUP BY package_id),
    finds AS (SELECT package_id, count(*) AS detections, count(DISTINCT rule_id) AS rules FROM ({DETECTED_SQL}) AS dd GROUP BY package_id),
    hits AS (SELECT package_id, count(*) AS reports FROM ({MATCHED_SQL}) AS mm GROUP BY package_id),
    changed AS (SELECT package_id, count(*) AS version_changes FROM ({CHANGES}) AS cc GROUP BY package_id)
    SELECT r.package_id, r.severity, round(r.final_score, 6) AS final_score, coalesce(advisories, 0) AS advisories,
           coalesce(detections, 0) AS detections, coalesce(rules, 0) AS rules, coalesce(version_changes, 0) AS version_changes,
           coalesce(reports, 0) AS reports
    FROM risks AS r LEFT JOIN counts USING (package_id) LEFT JOIN finds USING (package_id) LEFT JOIN hits USING (package_id)
    LEFT JOIN changed USING (package_id)""")
def explained_risk(d):
    e = evidence_stored(d)
    records = risk.assemble_risk(scored(d, e), *e)
    # A rule may stand in several parts of a package's record, so rules are counted before.
    rules = e.detections.groupBy("package_id").agg(F.countDistinct("rule_id").alias("rules"))
    sizes = records.select(
        "package_id", "severity", F.round("final_score", 6).alias("final_score"),
        *(F.coalesce(F.size(c), F.lit(0)).alias(name) for c, name in (
            ("advisories", "advisories"), ("version_changes", "version_changes"), ("community_reports", "reports"))),
        F.coalesce(F.aggregate("detections", F.lit(0).cast("bigint"), lambda a, x: a + x["copies"]), F.lit(0)).alias("detections"),
    )
    return sizes.groupBy("package_id", "severity", "final_score").agg(
        *(F.sum(c).alias(c) for c in ("advisories", "detections", "version_changes", "reports"))
    ).join(rules, "package_id", "left").withColumn("rules", F.coalesce("rules", F.lit(0).cast("bigint")))


@query(f"""
    WITH {SCORED}
    SELECT package_id, name, severity, round(final_score, 6) AS final_score, package_id % 5 = 0 AS is_ignored FROM risks""")
def ordered_results(d):
    # Ignored packages are listed by id here, so that a third of the rows share no name.
    risks = scored(d).select("package_id", F.col("package_id").alias("project_id"), "name", "severity", "final_score")
    ignored = d.adapter("packages").filter("package_id % 5 = 0").select(F.col("package_id").alias("project_id"), "name")
    return views.results_view(risks, ignored).select(
        "package_id", "name", "severity", F.round("final_score", 6).alias("final_score"), "is_ignored"
    )


ISSUES_SQL = f"""
    {BLOCKLIST_SQL}, det AS ({DETECTED_SQL}), every AS (
        SELECT package_id, 0 AS kind_order, CASE source WHEN 'osv' THEN 'OSV' WHEN 'github' THEN 'GitHub' ELSE 'NVD' END AS kind,
               upper(severity) AS severity, external_id AS text,
               CASE WHEN title = external_id THEN 'Advisory' ELSE title END AS detail,
               -coalesce(cvss_score, -1) AS rank FROM {{advisories}}
        UNION ALL
        SELECT package_id, 1, 'CODE', CASE WHEN confidence >= 8e-1 THEN 'HIGH' WHEN confidence >= 5e-1 THEN 'MEDIUM' ELSE 'LOW' END,
               description, concat(file_path, ':', CAST(line_number AS STRING)), -confidence FROM det
        UNION ALL
        SELECT package_id, 2, 'VERSION', upper(severity),
               description,
               concat(CAST(from_version AS STRING), ' → ', CAST(to_version AS STRING)), 0 FROM ({CHANGES}) AS cc
        UNION ALL
        SELECT package_id, 3, 'COMMUNITY', upper(severity), reason,
               coalesce('v' || matched_version || ' affected', 'all versions'), 0 FROM ({MATCHED_SQL}) AS mm),
    grouped AS (SELECT package_id, kind_order, rank, text, detail, kind, severity, count(*) AS copies FROM every GROUP BY ALL)"""


@query(f"""
    WITH {ISSUES_SQL}
    SELECT package_id, row_number() OVER (PARTITION BY package_id ORDER BY kind_order, rank, text, detail, kind, severity) AS position,
           kind, severity, copies, text AS full_text, detail AS full_detail,
           CASE WHEN kind_order > 0 AND length(text) > 45 THEN concat(left(text, 45), '…') ELSE text END AS text,
           CASE WHEN kind_order = 1 THEN split_part(detail, '/', -1) WHEN length(detail) > 55 THEN concat(left(detail, 55), '…') ELSE detail END AS detail
    FROM grouped""")
def issue_list(d):
    return views.issues_long(*evidence_stored(d))


@query(f"""
    WITH {SCORED}, f AS (
        SELECT project_id, r.severity, r.report_count FROM {{project_packages}} AS pp JOIN risks AS r ON r.package_id = pp.package_id),
    k AS (SELECT project_id, max({RANK}) AS worst, count(*) AS total_packages, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
                 count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count,
                 count(*) FILTER (WHERE severity = 'low') AS low_count, count(*) FILTER (WHERE severity = 'safe') AS safe_count,
                 CAST(sum(report_count) AS BIGINT) AS report_total FROM f GROUP BY project_id)
    SELECT project_id, total_packages, critical_count, high_count, medium_count, low_count, safe_count, report_total,
           ['safe', 'low', 'medium', 'high', 'critical'][worst + 1] AS worst_severity,
           ['passing', 'low', 'medium', 'high', 'critical'][worst + 1] AS status, CAST(greatest(worst - 1, 0) AS INTEGER) AS exit_code,
           worst >= 3 AS gate_failed FROM k""")
def fleet_status(d):
    return views.fleet_summary(fleet_risks(d))


def fleet_risks(d):
    """Every project's packages with their severity; the scored side has one row per package."""
    risks = scored(d).select("package_id", "name", "version", "ecosystem", "severity", "final_score", "report_count")
    return d.adapter("project_packages").join(risks, "package_id")


@query(f"""
    WITH {SCORED}, f AS (
        SELECT project_id, r.severity, r.report_count FROM {{project_packages}} AS pp JOIN risks AS r ON r.package_id = pp.package_id),
    k AS (SELECT project_id, coalesce(max({RANK}) FILTER (WHERE severity IN ('critical', 'medium')), 0) AS worst,
                 count(*) FILTER (WHERE severity IN ('critical', 'medium')) AS total_packages FROM f GROUP BY project_id)
    SELECT project_id, total_packages, CAST(greatest(worst - 1, 0) AS INTEGER) AS exit_code, worst >= 2 AS gate_failed FROM k""")
def filtered_gate(d):
    summary = views.fleet_summary(fleet_risks(d), ["Critical", "medium"], threshold="medium")
    return summary.select("project_id", "total_packages", "exit_code", "gate_failed")


SCAN_ID = "md5(concat(CAST(project_id AS STRING), '/', CAST(CAST(scanned_at AS DATE) AS STRING)))"
SCANS = f"""
    scans AS (
        SELECT {SCAN_ID} AS scan_id, concat('/p/', CAST(project_id AS STRING)) AS project_path, max(CAST(scanned_at AS DATE)) AS scan_date,
               count(*) AS total_packages, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
               count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count,
               count(*) FILTER (WHERE severity = 'low') AS low_count, count(*) FILTER (WHERE severity = 'safe') AS safe_count,
               string_agg(DISTINCT concat('eco', CAST(event_id % 3 AS STRING)), ',' ORDER BY concat('eco', CAST(event_id % 3 AS STRING))) AS ecosystem
        FROM {{risk_events}} GROUP BY 1, 2)"""


def saved_scans(d):
    rows = d.adapter("risk_events").selectExpr(
        f"{SCAN_ID} AS scan_id", "concat('/p/', project_id) AS project_path",
        "CAST(CAST(scanned_at AS DATE) AS TIMESTAMP) AS scanned_at", "concat('eco', event_id % 3) AS ecosystem", "severity",
    )
    return views.save_scan(rows)


@query(f"""
    WITH {SCANS} SELECT scan_id, project_path, CAST(scan_date AS STRING) AS scan_date, ecosystem, total_packages, critical_count, high_count,
    medium_count, low_count, safe_count FROM scans""")
def stored_scans(d):
    return saved_scans(d).select(
        "scan_id", "project_path", F.date_format("scanned_at", "yyyy-MM-dd").alias("scan_date"), "ecosystem", "total_packages",
        "critical_count", "high_count", "medium_count", "low_count", "safe_count",
    )


@query(f"""
    WITH {SCANS} SELECT left(scan_id, 8) AS id, concat(CAST(scan_date AS STRING), ' 00:00') AS date, total_packages, critical_count,
    high_count, medium_count, low_count, project_path FROM scans ORDER BY scan_date DESC, scan_id LIMIT 20""")
def scan_history(d):
    return views.history_view(saved_scans(d))


@query(f"""
    WITH {SCANS}
    SELECT scan_id FROM scans WHERE starts_with(scan_id, 'a') ORDER BY scan_date DESC, scan_id LIMIT 1""")
def scan_by_prefix(d):
    return views.resolve_scan_id(saved_scans(d), "A")


@query(f"""
    WITH {BLOCKLIST_SQL}, hits AS ({MATCHED_SQL})
    SELECT h.package_id, concat(h.listed_name, ' (', coalesce(array_to_string(b.versions, ', '), 'all versions'), ')') AS package,
           b.eco AS ecosystem, upper(b.severity) AS severity,
           CASE WHEN length(b.reason) > 55 THEN concat(left(b.reason, 55), '…') ELSE b.reason END AS reason, b.reason AS full_reason
    FROM hits AS h JOIN blocklist AS b ON h.listed_name = b.listed_name""")
def blocklist_rows(d):
    entries = bundled_blocklist(d.spark)
    listed = views.blocklist_view(entries, "package_name").withColumnRenamed("package_name", "listed_name")
    return reports(d).select("package_id", "listed_name").join(listed, "listed_name").drop("listed_name")


# Every field of an item in one text; a whole number of 60 bits is taken from its hash, and a project adds its items' numbers up.
_ITEM_TEXT = "concat_ws('|', section, ref, {fields}, CAST(coalesce(score, -1.0) AS STRING))".format(
    fields=", ".join(f"coalesce({c}, '-')" for c in ("name", "version", "source", "url", "severity", "method", "description")))
BILLS_SQL = f"""
    fleet AS (SELECT {{key}} AS project_id, p.package_id, p.name, p.version FROM {{{{project_packages}}}} AS pp
              JOIN {{{{packages}}}} AS p ON p.package_id = pp.package_id {{join}}),
    items AS (
        SELECT DISTINCT project_id, 'components' AS section, concat(name, '-', version) AS ref, name, version, NULL AS source, NULL AS url,
               CAST(NULL AS DOUBLE) AS score, NULL AS severity, NULL AS method, NULL AS description FROM fleet
        UNION ALL SELECT DISTINCT project_id, 'vulnerabilities', external_id, NULL, NULL, CASE source WHEN 'osv' THEN 'OSV' WHEN 'github' THEN 'GitHub' ELSE 'NVD' END,
               reference, CAST(cvss_score AS DOUBLE), severity, 'CVSSv3', description FROM fleet JOIN {{{{advisories}}}} AS a ON a.package_id = fleet.package_id
        UNION ALL SELECT DISTINCT project_id, 'vulnerabilities', concat('RISKFRAME-VER-', name, '-', CAST(from_version AS STRING), '-', CAST(to_version AS STRING)),
               NULL, NULL, 'riskframe-version-analysis', NULL, NULL, severity, 'other', description
        FROM fleet JOIN ({CHANGES.replace('{', '{{').replace('}', '}}')}) AS c ON c.package_id = fleet.package_id)
    SELECT project_id, '1.4' AS spec_version, CAST(count(*) FILTER (WHERE section = 'components') AS INTEGER) AS components,
           CAST(count(*) FILTER (WHERE section <> 'components') AS INTEGER) AS vulnerabilities,
           CAST(sum(CAST(concat('0x', left(md5({_ITEM_TEXT}), 10)) AS BIGINT)) AS BIGINT) AS fields
    FROM items GROUP BY project_id"""


def _bom_items(d, fleet, bundled=False):
    advisories = d.adapter("advisories").withColumn("references", F.array("reference"))
    changes = version_changes(d).select(
        "package_id", F.col("from_version").cast("string"), F.col("to_version").cast("string"), "severity", "description"
    )
    return views.sbom(fleet, advisories, changes, bundled)


def _bom_sizes(items):
    components = F.col("section") == "components"
    number = F.conv(F.left(F.md5(F.expr(_ITEM_TEXT)), F.lit(10)), 16, 10).cast("bigint")
    return items.groupBy("project_id").agg(
        F.count_if(components).cast("int").alias("components"), F.count_if(~components).cast("int").alias("vulnerabilities"),
        F.sum(number).alias("fields")).withColumn("spec_version", F.lit("1.4"))


@query("WITH " + BILLS_SQL.format(key="pp.project_id", join=""))
def bills_of_materials(d):
    """Items of every project with all their fields, as counts and a sum over the fields."""
    return _bom_sizes(_bom_items(d, d.adapter("project_packages").select("project_id", "package_id").join(d.adapter("packages"), "package_id")))


@query("WITH " + BILLS_SQL.format(key="o_custkey", join="JOIN {orders} ON o_orderkey = pp.project_id"))
def written_bills(d):
    """One document per customer is written and read again; its fields are taken from the parsed documents."""
    fleet = d.adapter("project_packages").join(d.table("orders"), F.col("o_orderkey") == F.col("project_id")).select(
        F.col("o_custkey").alias("project_id"), "package_id").join(d.adapter("packages"), "package_id")
    path = scratch_path(d.spark, "bills")
    views.write_sbom(_bom_items(d, fleet, bundled=True), path, compression="gzip")
    docs = views.read_sbom(d.spark, path).filter("bom.specVersion = '1.4'").select(F.col("project").cast("bigint").alias("project_id"), "bom.*")
    none = F.lit(None).cast("string")
    part = lambda c: F.struct(
        F.lit("components").alias("section"), c["bom-ref"].alias("ref"), c["name"].alias("name"), c["version"].alias("version"), none.alias("source"),
        none.alias("url"), F.lit(None).cast("double").alias("score"), none.alias("severity"), none.alias("method"), none.alias("description"))
    found = lambda v: F.struct(
        F.lit("vulnerabilities").alias("section"), v["id"].alias("ref"), none.alias("name"), none.alias("version"), v["source"]["name"].alias("source"),
        v["source"]["url"].alias("url"), v["ratings"][0]["score"].alias("score"), v["ratings"][0]["severity"].alias("severity"),
        v["ratings"][0]["method"].alias("method"), v["description"].alias("description"))
    rows = docs.select("project_id", F.inline(F.concat(F.transform("components", part), F.transform("vulnerabilities", found))))
    return _bom_sizes(rows)


@query(f"""
    WITH {SCORED} SELECT package_id, name, severity, round(final_score, 6) AS final_score FROM risks""")
def saved_report(d):
    """Write the scored packages as JSON lines to the shared folder and read them back."""
    path = scratch_path(d.spark, "report")
    rows = scored(d).select("package_id", "name", "severity", F.round("final_score", 6).alias("final_score"))
    views.write_risk_json(rows, path)
    return d.spark.read.schema(rows.schema).json(path)
