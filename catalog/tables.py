"""Table upkeep."""

from pyspark.sql import functions as F

from catalog.base import query
from catalog.evidence import CHANGES, version_changes
from riskframe.operators import tables

_KEYED = """
    SELECT name, version, ecosystem, package_id, concat('https://{tag}/', CAST(package_id AS STRING)) AS registry_url,
           CASE WHEN p_size = 25 AND '{tag}' = 'new' THEN NULL ELSE concat('{tag}-', p_brand) END AS checksum, p_size AS depth
    FROM {{packages}} JOIN {{part}} ON p_partkey = package_id WHERE {where}"""
OLD = _KEYED.format(tag="old", where="p_size <= 30")
NEW = _KEYED.format(tag="new", where="p_size >= 20")
_LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name, version, ecosystem ORDER BY package_id DESC) AS rn FROM ({t}) AS x) AS y WHERE rn = 1"


@query(f"""
    WITH o AS ({_LAST.format(t=OLD)}), n AS ({_LAST.format(t=NEW)})
    SELECT coalesce(o.name, n.name) AS name, coalesce(o.version, n.version) AS version, coalesce(o.ecosystem, n.ecosystem) AS ecosystem,
           coalesce(o.package_id, n.package_id) AS package_id, CASE WHEN n.name IS NULL THEN o.registry_url ELSE n.registry_url END AS registry_url,
           CASE WHEN n.name IS NULL THEN o.checksum ELSE n.checksum END AS checksum, coalesce(o.depth, n.depth) AS depth
    FROM o FULL JOIN n ON o.name = n.name AND o.version = n.version AND o.ecosystem = n.ecosystem""")
def merged_packages(d):
    old, new = (tables.dedup_last(d.sql(t), tables.PACKAGE_KEY, ["package_id"]) for t in (OLD, NEW))
    return tables.upsert_packages(old, new)


@query(f"""
    SELECT name, version, ecosystem, package_id FROM (
        SELECT *, row_number() OVER (PARTITION BY name, version, ecosystem ORDER BY package_id) AS rn FROM {{packages}}) AS x WHERE rn = 1""")
def first_packages(d):
    return tables.dedup_first(d.adapter("packages"), tables.PACKAGE_KEY, ["package_id"])


ADVISORY_ORDER = ["published_at", "fetched_at", "cvss_score", "severity", "patched_versions", "title", "reference"]
_FIELDS = "package_id, source, external_id, title, description, severity, cvss_score, patched_versions, published_at, fetched_at"
STORED = f"""
    SELECT {_FIELDS} FROM (SELECT *, row_number() OVER (PARTITION BY package_id, source, external_id ORDER BY
        {', '.join(f'{c} DESC NULLS LAST' for c in ADVISORY_ORDER)}) AS rn FROM {{advisories}}) AS x WHERE rn = 1"""
FETCHED = f"""
    SELECT package_id, source, CASE WHEN source = 'nvd' THEN concat(external_id, '-N') ELSE external_id END AS external_id,
           concat('new ', title) AS title, 'again' AS description, 'high' AS severity, cvss_score + 1 AS cvss_score,
           CAST(NULL AS STRING) AS patched_versions, fetched_at AS published_at, published_at AS fetched_at FROM ({STORED}) AS s"""


@query(f"""
    WITH o AS ({STORED}), n AS ({FETCHED})
    SELECT coalesce(o.package_id, n.package_id) AS package_id, coalesce(o.source, n.source) AS source,
           coalesce(o.external_id, n.external_id) AS external_id, CASE WHEN n.source IS NULL THEN o.title ELSE n.title END AS title,
           CASE WHEN n.source IS NULL THEN o.severity ELSE n.severity END AS severity,
           CASE WHEN n.source IS NULL THEN o.cvss_score ELSE n.cvss_score END AS cvss_score,
           CASE WHEN n.source IS NULL THEN o.patched_versions ELSE n.patched_versions END AS patched_versions,
           CAST(CAST(coalesce(o.published_at, n.published_at) AS DATE) AS STRING) AS published,
           CAST(CAST(CASE WHEN n.source IS NULL THEN o.fetched_at ELSE n.fetched_at END AS DATE) AS STRING) AS fetched
    FROM o FULL JOIN n ON o.package_id = n.package_id AND o.source = n.source AND o.external_id = n.external_id""")
def merged_advisories(d):
    stored = tables.dedup_last(d.adapter("advisories"), tables.ADVISORY_KEY, ADVISORY_ORDER).selectExpr(*_FIELDS.split(", "))
    fetched = d.spark.sql(FETCHED.replace(STORED, "SELECT * FROM {stored}"), stored=stored)
    merged = tables.upsert_advisories(stored, fetched)
    return merged.select(
        "package_id", "source", "external_id", "title", "severity", "cvss_score", "patched_versions",
        F.date_format("published_at", "yyyy-MM-dd").alias("published"), F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched"),
    )


_METRICS = """
    SELECT concat('lib-', CAST(package_id {shift} AS STRING)) AS package_name, 'npm' AS ecosystem, package_id AS id,
           CAST(stars {shift} AS BIGINT) AS stars, CAST(days_since_push AS BIGINT) AS days_since_push FROM {{maintainer_metrics}}"""
OLD_METRICS, NEW_METRICS = _METRICS.format(shift="+ 0"), _METRICS.format(shift="+ 300")


@query(f"""
    WITH o AS ({OLD_METRICS}), n AS ({NEW_METRICS})
    SELECT coalesce(o.package_name, n.package_name) AS package_name, coalesce(o.ecosystem, n.ecosystem) AS ecosystem,
           coalesce(o.id, n.id) AS id, coalesce(n.stars, o.stars) AS stars, coalesce(n.days_since_push, o.days_since_push) AS days_since_push
    FROM o FULL JOIN n ON o.package_name = n.package_name AND o.ecosystem = n.ecosystem""")
def merged_metrics(d):
    return tables.upsert_maintainer(d.sql(OLD_METRICS), d.sql(NEW_METRICS))


@query(f"""
    WITH c AS ({CHANGES})
    SELECT package_id, from_version, to_version, change_type, description,
           CASE WHEN severity = 'low' THEN 'critical' ELSE severity END AS severity FROM c""")
def stored_changes(d):
    # Every change comes twice in the new batch, once with a later description.
    found = version_changes(d)
    again = found.withColumn("description", F.concat("description", F.lit(" (seen again)")))
    old = found.filter("severity = 'low'").withColumn("severity", F.lit("critical"))
    return tables.insert_version_diffs(old, found.unionByName(again))


EXPIRY, TTL = "1998-06-01 00:00:00", 604800 * 52


@query(f"""
    SELECT package_id, external_id FROM {{advisories}} WHERE NOT fetched_at < TIMESTAMP '{EXPIRY}' - INTERVAL {TTL} SECOND""")
def unexpired_advisories(d):
    as_of = F.lit(EXPIRY).cast("timestamp")
    return tables.expire(d.adapter("advisories"), as_of, TTL).select("package_id", "external_id")


@query(f"""
    SELECT 'all' AS scope, count(*) AS expired FROM {{advisories}} WHERE fetched_at < TIMESTAMP '{EXPIRY}' - INTERVAL {TTL} SECOND
    UNION ALL SELECT 'kept_one', count(*) FROM {{advisories}} WHERE package_id <> 11 OR NOT fetched_at < TIMESTAMP '{EXPIRY}' - INTERVAL {TTL} SECOND""")
def expired_advisories(d):
    as_of, rows = F.lit(EXPIRY).cast("timestamp"), d.adapter("advisories")
    one = tables.expire(rows, as_of, TTL, package_id=11).agg(F.count("*").alias("expired"))
    return tables.expired_count(rows, as_of, TTL).select(F.lit("all").alias("scope"), "expired").unionByName(
        one.select(F.lit("kept_one").alias("scope"), "expired")
    )


@query("""
    WITH gone AS (SELECT p_partkey AS k FROM {part} WHERE p_brand = 'Brand#2'),
    pattern AS (SELECT l_orderkey AS pattern_id, l_partkey AS package_id FROM {lineitem})
    SELECT 'packages' AS table_name, count(*) AS n FROM {packages} WHERE package_id NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'advisories', count(*) FROM {advisories} WHERE package_id NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'dependencies', count(*) FROM {lineitem} WHERE l_partkey NOT IN (SELECT k FROM gone) AND l_suppkey NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'detected_patterns', count(*) FROM pattern WHERE package_id NOT IN (SELECT k FROM gone)
    UNION ALL SELECT 'mitre_mappings', count(*) FROM {orders} WHERE o_orderkey NOT IN
        (SELECT pattern_id FROM pattern WHERE package_id IN (SELECT k FROM gone))""")
def cascaded_deletes(d):
    items = d.table("lineitem")
    left = tables.delete_cascade({
        "packages": d.adapter("packages"), "advisories": d.adapter("advisories"),
        "dependencies": items.selectExpr("l_partkey AS parent_id", "l_suppkey AS child_id"),
        "detected_patterns": items.selectExpr("l_orderkey AS pattern_id", "l_partkey AS package_id"),
        "mitre_mappings": d.table("orders").selectExpr("o_orderkey AS pattern_id"),
    }, d.table("part").filter("p_brand = 'Brand#2'").selectExpr("p_partkey AS package_id"))
    out = None
    for name, rows in left.items():
        n = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


LISTED = "SELECT l_orderkey AS project_id, l_partkey AS name FROM {lineitem} WHERE l_tax <= 3e-2"
TOGGLED = "SELECT l_orderkey AS project_id, l_partkey AS name FROM {lineitem} WHERE l_linestatus = 'O'"


@query(f"""
    WITH a AS (SELECT DISTINCT * FROM ({LISTED}) AS x), b AS (SELECT DISTINCT * FROM ({TOGGLED}) AS y)
    SELECT project_id, name FROM a EXCEPT SELECT project_id, name FROM b
    UNION ALL (SELECT project_id, name FROM b EXCEPT SELECT project_id, name FROM a)""")
def toggled_ignores(d):
    return tables.toggle_ignored(d.sql(LISTED), d.sql(TOGGLED))


@query(f"""SELECT o_orderkey FROM {{orders}} WHERE date_diff('second', o_orderdate, TIMESTAMP '{EXPIRY}') <= {TTL}""")
def fresh_sources(d):
    cached = d.table("orders").selectExpr("o_orderkey", "o_orderdate AS modified_at")
    return tables.fresh_source(cached, F.lit(EXPIRY).cast("timestamp"), TTL).select("o_orderkey")
