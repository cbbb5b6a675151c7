"""Version behaviour."""

from pyspark.sql import functions as F

from catalog.base import query
from catalog.evidence import CHANGES, version_changes
from catalog.functions import SEMVER_RE2, VERSION_TEXT
from riskframe.operators import changes
from riskframe.session import durable, spread
from riskframe.sources.registry import registry_snapshots

_PART = "CAST(regexp_extract(version, '" + SEMVER_RE2 + "', {i}) AS BIGINT)"


@query(f"""
    WITH raw AS (SELECT DISTINCT package, version FROM ({VERSION_TEXT}) AS x),
    v AS (SELECT *, regexp_matches(version, '{SEMVER_RE2}') AS ok FROM raw),
    k AS (SELECT package, version, {_PART.format(i=1)} * 1000000 + {_PART.format(i=2)} * 1000 + {_PART.format(i=3)} AS core,
                 contains(version, '-') AS pre, regexp_extract(version, '{SEMVER_RE2}', 5) AS build FROM v WHERE ok),
    s AS (SELECT package, core, arg_max(version, build) AS version FROM k WHERE NOT pre GROUP BY package, core),
    p AS (SELECT k.package, k.version, arg_max(s.version, s.core) AS previous_version
          FROM k LEFT JOIN s ON s.package = k.package AND s.core < k.core GROUP BY k.package, k.version)
    SELECT package, version, previous_version FROM p UNION ALL SELECT package, version, NULL FROM v WHERE NOT ok""")
def previous_versions(d):
    return changes.previous_stable_version(d.sql(VERSION_TEXT))


# One registry document per order: two stable versions and a pre-release between them.
LICENSES = "['MIT', 'ISC', 'GPL']"


def registry_documents(d):
    return spread(d.table("orders")).selectExpr(
        "concat('lib-', o_orderkey) AS package",
        """concat('{"versions":{"1.', o_custkey % 10, '.0":{"license":"MIT","dependencies":{"a":"1","b', o_custkey % 3,
             '":"1"},"dist":{"fileCount":', 1 + o_custkey % 4, '}},"1.99.0-rc.1":{"license":7},"2.0.0":{"license":',
             CASE o_orderkey % 4 WHEN 0 THEN '"MIT"' WHEN 1 THEN '{"type":"GPL"}' WHEN 2 THEN '{"type":5}' ELSE 'null' END,
             ',"dependencies":{"a":"2"},"devDependencies":{"a":"3","c', o_orderkey % 2, '":"1"},"dist":{"fileCount":',
             o_orderkey % 3, '}}}}') AS json""",
    )


_BASE = """
    SELECT concat('lib-', CAST(o_orderkey AS STRING)) AS package, concat('1.', CAST(o_custkey % 10 AS STRING), '.0') AS old,
           1 + o_custkey % 4 AS old_files, o_orderkey % 3 AS new_files, concat('b', CAST(o_custkey % 3 AS STRING)) AS b,
           concat('c', CAST(o_orderkey % 2 AS STRING)) AS c,
           CASE o_orderkey % 4 WHEN 0 THEN 'MIT' WHEN 1 THEN 'GPL' WHEN 2 THEN 'unknown' END AS license
    FROM {orders}"""


@query(f"""
    WITH x AS ({_BASE})
    SELECT package, old AS version, old_files AS file_count, 'MIT' AS license, concat('a=1,', b, '=1') AS dependencies FROM x
    UNION ALL SELECT package, '1.99.0-rc.1', 0, 'unknown', '' FROM x
    UNION ALL SELECT package, '2.0.0', new_files, license, concat('a=3,', c, '=1') FROM x""")
def registry_versions(d):
    pairs = F.transform(F.sort_array(F.map_keys("dependencies")),
                        lambda k: F.concat(k, F.lit("="), F.try_element_at("dependencies", k)))
    return registry_snapshots(registry_documents(d)).select(
        "package", "version", F.size("files").cast("bigint").alias("file_count"), "license",
        F.array_join(pairs, ",").alias("dependencies"),
    )


@query(f"""
    WITH x AS ({_BASE})
    SELECT package, old AS from_version, '2.0.0' AS to_version, 'files_removed' AS change_type, 'medium' AS severity,
           concat('Files removed between ', old, ' and 2.0.0: ', array_to_string(
               list_transform(range(new_files, old_files), lambda i: concat('file_', CAST(i AS STRING))), ', ')) AS description
    FROM x WHERE old_files > new_files
    UNION ALL
    SELECT package, old, '2.0.0', 'license_changed', 'low',
           concat('License changed from MIT to ', license, ' between versions ', old, ' and 2.0.0') FROM x WHERE license <> 'MIT'
    UNION ALL
    SELECT package, old, '2.0.0', 'dependencies_changed', 'medium',
           concat('Dependencies changed between ', old, ' and 2.0.0: added: ', c, '; removed: ', b) FROM x
    UNION ALL
    SELECT package, old, '1.99.0-rc.1', 'files_removed', 'medium', concat('Files removed between ', old, ' and 1.99.0-rc.1: ',
           array_to_string(list_transform(range(0, old_files), lambda i: concat('file_', CAST(i AS STRING))), ', ')) FROM x
    UNION ALL
    SELECT package, old, '1.99.0-rc.1', 'license_changed', 'low',
           concat('License changed from MIT to unknown between versions ', old, ' and 1.99.0-rc.1') FROM x
    UNION ALL
    SELECT package, old, '1.99.0-rc.1', 'dependencies_changed', 'medium',
           concat('Dependencies changed between ', old, ' and 1.99.0-rc.1: removed: a, ', b) FROM x""")
def registry_changes(d):
    # Read three times and counted once, so the parsed documents are stored.
    snapshots = durable(registry_snapshots(registry_documents(d)))
    return changes.version_diffs(snapshots, changes.version_pairs(snapshots))


SEQUENCE = """
    SELECT package, version AS to_version, lag(version) OVER (PARTITION BY package ORDER BY released_at, version) AS from_version
    FROM (SELECT DISTINCT package, version, released_at FROM {version_events}) AS v"""
MEMBERS = """
    p AS (SELECT * FROM ({seq}) AS s WHERE from_version IS NOT NULL),
    m AS (SELECT DISTINCT package, version, {member} AS member FROM {{version_events}}),
    o AS (SELECT p.*, member FROM p JOIN m ON m.package = p.package AND m.version = p.from_version),
    n AS (SELECT p.*, member FROM p JOIN m ON m.package = p.package AND m.version = p.to_version),
    c AS (SELECT package, from_version, to_version, member, 'removed' AS change FROM (SELECT * FROM o EXCEPT SELECT * FROM n) AS r
          UNION ALL
          SELECT package, from_version, to_version, member, 'added' FROM (SELECT * FROM n EXCEPT SELECT * FROM o) AS a)"""


def _sequence(d):
    events = d.adapter("version_events")
    return events, changes.version_sequence(events.select("package", "version", "released_at").distinct(), ["released_at", "version"])


@query("WITH " + MEMBERS.format(seq=SEQUENCE, member="file_id") +
       " SELECT package, from_version, to_version, member, change FROM c")
def file_changes(d):
    events, pairs = _sequence(d)
    return changes.member_changes(events.selectExpr("package", "version", "file_id AS member"), pairs)


@query("WITH " + MEMBERS.format(seq=SEQUENCE, member="CAST(dependency_id AS STRING)") + """
    SELECT package, from_version, to_version, change, string_agg(member, ', ' ORDER BY member) AS members
    FROM c GROUP BY package, from_version, to_version, change""")
def dependency_changes(d):
    events, pairs = _sequence(d)
    found = changes.member_changes(events.selectExpr("package", "version", "CAST(dependency_id AS STRING) AS member"), pairs)
    # A long list comes in parts, and the query has a row per pair.
    parts = changes.member_change_text(found).withColumn("members", F.split("members", ", "))
    whole = F.array_join(F.sort_array(F.flatten(F.collect_list("members"))), ", ")
    return parts.groupBy("package", "from_version", "to_version", "change").agg(whole.alias("members"))


@query(f"SELECT package_id, from_version, to_version, description, severity FROM ({CHANGES}) AS c WHERE package_id = (SELECT min(o_custkey) FROM {{orders}})")
def package_history(d):
    dated = version_changes(d).withColumn("detected_at", F.col("to_version"))
    first = d.table("orders").agg(F.min("o_custkey")).first()[0]
    return changes.recent_diffs(dated, first).select("package_id", "from_version", "to_version", "description", "severity")
