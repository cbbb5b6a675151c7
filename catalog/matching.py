"""Joins (D1-D16, F2, F5, F7, I7)."""

from pyspark.sql import functions as F

from catalog.base import query, text_literal
from riskframe.operators import matching
from riskframe.plans.reports import rank_advisories
from riskframe.seeds import POPULAR_PACKAGES, TECHNIQUES, blocklist_document
from riskframe.sources.files import bundled_blocklist


def _entry(e: dict) -> str:
    def sql(v):
        if v is None:
            return "CAST(NULL AS VARCHAR[])"
        if isinstance(v, list):
            return "CAST([" + ", ".join(map(text_literal, v)) + "] AS VARCHAR[])"
        return text_literal(v)
    return "(" + ", ".join(sql(e[k]) for k in FIELDS) + ")"


FIELDS = ("package_name", "ecosystem", "affected_versions", "severity", "reason", "source", "reported_at", "references")
COLUMNS = "listed_name, eco, versions, severity, reason, source, reported_at, refs"
BLOCKLIST_SQL = (
    f"blocklist({COLUMNS}) AS (VALUES " + ", ".join(_entry(e) for e in blocklist_document()["entries"]) + ")"
)
MATCHED_SQL = """
    SELECT p.package_id, p.name, p.version, p.ecosystem, b.listed_name, b.severity, b.reason, b.refs,
           CASE WHEN list_contains(b.versions, p.version) THEN p.version END AS matched_version
    FROM {packages} AS p JOIN blocklist AS b
      ON lower(b.listed_name) = lower(p.name)
     AND b.eco = CASE WHEN p.ecosystem IN ('nodejs', 'bun') THEN 'npm' ELSE p.ecosystem END
    WHERE b.versions IS NULL OR list_contains(b.versions, p.version)"""


@query(f"WITH {BLOCKLIST_SQL} SELECT package_id, listed_name, severity, reason, matched_version, refs[1] AS reference "
       f"FROM ({MATCHED_SQL}) AS m")
def known_malicious(d):
    return matching.match_blocklist(d.adapter("packages"), bundled_blocklist(d.spark)).select(
        "package_id", "listed_name", "severity", "reason", "matched_version",
        F.get("references", F.lit(0)).alias("reference"),
    )


POPULAR_SQL = "popular(p, ordinal) AS (VALUES " + ", ".join(
    f"({text_literal(p)}, {i})" for i, p in enumerate(POPULAR_PACKAGES)) + ")"
# Short names cut from the text of every customer and part, so that edits of all kinds occur.
NAME_POOL = """
    SELECT name FROM {packages} UNION ALL SELECT lower(c_mktsegment) AS name FROM {customer}
    UNION ALL SELECT p_name AS name FROM {part}
    UNION ALL SELECT concat(substr('reactlodashexpressaxioswebpackjestmochachaisinonmomentvuenextnuxtsasscorszodyupjoiajvuuid',
                                   CAST(o_orderkey % 90 AS INT) + 1, CAST(o_custkey % 9 AS INT) + 1),
                            CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'x' ELSE 's' END) AS name FROM {orders}"""


@query(f"""
    WITH {POPULAR_SQL}, names AS (SELECT DISTINCT name FROM ({NAME_POOL}) AS x),
    near AS (SELECT name, p, ordinal, levenshtein(name, p) AS distance FROM names, popular
             WHERE abs(length(name) - length(p)) <= 2 AND levenshtein(name, p) <= 2),
    hit AS (SELECT name, arg_min(p, ordinal) AS popular, arg_min(distance, ordinal) AS distance FROM near GROUP BY name)
    SELECT name, popular, CAST(distance AS INTEGER) AS distance FROM hit WHERE distance > 0""")
def look_alike_names(d):
    return matching.typosquats(d.sql(NAME_POOL))


OSV_RANGES = """
    SELECT concat('GHSA-', CAST(s_suppkey AS STRING)) AS external_id,
           CASE s_suppkey % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'Go' END AS ecosystem,
           CASE s_suppkey % 5 WHEN 0 THEN 'react' WHEN 1 THEN 'lodash' WHEN 2 THEN 'next' WHEN 3 THEN 'Peacenotwar'
                ELSE concat('pkg-', CAST(s_suppkey AS STRING)) END AS name,
           CASE s_suppkey % 4 WHEN 0 THEN '0' WHEN 1 THEN '1.0.0' WHEN 2 THEN '0.5.2' ELSE NULL END AS introduced,
           CASE s_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN '2.0.0' ELSE '3.3.6' END AS fixed,
           CASE WHEN s_suppkey % 4 = 3 THEN '3.3.6' ELSE NULL END AS listed
    FROM {supplier}"""
_CORE = "CAST(split_part({v}, '.', 1) AS INT) * 1000000 + CAST(split_part({v}, '.', 2) AS INT) * 1000 + CAST(split_part({v}, '.', 3) AS INT)"


@query(f"""
    WITH r AS ({OSV_RANGES}), v AS (
        SELECT DISTINCT name, version, ecosystem, CASE WHEN ecosystem IN ('nodejs', 'bun') THEN 'npm' ELSE ecosystem END AS eco,
               {_CORE.format(v='version')} AS core FROM {{packages}}),
    b AS (SELECT *, CASE WHEN introduced = '0' THEN 0 WHEN introduced IS NOT NULL THEN {_CORE.format(v='introduced')} END AS lo,
                 CASE WHEN fixed IS NOT NULL THEN {_CORE.format(v='fixed')} END AS hi FROM r)
    SELECT DISTINCT v.name, v.version, v.ecosystem, b.external_id FROM v JOIN b ON v.eco = b.ecosystem AND v.name = b.name
    WHERE (v.core >= b.lo AND (b.hi IS NULL OR v.core < b.hi)) OR v.version = b.listed""")
def osv_matches(d):
    ranges = d.sql(OSV_RANGES).withColumn("versions", F.when(F.col("listed").isNotNull(), F.array("listed"))).drop("listed")
    return matching.match_osv(d.adapter("packages"), ranges)


def _versions(k: str, a: str, b: str, c: str, s: str) -> tuple[str, str]:
    """Version text of every shape of three ecosystems, and the number by which these versions order.

    From whole numbers: `k` picks the ecosystem, `s` the shape, `a` and `b` the release, `c` what follows it.
    """
    a_b = f"CAST({a} AS STRING), '.', CAST({b} AS STRING)"
    c_text = f"CAST({c} AS STRING)"
    text = f"""CASE concat(CAST({k} % 3 AS STRING), CAST({s} % 5 AS STRING))
        WHEN '00' THEN concat({a_b}, '.0') WHEN '01' THEN concat({a_b}, '.0-alpha.', {c_text}) WHEN '02' THEN concat({a_b}, '.0-alpha')
        WHEN '03' THEN concat({a_b}, '.0-rc.', {c_text}) WHEN '04' THEN concat({a_b}, '.0+build.', {c_text})
        WHEN '10' THEN concat({a_b}) WHEN '11' THEN concat({a_b}, 'rc', {c_text}) WHEN '12' THEN concat({a_b}, '.post', {c_text})
        WHEN '13' THEN concat(CAST({c} % 2 AS STRING), '!', {a_b}, '.0') WHEN '14' THEN concat({a_b}, '.dev', {c_text})
        WHEN '20' THEN concat('v', {a_b}, '.0') WHEN '21' THEN concat('v', {a_b}, '.0-2024010', {c_text}000000-abcdefabcdef')
        WHEN '22' THEN concat('v', {a_b}, '.0-0.2024010', {c_text}000000-abcdefabcdef') WHEN '23' THEN concat('v', {a_b}, '.0+incompatible')
        ELSE concat('v', {a_b}, '.0-rc.', {c_text}) END""".replace(f"{c_text}000000-abcdefabcdef'", f"{c_text}, '000000-abcdefabcdef'")
    phase = f"""CASE concat(CAST({k} % 3 AS STRING), CAST({s} % 5 AS STRING))
        WHEN '01' THEN 120 + {c} WHEN '02' THEN 110 WHEN '03' THEN 140 + {c} WHEN '11' THEN 140 + {c} WHEN '12' THEN 910 + {c} WHEN '14' THEN 100 + {c}
        WHEN '21' THEN 120 + {c} WHEN '22' THEN 110 + {c} WHEN '24' THEN 140 + {c} ELSE 900 END"""
    epoch = f"CASE WHEN {k} % 3 = 1 AND {s} % 5 = 3 THEN {c} % 2 ELSE 0 END"
    return text, f"((({epoch}) * 100 + {a}) * 100 + {b}) * 1000 + {phase}"


_HELD = _versions("p_partkey", "p_size % 3", "p_size % 25", "p_partkey % 7 % 4", "p_partkey")
_FIRST = _versions("s_suppkey", "s_suppkey % 2", "s_suppkey * 7 % 25", "s_suppkey % 4", "s_suppkey")
_FIXED = _versions("s_suppkey", "(1 + s_suppkey % 2)", "s_suppkey * 11 % 25", "(s_suppkey + 1) % 4", "(s_suppkey + 2)")
_ECOSYSTEM = "CASE {k} % 3 WHEN 0 THEN 'npm' WHEN 1 THEN 'PyPI' ELSE 'Go' END"
HELD = f"""
    SELECT DISTINCT concat('lib-', CAST(p_partkey % 7 AS STRING)) AS name, {_ECOSYSTEM.format(k='p_partkey')} AS ecosystem,
           {_HELD[0]} AS version, {_HELD[1]} AS place FROM {{part}}"""
SPANS = f"""
    SELECT concat('OSV-', CAST(s_suppkey AS STRING)) AS external_id, concat('lib-', CAST(s_suppkey % 7 AS STRING)) AS name,
           {_ECOSYSTEM.format(k='s_suppkey')} AS ecosystem, CASE WHEN s_suppkey % 4 = 0 THEN '0' ELSE {_FIRST[0]} END AS introduced,
           CASE WHEN s_suppkey % 11 = 3 THEN NULL ELSE {_FIXED[0]} END AS fixed,
           CASE WHEN s_suppkey % 4 = 0 THEN 0 ELSE {_FIRST[1]} END AS low, CASE WHEN s_suppkey % 11 <> 3 THEN {_FIXED[1]} END AS high
    FROM {{supplier}}"""


@query(f"""
    SELECT h.name, h.version, h.ecosystem, s.external_id FROM ({HELD}) AS h JOIN ({SPANS}) AS s ON h.name = s.name AND h.ecosystem = s.ecosystem
    WHERE h.place >= s.low AND (s.high IS NULL OR h.place < s.high)""")
def osv_matches_of_all_shapes(d):
    """Pre-releases, Python's phases and epochs, Go's pseudo-versions; the twin orders them by the numbers they were made from."""
    spans = d.sql(SPANS).drop("low", "high").withColumn("versions", F.lit(None).cast("array<string>"))
    return matching.match_osv(d.sql(HELD).drop("place"), spans)


NAME_ADVISORIES = """
    SELECT DISTINCT p.name, a.external_id, a.published_at FROM {advisories} AS a JOIN {packages} AS p ON a.package_id = p.package_id"""

@query(f"""
    WITH n AS (SELECT name, external_id, max(published_at) AS published_at FROM ({NAME_ADVISORIES}) AS x GROUP BY name, external_id)
    SELECT DISTINCT p.name, p.version, p.ecosystem, n.external_id FROM {{packages}} AS p JOIN n ON p.name = n.name
    WHERE p.ecosystem IN ('nodejs', 'bun')""")
def github_matches(d):
    named = d.sql(NAME_ADVISORIES).groupBy("name", "external_id").agg(F.max("published_at").alias("published_at"))
    return matching.match_github(d.adapter("packages"), named).select("name", "version", "ecosystem", "external_id")


# Every distinct word of the conversations is a package name, every document a description.
WORD_NAMES = """SELECT DISTINCT word AS name FROM (
    SELECT explode(split(text, '[^A-Za-z]+')) AS word FROM {conversations}) AS w WHERE word <> ''"""


@query(r"""
    WITH names AS (SELECT DISTINCT name, lower(name) AS token FROM (
             SELECT unnest(regexp_split_to_array(text, '[^A-Za-z]+')) AS name FROM {conversations}) AS w WHERE name <> ''),
    words AS (SELECT DISTINCT concat('CVE-', CAST(doc_id AS STRING)) AS external_id,
                     unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM {documents})
    SELECT n.name, w.external_id FROM names AS n JOIN words AS w ON n.token = w.token""")
def nvd_matches(d):
    cves = d.table("documents").selectExpr(
        "concat('CVE-', doc_id) AS external_id", "n_chars AS published_at", "text AS description"
    )
    return matching.match_nvd(d.sql(WORD_NAMES), cves, whole_runs=True).select("name", "external_id")


# The first word of every turn is a package name, and so are its first two words together.
TURN_NAMES = """SELECT DISTINCT name FROM (
    SELECT explode(array(regexp_extract(text, '^[A-Za-z]+', 0), regexp_extract(text, '^[A-Za-z]+[^A-Za-z]+[A-Za-z]+', 0))) AS name
    FROM {conversations}) AS w WHERE name <> ''"""


@query("""
    WITH names AS (SELECT DISTINCT name, lower(name) AS word FROM (
             SELECT unnest([regexp_extract(text, '^[A-Za-z]+'), regexp_extract(text, '^[A-Za-z]+[^A-Za-z]+[A-Za-z]+')]) AS name
             FROM {conversations}) AS w WHERE name <> ''),
    texts AS (SELECT concat('CVE-', CAST(doc_id AS STRING)) AS external_id, lower(text) AS description FROM {documents})
    SELECT name, external_id FROM names JOIN texts ON contains(description, word)""")
def nvd_text_matches(d):
    """Names of one run and of several, also inside longer words; the twin looks into every text for every name."""
    cves = d.table("documents").selectExpr(
        "concat('CVE-', doc_id) AS external_id", "n_chars AS published_at", "text AS description"
    )
    return matching.match_nvd(d.sql(TURN_NAMES), cves).select("name", "external_id")


@query("""
    SELECT package_id, source, external_id, CASE source WHEN 'osv' THEN 0 WHEN 'github' THEN 1 ELSE 2 END AS source_order
    FROM {advisories}""")
def advisories_of_all_sources(d):
    a = d.adapter("advisories")
    parts = [a.filter(F.col("source") == s) for s in ("osv", "github", "nvd")]
    return matching.all_advisories(*parts).select("package_id", "source", "external_id", "source_order")


TECHNIQUE_SQL = "technique(pattern_type, technique_id, technique_name, tactic, url, technique_text) AS (VALUES " + ", ".join(
    "(" + ", ".join(map(text_literal, (kind, *row))) + ")" for kind, rows in TECHNIQUES.items() for row in rows) + ")"
TYPED = """
    SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'credential_harvesting' WHEN 1 THEN 'crypto_mining'
           WHEN 2 THEN 'network_exfiltration' WHEN 3 THEN 'install_hook' WHEN 4 THEN 'typosquatting'
           WHEN 5 THEN 'reverseshell_code' ELSE 'obfuscated_code' END AS pattern_type FROM {events}"""


@query(f"WITH {TECHNIQUE_SQL}, t AS ({TYPED}) SELECT event_id, technique.* FROM t JOIN technique USING (pattern_type)")
def technique_mapping(d):
    return matching.map_mitre(d.sql(TYPED))


@query("""
    SELECT p.package_id, p.name, m.stars, m.days_since_push FROM {packages} AS p
    LEFT JOIN (SELECT name, ecosystem, max(stars) AS stars, max(days_since_push) AS days_since_push
               FROM {maintainer_metrics} JOIN {packages} USING (package_id) GROUP BY name, ecosystem) AS m
      ON p.name = m.name AND p.ecosystem = m.ecosystem""")
def packages_with_maintainer(d):
    metrics = d.adapter("maintainer_metrics").join(d.adapter("packages"), "package_id").groupBy(
        F.col("name").alias("package_name"), "ecosystem"
    ).agg(F.max("stars").alias("stars"), F.max("days_since_push").alias("days_since_push"))
    return matching.with_maintainer(d.adapter("packages"), metrics).select(
        "package_id", "name", "stars", "days_since_push"
    )


@query("""
    WITH r AS (SELECT c_custkey, concat('lib-', CAST(c_custkey AS STRING)) AS name, c_custkey % 4 AS form,
                      concat('o', CAST(c_nationkey AS STRING)) AS owner, concat('r', CAST(c_custkey % 200 AS STRING)) AS repo FROM {customer}),
    m AS (SELECT concat('o', CAST(s_nationkey AS STRING)) AS owner, concat('r', CAST(s_suppkey % 200 AS STRING)) AS repo,
                 max(s_suppkey) AS stars FROM {supplier} GROUP BY 1, 2)
    SELECT r.name, CASE WHEN form < 2 THEN r.owner END AS owner, CASE WHEN form < 2 THEN r.repo END AS repo, m.stars
    FROM r LEFT JOIN m ON r.owner = m.owner AND r.repo = m.repo AND form < 2""")
def packages_with_repository(d):
    c = d.table("customer")
    packages = c.selectExpr("concat('lib-', c_custkey) AS name")
    url = "concat('git+https://github.com/o', c_nationkey, '/r', c_custkey % 200, '.git')"
    latest = c.selectExpr(
        "concat('lib-', c_custkey) AS name",
        f"""CASE c_custkey % 4
              WHEN 0 THEN to_json(struct(struct('git' AS type, {url} AS url) AS repository))
              WHEN 1 THEN to_json(struct({url} AS repository))
              WHEN 2 THEN to_json(struct(struct('git' AS type) AS repository)) ELSE 'no json' END AS json""",
    )
    metrics = d.table("supplier").selectExpr(
        "concat('o', s_nationkey) AS owner", "concat('r', s_suppkey % 200) AS repo", "s_suppkey AS stars"
    ).groupBy("owner", "repo").agg(F.max("stars").alias("stars"))
    return matching.with_repo(packages, latest, metrics).select("name", "owner", "repo", "stars")


@query("""
    SELECT p.package_id, p.name, p.version FROM {packages} AS p
    WHERE package_id IN (SELECT package_id FROM {project_packages} WHERE project_id = 7)""")
def scan_packages(d):
    scans = d.adapter("project_packages").select(F.col("project_id").cast("string").alias("scan_id"), "package_id")
    return matching.packages_of_scan(d.adapter("packages"), scans, "7").select("package_id", "name", "version")


LOCKED = """
    SELECT l_orderkey AS project_id, concat('n', CAST(l_partkey AS STRING)) AS name, l_linenumber AS position FROM {lineitem}"""
WANTED = """
    SELECT DISTINCT l_orderkey AS project_id, concat('n', CAST(l_partkey AS STRING)) AS name FROM {lineitem} WHERE l_linestatus = 'O'"""
OWN = "SELECT DISTINCT o_orderkey AS project_id, concat('n', CAST(o_custkey AS STRING)) AS name FROM {orders}"


@query(f"""
    WITH w AS ({WANTED})
    SELECT k.project_id, k.name, k.position, w.name IS NOT NULL AS is_direct
    FROM ({LOCKED}) AS k LEFT JOIN w ON w.project_id = k.project_id AND w.name = k.name""")
def direct_flags(d):
    return matching.flag_direct(d.sql(LOCKED), d.sql(WANTED))


@query(f"""
    WITH o AS ({OWN})
    SELECT k.project_id, k.name, k.position FROM ({LOCKED}) AS k
    WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.project_id = k.project_id AND o.name = k.name)""")
def without_root(d):
    return matching.drop_root(d.sql(LOCKED), d.sql(OWN)).select("project_id", "name", "position")


@query("""
    SELECT 'package' AS lookup, count(*) AS n FROM {packages} WHERE name = 'react' AND version = '3.3.6' AND ecosystem = 'bun'
    UNION ALL SELECT 'advisory', count(*) FROM {advisories} WHERE source = 'osv' AND contains(external_id, '-1')
              AND external_id = (SELECT min(external_id) FROM {advisories} WHERE source = 'osv')
    UNION ALL SELECT 'by_package', count(*) FROM {advisories} WHERE package_id = 11
    UNION ALL SELECT 'by_packages', count(*) FROM {advisories} WHERE package_id IN (SELECT package_id FROM {packages} WHERE name = 'next')""")
def point_lookups(d):
    packages, advisories = d.adapter("packages"), d.adapter("advisories")
    first = advisories.filter("source = 'osv'").agg(F.min("external_id")).first()[0]
    found = {
        "package": matching.find_package(packages, "react", "3.3.6", "bun"),
        "advisory": matching.find_advisory(advisories, "osv", first).filter(F.contains("external_id", F.lit("-1"))),
        "by_package": matching.rows_of_package(advisories, 11),
        "by_packages": matching.rows_of_packages(advisories, packages.filter("name = 'next'")),
    }
    out = None
    for label, rows in found.items():
        counted = rows.agg(F.count("*").alias("n")).select(F.lit(label).alias("lookup"), "n")
        out = counted if out is None else out.unionByName(counted)
    return out


@query("""
    SELECT package_id, source, external_id, severity, cvss_score FROM {advisories}
    WHERE package_id = (SELECT min(package_id) FROM {advisories})""")
def ranked_advisories(d):
    a = d.adapter("advisories")
    first = a.agg(F.min("package_id")).first()[0]
    return rank_advisories(a, first).select("package_id", "source", "external_id", "severity", "cvss_score")


@query("""
    SELECT pp.project_id, pp.package_id,
           CASE WHEN p.package_id % 2 = 0 THEN concat('/cache/', replace(name, '/', '+'), '@', version)
                WHEN pp.project_id % 3 = 0 THEN concat('/projects/', CAST(pp.project_id AS STRING)) END AS source_path
    FROM {project_packages} AS pp JOIN (
        SELECT *, min(package_id) OVER (PARTITION BY name, version) AS first_id FROM {packages}) AS q ON pp.package_id = q.package_id
    JOIN {packages} AS p ON p.package_id = q.first_id""".replace("name, '/'", "p.name, '/'").replace("'@', version)", "'@', p.version)"))
def package_sources(d):
    packages = d.adapter("packages")
    fleet = d.adapter("project_packages").select("project_id", "package_id").join(packages, "package_id")
    own = packages.groupBy("name", "version").agg(F.min("package_id").alias("first_id")).filter("first_id % 2 = 0").selectExpr(
        "concat(replace(name, '/', '+'), '@', version) AS source_key",
        "concat('/cache/', replace(name, '/', '+'), '@', version) AS path",
    )
    project = d.table("orders").filter("o_orderkey % 3 = 0").selectExpr(
        "o_orderkey AS project_id", "concat('/projects/', o_orderkey) AS path"
    )
    return matching.source_for_package(fleet, own, project).select("project_id", "package_id", "source_path")
