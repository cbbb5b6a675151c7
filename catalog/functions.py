"""Scalar functions over whole tables."""

from pyspark.sql import functions as F

from catalog.base import case_sql, query
from riskframe.functions import identity, severity, text, version
from riskframe.seeds import SEVERITY_RANKS, SEVERITY_SCORES

RANK = case_sql("severity", SEVERITY_RANKS)
SCORE = f"CAST({case_sql('severity', SEVERITY_SCORES)} AS DOUBLE)"


@query(f"""
    SELECT package_id, external_id, {RANK} AS severity_rank, {SCORE} AS severity_score, upper(severity) AS label,
           CASE WHEN cvss_score >= 9 THEN 'critical' WHEN cvss_score >= 7 THEN 'high'
                WHEN cvss_score >= 4 THEN 'medium' WHEN cvss_score > 0 THEN 'low' ELSE 'safe' END AS band
    FROM {{advisories}}""")
def severity_scale(d):
    return d.adapter("advisories").select(
        "package_id", "external_id", severity.severity_rank(F.col("severity")).alias("severity_rank"),
        severity.severity_score(F.col("severity")).alias("severity_score"),
        severity.severity_label(F.col("severity")).alias("label"),
        severity.score_to_severity(F.col("cvss_score") / 10).alias("band"),
    )


CVSS_TEXT = """
    SELECT l_orderkey, l_linenumber, l_partkey,
           CASE l_suppkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'CVSS:3.1/AV:N/AC:L' WHEN 2 THEN ''
                ELSE CAST(l_suppkey % 11 AS STRING) END AS score_text,
           CASE l_suppkey % 5 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'MODERATE' WHEN 3 THEN 'LOW'
                ELSE 'OTHER' END AS level,
           CASE WHEN l_partkey % 3 = 0 THEN CAST(l_suppkey % 11 AS DOUBLE) END AS v31,
           CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey % 11 AS DOUBLE) END AS v30,
           CASE WHEN l_partkey % 5 = 0 THEN CAST(0 AS DOUBLE) END AS v2
    FROM {lineitem}"""


@query(f"""
    WITH raw AS ({CVSS_TEXT}), nums AS (
        SELECT *, TRY_CAST(nullif(score_text, '') AS DOUBLE) AS osv_cvss, coalesce(v31, v30, v2) AS nvd_cvss FROM raw)
    SELECT l_orderkey, l_linenumber, l_partkey, osv_cvss, nvd_cvss,
           CASE WHEN score_text IS NULL THEN 'medium' WHEN coalesce(osv_cvss, 0) >= 9 THEN 'critical'
                WHEN osv_cvss >= 7 THEN 'high' WHEN osv_cvss >= 4 THEN 'medium' ELSE 'low' END AS osv_severity,
           CASE WHEN nvd_cvss >= 9 THEN 'critical' WHEN nvd_cvss >= 7 THEN 'high' WHEN nvd_cvss >= 4 THEN 'medium'
                WHEN nvd_cvss > 0 THEN 'low' ELSE 'medium' END AS nvd_severity,
           CASE level WHEN 'CRITICAL' THEN 'critical' WHEN 'HIGH' THEN 'high' WHEN 'LOW' THEN 'low'
                ELSE 'medium' END AS github_severity
    FROM nums""")
def source_severity(d):
    raw = d.sql(CVSS_TEXT)
    nvd = severity.nvd_cvss(F.col("v31"), F.col("v30"), F.col("v2"))
    return raw.select(
        "l_orderkey", "l_linenumber", "l_partkey", severity.osv_cvss(F.col("score_text")).alias("osv_cvss"),
        nvd.alias("nvd_cvss"), severity.osv_severity(F.col("score_text")).alias("osv_severity"),
        severity.nvd_severity(nvd).alias("nvd_severity"), severity.github_severity(F.col("level")).alias("github_severity"),
    )


@query("""
    SELECT package_id, CASE WHEN ecosystem IN ('nodejs', 'bun') THEN 'npm' ELSE ecosystem END AS registry,
           CASE ecosystem WHEN 'PyPI' THEN concat('https://pypi.org/project/', name, '/', version, '/')
                WHEN 'Go' THEN concat('https://pkg.go.dev/', name, '@', version)
                WHEN 'crates.io' THEN concat('https://crates.io/crates/', name, '/', version) END AS url,
           concat(replace(name, '/', '+'), '@', version) AS source_key, concat(name, '-', version) AS bom_ref,
           sha256(concat(name, chr(1), version, chr(1), ecosystem)) AS package_key
    FROM {packages}""")
def package_identity(d):
    name, ver, eco = F.col("name"), F.col("version"), F.col("ecosystem")
    return d.adapter("packages").select(
        "package_id", identity.registry_ecosystem(eco).alias("registry"),
        identity.registry_url(eco, name, ver).alias("url"), identity.package_source_key(name, ver).alias("source_key"),
        text.sbom_ref(name, ver).alias("bom_ref"), identity.package_key(name, ver, eco).alias("package_key"),
    )


@query("""
    SELECT package_id, source, external_id,
           concat(CASE source WHEN 'osv' THEN 'https://osv.dev/vulnerability/'
                  WHEN 'github' THEN 'https://github.com/advisories/'
                  ELSE 'https://nvd.nist.gov/vuln/detail/' END, external_id) AS url,
           CASE source WHEN 'osv' THEN 'OSV' WHEN 'github' THEN 'GitHub' ELSE 'NVD' END AS label,
           severity AS bom_severity
    FROM {advisories}""")
def advisory_urls(d):
    return d.adapter("advisories").select(
        "package_id", "source", "external_id",
        identity.advisory_url(F.col("source"), F.col("external_id")).alias("url"),
        text.source_label(F.col("source")).alias("label"), text.sbom_severity(F.col("severity")).alias("bom_severity"),
    )


SPECS = """
    SELECT o_orderkey, o_custkey, concat('Na.me-', o_orderstatus, '[extra', CAST(o_custkey AS STRING), ']') AS raw_name,
           concat(CASE o_orderkey % 10 WHEN 0 THEN '==' WHEN 1 THEN '>=' WHEN 2 THEN '<= ' WHEN 3 THEN '~=' WHEN 4 THEN '!='
                  WHEN 5 THEN '>' WHEN 6 THEN '<' WHEN 7 THEN '^' WHEN 8 THEN '' ELSE ' ==  ' END,
                  CAST(o_custkey % 9 AS STRING), '.', CAST(o_orderkey % 7 AS STRING),
                  CASE WHEN o_orderkey % 4 = 0 THEN ' , <9' ELSE '' END) AS spec,
           concat('node_modules/a/node_modules/@s', CAST(o_custkey % 5 AS STRING), '/p', CAST(o_orderkey AS STRING)) AS lock_key
    FROM {orders}"""
_CUT = "nullif(trim(split_part(substr(s, {n}), ',', 1)), '')"


@query(f"""
    WITH raw AS (SELECT *, trim(spec) AS s FROM ({SPECS}) AS x)
    SELECT o_orderkey, replace(replace(lower(raw_name), '-', '_'), '.', '_') AS pypi_name,
           split_part(raw_name, '[', 1) AS bare_name,
           CASE WHEN left(s, 2) IN ('==', '>=', '<=', '~=', '!=') THEN {_CUT.format(n=3)}
                WHEN left(s, 1) IN ('>', '<', '^') THEN {_CUT.format(n=2)} END AS python_version,
           nullif(trim(split_part(regexp_replace(spec, '^\\^*~*=*(>=)*(<=)*>*<*', ''), ',', 1)), '') AS cargo_version,
           regexp_replace(spec, '^\\^*~*', '') AS npm_version,
           concat('@s', CAST(o_custkey % 5 AS STRING), '/p', CAST(o_orderkey AS STRING)) AS lock_name,
           concat('p', CAST(o_orderkey AS STRING)) AS lock_name_short, 2 AS lock_depth
    FROM raw""")
def version_specs(d):
    return d.sql(SPECS).select(
        "o_orderkey", identity.normalize_pypi_name(F.col("raw_name")).alias("pypi_name"),
        identity.strip_extras(F.col("raw_name")).alias("bare_name"),
        version.python_version(F.col("spec")).alias("python_version"),
        version.cargo_version(F.col("spec")).alias("cargo_version"), version.npm_version(F.col("spec")).alias("npm_version"),
        identity.npm_name_from_key(F.col("lock_key")).alias("lock_name"),
        identity.npm_name_from_key(F.col("lock_key"), compat=True).alias("lock_name_short"),
        identity.npm_depth(F.col("lock_key")).alias("lock_depth"),
    )


REPO_URLS = """
    SELECT c_custkey,
           CASE c_custkey % 8
             WHEN 0 THEN concat('https://github.com/o', CAST(c_nationkey AS STRING), '/r', CAST(c_custkey AS STRING), '.git')
             WHEN 1 THEN concat('git+https://github.com/o', CAST(c_nationkey AS STRING), '/r', CAST(c_custkey AS STRING), '.git')
             WHEN 2 THEN concat('git://github.com/o', CAST(c_nationkey AS STRING), '/r', CAST(c_custkey AS STRING))
             WHEN 3 THEN concat('git+ssh://git@github.com:o', CAST(c_nationkey AS STRING), '/r', CAST(c_custkey AS STRING), '.git')
             WHEN 4 THEN concat('  https://github.com/o', CAST(c_nationkey AS STRING), '/r', CAST(c_custkey AS STRING), '  ')
             WHEN 5 THEN 'https://github.com/owneronly'
             WHEN 6 THEN concat('https://example.com/o/r', CAST(c_custkey AS STRING))
             ELSE NULL END AS url
    FROM {customer}"""


@query(f"""
    WITH raw AS ({REPO_URLS})
    SELECT c_custkey,
           CASE WHEN c_custkey % 8 < 5 THEN concat('https://github.com/o', CAST(c_nationkey AS STRING), '/r', CAST(c_custkey AS STRING))
                WHEN c_custkey % 8 = 5 THEN 'https://github.com/owneronly' END AS repo_url,
           CASE WHEN c_custkey % 8 < 5 THEN concat('o', CAST(c_nationkey AS STRING)) END AS owner,
           CASE WHEN c_custkey % 8 < 5 THEN concat('r', CAST(c_custkey AS STRING)) END AS repo
    FROM {{customer}}""")
def repository_urls(d):
    pair = identity.owner_repo(F.col("url"))
    return d.sql(REPO_URLS).select(
        "c_custkey", identity.normalize_repo_url(F.col("url")).alias("repo_url"), pair["owner"].alias("owner"),
        pair["repo"].alias("repo"),
    )


VERSION_TEXT = """
    SELECT o_custkey AS package,
           CASE WHEN o_orderkey % 17 = 0 THEN concat('1.', CAST(o_orderkey % 4 AS STRING))
                WHEN o_orderkey % 19 = 0 THEN concat('01.2.', CAST(o_orderkey % 4 AS STRING))
                ELSE concat(CAST(o_orderkey % 3 AS STRING), '.', CAST(o_orderkey % 11 AS STRING), '.',
                            CAST(o_orderkey % 5 AS STRING),
                            CASE WHEN o_orderkey % 7 = 0 THEN '-rc.1' WHEN o_orderkey % 13 = 0 THEN '+b7' ELSE '' END)
                END AS version
    FROM {orders}"""
SEMVER_RE2 = r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(?:-([0-9a-zA-Z.-]+))?(?:\+([0-9a-zA-Z.-]+))?$"


@query(f"""
    WITH raw AS ({VERSION_TEXT}), parsed AS (
        SELECT *, regexp_matches(version, '{SEMVER_RE2}') AS ok FROM raw)
    SELECT package, version,
           CASE WHEN ok THEN CAST(regexp_extract(version, '{SEMVER_RE2}', 1) AS BIGINT) END AS major,
           CASE WHEN ok THEN CAST(regexp_extract(version, '{SEMVER_RE2}', 2) AS BIGINT) END AS minor,
           CASE WHEN ok THEN CAST(regexp_extract(version, '{SEMVER_RE2}', 3) AS BIGINT) END AS patch,
           nullif(regexp_extract(version, '{SEMVER_RE2}', 4), '') AS prerelease,
           nullif(regexp_extract(version, '{SEMVER_RE2}', 5), '') AS build,
           ok AND NOT contains(version, '-') AS is_stable
    FROM parsed""")
def semver_keys(d):
    core = version.semver_core(F.col("version"))
    return d.sql(VERSION_TEXT).select(
        "package", "version", *(core[c].alias(c) for c in ("major", "minor", "patch")),
        version.prerelease(F.col("version")).alias("prerelease"), version.build_metadata(F.col("version")).alias("build"),
        version.is_stable(F.col("version")).alias("is_stable"),
    )


@query("""
    SELECT doc_id, substr(text, 1, 120) AS script_snippet,
           trim(substr(text, 1, 120), concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS code_snippet,
           CASE WHEN length(text) > 45 THEN concat(left(text, 45), '…') ELSE text END AS label
    FROM {documents}""")
def text_snippets(d):
    return d.table("documents").select(
        "doc_id", text.script_snippet(F.col("text")).alias("script_snippet"),
        text.code_snippet(F.col("text")).alias("code_snippet"), text.truncate_label(F.col("text"), 45).alias("label"),
    )


@query("""
    SELECT package_id, CASE WHEN days_since_push >= 9999 THEN 'unknown' ELSE concat(CAST(days_since_push AS STRING), 'd ago') END AS staleness,
           CAST(stars / 200 AS INTEGER) AS pct,
           CASE WHEN stars < 6000 THEN 'LOW RISK' WHEN stars < 12000 THEN 'MODERATE RISK' ELSE 'HIGH RISK' END AS maintainer,
           CASE WHEN stars >= 16000 THEN 'HIGH' WHEN stars >= 10000 THEN 'MEDIUM' ELSE 'LOW' END AS detection
    FROM (SELECT * REPLACE (stars // 200 * 200 AS stars) FROM {maintainer_metrics})""")
def report_labels(d):
    # Scores are exact hundredths, so that no band edge depends on rounding.
    share = (F.floor(F.col("stars") / 200)) / F.lit(100)
    return d.adapter("maintainer_metrics").select(
        "package_id", text.staleness_text(F.col("days_since_push")).alias("staleness"),
        text.percent(share + 1e-9).alias("pct"), severity.maintainer_label(share).alias("maintainer"),
        severity.detection_severity(share).alias("detection"),
    )


@query("""
    SELECT package_id, external_id,
           concat(external_id, ' (', upper(severity), ') — ', name, '@', version, ' — fix: ', coalesce(patched_versions, 'unknown')) AS issue,
           concat_ws('-', 'RISKFRAME-VER', name, replace(version, '.', '_'), replace(coalesce(patched_versions, '0'), '.', '_')) AS bom_id
    FROM {advisories} JOIN {packages} USING (package_id)""")
def issue_texts(d):
    joined = d.adapter("advisories").join(d.adapter("packages"), "package_id")
    c = F.col
    return joined.select(
        "package_id", "external_id",
        text.advisory_issue_text(c("external_id"), c("severity"), c("name"), c("version"), c("patched_versions")).alias("issue"),
        text.sbom_version_id(c("name"), c("version"), F.coalesce("patched_versions", F.lit("0"))).alias("bom_id"),
    )
