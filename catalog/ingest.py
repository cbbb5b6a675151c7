"""Manifest, advisory and source ingest.

Every order is a project with one manifest of each kind, written from its columns, and the
SQL twin states what reading them must give.
"""

from pyspark.sql import functions as F

from catalog.base import query
from riskframe.sources import advisories, cargo, common, golang, manifests, node, python
from riskframe.session import SPREAD_ROWS, scratch_path, spread
from riskframe.sources.files import land_manifests, source_files
from riskframe.operators.detection import source_lines

O, C, K = "o_orderkey", "o_custkey", "o_custkey % 10"
NPM_LOCK = f"""concat('{{"packages":{{"":{{"name":"root"}},"node_modules/n', {C}, '":{{"version":"1.', {K}, '.0","resolved":"https://r/', {O},
    '","integrity":"sha-', {O}, '","dependencies":{{"m', {K}, '":"^2.0.0","z":"*"}},"scripts":{{"postinstall":"curl x","preinstall":"a","test":"t"}}}},',
    '"node_modules/n', {C}, '/node_modules/@s/x', {O}, '":{{"dev":true}}}}}}')"""
NPM_MANIFEST = f"""concat('{{"name":"p","dependencies":{{"n', {C}, '":"^1.0.0","e":"~', {K}, '.1"}},"devDependencies":{{"e":"^9.0.0","d":"2"}}}}')"""
BUN_LOCK = f"""concat('{{\\n  "n', {C}, '@1.', {K}, '.0":\\n"@s/x@2.0.0":\\n"nodeps":\\n"n', {C}, '@2.', {K}, '.0":\\n}}')"""
REQUIREMENTS = f"""concat('# pinned\\n\\nFlask-', {C}, '[async]==1.', {K}, '.0 # pin\\n-r other.txt\\n--index-url https://x\\nrequests>=2.', {K},
    ', <3\\nplain\\n', CASE WHEN {O} % 2 = 0 THEN concat('flask.', {C}, ' ~= 9.', {K}) ELSE '' END, '\\r\\n')"""
PYPROJECT = f"""concat('[tool.poetry]\\nname = "x"\\n\\n[tool.poetry.dependencies]\\npython = "^3.9"\\nReq.uests = "^2"\\n[tool.poetry.group.dev.dependencies]\\npytest',
    {K}, ' = {{ version = "^7" }}\\n[project]\\nname = "x"\\ndependencies = [\\n  "httpx[http2]>=0.2",\\n  ''numpy'', # fast\\n]\\n')"""
POETRY_LOCK = f"""concat('[[package]]\\nname = "req-uests"\\nversion = "2.', {K}, '.0"\\n\\n[package.dependencies]\\nname = "trap"\\n\\n[[package]]\\nname = "pytest',
    {K}, '"\\n\\n[[package]]\\nname = "deep', {O}, '"\\nversion = "3"\\n[metadata]\\nlock-version = "2"\\n')"""
PIPFILE_LOCK = f"""concat('{{"_meta":{{"hash":{{}}}},"default":{{"a-b":{{"version":"==1.', {K}, '"}},"only', {O}, '":{{"version":"*"}}}},"develop":{{"a.b":{{"version":"==2"}},"c":{{}}}}}}')"""
GO_MOD = f"""concat('module example.com/p', {O}, '\\n\\ngo 1.21\\nrequire example.com/single v1.', {K}, '.0\\n\\nrequire (\\n\\texample.com/a v1.2.3\\n\\texample.com/b',
    {K}, ' v0.1.0 // indirect\\n)\\n\\nreplace (\\n\\tx v1 => y v2\\n)\\n')"""
GO_SUM = f"""concat('example.com/a v1.2.3 h1:x=\\nexample.com/a v1.2.3/go.mod h1:y=\\nexample.com/b', {K}, ' v0.1.0 h1:z=\\nexample.com/a v9.9.9 h1:later=\\nshort line\\n')"""
CARGO_TOML = f"""concat('[package]\\nname = "root', {O}, '"\\nversion = "0.1.0"\\n\\n[dependencies]\\nserde = {{ version = "^1.0", features = ["derive"] }}\\nlog = "~0.', {K},
    '"\\nlocal = {{ path = "../x" }}\\n\\n[dev-dependencies]\\nproptest = ">=1.2, <2"\\n\\n[build-dependencies]\\ncc = "=1.0"\\nlog = "9"\\n\\n[dependencies.tokio]\\nversion = "1.', {K}, '"\\n')"""
CARGO_LOCK = f"""concat('version = 3\\n\\n[[package]]\\nname = "root', {O}, '"\\nversion = "0.1.0"\\ndependencies = [\\n "serde",\\n]\\n\\n[[package]]\\nname = "serde"\\nversion = "1.0.', {K},
    '"\\nchecksum = "c', {O}, '"\\n\\n[[package]]\\nname = "proptest"\\n\\n[[package]]\\nname = "deep"\\nversion = "2"\\n\\n[[package]]\\nname = "deep"\\nversion = "3"\\n')"""
CONTENTS = {
    "package-lock.json": NPM_LOCK, "package.json": NPM_MANIFEST, "bun.lock": BUN_LOCK, "requirements.txt": REQUIREMENTS,
    "pyproject.toml": PYPROJECT, "poetry.lock": POETRY_LOCK, "Pipfile.lock": PIPFILE_LOCK, "go.mod": GO_MOD, "go.sum": GO_SUM,
    "Cargo.toml": CARGO_TOML, "Cargo.lock": CARGO_LOCK,
}


def corpus(d, *names):
    """(project_id, path, file_name, content) of the named manifests of every order."""
    entries = ", ".join(f"struct('{n}' AS file_name, {CONTENTS[n]} AS content)" for n in names or CONTENTS)
    files = spread(d.table("orders"), SPREAD_ROWS).selectExpr(O, f"explode(array({entries})) AS f")
    return files.selectExpr(f"{O} AS project_id", f"concat('/', {O}, '/', f.file_name) AS path", "f.*")


def listed(rows):
    """(project_id, name, version, is_direct, is_dev, depth): what most twins state."""
    return rows.select("project_id", "name", "version", "is_direct", "is_dev", F.col("depth").cast("int").alias("depth"))


def expected(*rows) -> str:
    """Twin of `listed`: one SELECT per package of an order; names and versions are SQL."""
    return " UNION ALL ".join(
        f"SELECT {O} AS project_id, {name} AS name, {version} AS version, {direct} AS is_direct, {dev} AS is_dev, "
        f"CAST({depth} AS INTEGER) AS depth FROM {{orders}}" + (f" WHERE {where[0]}" if where else "")
        for name, version, direct, dev, depth, *where in rows
    )


S = f"CAST({O} AS STRING)"
CS, KS = f"CAST({C} AS STRING)", f"CAST({K} AS STRING)"


@query(f"""
    SELECT {O} AS project_id, concat('node_modules/n', {CS}) AS pkg_key, concat('n', {CS}) AS name, concat('1.', {KS}, '.0') AS version,
           concat('https://r/', {S}) AS registry_url, concat('sha-', {S}) AS checksum, TRUE AS is_direct, FALSE AS is_dev, 1 AS depth,
           concat('m', {KS}, ',z') AS dependencies, 'a;curl x' AS scripts FROM {{orders}}
    UNION ALL
    SELECT {O}, concat('node_modules/n', {CS}, '/node_modules/@s/x', {S}), concat('@s/x', {S}), '', NULL, NULL, FALSE, TRUE, 2, '', '' FROM {{orders}}""")
def npm_lock(d):
    rows = node.npm_lock_packages(corpus(d, "package-lock.json", "package.json"))
    return rows.select(
        "project_id", "pkg_key", "name", "version", "registry_url", "checksum", "is_direct", "is_dev", "depth",
        F.array_join(F.sort_array("dependencies"), ",").alias("dependencies"), F.array_join("install_scripts", ";").alias("scripts"),
    )


@query(f"""
    SELECT {O} AS project_id, concat('node_modules/n', {CS}) AS parent, concat('m', {KS}) AS child, '^2.0.0' AS version_constraint,
           FALSE AS is_dev, FALSE AS is_optional FROM {{orders}}
    UNION ALL SELECT {O}, concat('node_modules/n', {CS}), 'z', '*', FALSE, FALSE FROM {{orders}}""")
def npm_edges(d):
    return node.npm_lock_edges(corpus(d, "package-lock.json"))


@query(expected((f"concat('n', {CS})", "'1.0.0'", "TRUE", "FALSE", 1), ("'e'", f"concat({KS}, '.1')", "TRUE", "FALSE", 1)))
def npm_manifest(d):
    return listed(node.npm_manifest_packages(corpus(d, "package.json")))


@query(expected((f"concat('n', {CS})", f"concat('2.', {KS}, '.0')", "TRUE", "FALSE", 1), ("'@s/x'", "'2.0.0'", "FALSE", "FALSE", 1)))
def bun_lock(d):
    return listed(node.bun_lock_packages(corpus(d, "bun.lock", "package.json")))


@query(expected((f"concat('n', {CS})", "'1.0.0'", "TRUE", "FALSE", 1), ("'e'", "'9.0.0'", "TRUE", "TRUE", 1), ("'d'", "'2'", "TRUE", "TRUE", 1)))
def bun_manifest(d):
    return listed(node.bun_manifest_packages(corpus(d, "package.json")))


REQUIREMENT_ROWS = (
    (f"concat('Flask-', {CS})", f"concat('1.', {KS}, '.0')", "TRUE", "FALSE", 0, f"{O} % 2 = 1"),
    (f"concat('flask.', {CS})", f"concat('9.', {KS})", "TRUE", "FALSE", 0, f"{O} % 2 = 0"),
    ("'requests'", f"concat('2.', {KS})", "TRUE", "FALSE", 0), ("'plain'", "'0.0.0'", "TRUE", "FALSE", 0),
)


@query(expected(*REQUIREMENT_ROWS))
def requirements(d):
    return listed(python.requirements_packages(corpus(d, "requirements.txt")))


# Whole documents read as requirement files: every line is a name, whatever it says.
@query(r"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM {documents}),
    cut AS (SELECT doc_id, n, trim(split_part(trim(raw, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '#', 1),
                                   concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS spec FROM lines
            WHERE NOT starts_with(trim(raw, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), '-')),
    named AS (SELECT doc_id, n, trim(split_part(regexp_extract(spec, '(?s)^[^=><!~^]*'), '[', 1),
                                     concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS name FROM cut WHERE spec <> ''),
    keyed AS (SELECT *, replace(replace(lower(name), '-', '_'), '.', '_') AS pkg_key FROM named WHERE name <> '')
    SELECT doc_id AS project_id, pkg_key, arg_max(name, n) AS name FROM keyed GROUP BY doc_id, pkg_key""")
def document_requirements(d):
    files = spread(d.table("documents")).selectExpr("doc_id AS project_id", "'requirements.txt' AS file_name", "text AS content")
    return python.requirements_packages(files).select("project_id", "pkg_key", "name")


@query(f"""
    SELECT {O} AS project_id, 'req_uests' AS name, FALSE AS is_dev FROM {{orders}} UNION ALL SELECT {O}, concat('pytest', {KS}), TRUE FROM {{orders}}
    UNION ALL SELECT {O}, 'httpx', FALSE FROM {{orders}} UNION ALL SELECT {O}, 'numpy', FALSE FROM {{orders}}""")
def pyproject_names(d):
    return python.pyproject_direct(corpus(d, "pyproject.toml")).select("project_id", "name", "is_dev")


@query(expected(("'req-uests'", f"concat('2.', {KS}, '.0')", "TRUE", "FALSE", 0), (f"concat('pytest', {KS})", "'0.0.0'", "TRUE", "TRUE", 0),
                (f"concat('deep', {S})", "'3'", "FALSE", "FALSE", 1)))
def poetry_lock(d):
    return listed(python.poetry_lock_packages(corpus(d, "poetry.lock", "pyproject.toml")))


@query(expected(("'a.b'", "'2'", "TRUE", "TRUE", 0), (f"concat('only', {S})", "'0.0.0'", "TRUE", "FALSE", 0), ("'c'", "'0.0.0'", "TRUE", "TRUE", 0)))
def pipfile_lock(d):
    return listed(python.pipfile_lock_packages(corpus(d, "Pipfile.lock")))


@query(expected(("'example.com/single'", f"concat('1.', {KS}, '.0')", "TRUE", "FALSE", 0), ("'example.com/a'", "'1.2.3'", "TRUE", "FALSE", 0),
                (f"concat('example.com/b', {KS})", "'0.1.0'", "FALSE", "FALSE", 1)))
def go_mod(d):
    return listed(golang.go_mod_packages(corpus(d, "go.mod")))


@query(expected(("'example.com/a'", "'1.2.3'", "TRUE", "FALSE", 0), (f"concat('example.com/b', {KS})", "'0.1.0'", "FALSE", "FALSE", 1)))
def go_sum(d):
    return listed(golang.go_sum_packages(corpus(d, "go.sum", "go.mod")))


@query(f"""
    SELECT {O} AS project_id, concat('example.com/p', {S}) AS module, 'example.com/a' AS name FROM {{orders}}
    UNION ALL SELECT {O}, concat('example.com/p', {S}), 'example.com/single' FROM {{orders}}""")
def go_direct_modules(d):
    files = corpus(d, "go.mod")
    return golang.go_module(files).join(golang.go_direct(files), "project_id")


@query(expected(("'serde'", "'1.0'", "TRUE", "FALSE", 0), ("'log'", "'9'", "TRUE", "FALSE", 0), ("'local'", "'0.0.0'", "TRUE", "FALSE", 0),
                ("'proptest'", "'1.2'", "TRUE", "TRUE", 0), ("'cc'", "'1.0'", "TRUE", "FALSE", 0),
                ("'tokio'", f"concat('1.', {KS})", "TRUE", "FALSE", 0)))
def cargo_manifest(d):
    return listed(cargo.cargo_toml_packages(corpus(d, "Cargo.toml")))


@query(expected(("'serde'", f"concat('1.0.', {KS})", "TRUE", "FALSE", 0), ("'proptest'", "'0.0.0'", "TRUE", "TRUE", 0),
                ("'deep'", "'2'", "FALSE", "FALSE", 1), ("'deep'", "'3'", "FALSE", "FALSE", 1)))
def cargo_lock(d):
    return listed(cargo.cargo_lock_packages(corpus(d, "Cargo.lock", "Cargo.toml")))


@query(f"""
    SELECT {O} AS project_id, section, CAST(entries AS BIGINT) AS entries FROM {{orders}}, (VALUES ('package', 2), ('dependencies', 3),
        ('dev-dependencies', 1), ('build-dependencies', 2), ('dependencies.tokio', 1)) AS v(section, entries)""")
def manifest_sections(d):
    lines = common.section_lines(corpus(d, "Cargo.toml"))
    return lines.groupBy("project_id", "section").agg(F.count("*").alias("entries"))


NAMES = """
    SELECT o_custkey AS project_id, CASE o_orderkey % 16 WHEN 0 THEN 'package.json' WHEN 1 THEN 'package-lock.json' WHEN 2 THEN 'yarn.lock'
           WHEN 3 THEN 'pnpm-lock.yaml' WHEN 4 THEN 'bun.lockb' WHEN 5 THEN 'bun.lock' WHEN 6 THEN 'bunfig.toml' WHEN 7 THEN 'requirements.txt'
           WHEN 8 THEN 'pyproject.toml' WHEN 9 THEN 'poetry.lock' WHEN 10 THEN 'Pipfile.lock' WHEN 11 THEN 'go.mod' WHEN 12 THEN 'go.sum'
           WHEN 13 THEN 'Cargo.toml' WHEN 14 THEN 'Cargo.lock' ELSE 'README.md' END AS file_name FROM {orders}"""
_HAS = "bool_or(file_name IN ({names}))"
FOUND = f"""
    SELECT project_id, {_HAS.format(names="'package.json'")} AS n, {_HAS.format(names="'bun.lockb', 'bun.lock', 'bunfig.toml'")} AS b,
           {_HAS.format(names="'requirements.txt', 'pyproject.toml', 'poetry.lock', 'Pipfile.lock'")} AS p, {_HAS.format(names="'go.mod'")} AS g,
           {_HAS.format(names="'Cargo.toml'")} AS r, list(file_name) AS files FROM ({NAMES}) AS x GROUP BY project_id"""


@query(f"""
    SELECT project_id, concat_ws(',', CASE WHEN n THEN 'nodejs' END, CASE WHEN b THEN 'bun' END, CASE WHEN p THEN 'python' END,
                                 CASE WHEN g THEN 'golang' END, CASE WHEN r THEN 'rust' END) AS ecosystems FROM ({FOUND}) AS f""")
def project_ecosystems(d):
    return manifests.detect_ecosystems(d.sql(NAMES)).select("project_id", F.array_join("ecosystems", ",").alias("ecosystems"))


def _best(*names: str) -> str:
    return "CASE " + " ".join(f"WHEN list_contains(files, '{n}') THEN '{n}'" for n in names) + " END"


@query(f"""
    WITH f AS ({FOUND}), c AS (
        SELECT project_id, 'nodejs' AS resolver, {_best('package-lock.json', 'yarn.lock', 'pnpm-lock.yaml', 'package.json')} AS file_name FROM f WHERE n
        UNION ALL SELECT project_id, 'bun', {_best('bun.lock', 'package.json')} FROM f WHERE b
        UNION ALL SELECT project_id, 'python', {_best('poetry.lock', 'Pipfile.lock', 'requirements.txt', 'pyproject.toml')} FROM f WHERE p
        UNION ALL SELECT project_id, 'golang', {_best('go.sum', 'go.mod')} FROM f WHERE g
        UNION ALL SELECT project_id, 'rust', {_best('Cargo.lock', 'Cargo.toml')} FROM f WHERE r)
    SELECT project_id, resolver, file_name FROM c WHERE file_name IS NOT NULL""")
def chosen_locks(d):
    return manifests.choose_lock(d.sql(NAMES))


# Open orders have every manifest, the others no lock files.
@query(f"""
    SELECT {O} AS project_id, ecosystem, CASE WHEN o_orderstatus = 'O' THEN locked ELSE plain END AS packages FROM {{orders}},
    (VALUES ('nodejs', 2, 2), ('bun', 2, NULL), ('PyPI', 3, 3), ('Go', 2, 3), ('crates.io', 4, 6)) AS v(ecosystem, locked, plain)
    WHERE o_orderstatus = 'O' OR plain IS NOT NULL""")
def resolved_packages(d):
    open_orders = d.table("orders").filter("o_orderstatus = 'O'").selectExpr(f"{O} AS project_id")
    files = corpus(d)
    is_lock = F.col("file_name").isin("package-lock.json", "bun.lock", "poetry.lock", "Pipfile.lock", "go.sum", "Cargo.lock")
    kept = files.filter(~is_lock).unionByName(files.filter(is_lock).join(open_orders, "project_id", "left_semi"))
    # A corpus lives in a table partitioned by file name: each reader opens its own kind only.
    path = scratch_path(d.spark, "manifests")
    land_manifests(kept, path)
    return manifests.resolve_packages(d.spark.read.parquet(path)).groupBy("project_id", "ecosystem").agg(F.count("*").alias("packages"))


def osv_documents(d):
    return spread(d.table("lineitem"), SPREAD_ROWS).selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey",
        """to_json(struct(concat('OSV-', l_orderkey) AS id, CASE WHEN l_suppkey % 2 = 0 THEN concat('Summary ', l_partkey) END AS summary,
           CASE WHEN l_suppkey % 3 = 0 THEN 'text' END AS details,
           CASE WHEN l_suppkey % 7 = 0 THEN 'soon' ELSE concat(date_format(l_shipdate, 'yyyy-MM-dd'), 'T00:00:00Z') END AS published,
           CASE WHEN l_suppkey % 5 = 0 THEN array() WHEN l_suppkey % 5 = 1 THEN array(struct('CVSS:3.1/AV:N' AS score))
                ELSE array(struct(cast(l_linenumber + 3 AS string) AS score), struct('1.0' AS score)) END AS severity,
           array(struct(struct(concat('p', l_partkey) AS name, 'npm' AS ecosystem) AS package, CASE WHEN l_linenumber = 1 THEN array('9.9.9') END AS versions,
                 array(struct(array(named_struct('introduced', '0', 'fixed', CAST(NULL AS STRING)), named_struct('introduced', CAST(NULL AS STRING), 'fixed', '1.2.0'),
                                    named_struct('introduced', concat('2.', l_linenumber, '.0'), 'fixed', CAST(NULL AS STRING))) AS events)) AS ranges)) AS affected,
           array(struct(concat('https://x/', l_orderkey) AS url)) AS references)) AS json""",
    )


@query("""
    SELECT l_orderkey, l_linenumber, l_partkey, concat('OSV-', CAST(l_orderkey AS STRING)) AS external_id,
           CASE WHEN l_suppkey % 2 = 0 THEN concat('Summary ', CAST(l_partkey AS STRING)) ELSE concat('OSV-', CAST(l_orderkey AS STRING)) END AS title,
           CASE WHEN l_suppkey % 3 = 0 THEN 'text' ELSE '' END AS description,
           CASE WHEN l_suppkey % 5 = 0 THEN 'medium' WHEN l_suppkey % 5 = 1 THEN 'low' WHEN l_linenumber >= 6 THEN 'critical'
                WHEN l_linenumber >= 4 THEN 'high' ELSE 'medium' END AS severity,
           CASE WHEN l_suppkey % 5 > 1 THEN CAST(l_linenumber + 3 AS DOUBLE) END AS cvss_score,
           concat('0, 2.', CAST(l_linenumber AS STRING), '.0') AS affected_versions,
           CASE WHEN l_suppkey % 7 <> 0 THEN strftime(l_shipdate, '%Y-%m-%d') END AS published, concat('https://x/', CAST(l_orderkey AS STRING)) AS refs
    FROM {lineitem}""")
def osv_records(d):
    return advisories.osv_advisories(osv_documents(d)).select(
        "l_orderkey", "l_linenumber", "l_partkey", "external_id", "title", "description", "severity", "cvss_score", "affected_versions",
        F.date_format("published_at", "yyyy-MM-dd").alias("published"), F.array_join("references", ",").alias("refs"),
    )


@query("""
    SELECT concat('OSV-', CAST(l_orderkey AS STRING)) AS external_id, concat('p', CAST(l_partkey AS STRING)) AS name, '0' AS introduced, '1.2.0' AS fixed, '' AS versions FROM {lineitem}
    UNION ALL SELECT concat('OSV-', CAST(l_orderkey AS STRING)), concat('p', CAST(l_partkey AS STRING)), concat('2.', CAST(l_linenumber AS STRING), '.0'), NULL, '' FROM {lineitem}
    UNION ALL SELECT concat('OSV-', CAST(l_orderkey AS STRING)), concat('p', CAST(l_partkey AS STRING)), NULL, NULL, '9.9.9' FROM {lineitem} WHERE l_linenumber = 1""")
def osv_intervals(d):
    return advisories.osv_ranges(osv_documents(d).select("json")).select(
        "external_id", "name", "introduced", "fixed", F.coalesce(F.array_join("versions", ","), F.lit("")).alias("versions")
    )


@query("""
    SELECT l_orderkey, l_partkey, l_linenumber, concat('GHSA-', CAST(l_orderkey AS STRING)) AS external_id,
           CASE l_suppkey % 4 WHEN 0 THEN 'critical' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'medium' END AS severity,
           CASE WHEN l_linenumber = 1 THEN '' ELSE concat('< ', CAST(l_linenumber AS STRING)) END AS affected_versions,
           CASE WHEN l_linenumber > 2 THEN CAST(l_linenumber AS STRING) END AS patched_versions,
           CASE WHEN l_linenumber = 2 THEN concat('GHSA-', CAST(l_orderkey AS STRING)) ELSE 'S' END AS title
    FROM {lineitem}""")
def github_records(d):
    raw = spread(d.table("lineitem"), SPREAD_ROWS).selectExpr(
        "l_orderkey", "l_partkey", "l_linenumber",
        """to_json(struct(struct(concat('GHSA-', l_orderkey) AS ghsaId, CASE WHEN l_linenumber <> 2 THEN 'S' END AS summary,
           CASE l_suppkey % 4 WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'MODERATE' WHEN 2 THEN 'LOW' END AS severity) AS advisory,
           CASE WHEN l_linenumber > 1 THEN concat('< ', l_linenumber) END AS vulnerableVersionRange,
           CASE WHEN l_linenumber > 2 THEN cast(l_linenumber AS string) END AS patchedVersions)) AS json""",
    )
    return advisories.github_advisories(raw).select(
        "l_orderkey", "l_partkey", "l_linenumber", "external_id", "severity", "affected_versions", "patched_versions", "title"
    )


@query("""
    SELECT doc_id, concat('CVE-', CAST(doc_id AS STRING)) AS external_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE text END AS description,
           CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 11 AS DOUBLE) WHEN doc_id % 3 = 1 THEN CAST(3.5 AS DOUBLE) END AS cvss_score,
           CASE WHEN doc_id % 3 = 1 THEN 'low' WHEN doc_id % 3 = 2 THEN 'medium' WHEN doc_id % 11 >= 9 THEN 'critical' WHEN doc_id % 11 >= 7 THEN 'high'
                WHEN doc_id % 11 >= 4 THEN 'medium' WHEN doc_id % 11 > 0 THEN 'low' ELSE 'medium' END AS severity
    FROM {documents}""")
def nvd_records(d):
    score = "array(struct(struct(cast({0} AS double) AS baseScore) AS cvssData))"
    raw = spread(d.table("documents")).selectExpr(
        "doc_id",
        f"""to_json(struct(struct(concat('CVE-', doc_id) AS id, '2024-01-01T00:00:00.000' AS published,
            CASE WHEN doc_id % 4 = 3 THEN array(struct('es' AS lang, text AS value))
                 ELSE array(struct('es' AS lang, 'x' AS value), struct('en' AS lang, text AS value), struct('en' AS lang, 'y' AS value)) END AS descriptions,
            struct(CASE WHEN doc_id % 3 = 0 THEN {score.format('doc_id % 11')} END AS cvssMetricV31,
                   CASE WHEN doc_id % 3 = 1 THEN {score.format('3.5')} END AS cvssMetricV2) AS metrics) AS cve)) AS json""",
    )
    return advisories.nvd_advisories(raw).select("doc_id", "external_id", "description", "cvss_score", "severity")


@query(f"""
    SELECT concat('@', source, '/lib') AS package, concat('1.', CAST(doc_id AS STRING)) AS version, 'src/index.js' AS file_path,
           CAST(len(string_split(text, chr(10))) AS BIGINT) AS line_count FROM {{documents}}""")
def source_trees(d):
    files = spread(d.table("documents")).selectExpr(
        "concat('file:/cache/@', source, '+lib@1.', doc_id, '/package/src/index.js') AS path", "text AS content"
    )
    lines = source_lines(source_files(files))
    return lines.groupBy("package", "version", "file_path").agg(F.count("*").alias("line_count"))
