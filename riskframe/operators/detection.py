"""Detections over source text, install scripts and names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.text import code_snippet, script_snippet
from riskframe.operators.matching import with_look_alike
from riskframe.seeds import RULES, SUSPICIOUS_COMMANDS, Rule

DETECTION_FIELDS = (
    "pattern_type", "description", "file_path", "line_number", "code_snippet", "confidence", "origin",
)


def source_lines(files: DataFrame, content: str = "content") -> DataFrame:
    """One row per line of each file, numbered from 1."""
    kept = [c for c in files.columns if c != content]
    return files.select(*kept, F.posexplode(F.split(content, "\n")).alias("_pos", "line")).select(
        *kept, (F.col("_pos") + 1).alias("line_number"), "line"
    )


def _any_needle(text: Column, needles: Sequence[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(n)) for n in needles))


def _needles(rules: Sequence[Rule]) -> list[str]:
    """Needles of all rules; one that contains another is implied by the shorter one."""
    every = {n for rule in rules for n in rule.needles}
    return sorted(n for n in every if not any(m != n and m in n for m in every))


def _hit(rule: Rule, line: Column) -> Column:
    text = line
    if rule.origin == "structural":
        text = F.regexp_replace(line, r"(?d)(^|[^:])//.*$", "$1")
    # (?d): only \n ends a line, as lines were split on it. The substring test comes first,
    # so that expressions run only where they can match.
    found = _any_needle(line, rule.needles) & text.rlike("(?d)" + rule.regex)
    if rule.excludes:
        found = found & ~text.rlike("(?d)" + rule.excludes)
    return F.when(found, F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.pattern_type).alias("pattern_type"),
        F.lit(rule.description).alias("description"),
        F.lit(rule.confidence).alias("confidence"),
        F.lit(rule.origin).alias("origin"),
    ))


def detect_lines(lines: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per (file, line, rule) that matches, in one narrow pass over the lines.

    A plain substring test drops nearly every line before an expression is tried. The
    rules themselves sit in a higher-order filter: generated code stays small enough to
    be compiled, however long the rule list gets.
    """
    kept = [c for c in lines.columns if c != "line"]
    suspects = lines.filter(_any_needle(F.col("line"), _needles(rules)))
    hits = F.filter(F.array(*(_hit(rule, F.col("line")) for rule in rules)), lambda h: h.isNotNull())
    return suspects.select(*kept, "line", F.explode(hits).alias("_hit")).select(
        *kept, "_hit.*", code_snippet(F.col("line")).alias("code_snippet")
    )


def detect_files(files: DataFrame, rules: Sequence[Rule] = RULES, content: str = "content") -> DataFrame:
    """`detect_lines` over whole files."""
    return detect_lines(source_lines(files, content), rules)


def suspicious_command(script: Column, commands: Sequence[str] = SUSPICIOUS_COMMANDS) -> Column:
    """First listed fragment the script holds, or null."""
    lower = F.lower(script)
    return F.coalesce(*(F.when(F.contains(lower, F.lit(c)), F.lit(c)) for c in commands))


def install_hook_findings(packages: DataFrame) -> DataFrame:
    """At most one finding per install script."""
    kept = [c for c in packages.columns if c != "install_scripts"]
    scripts = packages.select(*kept, F.explode("install_scripts").alias("script"))
    return scripts.withColumn("_cmd", suspicious_command(F.col("script"))).filter(
        "_cmd IS NOT NULL"
    ).select(
        *kept,
        F.lit("install_hook").alias("pattern_type"),
        F.concat(F.lit("install script contains suspicious command: "), "_cmd").alias("description"),
        F.lit("package.json").alias("file_path"),
        F.lit(None).cast("int").alias("line_number"),
        script_snippet(F.col("script")).alias("code_snippet"),
        F.lit(0.85).alias("confidence"),
        F.lit("script").alias("origin"),
    )


def typosquat_findings(packages: DataFrame, exact_first: bool = False) -> DataFrame:
    """One finding per look-alike package row."""
    return with_look_alike(packages, exact_first).select(
        *packages.columns,
        F.lit("typosquatting").alias("pattern_type"),
        F.concat(
            F.lit("package '"), "name", F.lit("' is similar to popular package '"), "popular",
            F.lit("' (edit distance: "), F.col("distance").cast("string"), F.lit(")"),
        ).alias("description"),
        F.lit(None).cast("string").alias("file_path"),
        F.lit(None).cast("int").alias("line_number"),
        F.lit(None).cast("string").alias("code_snippet"),
        F.when(F.col("distance") == 1, 0.75).otherwise(0.5).alias("confidence"),
        F.lit("name").alias("origin"),
    )


def all_detections(code: DataFrame, hooks: DataFrame, names: DataFrame,
                   keys: Sequence[str] = ("package_id",)) -> DataFrame:
    """Code, script and name findings together; duplicates are kept."""
    columns = [*keys, *DETECTION_FIELDS]
    return code.select(*columns).unionByName(hooks.select(*columns)).unionByName(names.select(*columns))


def analysis_summary(packages: DataFrame, detections: DataFrame) -> DataFrame:
    """Per package: clean or not, highest confidence, whether it runs install scripts."""
    best = detections.groupBy("package_id").agg(F.max("confidence").alias("_best"))
    return packages.join(best, "package_id", "left").select(
        "package_id",
        F.col("_best").isNull().alias("is_clean"),
        F.coalesce("_best", F.lit(0.0)).alias("highest_confidence"),
        (F.size("install_scripts") > 0).alias("has_install_scripts"),
    )
