"""Changes between consecutive versions of a package."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.version import build_metadata, is_stable, semver_core
from riskframe.operators.groups import MAX_ITEMS, carry_previous, collect_parts

CORE = ("major", "minor", "patch")


def previous_stable_version(versions: DataFrame) -> DataFrame:
    """(package, version, previous_version): the greatest stable version with a lower core.

    Null when the version is no semantic version or nothing precedes it. Pre-releases of
    one core share its answer, so only distinct cores are ordered.
    """
    # `explode` keeps the parsed core one computed column instead of one copy per use.
    known = versions.select("package", "version").distinct().select(
        "package", "version", F.explode(F.array(semver_core(F.col("version")))).alias("_core")
    )
    valid = known.filter("_core IS NOT NULL").select("package", "version", "_core.*")
    stable = F.when(
        is_stable(F.col("version")),
        F.struct(F.coalesce(build_metadata(F.col("version")), F.lit("")).alias("build"), "version"),
    )
    cores = valid.groupBy("package", *CORE).agg(F.max(stable).alias("_best")).select(
        "package", *CORE, F.col("_best.version").alias("_stable")
    )
    placed = carry_previous(cores, ["package"], CORE, "_stable", "previous_version")
    answers = valid.join(placed.select("package", *CORE, "previous_version"), ["package", *CORE])
    return answers.select("package", "version", "previous_version").unionByName(
        known.filter("_core IS NULL").select(
            "package", "version", F.lit(None).cast("string").alias("previous_version")
        )
    )


def version_pairs(versions: DataFrame) -> DataFrame:
    """(package, from_version, to_version) for versions that have a stable predecessor."""
    return previous_stable_version(versions).filter("previous_version IS NOT NULL").select(
        "package", F.col("previous_version").alias("from_version"), F.col("version").alias("to_version")
    )


def placeholder_files(count: Column) -> Column:
    """`file_0` .. `file_n-1`, where a registry gives only the number of files."""
    return F.when(
        count > 0,
        F.transform(F.sequence(F.lit(0), (count - 1).cast("int")),
                    lambda i: F.concat(F.lit("file_"), i.cast("string"))),
    ).otherwise(F.array().cast("array<string>"))


def files_removed_text(old: Column, new: Column, from_version: Column, to_version: Column) -> Column:
    """Description, or null when nothing was removed. Added files do not count."""
    gone = F.sort_array(F.array_except(old, new))
    return F.when(F.size(gone) > 0, F.concat(
        F.lit("Files removed between "), from_version, F.lit(" and "), to_version, F.lit(": "),
        F.array_join(gone, ", "),
    ))


def license_changed_text(old: Column, new: Column, from_version: Column, to_version: Column) -> Column:
    """Description, or null unless both are known and differ."""
    return F.when(old != new, F.concat(
        F.lit("License changed from "), old, F.lit(" to "), new, F.lit(" between versions "),
        from_version, F.lit(" and "), to_version,
    ))


def dependencies_changed_text(old: Column, new: Column, from_version: Column, to_version: Column) -> Column:
    """Description of added and removed names, or null. Changed ranges do not count."""
    added = F.sort_array(F.array_except(new, old))
    removed = F.sort_array(F.array_except(old, new))
    parts = F.concat_ws(
        "; ",
        F.when(F.size(added) > 0, F.concat(F.lit("added: "), F.array_join(added, ", "))),
        F.when(F.size(removed) > 0, F.concat(F.lit("removed: "), F.array_join(removed, ", "))),
    )
    return F.when(parts != "", F.concat(
        F.lit("Dependencies changed between "), from_version, F.lit(" and "), to_version,
        F.lit(": "), parts,
    ))


def _names(dependencies: Column) -> Column:
    return F.coalesce(F.map_keys(dependencies), F.array().cast("array<string>"))


def version_diffs(snapshots: DataFrame, pairs: DataFrame) -> DataFrame:
    """File, license and dependency changes of each pair of snapshots.

    `snapshots`: package, version, files, license, dependencies (map). All three checks
    run on the joined row, so the pair is built once.
    """
    fields = ("files", "license", "dependencies")
    old = snapshots.select("package", F.col("version").alias("from_version"),
                           *(F.col(c).alias(f"_old_{c}") for c in fields))
    new = snapshots.select("package", F.col("version").alias("to_version"),
                           *(F.col(c).alias(f"_new_{c}") for c in fields))
    both = pairs.join(new, ["package", "to_version"]).join(old, ["package", "from_version"])
    span = (F.col("from_version"), F.col("to_version"))

    def change(kind: str, severity: str, text: Column) -> Column:
        return F.when(text.isNotNull(), F.struct(
            F.lit(kind).alias("change_type"), F.lit(severity).alias("severity"), text.alias("description")
        ))

    found = F.array(
        change("files_removed", "medium",
               files_removed_text(F.col("_old_files"), F.col("_new_files"), *span)),
        change("license_changed", "low",
               license_changed_text(F.col("_old_license"), F.col("_new_license"), *span)),
        change("dependencies_changed", "medium",
               dependencies_changed_text(_names(F.col("_old_dependencies")),
                                         _names(F.col("_new_dependencies")), *span)),
    )
    return both.select("package", *span, F.explode(found).alias("_c")).filter("_c IS NOT NULL").select(
        "package", "from_version", "to_version", "_c.*"
    )


def version_sequence(versions: DataFrame, order: Sequence[str]) -> DataFrame:
    """(package, from_version, to_version) where order is given by columns, not by the text."""
    placed = carry_previous(versions, ["package"], order, "version", "from_version")
    return placed.filter("from_version IS NOT NULL").select(
        "package", "from_version", F.col("version").alias("to_version")
    )


def member_changes(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(package, from_version, to_version, member, change) for files or dependencies held
    as rows (package, version, member). Works per member, so one huge version is spread."""
    keys = ["package", "from_version", "to_version"]

    def side(version: str, flag: str) -> DataFrame:
        joined = pairs.join(members.withColumnRenamed("version", version), ["package", version])
        return joined.select(*keys, "member", F.lit(flag).alias("_side"))

    sides = side("from_version", "from").unionByName(side("to_version", "to"))
    seen = sides.groupBy(*keys, "member").agg(
        F.max(F.col("_side") == "from").alias("_was"), F.max(F.col("_side") == "to").alias("_is")
    )
    return seen.filter("_was <> _is").select(
        *keys, "member", F.when(F.col("_was"), "removed").otherwise("added").alias("change")
    )


def member_change_text(changes: DataFrame, max_items: int = MAX_ITEMS) -> DataFrame:
    """One sorted, comma-joined list per pair and kind of change; a list of more than
    `max_items` members comes as several parts."""
    keys = ["package", "from_version", "to_version", "change"]
    parts = collect_parts(changes, keys, "member", "members", max_items)
    names = F.transform("members", lambda m: m["item"].cast("string"))
    return parts.select(*keys, "part", "parts", F.array_join(names, ", ").alias("members"))


def recent_diffs(diffs: DataFrame, package_id) -> DataFrame:
    """Changes of one package, newest first."""
    return diffs.filter(F.col("package_id") == package_id).orderBy(F.col("detected_at").desc())
