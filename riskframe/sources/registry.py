"""Registry and repository dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.functions.health import maintainer_health
from riskframe.operators.changes import placeholder_files
from riskframe.operators.evidence import repo_activity

_MAP = "MAP<STRING, STRING>"
VERSIONS = (
    f"STRUCT<versions: MAP<STRING, STRUCT<license: VARIANT, dependencies: {_MAP}, devDependencies: {_MAP}, "
    "dist: STRUCT<fileCount: INT>>>>"
)
UNPUSHED = 9999


def license_string(value: Column) -> Column:
    """License of a VARIANT: text, the `type` of an object, `unknown` for anything else."""
    kind = F.schema_of_variant(value)
    type_ = F.try_variant_get(value, "$.type", "variant")
    return (
        F.when(kind == "STRING", F.try_variant_get(value, "$", "string"))
        .when(F.is_variant_null(value) | value.isNull(), None)
        .when(kind.startswith("OBJECT") & (F.schema_of_variant(type_) == "STRING"),
              F.try_variant_get(value, "$.type", "string"))
        .otherwise("unknown")
    )


def merge_dependencies(prod: Column, dev: Column) -> Column:
    """Both maps; a name in both takes the dev range."""
    none = F.create_map().cast("map<string,string>")
    prod, dev = F.coalesce(prod, none), F.coalesce(dev, none)
    return F.map_concat(F.map_filter(prod, lambda k, _: ~F.map_contains_key(dev, k)), dev)


def registry_snapshots(raw: DataFrame) -> DataFrame:
    """(package, version, files, license, dependencies) of every published version.

    `raw`: package, json. The registry gives only a number of files.
    """
    docs = raw.select("package", F.from_json("json", VERSIONS).alias("d"))
    each = docs.select("package", F.explode("d.versions").alias("version", "m"))
    return each.select(
        "package", "version", placeholder_files(F.col("m.dist.fileCount")).alias("files"),
        license_string(F.col("m.license")).alias("license"),
        merge_dependencies(F.col("m.dependencies"), F.col("m.devDependencies")).alias("dependencies"),
    )


def repo_metrics(meta: DataFrame, releases: DataFrame, contributors: DataFrame, as_of: Column) -> DataFrame:
    """Metrics per repository as of a given time, with its health as `reputation_score`.

    `meta`: owner, repo, pushed_at, open_issues, stars, forks. `releases`: owner, repo,
    published_at. `contributors`: owner, repo, login. Missing counts are zero.
    """
    days = F.floor((F.unix_seconds(as_of) - F.unix_seconds(F.col("pushed_at").cast("timestamp"))) / 86400)
    joined = meta.join(repo_activity(releases, contributors, as_of), ["owner", "repo"], "left").na.fill(
        0, ["releases_last_year", "contributor_count"]
    ).withColumn("days_since_push", F.coalesce(days, F.lit(UNPUSHED)).cast("int"))
    health = maintainer_health(*(F.col(c) for c in (
        "days_since_push", "releases_last_year", "open_issues", "stars", "contributor_count"
    )))
    return joined.select(
        "owner", "repo", "days_since_push", F.col("releases_last_year").cast("int"), "open_issues", "stars",
        "forks", F.col("contributor_count").cast("int"), health.alias("reputation_score"),
    )
