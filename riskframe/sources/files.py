"""Reading file corpora, the blocklist and saved reports."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskframe.operators.detection import source_lines
from riskframe.seeds import blocklist_document

ENTRY = (
    "STRUCT<package_name: STRING, ecosystem: STRING, affected_versions: ARRAY<STRING>, severity: STRING, "
    "reason: STRING, source: STRING, reported_at: STRING, references: ARRAY<STRING>>"
)


SCHEME, LANDING = r"^[a-z0-9]+:/+", r"/v=([0-9]+)$"


def _decoded(path: Column) -> Column:
    """A `_metadata.file_path` as plain text; a plus sign is no blank there."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def describe_files(files: DataFrame, root: str) -> DataFrame:
    """(project_id, path, file_name, landing) and the `content` of whole-text files below `root`.

    A project is a folder, named by its path below `root` (`.` is the root itself). A landing folder
    (`<project>/v=<n>/<file>`) is skipped in the name and gives the landing's number, else 0.
    """
    path = F.regexp_replace(_decoded(F.col("_metadata.file_path")), SCHEME, "/")
    content = [F.col("value").alias("content")] if "value" in files.columns else []
    top = re.sub(SCHEME, "/", root).rstrip("/")
    parts = files.select(path.alias("path"), *content).withColumns({
        "file_name": F.substring_index("path", "/", -1), "_in": F.regexp_replace("path", "/[^/]*$", "")})
    folder = F.regexp_replace("_in", LANDING, "")
    below = F.when(folder == top, ".").when(folder.startswith(top + "/"), F.substr(folder, F.lit(len(top) + 2))).otherwise(folder)
    landing = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract("_in", LANDING, 1), F.lit("")), F.lit("9" * 18)), F.lit(0))
    return parts.select(below.alias("project_id"), "path", "file_name", landing.cast("bigint").alias("landing"),
                        *(["content"] if content else []))


def superseded(listing: DataFrame) -> DataFrame:
    """Paths of files of which their project has a later landing. Only names are shuffled."""
    same = Window.partitionBy("project_id", "file_name")
    last = F.max(F.struct("landing", "path")).over(same)
    return listing.withColumn("_last", last["path"]).filter("path <> _last").select("path")


def read_manifests(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Every manifest under `path`, one row per file; `latest_landings` leaves the current ones."""
    options = {"recursiveFileLookup": True} | ({"pathGlobFilter": glob} if glob else {})
    return describe_files(spark.read.options(**options).text(path, wholetext=True), path)


def latest_landings(files: DataFrame) -> DataFrame:
    """Of several landings of a project's file the latest; files without landings are left as they are."""
    if "landing" not in files.columns:
        return files
    return files.join(superseded(files.drop("content")), "path", "left_anti").select(*files.columns)


def project_files(spark: SparkSession, root: str, projects: list[str]) -> DataFrame:
    """The current files of a few projects; only their folders are read."""
    top = root.rstrip("/")
    folders = [f"{top}/{p}" if p != "." and not p.startswith("/") else top if p == "." else p for p in projects]
    text = spark.read.option("recursiveFileLookup", True).text(folders, wholetext=True)
    files = describe_files(text, root).filter(F.col("project_id").isin(*projects))
    return latest_landings(files)


def land_manifests(files: DataFrame, path: str, mode: str = "append") -> None:
    """Store a corpus as a table partitioned by file name, so that a reader of one kind of
    manifest opens only those files. Tasks write in place; nothing is shuffled."""
    files.write.mode(mode).partitionBy("file_name").parquet(path)


def source_files(files: DataFrame, path: str = "path") -> DataFrame:
    """(package, version, file_path, content) from `<root>/<name>@<version>/<archive>/<file>`.

    `+` in the directory stands for `/` in the name; the archive's own top folder is dropped.
    """
    pattern = r"^(?:.*/)?([^/]+)@([^/@]+)/[^/]+/(.+)$"
    part = lambda i: F.regexp_extract(path, pattern, i)
    return files.select(
        F.replace(part(1), F.lit("+"), F.lit("/")).alias("package"), part(2).alias("version"),
        part(3).alias("file_path"), "content",
    ).filter("file_path <> ''")


def read_source_lines(spark: SparkSession, path: str) -> DataFrame:
    """(package, version, file_path, line_number, line) of extracted source trees."""
    text = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    files = text.select(_decoded(F.col("_metadata.file_path")).alias("path"),
                        F.col("value").alias("content"))
    return source_lines(source_files(files))


def bundled_blocklist(spark: SparkSession) -> DataFrame:
    """The twenty bundled entries with the list's version."""
    document = blocklist_document()
    fields = ("package_name", "ecosystem", "affected_versions", "severity", "reason", "source",
              "reported_at", "references")
    strings = pa.list_(pa.string())
    types = {"affected_versions": strings, "references": strings}
    columns = {
        f: pa.array([e[f] for e in document["entries"]], types.get(f, pa.string())) for f in fields
    }
    columns["list_version"] = pa.array([document["version"]] * len(document["entries"]))
    return spark.createDataFrame(pa.table(columns))


def read_blocklist(spark: SparkSession, path: str) -> DataFrame:
    """A list in the bundled format from shared storage."""
    raw = spark.read.schema(f"version STRING, entries ARRAY<{ENTRY}>").json(path, multiLine=True)
    return raw.select(F.explode("entries").alias("e"), F.col("version").alias("list_version")).select(
        "e.*", "list_version"
    )
