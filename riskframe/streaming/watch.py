"""Continuous work: rescans on new lock files, findings and running counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from riskframe.operators.detection import detect_files
from riskframe.operators.evidence import severity_counts
from riskframe.operators.published import Published, Table
from riskframe.operators.tables import expire
from riskframe.seeds import LOCK_FILES
from riskframe.session import scratch_path
from riskframe.sources.files import describe_files, land_manifests, project_files
from riskframe.sources.manifests import resolve_packages

# The text form of Bun's lock is watched beside the listed files.
WATCHED = (*LOCK_FILES, "bun.lock")
# Lock files per batch; it bounds the projects that one rescan reads.
MAX_FILES = 1_000


def watch_manifests(spark: SparkSession, path: str, glob: str | None = None, max_files: int = MAX_FILES) -> DataFrame:
    """Stream of newly landed lock files. The file source sees new files, not edits in
    place, so every version of a lock lands in a new folder `<project>/<landing>/<file>`."""
    reader = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return describe_files(reader.text(path, wholetext=True), path).filter(F.col("file_name").isin(*WATCHED))


def changed_packages(root: str, assess: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """A scan for `rescan`: the packages of the projects whose locks changed, from all their current files.

    A lock alone says neither the ecosystem nor what is direct, so an event only names its project.
    `assess` turns packages into the rows to store, such as scores.
    """
    def scan(batch: DataFrame) -> DataFrame:
        # At most one project per file of the batch, which `max_files` bounds.
        projects = [r.project_id for r in batch.select("project_id").distinct().collect()]
        packages = resolve_packages(project_files(batch.sparkSession, root, projects)) if projects else resolve_packages(batch)
        return assess(packages) if assess else packages

    return scan


def landed_packages(path: str) -> Callable[[DataFrame], DataFrame]:
    """The packages of the projects that a batch names, from all their files in the table at `path`
    (as `land_manifests` stores them). Projects and files meet in a join, so a batch may name any number; it is made once, and
    its files are landed as scratch, since each reader would else shuffle contents and projects anew."""
    def packages(batch: DataFrame) -> DataFrame:
        files = batch.sparkSession.read.parquet(path)
        projects = batch.select(batch["project_id"].cast(files.schema["project_id"].dataType).alias("project_id")).distinct()
        own = scratch_path(batch.sparkSession, "batch-files")
        land_manifests(files.join(projects, "project_id", "left_semi"), own)
        return resolve_packages(batch.sparkSession.read.schema(files.schema).parquet(own))

    return packages


def landed_locks(spark: SparkSession, path: str, max_files: int = MAX_FILES) -> DataFrame:
    """Stream of the lock files (project_id, file_name) that land in such a table; contents are not read."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)
    return stream.select("project_id", "file_name").filter(F.col("file_name").isin(*WATCHED))


def publish_rescans(events: DataFrame, scan: Callable[[DataFrame], dict[str, Table]], store: Published,
                    checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Scan the projects that the events of a batch name, and publish all its tables at once under the batch id.

    A batch that is repeated after a failure, or was already published, is seen once.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        store.commit(batch_id, scan(batch))

    writer = events.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def rescan(scan: Callable[[DataFrame], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch body: scan the changed projects, store the rows under the batch id.

    A repeated batch overwrites its own folder, so a retry leaves one copy.
    """
    def body(batch: DataFrame, batch_id: int) -> None:
        scan(batch).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return body


def run_rescans(events: DataFrame, scan: Callable[[DataFrame], DataFrame], path: str,
                checkpoint: str, available_now: bool = True) -> StreamingQuery:
    writer = events.writeStream.foreachBatch(rescan(scan, path)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def continuous_findings(files: DataFrame, content: str = "content") -> DataFrame:
    """Detections over a stream of source files; stateless, so it equals the batch result."""
    return detect_files(files, content=content)


def append_findings(findings: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Store findings exactly once until the input is used up."""
    return (
        findings.writeStream.format("parquet").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def running_severity_counts(risks: DataFrame, keys=("project_id",)) -> DataFrame:
    """Streaming counts per key; state holds one row per key."""
    return severity_counts(risks, keys)


CHANGE = "project_id {0}, package_id {1}, severity STRING, change INT"


def severity_changes(risks: DataFrame) -> DataFrame:
    """Signed changes of the severity counts over a stream: +1 for a package's new severity, -1 for the one it had.

    `risks`: project_id, package_id, severity, scanned_at, event_id. State is one row per (project, package): its last
    severity and when it was scanned. An older scan that arrives late changes nothing; of equal times the larger event_id
    counts, so the result does not depend on how rows fall into batches.
    """
    kinds = [risks.schema[c].dataType.simpleString() for c in ("project_id", "package_id")]
    narrow = risks.select("project_id", "package_id", "severity", F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("at"),
                          F.col("event_id").cast("bigint").alias("event_id"))

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        before = state.get if state.exists else None
        latest = before
        for rows in batches:
            if len(rows):
                row = rows.sort_values(["at", "event_id"]).iloc[-1]
                found = (int(row["at"]), int(row["event_id"]), row["severity"])
                latest = found if latest is None or found[:2] > tuple(latest[:2]) else latest
        if latest is not None and latest is not before:
            state.update(tuple(latest))
            old, new = before and before[2], latest[2]
            if old != new:
                changes = [(*key, s, n) for s, n in ((old, -1), (new, 1)) if s is not None]
                yield pd.DataFrame(changes, columns=["project_id", "package_id", "severity", "change"])

    return narrow.filter("at IS NOT NULL AND severity IS NOT NULL").groupBy("project_id", "package_id").applyInPandasWithState(
        follow, CHANGE.format(*kinds), "at BIGINT, event_id BIGINT, severity STRING", "append", GroupStateTimeout.NoTimeout)


def latest_severities(risks: DataFrame, keys: Sequence[str] = ("project_id", "package_id")) -> DataFrame:
    """The last severity of every (project, package) over a stream, for `store_counts`: a batch tells the packages it met.

    Scans without time or severity count nothing, an older scan that arrives late changes nothing, and of equal times the larger
    event_id counts. State is one row per package, kept by Spark's own aggregate, so no Python runs per package.
    """
    at, event = F.col("scanned_at").cast("timestamp").alias("at"), F.col("event_id").cast("bigint").alias("event_id")
    told = risks.filter("scanned_at IS NOT NULL AND severity IS NOT NULL")
    return told.groupBy(*keys).agg(F.max(F.struct(at, event, "severity")).alias("last")).select(*keys, "last.severity")


def latest_counts(stored: DataFrame, keys: Sequence[str] = ("project_id", "package_id")) -> DataFrame:
    """Packages per project and severity now, from the stored rows of `latest_severities`: a package's newest batch counts."""
    now = stored.groupBy(*keys).agg(F.max_by("severity", "batch").alias("severity"))
    return now.groupBy("project_id", "severity").agg(F.count("*").alias("packages"))


def store_changes(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep each batch's changes summed by project and severity; a repeated batch overwrites its own folder."""
    def body(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("project_id", "severity").agg(F.sum("change").alias("change")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return changes.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_counts(stored: DataFrame) -> DataFrame:
    """Packages per project and severity now, from the stored changes; severities without a package are left out."""
    return stored.groupBy("project_id", "severity").agg(F.sum("change").alias("packages")).filter("packages <> 0")


def store_counts(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keep the changed counts of every batch; the newest row per key is current."""
    def body(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("update").foreachBatch(body)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def expire_cached(advisories: DataFrame, metrics: DataFrame, as_of: Column,
                  ttl_seconds: int) -> tuple[DataFrame, DataFrame]:
    """The scheduled clean-up of both cached tables."""
    return expire(advisories, as_of, ttl_seconds), expire(metrics, as_of, ttl_seconds)
