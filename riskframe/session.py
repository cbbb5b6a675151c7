"""Session settings and durable intermediate results."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  **extra: str) -> SparkSession:
    """Session for tests and benchmarks; a cluster job brings its own."""
    builder = SparkSession.builder.appName("riskframe")
    if master:
        builder = builder.master(master)
    settings = {**SETTINGS, **extra}
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as `spark.checkpoint.dir` names it.

    Where it is unset, a session in one JVM (tests) gets a temporary one; a cluster must name one.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/riskframe-{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def durable(df: DataFrame, name: str = "stored") -> DataFrame:
    """Write `df` once to the shared folder and read it back.

    Later uses see the same rows in the same slices, read only the columns they need, and
    losing an executor costs no recomputation. (A checkpoint would compute `df` twice.)
    The folder is scratch space: `step` removes it, or the cluster cleans it like its checkpoints.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def step(spark: SparkSession, make: Callable[[], DataFrame], name: str = "step") -> DataFrame:
    """`make()` as a durable table; what `make` stored on the way is removed when that table is written."""
    start = len(_written)
    result = durable(make(), name)
    passing, _written[start:] = _written[start:-1], _written[-1:]
    for path in passing:
        remove(spark, path)
    return result


def remove(spark: SparkSession, path: str) -> None:
    """Delete a stored folder wherever Spark keeps it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


# Rows of one task that makes or parses files.
SPREAD_ROWS = 200_000


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """At least one partition per core for CPU-heavy work on an input of few splits, and with `rows` no more rows than these
    in one, so that a task's memory does not grow with the input (narrow rows that become wide ones).

    An input that already has that many splits is left as it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if rows:
        wanted = max(wanted, -(-df.count() // rows))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df
