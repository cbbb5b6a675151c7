"""Batches of stored tables that are seen whole or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.session import remove

Table = DataFrame | Callable[[dict[str, DataFrame]], DataFrame]


class Published:
    """Tables under one folder that all executors share, added to batch by batch.

    A batch writes new folders of its own. Only when all its tables are written, a small file in `_commits` names
    them, and readers look at named folders only. So a batch that breaks leaves nothing to see, and one
    that is tried again, whole or after a failure, is seen once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _path(self, path: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self):
        return self._path(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def batches(self) -> dict[str, str]:
        """Token of every published batch."""
        files, commits = self._files(), f"{self.path}/_commits"
        if not files.exists(self._path(commits)) or not files.listStatus(self._path(commits)):
            return {}
        rows = self.spark.read.text(commits, wholetext=True).select(F.col("_metadata.file_name").alias("batch"), "value")
        return {r.batch: r.value for r in rows.collect()}

    def commit(self, batch: int | str, tables: dict[str, Table]) -> bool:
        """Write `tables` and publish them as `batch`; False if that batch was there already.

        A table may be a function of those written before it in this batch, which it reads back.
        """
        batch, token = str(batch), uuid.uuid4().hex
        files, named = self._files(), self._path(f"{self.path}/_commits/{batch}")
        if files.exists(named):
            return False
        written: dict[str, DataFrame] = {}
        for name, table in tables.items():
            rows = table(written) if callable(table) else table
            folder = self._folder(name, batch, token)
            rows.withColumn("batch", F.lit(batch)).write.parquet(folder)
            written[name] = self.spark.read.schema(rows.schema).parquet(folder)
        staged = self._path(f"{self.path}/_staged/{token}")
        out = files.create(staged, True)
        out.write(bytearray(token.encode()))
        out.close()
        files.mkdirs(named.getParent())
        published = not files.exists(named) and files.rename(staged, named)
        if not published:
            for name in tables:
                remove(self.spark, self._folder(name, batch, token))
        return published

    def _folder(self, name: str, batch: str, token: str) -> str:
        return f"{self.path}/{name}/{batch}-{token}"

    def read(self, name: str, batches: dict[str, str] | None = None) -> DataFrame:
        """A table's rows of all published batches, or of those given, with their `batch` as text."""
        folders = [self._folder(name, b, t) for b, t in sorted((self.batches() if batches is None else batches).items())]
        if not folders:
            raise ValueError(f"nothing is published under {self.path}")
        return self.spark.read.parquet(*folders)

    def current(self, name: str, keys: list[str]) -> DataFrame:
        """Of every key the rows of its last batch; batches are numbered. Rows of the newest batch are current as they
        are; only those of earlier ones meet the last batch of their key."""
        batches = self.batches()
        rows = self.read(name, batches).withColumn("_number", F.col("batch").cast("bigint"))
        newest = max(map(int, batches))
        fresh = rows.filter(F.col("_number") == newest).dropna(subset=keys)
        if len(batches) > 1:
            last = rows.groupBy(*keys).agg(F.max("_number").alias("_number"))
            fresh = fresh.unionByName(rows.filter(F.col("_number") < newest).join(last, [*keys, "_number"], "left_semi"))
        return fresh.drop("_number")
