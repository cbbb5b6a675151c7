import pytest
from pyspark.sql import functions as F

from riskframe.operators.changes import placeholder_files, version_diffs


def diffs(spark, old, new):
    schema = "package STRING, version STRING, files ARRAY<STRING>, license STRING, dependencies MAP<STRING, STRING>"
    snapshots = spark.createDataFrame([("p", "1", *old), ("p", "2", *new)], schema)
    pairs = spark.createDataFrame([("p", "1", "2")], "package STRING, from_version STRING, to_version STRING")
    return {r.change_type: (r.severity, r.description) for r in version_diffs(snapshots, pairs).collect()}


BASE = (["a", "b"], "MIT", {"x": "1"})


@pytest.mark.parametrize("new,found", [
    (BASE, {}),
    ((["b", "c"], "MIT", {"x": "1"}), {"files_removed": ("medium", "Files removed between 1 and 2: a")}),
    ((["a", "b", "c"], "MIT", {"x": "2"}), {}),
    ((["a", "b"], "GPL", {"x": "1"}), {"license_changed": ("low", "License changed from MIT to GPL between versions 1 and 2")}),
    ((["a", "b"], None, {"x": "1"}), {}),
    ((["a", "b"], "MIT", {"z": "1", "y": "1"}),
     {"dependencies_changed": ("medium", "Dependencies changed between 1 and 2: added: y, z; removed: x")}),
    ((["a", "b"], "MIT", None), {"dependencies_changed": ("medium", "Dependencies changed between 1 and 2: removed: x")}),
])
def test_changes(spark, new, found):
    assert diffs(spark, BASE, new) == found


def test_all_three_at_once(spark):
    assert set(diffs(spark, BASE, ([], "ISC", {}))) == {"files_removed", "license_changed", "dependencies_changed"}


def test_placeholder_files(value):
    assert value(placeholder_files(F.lit(0))) == [] and value(placeholder_files(F.lit(None).cast("int"))) == []
    assert value(placeholder_files(F.lit(3))) == ["file_0", "file_1", "file_2"]
