from datetime import datetime

from pyspark.sql import functions as F

from riskframe.operators import tables

PACKAGES = "name STRING, version STRING, ecosystem STRING, id INT, registry_url STRING, checksum STRING"


def sets(df):
    return {tuple(r) for r in df.collect()}


def test_package_upsert(spark):
    old = spark.createDataFrame([("a", "1", "npm", 1, "u", "c"), ("b", "1", "npm", 2, "u", "c")], PACKAGES)
    new = spark.createDataFrame([("a", "1", "npm", 9, None, "d"), ("c", "1", "npm", 3, "u", None)], PACKAGES)
    merged = tables.upsert_packages(old, new)
    assert sets(merged) == {("a", "1", "npm", 1, None, "d"), ("b", "1", "npm", 2, "u", "c"), ("c", "1", "npm", 3, "u", None)}
    assert sets(tables.upsert_packages(merged, new)) == sets(merged)


def test_diff_insert_keeps_what_is_stored(spark):
    schema = "package_id INT, from_version STRING, to_version STRING, change_type STRING, description STRING"
    old = spark.createDataFrame([(1, "1", "2", "license_changed", "old")], schema)
    new = spark.createDataFrame([(1, "1", "2", "license_changed", "new"), (1, "1", "2", "files_removed", "new"),
                                 (1, "1", "2", "files_removed", "other")], schema)
    assert sets(tables.insert_version_diffs(old, new)) == {(1, "1", "2", "license_changed", "old"), (1, "1", "2", "files_removed", "new")}


def test_expiry_is_strict(spark):
    df = spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0, 0)), (1, datetime(2024, 1, 1, 0, 0, 1)), (2, datetime(2023, 1, 1)), (3, None)],
                               "package_id INT, fetched_at TIMESTAMP")
    as_of = F.lit("2024-01-01 00:01:01").cast("timestamp")
    assert {r.package_id for r in tables.expire(df, as_of, 60).collect()} == {1, 3}
    assert tables.expire(df, as_of, 60, package_id=2).count() == 3 and tables.expired_count(df, as_of, 60).first().expired == 2


def test_toggle_twice_restores(spark):
    lists = spark.createDataFrame([(1, "a"), (1, "b")], "project_id INT, name STRING")
    toggled = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "project_id INT, name STRING")
    once = tables.toggle_ignored(lists, toggled)
    assert sets(once) == {(1, "a"), (2, "c")} and sets(tables.toggle_ignored(once, toggled)) == sets(lists)


def test_scans_are_partitioned_by_day(spark, tmp_path):
    df = spark.createDataFrame([("s", datetime(2024, 5, 6, 7, 8))], "scan_id STRING, scanned_at TIMESTAMP")
    tables.append_by_date(df, str(tmp_path / "t"))
    assert (tmp_path / "t" / "scan_date=2024-05-06").is_dir()


def test_step_keeps_its_result_and_removes_what_it_passed(spark):
    import os
    from riskframe.session import _written, durable, step
    before = durable(spark.range(3), "before")
    passed = []

    def make():
        first = durable(before.selectExpr("id + 1 AS id"), "first")
        passed.append(_written[-1])
        return durable(first.selectExpr("id * 2 AS id"), "second").filter("id > 2")

    result = step(spark, make)
    assert sorted(r["id"] for r in result.collect()) == [4, 6] and before.count() == 3
    assert not os.path.exists(passed[0]) and os.path.exists(_written[-1])
