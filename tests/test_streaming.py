from datetime import datetime

from pyspark.sql import functions as F

from riskframe.operators.detection import detect_files
from riskframe.sources.files import read_manifests
from riskframe.sources.manifests import resolve_packages
from riskframe.streaming import watch


def land(root, project, landing, name, content):
    folder = root / project / f"v={landing}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(content)


def test_rescans_follow_landed_locks(spark, tmp_path):
    root, out, progress = tmp_path / "in", tmp_path / "out", tmp_path / "progress"
    pip = lambda v: '{"default":{\n"a":{"version":"==%s"}}}' % v
    land(root, "one", 1, "Pipfile.lock", pip(1))
    land(root, "one", 1, "notes.txt", "ignored")

    def scan(batch):
        return resolve_packages(batch).select("project_id", "name", "version")

    def run():
        watch.run_rescans(watch.watch_manifests(spark, str(root)), scan, str(out), str(progress)).awaitTermination()
        return sorted((r.project_id, r.version, r.batch) for r in spark.read.parquet(str(out)).collect())

    assert run() == [("one", "1", 0)]
    land(root, "one", 2, "Pipfile.lock", pip(2))
    land(root, "two", 1, "Pipfile.lock", pip(5))
    assert run() == [("one", "1", 0), ("one", "2", 1), ("two", "5", 1)]
    whole = resolve_packages(read_manifests(spark, str(root)).dropDuplicates(["path"]))
    assert whole.count() == 2  # the last lock of each project


def test_rescan_reads_all_current_files_of_a_project(spark, tmp_path):
    root, out, progress = tmp_path / "in", tmp_path / "out", tmp_path / "progress"
    npm = lambda v: '{"packages":{"":{},"node_modules/a":{"version":"%s"}}}' % v
    land(root, "team/web", 1, "package.json", '{"dependencies":{"a":"1"}}')
    land(root, "team/web", 1, "package-lock.json", npm("1.0.0"))
    land(root, "crab", 1, "Cargo.toml", '[dependencies]\nserde = "1"\n')
    land(root, "crab", 1, "Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\nsource = "r"\nchecksum = "c"\n')
    land(root, "gopher", 1, "go.mod", "module m\nrequire two v2.0.0\n")
    land(root, "gopher", 1, "go.sum", "two v2.0.0 h1:a=\n")
    land(root, "bunny", 1, "package.json", '{"dependencies":{"lodash":"^4"}}')
    land(root, "bunny", 1, "bun.lock", '{\n"lodash@4.17.21":\n')
    land(root, "quiet", 1, "requirements.txt", "x==1\n")

    def run():
        scan = watch.changed_packages(str(root), lambda p: p.select("project_id", "name", "version", "ecosystem"))
        watch.run_rescans(watch.watch_manifests(spark, str(root)), scan, str(out), str(progress)).awaitTermination()
        return spark.read.parquet(str(out))

    first = {(r.project_id, r.name, r.version) for r in run().collect()}
    whole = {(r.project_id, r.name, r.version) for r in resolve_packages(read_manifests(spark, str(root))).collect()}
    assert {p for p, _, _ in first} == {"team/web", "crab", "gopher", "bunny"} and first == {r for r in whole if r[0] != "quiet"}
    land(root, "team/web", 2, "package-lock.json", npm("2.0.0"))  # package.json stays where it landed
    later = [(r.project_id, r.name, r.version) for r in run().filter("batch = 1").collect()]
    assert later == [("team/web", "a", "2.0.0")]


def test_a_repeated_batch_leaves_one_copy(spark, tmp_path):
    body = watch.rescan(lambda b: b, str(tmp_path / "out"))
    batch = spark.range(3)
    body(batch, 7), body(batch, 7)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_streamed_findings_equal_batch(spark, tmp_path):
    files = spark.createDataFrame([(i, "a\neval(x)" if i % 2 else "ok") for i in range(20)], "i INT, content STRING")
    files.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(files.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch.append_findings(watch.continuous_findings(stream), str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    key = lambda df: sorted(map(tuple, df.select("i", "rule_id", "line_number").collect()))
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(detect_files(files))


def test_running_counts(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, "high" if i % 2 else "safe") for i in range(30)], "project_id INT, severity STRING")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    watch.store_counts(watch.running_severity_counts(stream), str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "out"))
    last = stored.groupBy("project_id").agg(F.max_by("total_packages", "batch").alias("n"), F.max_by("high_count", "batch").alias("h"))
    assert sorted(map(tuple, last.collect())) == [(0, 10, 5), (1, 10, 5), (2, 10, 5)] and stored.select("batch").distinct().count() == 3


def test_counts_take_a_changed_severity_back(spark, tmp_path):
    from datetime import datetime
    schema = "project_id STRING, package_id INT, severity STRING, scanned_at TIMESTAMP, event_id INT"
    at = lambda day: datetime(2024, 1, day)
    landings = [
        [("p", 1, "high", at(2), 1), ("p", 1, "low", at(1), 2), ("p", 2, "safe", at(1), 3), (None, 1, "low", at(1), 4)],
        [("p", 1, "critical", at(3), 5), ("p", 2, "high", at(1), 2), ("q", 1, "low", at(1), 6), ("p", 3, None, at(1), 7)],
        [("p", 1, "high", at(1), 8), ("p", 2, "medium", at(1), 9), ("q", 1, "low", at(5), 10), ("q", 2, "low", None, 11)],
    ]
    wanted = [
        {("p", "high", 1), ("p", "safe", 1), (None, "low", 1)}, {("p", "critical", 1), ("p", "safe", 1), ("q", "low", 1), (None, "low", 1)},
        {("p", "critical", 1), ("p", "medium", 1), ("q", "low", 1), (None, "low", 1)},
    ]
    for n, (landing, want) in enumerate(zip(landings, wanted)):
        spark.createDataFrame(landing, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        watch.store_changes(watch.severity_changes(stream), str(tmp_path / "out"), str(tmp_path / "p")).awaitTermination()
        assert set(map(tuple, watch.current_counts(spark.read.parquet(str(tmp_path / "out"))).collect())) == want, n


def test_streamed_queries_read_a_table_that_is_a_folder_of_files(spark, tmp_path):
    """The file source once saw only a table that is a single file."""
    from catalog import QUERIES
    for name in ("documents", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("streamed_findings", "streamed_severity_counts", "streamed_rescans"):
        single, folder = (sorted(map(tuple, QUERIES[name](spark, sf).collect())) for sf in ("/root/testdata/sf0.001", str(tmp_path)))
        assert folder and folder == single


def test_latest_severities_take_back_without_python(spark, tmp_path):
    schema = "project_id INT, package_id INT, severity STRING, scanned_at TIMESTAMP_NTZ, event_id BIGINT"
    at = [datetime(2024, 1, d) for d in range(1, 6)]
    landings = [
        [(1, 7, "high", at[2], 1), (1, 8, "low", at[0], 2), (1, 7, "low", at[1], 3), (2, 7, None, at[3], 4)],
        [(1, 7, "critical", at[0], 9), (1, 8, "high", at[0], 1), (2, 9, "low", None, 5)],
        [(1, 7, "safe", at[2], 2), (1, 8, "high", at[0], 3), (1, 8, None, at[4], 8), (2, 9, "low", at[0], 6)],
    ]
    wanted = [{(1, "high", 1), (1, "low", 1)}, {(1, "high", 1), (1, "low", 1)}, {(1, "safe", 1), (1, "high", 1), (2, "low", 1)}]
    for landing, want in zip(landings, wanted):
        spark.createDataFrame(landing, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        latest = watch.latest_severities(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        run = watch.store_counts(latest, str(tmp_path / "out"), str(tmp_path / "p"))
        run.awaitTermination()
        assert "InPandas" not in run._jsq.explainInternal(False)
        assert set(map(tuple, watch.latest_counts(spark.read.parquet(str(tmp_path / "out"))).collect())) == want
