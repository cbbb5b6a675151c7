"""Published batches, and rescans from landed locks to stored scores."""

import pytest
from pyspark.sql import functions as F

from riskframe.operators.published import Published
from riskframe.plans.rescans import assess, scan_summaries, scored_scan
from riskframe.sources.files import bundled_blocklist, land_manifests
from riskframe.sources.manifests import READERS, resolve_packages
from riskframe.streaming import watch

FILES = "project_id STRING, path STRING, file_name STRING, content STRING"
AFFECTED = "external_id STRING, ecosystem STRING, name STRING, introduced STRING, fixed STRING, versions ARRAY<STRING>, severity STRING, cvss_score DOUBLE"


def test_a_batch_is_seen_whole_or_not_at_all(spark, tmp_path):
    store = Published(spark, str(tmp_path / "store"))
    assert store.batches() == {}
    with pytest.raises(ValueError):
        store.read("a")
    assert store.commit(1, {"a": spark.range(3), "b": lambda written: written["a"].agg(F.count("*").alias("n"))})

    def broken(written):
        raise OSError("the second table fails")

    with pytest.raises(OSError):
        store.commit(2, {"a": spark.range(100), "b": broken})
    assert list(store.batches()) == ["1"] and store.read("a").count() == 3 and store.read("b").first()["n"] == 3
    assert store.commit(2, {"a": spark.range(5), "b": lambda written: written["a"].agg(F.count("*").alias("n"))})
    assert not store.commit(2, {"a": spark.range(9), "b": spark.range(9)})  # tried again: seen once
    assert store.read("a").count() == 8 and sorted(r["batch"] for r in store.read("b").collect()) == ["1", "2"]


def test_current_rows_are_those_of_the_last_batch_of_a_key(spark, tmp_path):
    store = Published(spark, str(tmp_path / "store"))
    for batch, rows in ((9, [("p", "old"), ("q", "only")]), (10, [("p", "new"), ("p", "newer")])):
        store.commit(batch, {"t": spark.createDataFrame(rows, "k STRING, v STRING")})
    assert sorted((r.k, r.v) for r in store.current("t", ["k"]).collect()) == [("p", "new"), ("p", "newer"), ("q", "only")]


def affected(spark):
    return spark.createDataFrame([
        ("A", "npm", "web", "1.0.0-alpha", "2.0.0", None, "critical", 9.8), ("B", "PyPI", "tool", "0", "2.20", None, "high", None),
        ("C", "Go", "mod/a", "0", "0.0.0-20220101000000-abcdefabcdef", None, "medium", None), ("D", "crates.io", "serde", "0", "0.5", None, "low", None)], AFFECTED)


def npm(version):
    return '{"packages":{"":{},"node_modules/web":{"version":"%s"},"node_modules/event-stream":{"version":"3.3.6"}}}' % version


FLEET = [("one", "package.json", '{"dependencies":{"web":"1"}}'), ("one", "package-lock.json", npm("1.0.0-beta.1")),
         ("two", "Pipfile.lock", '{"default":{"tool":{"version":"==2.19"}}}'), ("three", "go.mod", "module m\nrequire mod/a v0.0.0-20210101000000-abcdefabcdef\n"),
         ("three", "go.sum", "mod/a v0.0.0-20210101000000-abcdefabcdef h1:a=\n"), ("four", "Cargo.toml", '[dependencies]\nserde = "1"\n'),
         ("four", "Cargo.lock", '[[package]]\nname = "serde"\nversion = "1.0.1"\nsource = "r"\nchecksum = "c"\n'), ("quiet", "requirements.txt", "x==1\n")]


def files(spark, rows):
    return spark.createDataFrame([(p, f"/{p}/{n}", n, c) for p, n, c in rows], FILES)


def scores(df):
    return sorted((r.project_id, r.name, r.version, r.advisory_count, r.report_count, round(r.final_score, 6)) for r in df.collect())


def test_rescans_equal_a_batch_over_the_same_files(spark, tmp_path):
    landed, progress = str(tmp_path / "landed"), str(tmp_path / "progress")
    store = Published(spark, str(tmp_path / "store"))
    evidence = dict(affected=affected(spark), blocklist=bundled_blocklist(spark))
    scan = scored_scan(watch.landed_packages(landed), F.lit("2024-05-01").cast("timestamp"), **evidence)

    def run():
        watch.publish_rescans(watch.landed_locks(spark, landed), scan, store, progress).awaitTermination()
        return scores(store.current("risks", ["project_id"]))

    land_manifests(files(spark, FLEET), landed)
    first = run()
    whole = scores(assess(resolve_packages(spark.read.parquet(landed)), **evidence).filter("project_id <> 'quiet'"))
    assert first == whole and {(p, n, a > 0) for p, n, _, a, _, _ in first} == {
        ("one", "web", True), ("one", "event-stream", False), ("two", "tool", True), ("three", "mod/a", True), ("four", "serde", False)}
    assert [r[4] for r in first if r[1] == "event-stream"] == [1]
    scans = store.read("scans").collect()
    assert sorted((r.project_path, r.total_packages) for r in scans) == [("four", 1), ("one", 2), ("three", 1), ("two", 1)]
    assert len({r.scan_id for r in scans}) == 4 and all(len(r.scan_id) == 36 for r in scans)
    # A later lock of one project: only that project is scanned again.
    land_manifests(files(spark, [("four", "Cargo.lock", '[[package]]\nname = "serde"\nversion = "0.4.0"\nsource = "r"\nchecksum = "c"\n')]), landed)
    run()
    assert {r.project_id for r in store.read("risks").filter("batch = '1'").collect()} == {"four"}


def test_summaries_of_the_same_scan_have_the_same_id(spark):
    risks = spark.createDataFrame([("p", "npm", "high"), ("p", "Go", "safe"), ("q", "npm", "low")], "project_id STRING, ecosystem STRING, severity STRING")
    at = F.lit("2024-05-01").cast("timestamp")
    one, two = (sorted(map(str, scan_summaries(risks, at).collect())) for _ in range(2))
    assert one == two and len(one) == 2
    assert scan_summaries(risks.limit(0), at).count() == 0


def test_a_scan_resolves_its_packages_once(spark):
    """Matching and scoring use the packages many times; the manifests behind them are parsed once."""
    met = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            met.add(len(batch))
            yield batch

    packages = resolve_packages(files(spark, FLEET))
    n = packages.count()
    rows = assess(packages.mapInPandas(count, packages.schema), affected(spark), bundled_blocklist(spark))
    assert rows.count() == n and met.value == n


def test_the_choice_of_files_is_made_once(spark):
    """Not by every reader again; and a lock that is chosen wherever it is meets no choice."""
    found = resolve_packages(files(spark, [*FLEET, (None, "poetry.lock", '[[package]]\nname = "x"\nversion = "1"\n'),
                                           ("five", "poetry.lock", '[[package]]\nname = "y"\nversion = "2"\n'), ("five", "requirements.txt", "z==1\n")]))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "max(file_name" not in plan and plan.count("Join LeftSemi") == len({*READERS.values()}) - 2
    assert sorted((r.project_id, r.name) for r in found.collect()) == [
        ("five", "y"), ("four", "serde"), ("one", "event-stream"), ("one", "web"), ("quiet", "x"), ("three", "mod/a"), ("two", "tool")]


def test_files_of_a_batch_are_landed_once(spark, tmp_path):
    """Readers scan what was landed for the batch; none of them joins all files with the batch's projects."""
    land_manifests(files(spark, FLEET), str(tmp_path / "landed"))
    packages = watch.landed_packages(str(tmp_path / "landed"))
    batch = spark.createDataFrame([("one", "package-lock.json"), ("three", "go.sum")], "project_id STRING, file_name STRING")
    found = packages(batch)
    assert sorted((r.project_id, r.name) for r in found.collect()) == [("one", "event-stream"), ("one", "web"), ("three", "mod/a")]
    assert str(tmp_path) not in "".join(found.inputFiles())
    assert packages(batch.limit(0)).count() == 0


def test_rows_of_the_newest_batch_are_current_without_a_join(spark, tmp_path):
    store = Published(spark, str(tmp_path / "store"))
    store.commit(1, {"t": spark.createDataFrame([("p", "a"), ("q", "b"), (None, "c")], "k STRING, v STRING")})
    only = store.current("t", ["k"])
    assert sorted((r.k, r.v) for r in only.collect()) == [("p", "a"), ("q", "b")]
    assert "Join" not in only._jdf.queryExecution().optimizedPlan().toString()
    store.commit(2, {"t": spark.createDataFrame([("p", "d"), (None, "e")], "k STRING, v STRING")})
    assert sorted((r.k, r.v) for r in store.current("t", ["k"]).collect()) == [("p", "d"), ("q", "b")]
