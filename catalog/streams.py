"""Streams run to the end of their input."""

from pyspark.sql import functions as F

from catalog.base import ADAPTERS, query
from catalog.detection import DETECTED_SQL
from catalog.filters import ARRIVALS
from catalog.ingest import corpus
from catalog.tables import EXPIRY, TTL
from riskframe.functions.severity import SEVERITY_SCORES
from riskframe.operators.filters import lock_events
from riskframe.operators.published import Published
from riskframe.plans.rescans import scored_scan
from riskframe.session import scratch_path
from riskframe.sources.files import bundled_blocklist, land_manifests
from riskframe.streaming import watch


def _stream(d, name):
    """A table as a stream of its files, whether it is one file or a folder of them; the brackets make a pattern of the
    path, since the file source takes a plain path for a folder."""
    return d.spark.readStream.schema(d.table(name).schema).parquet(f"{d.sf_dir}/{name}.parque[t]")


def _run(d, name, start):
    """Run `start(path, checkpoint)` until the input is used up; return the stored rows."""
    path, checkpoint = scratch_path(d.spark, name), scratch_path(d.spark, f"{name}-progress")
    start(path, checkpoint).awaitTermination()
    return d.spark.read.parquet(path)


@query(f"SELECT package_id, CAST(line_number AS INTEGER) AS line_number, rule_id, confidence FROM ({DETECTED_SQL}) AS c")
def streamed_findings(d):
    files = d.sql(ADAPTERS["source_files"], documents=_stream(d, "documents"))
    findings = watch.continuous_findings(files).select("package_id", "line_number", "rule_id", "confidence")
    return _run(d, "findings", lambda p, c: watch.append_findings(findings, p, c))


@query("""
    SELECT project_id, count(*) AS total_packages, count(*) FILTER (WHERE severity = 'critical') AS critical_count,
           count(*) FILTER (WHERE severity = 'high') AS high_count, count(*) FILTER (WHERE severity = 'medium') AS medium_count,
           count(*) FILTER (WHERE severity = 'low') AS low_count, count(*) FILTER (WHERE severity = 'safe') AS safe_count
    FROM {risk_events} GROUP BY project_id""")
def streamed_severity_counts(d):
    rows = d.sql(ADAPTERS["risk_events"], events=_stream(d, "events"))
    stored = _run(d, "counts", lambda p, c: watch.store_counts(watch.running_severity_counts(rows), p, c))
    fields = [c for c in stored.columns if c not in ("project_id", "batch")]
    return stored.groupBy("project_id").agg(F.max_by(F.struct(*fields), "batch").alias("now")).select("project_id", "now.*")


@query("""
    SELECT project_id, severity, count(*) AS packages FROM (
        SELECT project_id, severity, row_number() OVER (PARTITION BY project_id, event_id % 20 ORDER BY scanned_at DESC, event_id DESC) AS nth
        FROM {risk_events}) AS x WHERE nth = 1 GROUP BY project_id, severity""")
def streamed_current_counts(d):
    """Every package counts once, under its last severity, though its scans arrive over several batches in any order."""
    landed = scratch_path(d.spark, "risk-events")
    d.adapter("risk_events").repartition(4, "event_id").write.parquet(landed)
    rows = d.spark.readStream.schema(d.spark.read.parquet(landed).schema).option("maxFilesPerTrigger", 1).parquet(landed)
    latest = watch.latest_severities(rows.withColumn("package_id", F.col("event_id") % 20))
    return watch.latest_counts(_run(d, "latest", lambda p, c: watch.store_counts(latest, p, c)))


@query(f"SELECT file_name, count(*) AS landed FROM ({ARRIVALS}) AS x WHERE event_id % 12 < 8 GROUP BY file_name")
def streamed_rescans(d):
    arrivals = lock_events(d.sql(ARRIVALS, events=_stream(d, "events")))

    def scan(batch):
        return batch.groupBy("file_name").agg(F.count("*").alias("landed"))

    stored = _run(d, "rescans", lambda p, c: watch.run_rescans(arrivals, scan, p, c))
    return stored.groupBy("file_name").agg(F.sum("landed").alias("landed"))


FILES = ("package-lock.json", "package.json", "poetry.lock", "pyproject.toml", "go.sum", "go.mod", "Cargo.lock", "Cargo.toml")
K = "CAST({k} % 10 AS STRING)"
AFFECTED = f"""
    SELECT concat('OSV-', CAST(s_suppkey AS STRING)) AS external_id, CASE s_suppkey % 4 WHEN 0 THEN 'PyPI' WHEN 1 THEN 'crates.io' WHEN 2 THEN 'Go' ELSE 'npm' END AS ecosystem,
           CASE s_suppkey % 4 WHEN 0 THEN 'req-uests' WHEN 1 THEN 'serde' WHEN 2 THEN 'example.com/a' ELSE concat('n', CAST(s_suppkey AS STRING)) END AS name,
           CASE s_suppkey % 4 WHEN 0 THEN '2' WHEN 1 THEN '0' WHEN 2 THEN 'v1.0.0' ELSE concat('1.', {K.format(k='s_suppkey')}, '.0-rc.1') END AS introduced,
           CASE s_suppkey % 4 WHEN 0 THEN concat('2.', {K.format(k='s_suppkey')}) WHEN 1 THEN concat('1.0.', {K.format(k='s_suppkey')})
                WHEN 2 THEN concat('1.2.', CAST(s_suppkey % 7 AS STRING)) ELSE NULL END AS fixed,
           CASE s_suppkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
    FROM {{supplier}}"""
_SCORE = "CASE s_suppkey % 5 WHEN 0 THEN {critical} WHEN 1 THEN {high} WHEN 2 THEN {medium} ELSE {low} END".format(
    **{name: f"CAST({score} AS DOUBLE)" for name, score in SEVERITY_SCORES.items()})
_O, _K = "CAST(o_orderkey AS STRING)", K.format(k="o_custkey")


# Every order is a project with four kinds of locks; the twin states its packages and which suppliers' advisories hold them.
@query(f"""
    WITH held AS (
        SELECT o_orderkey AS project_id, o_custkey AS c, o_custkey % 10 AS k, v.* FROM {{orders}}, (VALUES
            ('nodejs', 1), ('nodejs', 2), ('PyPI', 3), ('PyPI', 4), ('PyPI', 5), ('Go', 6), ('Go', 7), ('crates.io', 8), ('crates.io', 9), ('crates.io', 10), ('crates.io', 11)
        ) AS v(ecosystem, n)),
    told AS (
        SELECT project_id, ecosystem, c, k, n,
               CASE n WHEN 1 THEN concat('n', CAST(c AS STRING)) WHEN 2 THEN concat('@s/x', CAST(project_id AS STRING)) WHEN 3 THEN 'req-uests' WHEN 4 THEN concat('pytest', CAST(k AS STRING))
                      WHEN 5 THEN concat('deep', CAST(project_id AS STRING)) WHEN 6 THEN 'example.com/a' WHEN 7 THEN concat('example.com/b', CAST(k AS STRING))
                      WHEN 8 THEN 'serde' WHEN 9 THEN 'proptest' ELSE 'deep' END AS name,
               CASE n WHEN 1 THEN concat('1.', CAST(k AS STRING), '.0') WHEN 2 THEN '' WHEN 3 THEN concat('2.', CAST(k AS STRING), '.0') WHEN 4 THEN '0.0.0' WHEN 5 THEN '3'
                      WHEN 6 THEN '1.2.3' WHEN 7 THEN '0.1.0' WHEN 8 THEN concat('1.0.', CAST(k AS STRING)) WHEN 9 THEN '0.0.0' WHEN 10 THEN '2' ELSE '3' END AS version FROM held),
    hit AS (
        SELECT s_suppkey % 4 AS kind, CASE s_suppkey % 4 WHEN 3 THEN s_suppkey WHEN 2 THEN s_suppkey % 7 ELSE s_suppkey % 10 END AS bound, {_SCORE} AS score FROM {{supplier}}),
    found AS (
        SELECT project_id, n, count(*) AS advisory_count, max(score) AS score FROM told JOIN hit ON
            (n = 3 AND kind = 0 AND k < bound) OR (n = 8 AND kind = 1 AND k < bound) OR (n = 6 AND kind = 2 AND 3 < bound) OR (n = 1 AND kind = 3 AND c = bound)
        GROUP BY project_id, n)
    SELECT t.project_id, ecosystem, name, version, coalesce(advisory_count, 0) AS advisory_count, coalesce(score, 0.0) AS final_score
    FROM told t LEFT JOIN found f ON t.project_id = f.project_id AND t.n = f.n""")
def streamed_project_risks(d):
    """Lands the corpus, streams its locks in batches, resolves, scores and publishes the projects they name."""
    corpus_path = scratch_path(d.spark, "landed")
    land_manifests(corpus(d, *FILES), corpus_path)
    affected = d.sql(AFFECTED).withColumns({"cvss_score": F.lit(None).cast("double"), "versions": F.lit(None).cast("array<string>")})
    scan = scored_scan(watch.landed_packages(corpus_path), F.lit("2024-01-01").cast("timestamp"), affected=affected, blocklist=bundled_blocklist(d.spark))
    store = Published(d.spark, scratch_path(d.spark, "published"))
    watch.publish_rescans(watch.landed_locks(d.spark, corpus_path), scan, store, scratch_path(d.spark, "published-progress")).awaitTermination()
    return store.current("risks", ["project_id"]).select(
        "project_id", "ecosystem", "name", "version", "advisory_count", "final_score")


@query(f"""
    SELECT 'advisories' AS table_name, count(*) AS n FROM {{advisories}} WHERE fetched_at >= TIMESTAMP '{EXPIRY}' - INTERVAL {TTL} SECOND
    UNION ALL SELECT 'metrics', count(*) FROM {{maintainer_metrics}} JOIN {{orders}} ON o_orderkey = package_id
    WHERE o_orderdate >= TIMESTAMP '{EXPIRY}' - INTERVAL {TTL} SECOND""")
def scheduled_expiry(d):
    metrics = d.adapter("maintainer_metrics").join(d.table("orders"), F.col("o_orderkey") == F.col("package_id")).withColumnRenamed(
        "o_orderdate", "fetched_at")
    kept = watch.expire_cached(d.adapter("advisories"), metrics, F.lit(EXPIRY).cast("timestamp"), TTL)
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
              for name, rows in zip(("advisories", "metrics"), kept)]
    return counts[0].unionByName(counts[1])
