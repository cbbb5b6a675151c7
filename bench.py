"""Time the headline queries; prints one JSON line.

`BENCH_SF_DIR` (default /root/testdata/sf0.1) and `BENCH_CPUS` (default 8) set the input and
the cores. Each query is planned, run in full and thrown away (`noop`), so nothing goes
through the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "package_risk", "fleet_status", "project_severity_counts", "explained_risk", "report_table", "issue_list",
    "bills_of_materials", "code_findings", "combined_detections", "look_alike_names", "known_malicious",
    "osv_matches", "github_matches", "nvd_matches", "maintainer_scores", "repository_metrics",
    "previous_versions", "registry_changes", "file_changes", "dependency_changes", "merged_advisories",
    "resolved_packages", "npm_lock", "document_requirements", "osv_records", "stored_scans",
    "streamed_findings", "streamed_severity_counts",
)


def main() -> None:
    from catalog import QUERIES
    from riskframe.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", int(cpus), **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
