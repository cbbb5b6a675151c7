import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import filters, matching, words
from riskframe.sources.files import bundled_blocklist, read_blocklist


def pkgs(spark, *data):
    return spark.createDataFrame(list(data), "name STRING, version STRING, ecosystem STRING")


@pytest.mark.parametrize("package,hits", [
    (("event-stream", "3.3.6", "npm"), [("event-stream", "3.3.6")]), (("event-stream", "4.0.0", "npm"), []),
    (("EVENT-Stream", "3.3.6", "nodejs"), [("event-stream", "3.3.6")]), (("peacenotwar", "9", "bun"), [("peacenotwar", None)]),
    (("peacenotwar", "9", "PyPI"), []), (("ua-parser-js", "0.7.30", "npm"), [("ua-parser-js", "0.7.30")]), (("react", "1", "npm"), []),
])
def test_blocklist(spark, package, hits):
    got = matching.match_blocklist(pkgs(spark, package), bundled_blocklist(spark)).collect()
    assert [(r.listed_name, r.matched_version) for r in got] == hits


def test_small_blocklist_is_broadcast_by_size_and_a_large_one_is_not(spark):
    packages = spark.range(1000).selectExpr("concat('n', id) AS name", "'1' AS version", "'npm' AS ecosystem")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan(matching.match_blocklist(packages, bundled_blocklist(spark)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100")
    try:
        assert "SortMergeJoin" in plan(matching.match_blocklist(packages, bundled_blocklist(spark)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_read_blocklist(spark, tmp_path):
    path = tmp_path / "list.json"
    path.write_text('{"version": "7", "entries": [{"package_name": "x", "ecosystem": "npm", "affected_versions": null, "severity": "low", '
                    '"reason": "r", "source": "community", "reported_at": "2020-01-01", "references": []}]}')
    row = read_blocklist(spark, str(path)).first()
    assert (row.package_name, row.affected_versions, row.list_version) == ("x", None, "7")
    assert filters.filter_blocklist(bundled_blocklist(spark), "NPM", "critical").count() == 12
    assert bundled_blocklist(spark).filter("affected_versions IS NULL").count() == 11


def ranges(spark, *data):
    return spark.createDataFrame(list(data), "external_id STRING, ecosystem STRING, name STRING, introduced STRING, fixed STRING, versions ARRAY<STRING>")


@pytest.mark.parametrize("version,ids", [
    ("0.9.0", ["open"]), ("1.0.0", ["open", "span"]), ("1.5.0", ["open", "span"]), ("2.0.0", ["open"]),
    ("1.0.0-rc.1", ["open"]), ("2.0.0-rc.1", ["open", "span"]), ("7.7.7", ["listed", "open"]), ("junk", ["open"]),
])
def test_osv_intervals(spark, version, ids):
    affected = ranges(
        spark, ("open", "npm", "p", "0", None, None), ("span", "npm", "p", "1.0.0", "2.0.0", None),
        ("listed", "npm", "p", None, None, ["7.7.7"]), ("other", "PyPI", "p", "0", None, None),
    )
    got = matching.match_osv(pkgs(spark, ("p", version, "nodejs")), affected).collect()
    assert sorted(r.external_id for r in got) == ids


def test_osv_equals_brute_force(spark):
    import itertools
    versions = [f"{a}.{b}.0{p}" for a, b, p in itertools.product(range(4), range(3), ("", "-rc.1"))]
    spans = [("0", None), ("0", "2.1.0"), ("1.0.0", "1.2.0"), ("1.1.0", None), ("2.0.0", "3.0.0"), ("bad", None), ("1.0.0", "bad")]

    def place(v):
        core, _, pre = v.partition("-")
        return [int(x) for x in core.split(".")] + [0 if pre else 1]

    want = {(v, str(i)) for v in versions for i, (lo, hi) in enumerate(spans)
            if "bad" not in (lo, hi) and (lo == "0" or place(v) >= place(lo)) and (hi is None or place(v) < place(hi))}
    affected = ranges(spark, *((str(i), "npm", "p", lo, hi, None) for i, (lo, hi) in enumerate(spans)))
    got = matching.match_osv(pkgs(spark, *(("p", v, "bun") for v in versions)), affected)
    assert {(r.version, r.external_id) for r in got.collect()} == want


def test_github_takes_the_newest_ten(spark):
    advisories = spark.createDataFrame([("p", f"G{i:02}", i % 7) for i in range(30)], "name STRING, external_id STRING, published_at INT")
    packages = pkgs(spark, ("p", "1", "nodejs"), ("p", "2", "bun"), ("p", "1", "Go"))
    assert matching.match_github(packages, advisories).count() == 60
    got = matching.match_github(packages, advisories, k=10).collect()
    want = sorted((f"G{i:02}" for i in range(30)), key=lambda g: (-(int(g[1:]) % 7), g))[:10]
    assert {r.ecosystem for r in got} == {"nodejs", "bun"} and len(got) == 20
    assert sorted({r.external_id for r in got}) == sorted(want)


def test_nvd_equals_brute_force(spark):
    texts = ["A flaw in Left-Pad allows x.", "left-pad, again", "leftpad only", "The react core (react) fails.", "REACT!", "preact is fine", "",
             "in `react`", "*react* [react]", "react/fp and react-dom", "lib/left-pad.js", "éreact", None, "two\nlines of .net", "😀😀 emoji", "C++ and Z"]
    cves = spark.createDataFrame([(f"C{i}", i, t) for i, t in enumerate(texts)], "external_id STRING, published_at INT, description STRING")
    known = ["left-pad", "React", "react", "fails", "none", "act", "re", "z", "c++", ".NET", "o\nlines o", "éREACT", "😀", "😀 e", "?", "react react", "", None]
    want, newest = set(), set()
    for name in filter(None, known):
        hits = [i for i, t in enumerate(texts) if t and name.lower() in t.lower()]
        want |= {(name, f"C{i}") for i in hits}
        newest |= {(name, f"C{i}") for i in sorted(hits, reverse=True)[:2]}
    packages = pkgs(spark, *((name, "1", "npm") for name in known for _ in range(2)))
    assert {("react", "C5"), ("😀", "C14"), ("re", "C11"), ("left-pad", "C10")} <= want
    assert sorted((r.name, r.external_id) for r in matching.match_nvd(packages, cves).collect()) == sorted(want)
    assert {(r.name, r.external_id) for r in matching.match_nvd(packages, cves, k=2).collect()} == newest
    assert matching.match_nvd(packages, cves.limit(0)).count() == 0 == matching.match_nvd(packages.limit(0), cves).count()


def test_nvd_of_whole_runs_equals_brute_force(spark):
    texts = ["A flaw in Left-Pad allows x.", "left-pad, again", "leftpad only", "The react core (react) fails.", "REACT!", "preact is fine", "",
             "in `react`", "*react* [react]", "react/fp and react-dom", "lib/left-pad.js", "éreact"]
    cves = spark.createDataFrame([(f"C{i}", i, t) for i, t in enumerate(texts)], "external_id STRING, published_at INT, description STRING")
    packages = pkgs(spark, ("left-pad", "1", "npm"), ("React", "1", "npm"), ("react", "1", "npm"), ("fails", "1", "npm"), ("none", "1", "npm"))
    import regex
    want, newest = set(), set()
    for name in ("left-pad", "React", "react", "fails"):
        runs = regex.findall(r"[\p{L}\p{N}]+", name.lower())
        hits = [i for i, t in enumerate(texts) if runs[0] in regex.findall(r"[\p{L}\p{N}]+", t.lower()) and name.lower() in t.lower()]
        want |= {(name, f"C{i}") for i in hits}
        newest |= {(name, f"C{i}") for i in sorted(hits, reverse=True)[:2]}
    assert {(r.name, r.external_id) for r in matching.match_nvd(packages, cves, whole_runs=True).collect()} == want
    assert ("react", "C7") in want and ("react", "C9") in want and ("left-pad", "C10") in want
    got = matching.match_nvd(packages, cves, k=2, whole_runs=True)
    assert {(r.name, r.external_id) for r in got.collect()} == newest
    assert got.filter("NOT contains(lower(description), lower(name))").count() == 0


def test_nvd_candidates_come_from_the_rarest_gram(spark):
    cves = spark.createDataFrame([(f"C{i}", i, "common words react" + (" zq9" if i == 5 else "")) for i in range(50)],
                                 "external_id STRING, published_at INT, description STRING")
    names = spark.createDataFrame([("react zq9",), ("react zq8",)], "word STRING")
    grams = matching.name_grams(names)
    index = matching.gram_index(cves, grams.select("gram").distinct())
    held = {r.gram: r["count"] for r in index.groupBy("gram").count().collect()}
    assert held["rea"] == 50 and held["zq9"] == 1 and "zq8" not in held
    hits = matching.match_nvd(pkgs(spark, ("react zq9", "1", "npm"), ("react zq8", "1", "npm")), cves)
    assert [(r.name, r.external_id) for r in hits.collect()] == [("react zq9", "C5")]


def test_severity_filter_prefers_the_request(spark):
    risks = spark.createDataFrame([("critical",), ("low",), ("safe",)], "severity STRING")
    kept = lambda *a: sorted(r.severity for r in filters.filter_severity(risks, *a).collect())
    assert kept(["LOW"], ["critical"]) == ["low"] and kept([], ["Critical"]) == ["critical"] and len(kept(None, [])) == 3


def test_filters_reach_the_scan(spark):
    packages = spark.read.parquet("/root/testdata/sf0.001/part.parquet").withColumnRenamed("p_size", "depth")
    plan = filters.limit_depth(packages, 3).select("p_partkey")._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(p_size,3)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_repository_url(spark):
    texts = ['{"repository":{"url":"u1"}}', '{"repository":"u2"}', '{"repository":{"type":"git"}}', "{}", "junk"]
    df = spark.createDataFrame([(t,) for t in texts], "json STRING")
    assert [r.u for r in df.select(matching.repository_url(F.col("json")).alias("u")).collect()] == ["u1", "u2", None, None, None]


def test_names_anywhere_meet_texts_in_blocks_without_a_shuffle_of_hits(spark):
    words = ["a", "ab", "react", "React", "re act", "zq9", "x" * 40, "text 1"]
    texts = [(f"C{i}", f"{w.upper()} in text {i} preact"[: 40 + i]) for i, w in enumerate(words)] + [("N", None), ("E", "")]
    cves = spark.createDataFrame(texts, "external_id STRING, description STRING")
    packages = spark.createDataFrame([(w,) for w in words] + [("",), (None,)], "name STRING")
    want = sorted((w, i) for w in words for i, t in texts if t and w.lower() in t.lower())
    for block in (2, 100):
        hits = matching.hits_anywhere(packages, cves, block)
        assert sorted((r.name, r.external_id) for r in hits.collect()) == want
        assert "hashpartitioning" not in hits._jdf.queryExecution().executedPlan().toString()


def test_one_pass_over_a_text_finds_all_words():
    """However many words share a gram or end inside another, each byte of a text is looked at once."""
    random.seed(5)
    known = ["".join(random.choices("ab é", k=random.randrange(1, 9))) for _ in range(300)] + ["a" * 400]
    start = words.automaton([(w.encode(), f"{w}{n}") for n, w in enumerate(known)])

    class Counted(bytes):
        steps = 0

        def __iter__(self):
            for byte in super().__iter__():
                Counted.steps += 1
                yield byte

    for text in ("", "a" * 500, "é", *("".join(random.choices("ab é", k=200)) for _ in range(20))):
        Counted.steps = 0
        found = words.names_in(start, Counted(text.encode()))
        assert sorted(found) == sorted(f"{w}{n}" for n, w in enumerate(known) if w in text) and Counted.steps == len(text.encode())


def test_texts_meet_words_without_a_row_per_candidate(spark):
    """All names share their rarest gram with all texts, so candidates would be names times texts; only hits become rows."""
    cves = spark.range(200).selectExpr("concat('C', id) AS external_id", "concat('qqq', id, ' end') AS description")
    packages = spark.range(200).selectExpr("concat('qqq', id, ' end') AS name")
    hits = matching.hits_anywhere(packages, cves)
    assert hits.count() == 200 and hits.filter("name <> description").count() == 0
    assert "Join" not in hits._jdf.queryExecution().executedPlan().toString()
