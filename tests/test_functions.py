import pytest
from pyspark.sql import functions as F

from riskframe.functions import health, identity, severity, text, version
from riskframe.plans.risk import combine_scores


@pytest.mark.parametrize("score,level", [
    (0.95, "critical"), (0.9, "critical"), (0.89, "high"), (0.7, "high"), (0.5, "medium"), (0.4, "medium"),
    (0.1, "low"), (0.0, "safe"),
])
def test_score_bands(value, score, level):
    assert value(severity.score_to_severity(F.lit(score))) == level


@pytest.mark.parametrize("text_,level,cvss", [
    ("9.8", "critical", 9.8), ("7.4", "high", 7.4), ("4.0", "medium", 4.0), ("1", "low", 1.0),
    ("CVSS:3.1/AV:N", "low", None), ("", "low", None), (None, "medium", None),
])
def test_osv_severity(value, text_, level, cvss):
    score = F.lit(text_).cast("string")
    assert value(severity.osv_severity(score)) == level
    assert value(severity.osv_cvss(score)) == cvss


@pytest.mark.parametrize("args,final", [
    ((0.98, 0, 0, 0, 0), 0.98),            # advisories alone count in full
    ((0.98, 0, 0, 0.5, 0), 0.467),         # any other signal blends
    ((0.0, 0, 0, 0, 0.8), 0.8),            # a definite report decides alone
    ((1.0, 1.0, 1.0, 1.0, 0.5), 0.95),
    ((0.0, 0, 0, 0, 0), 0.0),
])
def test_combined_score(value, args, final):
    assert value(combine_scores(*(F.lit(float(a)) for a in args))) == pytest.approx(final)


METRICS = ("days", "releases", "issues", "stars", "people")


@pytest.mark.parametrize("metrics,low,high", [
    ((10, 12, 5, 5000, 20), 0.0, 0.3), ((2000, 0, 500, 1, 0), 0.7, 1.0),
    ((0, 100, 0, 1000000, 1000), 0.0, 1.0), ((99999, 0, 99999, 0, 0), 0.0, 1.0),
])
def test_maintainer_risk(value, metrics, low, high):
    columns = [F.lit(m) for m in metrics]
    risk, health_ = value(health.maintainer_risk(*columns)), value(health.maintainer_health(*columns))
    assert low <= risk <= high and risk + health_ == pytest.approx(1.0)


def test_issue_bands(value):
    got = [value(health.issues(F.lit(i), F.lit(r))) for i, r in ((51, 0), (50, 0), (0, 0), (10, 1), (200, 1), (501, 1))]
    assert got == [0.10, 0.75, 0.80, 1.0, 0.55, 0.15]


@pytest.mark.parametrize("url,owner,repo", [
    ("https://github.com/lodash/lodash.git", "lodash", "lodash"), ("git+https://github.com/a/b.git", "a", "b"),
    ("git://github.com/a/b", "a", "b"), ("git+ssh://git@github.com/a/b.git", "a", "b"),
    ("https://github.com/a/b/tree/main", "a", "b"), ("https://gitlab.com/a/b", None, None),
    ("https://github.com/onlyowner", None, None),
])
def test_owner_repo(value, url, owner, repo):
    pair = value(identity.owner_repo(F.lit(url)))
    assert (pair and pair["owner"], pair and pair["repo"]) == (owner, repo)


@pytest.mark.parametrize("spec,found", [
    ("==1.2.3", "1.2.3"), (">=2.0,<3", "2.0"), ("~=1.4", "1.4"), ("!= 1", "1"), ("^1", "1"), ("*", None), ("", None),
    ("1.0", None), (" == 1.0 ", "1.0"),
])
def test_python_version(value, spec, found):
    assert value(version.python_version(F.lit(spec))) == found


@pytest.mark.parametrize("spec,found", [("^1.0", "1.0"), (">=1.2, <2", "1.2"), ("=0.3", "0.3"), ("~1", "1"), ("^", None)])
def test_cargo_version(value, spec, found):
    assert value(version.cargo_version(F.lit(spec))) == found


@pytest.mark.parametrize("text_,core,pre,build", [
    ("1.2.3", (1, 2, 3), None, None), ("1.2.3-rc.1", (1, 2, 3), "rc.1", None), ("1.2.3+b-7", (1, 2, 3), None, "b-7"),
    ("1.2.3-a.0+x", (1, 2, 3), "a.0", "x"), ("1.2", None, None, None), ("01.2.3", None, None, None), ("v1.2.3", None, None, None),
    ("1.2.3-01", None, None, None), ("10.0.0", (10, 0, 0), None, None),
])
def test_semver(value, text_, core, pre, build):
    got = value(version.semver_core(F.lit(text_)))
    assert (tuple(got) if got else None) == core
    assert value(version.prerelease(F.lit(text_))) == pre and value(version.build_metadata(F.lit(text_))) == build
    assert bool(value(version.is_stable(F.lit(text_)))) == (core is not None and pre is None)


def test_small_texts(value):
    assert value(identity.npm_name_from_key(F.lit("node_modules/a/node_modules/@babel/core"))) == "@babel/core"
    assert value(identity.npm_name_from_key(F.lit("node_modules/@babel/core"), compat=True)) == "core"
    assert value(identity.npm_depth(F.lit("node_modules/a/node_modules/b"))) == 2
    assert value(identity.normalize_pypi_name(F.lit("Zope.Inter-face"))) == "zope_inter_face"
    assert value(text.truncate_label(F.lit("x" * 50), 45)) == "x" * 45 + "…"
    assert value(text.staleness_text(F.lit(9999))) == "unknown"
    assert value(text.sbom_version_id(F.lit("a"), F.lit("1.0.0"), F.lit("1.1.0"))) == "RISKFRAME-VER-a-1_0_0-1_1_0"
    assert value(severity.gate_fails(F.lit(2), "whatever")) and not value(severity.gate_fails(F.lit(3), "none"))
