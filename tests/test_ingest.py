"""Manifests written to disk, read as a corpus and resolved."""

import json
import tomllib

import pytest

from riskframe.sources import cargo, common, golang, node, python
from riskframe.sources.advisories import osv_advisories, osv_ranges
from riskframe.sources.files import read_manifests, read_source_lines
from riskframe.sources.manifests import choose_lock, detect_ecosystems, resolve_packages
from riskframe.sources.registry import registry_snapshots

LOCK = {"packages": {
    "": {"name": "app"},
    "node_modules/a": {"version": "1.0.0", "resolved": "u", "integrity": "s", "dependencies": {"b": "^2"}, "scripts": {"postinstall": "p", "install": "i"}},
    "node_modules/a/node_modules/b": {"version": "2.0.0"},
    "node_modules/@babel/core": {"version": "7.0.0", "dev": True},
    "node_modules/x": {"name": "real-x"},
}}
CARGO = """
[package]
name = "app"   # own
version = "0.1.0"

[dependencies]
serde = { version = "1.0.188", features = [
  "derive",
] }
"quoted" = "=2.0"
tokio.version = "1.32"
ws = { workspace = true }

[target.'cfg(unix)'.dependencies]
nix = "0.27"

[dev-dependencies]
proptest = "^1"
serde = "9"

[[bin]]
name = "tool"
"""
PYPROJECT = """
[tool.poetry.dependencies]
python = "^3.11"
Flask = "^2.0"
[tool.poetry.dev-dependencies]
black = "*"
[tool.poetry.group.dev.dependencies]
"py.test" = { version = "^7", extras = ["x"] }
[project]
name = "app"
dependencies = ["requests[security]>=2", 'idna', "Flask"]
optional = ["no"]
"""


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    projects = {
        "web": {"package-lock.json": json.dumps(LOCK), "package.json": '{"dependencies":{"a":"^1","@babel/core":"1"},"optionalDependencies":{"real-x":"1"}}'},
        "yarned": {"yarn.lock": "x", "package.json": '{"dependencies":{"a":"^1.2","b":"~3"},"devDependencies":{"c":"1"}}'},
        "bunny": {"bun.lock": '{\n"lodash@4.17.21":\n"@babel/core@7.24.0":\n"nodeps":\n', "package.json": '{"dependencies":{"lodash":"^4"}}'},
        "flask": {"requirements.txt": "# c\n\nFlask[async]==2.0 # x\n-r dev.txt\n--index-url u\nrequests>=2,<3\nplain\n"},
        "poet": {"poetry.lock": '[[package]]\nname = "flask"\nversion = "2.1"\n\n[package.extras]\nname = "trap"\n\n[[package]]\nname = "idna"\n\n[[package]]\nname = "other"\nversion = "1"\n',
                 "pyproject.toml": PYPROJECT},
        "pip": {"Pipfile.lock": '{"default":{"a":{"version":"==1"}},"develop":{"b":{"version":"*"}}}'},
        "gopher": {"go.mod": "module example.com/m\n\nrequire one v1.0.0\n\nrequire (\n\ttwo v2.0.0\n\tthree v3.0.0 // indirect\n)\n",
                   "go.sum": "two v2.0.0 h1:a=\ntwo v2.0.0/go.mod h1:b=\nthree v3.0.0 h1:c=\ntwo v9 h1:d=\n"},
        "modonly": {"go.mod": "module m\nrequire (\n\ttwo v2.0.0\n\tthree v3.0.0 // indirect\n)\n"},
        "crab": {"Cargo.toml": CARGO, "Cargo.lock": '[[package]]\nname = "app"\nversion = "0.1.0"\n\n[[package]]\nname = "serde"\nversion = "1.0.1"\nchecksum = "c"\n\n[[package]]\nname = "deep"\n'},
        "other": {"README.md": "x"},
    }
    for name, files in projects.items():
        (root / name).mkdir()
        for file, content in files.items():
            (root / name / file).write_text(content)
    return read_manifests(spark, str(root)).cache()


def listed(df, project, *fields):
    return sorted(tuple(r[f] for f in fields) for r in df.filter(df.project_id == project).collect())


def test_corpus(corpus):
    assert corpus.count() == 16 and corpus.filter("project_id = 'web'").count() == 2


def test_equal_folder_names_are_different_projects(spark, tmp_path):
    for team, version in (("a", 1), ("b", 2)):
        (tmp_path / team / "app").mkdir(parents=True)
        (tmp_path / team / "app" / "Pipfile.lock").write_text('{"default":{"x":{"version":"==%d"}}}' % version)
    (tmp_path / "Pipfile.lock").write_text('{"default":{"y":{"version":"==3"}}}')
    got = {(r.project_id, r.name, r.version) for r in resolve_packages(read_manifests(spark, str(tmp_path))).collect()}
    assert got == {("a/app", "x", "1"), ("b/app", "x", "2"), (".", "y", "3")}


def test_the_latest_landing_counts(spark, tmp_path):
    for landing, name in ((1, "a"), (9, "b"), (10, "c")):
        (tmp_path / "p q" / f"v={landing}").mkdir(parents=True)
        (tmp_path / "p q" / f"v={landing}" / "Pipfile.lock").write_text('{"default":{"%s":{"version":"==1"}}}' % name)
    files = read_manifests(spark, str(tmp_path))
    assert sorted((r.project_id, r.landing) for r in files.collect()) == [("p q", 1), ("p q", 9), ("p q", 10)]
    assert [r.name for r in resolve_packages(files).collect()] == ["c"]


def test_ecosystems_and_locks(corpus):
    got = {r.project_id: r.ecosystems for r in detect_ecosystems(corpus).collect()}
    assert got["bunny"] == ["nodejs", "bun"] and got["other"] == [] and got["poet"] == ["python"]
    chosen = {(r.project_id, r.resolver): r.file_name for r in choose_lock(corpus).collect()}
    assert chosen["web", "nodejs"] == "package-lock.json" and chosen["yarned", "nodejs"] == "yarn.lock"
    assert chosen["poet", "python"] == "poetry.lock" and chosen["crab", "rust"] == "Cargo.lock" and ("web", "bun") not in chosen


def test_npm_lock(corpus):
    assert listed(node.npm_lock_packages(corpus), "web", "name", "version", "is_direct", "is_dev", "depth") == [
        ("@babel/core", "7.0.0", True, True, 1), ("a", "1.0.0", True, False, 1), ("b", "2.0.0", False, False, 2), ("real-x", "", True, False, 1)]
    scripts = node.npm_lock_packages(corpus).filter("name = 'a'").first().install_scripts
    assert scripts == ["i", "p"]
    assert [tuple(r) for r in node.npm_lock_edges(corpus).collect()] == [("web", "node_modules/a", "b", "^2", False, False)]


def test_resolve(corpus):
    packages = resolve_packages(corpus).cache()
    assert listed(packages, "yarned", "name", "version", "ecosystem") == [("a", "1.2", "nodejs"), ("b", "3", "nodejs")]
    assert listed(packages.filter("ecosystem = 'bun'"), "bunny", "name", "version", "is_direct") == [("@babel/core", "7.24.0", False), ("lodash", "4.17.21", True)]
    assert listed(packages, "flask", "name", "version") == [("Flask", "2.0"), ("plain", "0.0.0"), ("requests", "2")]
    assert listed(packages, "poet", "name", "version", "is_direct", "depth") == [("flask", "2.1", True, 0), ("idna", "0.0.0", True, 0), ("other", "1", False, 1)]
    assert listed(packages, "pip", "name", "version", "is_dev") == [("a", "1", False), ("b", "0.0.0", True)]
    assert listed(packages, "gopher", "name", "version", "is_direct") == [("three", "3.0.0", False), ("two", "2.0.0", True)]
    assert listed(packages, "modonly", "name", "depth") == [("three", 1), ("two", 0)]
    assert listed(packages, "crab", "pkg_key", "checksum", "is_direct") == [("deep@0.0.0", None, False), ("serde@1.0.1", "c", True)]
    assert packages.filter("project_id = 'other'").count() == 0
    assert {r.ecosystem for r in resolve_packages(corpus, ["golang", "nonsense"]).select("ecosystem").distinct().collect()} == {"Go"}


def test_cargo_manifest_against_a_toml_parser(corpus):
    doc = tomllib.loads(CARGO)
    want = {}
    for section, dev in (("dependencies", False), ("dev-dependencies", True), ("build-dependencies", False)):
        for name, spec in doc.get(section, {}).items():
            text = spec if isinstance(spec, str) else spec.get("version")
            want[name] = (text.lstrip("^~=") if text else "0.0.0", dev)
    got = {r.name: (r.version, r.is_dev) for r in cargo.cargo_toml_packages(corpus).collect()}
    assert got == want


def test_pyproject_against_a_toml_parser(corpus):
    doc = tomllib.loads(PYPROJECT)
    poetry = doc["tool"]["poetry"]
    want = {n.lower(): False for n in poetry["dependencies"] if n != "python"}
    want |= {n.lower(): True for n in poetry["dev-dependencies"]}
    want |= {n.lower().replace(".", "_"): True for n in poetry["group"]["dev"]["dependencies"]}
    want |= {d.split("[")[0].split(">")[0].lower(): False for d in doc["project"]["dependencies"]}
    assert {r.name: r.is_dev for r in python.pyproject_direct(corpus).collect()} == want


def test_sections_need_no_shuffle(corpus):
    plan = common.section_lines(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_go_module(corpus):
    assert {r.project_id: r.module for r in golang.go_module(corpus).collect()} == {"gopher": "example.com/m", "modonly": "m"}


def test_osv_records(spark):
    raw = spark.createDataFrame([("{}",), ('{"id":"V","published":"2024-01-02T00:00:00Z","severity":[{"score":"9.8"}],"affected":[{"package":{"name":"p","ecosystem":"npm"},'
                                  '"ranges":[{"events":[{"introduced":"0"},{"fixed":"1.0.0"},{"introduced":"2.0.0"}]}]}]}',), ("junk",)], "json STRING")
    row, = osv_advisories(raw).collect()
    assert (row.external_id, row.title, row.severity, row.cvss_score, row.affected_versions) == ("V", "V", "critical", 9.8, "0, 2.0.0")
    assert sorted((r.introduced, r.fixed) for r in osv_ranges(raw).collect()) == [("0", "1.0.0"), ("2.0.0", None)]


def test_registry_licenses(spark):
    doc = {"versions": {v: {"license": lic} for v, lic in {"1": "MIT", "2": {"type": "GPL"}, "3": {"url": "u"}, "4": 5, "5": None, "6": ["MIT"]}.items()}}
    doc["versions"]["7"] = {"dependencies": {"a": "1", "b": "1"}, "devDependencies": {"a": "2"}, "dist": {"fileCount": 2}}
    got = {r.version: r for r in registry_snapshots(spark.createDataFrame([("p", json.dumps(doc))], "package STRING, json STRING")).collect()}
    assert {v: r.license for v, r in got.items()} == {"1": "MIT", "2": "GPL", "3": "unknown", "4": "unknown", "5": None, "6": "unknown", "7": None}
    assert got["7"].dependencies == {"a": "2", "b": "1"} and got["7"].files == ["file_0", "file_1"] and got["1"].files == []


def test_source_trees(spark, tmp_path):
    folder = tmp_path / "@s+lib@1.0.0" / "package" / "src"
    folder.mkdir(parents=True)
    (folder / "i.js").write_text("a\nb")
    got = sorted(tuple(r) for r in read_source_lines(spark, str(tmp_path)).collect())
    assert got == [("@s/lib", "1.0.0", "src/i.js", 1, "a"), ("@s/lib", "1.0.0", "src/i.js", 2, "b")]


def test_duplicates_inside_a_file_are_dropped_without_a_shuffle(spark):
    files = spark.createDataFrame([
        ("p", "requirements.txt", "a==1\nb==2\nA==3\n"), ("p", "go.mod", "require a v1\nrequire (\n b v1\n a v2 // indirect\n)\n"),
        ("p", "package.json", '{"dependencies":{"a":"1","b":"1"},"devDependencies":{"a":"2"}}'),
        ("p", "Pipfile.lock", '{"default":{"a-b":{"version":"==1"}},"develop":{"a.b":{"version":"==2"}}}'),
        ("p", "Cargo.toml", '[dependencies]\na = "1"\na.version = "0"\n[build-dependencies]\na = "2"\nb = "3"\n'),
        ("p", "pyproject.toml", '[tool.poetry.dependencies]\na = "1"\n[tool.poetry.group.dev.dependencies]\nA = "2"\n')],
        "project_id STRING, file_name STRING, content STRING")
    want = {
        python.requirements_packages: {("A", "3"), ("b", "2")}, golang.go_mod_packages: {("a", "2"), ("b", "1")},
        node.bun_manifest_packages: {("a", "2"), ("b", "1")}, python.pipfile_lock_packages: {("a.b", "2")},
        cargo.cargo_toml_packages: {("a", "2"), ("b", "3")}, python.pyproject_packages: {("a", "0.0.0")}}
    for reader, packages in want.items():
        rows = reader(files)
        assert sorted((r["name"], r["version"]) for r in rows.collect()) == sorted(packages), reader.__name__
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString(), reader.__name__
