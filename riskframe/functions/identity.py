"""Package names, ecosystems, urls and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskframe.functions.severity import lookup

WHITESPACE = " \t\r\n\x0b\x0c"


def strip(text: Column) -> Column:
    """Trim blanks, tabs and line ends (plain `trim` only cuts blanks)."""
    return F.btrim(text, F.lit(WHITESPACE))


def empty_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def package_key(name: Column, version: Column, ecosystem: Column) -> Column:
    """Stable key of one package version, equal in every run."""
    return F.sha2(F.concat_ws("\u0001", name, version, ecosystem), 256)


def registry_ecosystem(ecosystem: Column) -> Column:
    return F.when(ecosystem.isin("nodejs", "bun"), "npm").otherwise(ecosystem)


# Canonical pages per advisory source and per ecosystem.
ADVISORY_PAGES = {
    "osv": "https://osv.dev/vulnerability/",
    "github": "https://github.com/advisories/",
    "nvd": "https://nvd.nist.gov/vuln/detail/",
    "mitre": "https://cve.mitre.org/cgi-bin/cvename.cgi?name=",
}


def advisory_url(source: Column, external_id: Column) -> Column:
    return F.concat(lookup(source, ADVISORY_PAGES), external_id)


def registry_url(ecosystem: Column, name: Column, version: Column) -> Column:
    """Package page; null where the registry url comes from the lock file itself."""
    return (
        F.when(ecosystem == "PyPI",
               F.concat(F.lit("https://pypi.org/project/"), name, F.lit("/"), version, F.lit("/")))
        .when(ecosystem == "Go",
              F.concat(F.lit("https://pkg.go.dev/"), name, F.lit("@"), version))
        .when(ecosystem == "crates.io",
              F.concat(F.lit("https://crates.io/crates/"), name, F.lit("/"), version))
    )


def normalize_pypi_name(name: Column) -> Column:
    return F.translate(F.lower(name), "-.", "__")


def strip_extras(spec: Column) -> Column:
    return strip(F.substring_index(spec, "[", 1))


def npm_name_from_key(key: Column, compat: bool = False) -> Column:
    """Name behind a lock key. `compat` drops the scope (`@a/b` gives `b`)."""
    if compat:
        return F.element_at(F.split(key, "/"), -1)
    return F.regexp_replace(key, r"^.*node_modules/", "")


def npm_depth(key: Column) -> Column:
    return F.regexp_count(key, F.lit("node_modules/"))


def _repo_path(url: Column) -> Column:
    bare = F.regexp_replace(strip(url), r"^(git\+)*(git://)*", "")
    bare = F.regexp_replace(bare, r"(\.git)+$", "")
    return empty_to_null(F.regexp_extract(bare, r"github\.com[/:]+(.*)$", 1))


def normalize_repo_url(url: Column) -> Column:
    """`https://github.com/<path>`, or null for any other host."""
    return F.concat(F.lit("https://github.com/"), _repo_path(url))


def owner_repo(url: Column) -> Column:
    """STRUCT<owner, repo>, or null unless both are present."""
    path = _repo_path(url)
    owner = empty_to_null(F.regexp_extract(path, r"^([^/]+)/([^/]+)", 1))
    repo = empty_to_null(F.regexp_extract(path, r"^([^/]+)/([^/]+)", 2))
    return F.when(owner.isNotNull(), F.struct(owner.alias("owner"), repo.alias("repo")))


def package_source_key(name: Column, version: Column) -> Column:
    """Directory name that holds the source of one package version."""
    return F.concat(F.replace(name, F.lit("/"), F.lit("+")), F.lit("@"), version)
