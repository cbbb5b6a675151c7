"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from catalog import QUERIES, SQL
from tests.check_queries import TESTDATA, compare, connect

SF_DIR = f"{TESTDATA}/sf0.001"
# No row of the smallest tables qualifies; larger ones have some.
EMPTY = {"page_secrets"}


@pytest.fixture(scope="module")
def twin():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_equals_its_twin(spark, twin, name):
    verdict, _, rows = compare(spark, twin, name, SF_DIR)
    assert verdict == ("ok, but empty" if name in EMPTY else "ok")


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    assert df.count() == 200 and "final_score" in df.columns
    assert set(entry.queries()) >= set(entry.oracle_sql())
