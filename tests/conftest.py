import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from riskframe.session import build_session
    session = build_session("local[8]", 4, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g",
    })
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def rows(spark):
    """rows(schema, tuples...) -> DataFrame."""
    return lambda schema, *values: spark.createDataFrame(list(values), schema)


@pytest.fixture
def value(spark):
    """value(column expression over literals) -> Python value."""
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]
