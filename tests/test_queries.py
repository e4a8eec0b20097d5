import os

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
CORE = [n for n in entry.queries() if n.startswith("q_")]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", CORE)
def test_query(spark, con, name):
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert entry.queries()[name](spark, SF).count() > 0
    else:
        assert difference(spark, con, SF, entry.queries()[name], sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_without_the_operators_of_the_training_pipeline():
    """Nothing else in the library imports them."""
    import pathlib

    for p in pathlib.Path(entry.__file__).parent.glob("wordloom/**/*.py"):
        if "llm" not in p.parts:
            assert "wordloom.llm" not in p.read_text()
