import pytest

import __spark_entry__ as entry
from oracle_check import TESTDATA, compare, connect

SF = TESTDATA / "sf0.001"
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_equivalent_has_a_query():
    assert set(ORACLE) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, str(SF)), con, ORACLE[name]) == ""
