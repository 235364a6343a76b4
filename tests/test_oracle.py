"""Every registered query of the engine against its SQL."""

import os

import pytest
from oracle import connect, duck_rows, spark_rows

from quillon import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, con, name):
    found = spark_rows(queries.QUERIES[name](spark, SF))
    if name in queries.ORACLE:
        assert found == duck_rows(con, queries.ORACLE[name])
    else:
        assert found[1]


def test_entry_has_a_stable_schema(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["_id", "total", "n"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
