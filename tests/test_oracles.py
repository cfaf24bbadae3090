import pytest

import __spark_entry__ as entry
from oracle import compare, connect

SF = "/root/testdata/sf0.001"
CHECKED = [n for n in entry.catalogue.QUERIES]


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    sql = entry.oracle_sql().get(name)
    if sql:
        assert compare(df, db, sql) == ""
    else:
        assert df.count() > 0
