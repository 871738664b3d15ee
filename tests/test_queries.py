"""Every query with SQL gives the rows that the SQL gives."""

import pytest
from compare import connection, rows

from slicelake import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, con, name):
    own = catalog.QUERIES[name](spark, SF).toPandas()
    sql = con.execute(catalog.ORACLES[name]).df()
    assert sorted(own.columns) == sorted(sql.columns)
    assert rows(own) == rows(sql)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0
