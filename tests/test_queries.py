import pytest

import oracle
from lorekeep.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE_SQL:
        oracle.assert_same(con, df, catalog.ORACLE_SQL[name])
    else:
        assert df.columns and df.count() >= 0
