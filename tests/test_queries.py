"""Every query of the catalogue against its SQL."""

import pytest

from tessera.plans import catalog
from tests.oracle import differs, expected

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    got = catalog.QUERIES[name](spark, SF).toPandas()
    assert len(got.columns)
    if name in catalog.ORACLE_SQL:
        assert not differs(got, expected(SF, catalog.ORACLE_SQL[name]))
