"""Every registered query against its SQL at the smallest scale."""

import pytest
from oracle import assert_equal

from weftline import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    df = catalog.queries()[name](spark, FOLDER)
    if name in catalog.oracle_sql():
        assert_equal(df, catalog.oracle_sql()[name], FOLDER)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 20
    assert set(catalog.queries()) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
