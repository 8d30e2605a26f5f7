"""Every query against its SQL counterpart; those without one run and give rows."""

import compare
import pytest

from framewright.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connection(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.ORACLES:
        assert compare.compared(df, con, catalog.ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
