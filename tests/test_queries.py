"""Every registered query against its SQL."""

import pytest

from spanlake.plans import registry
from tests.conftest import SMALL, same_rows


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, SMALL)
    if name in registry.SQL:
        same_rows(df, registry.SQL[name], SMALL)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(registry.QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
