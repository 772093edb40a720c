"""Every registered query of the core runs at the smallest scale and equals its SQL."""

import pytest
from conftest import SMALL, same_rows

from cadenza.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    if name in ORACLE_SQL:
        same_rows(df, ORACLE_SQL[name], SMALL)
    else:
        assert df.count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
