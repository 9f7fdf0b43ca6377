import pytest
from oracle import same

from tabflow import queries_checks as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    if name in Q.ORACLES:
        same(df, Q.ORACLES[name], sf)
    else:
        assert df.count() > 0


def test_entry(spark, sf):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
