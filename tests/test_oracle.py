import pytest

from sparkloom.registry import ORACLES, QUERIES
from tests.oracle import SF, connect, rows

CONNECTION = connect()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(got) > 0
        return
    want = CONNECTION.sql(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
