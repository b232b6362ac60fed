"""Every query with SQL against DuckDB, over whole tables."""

import pytest

from tessera.plans.oracles import ORACLES
from tessera.plans.queries import QUERIES
from tests.comparing import connect, rows


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_names():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, sf, con, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = con.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
