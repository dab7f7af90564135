"""Every registered query with an oracle matches DuckDB on sf0.001."""
import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL
from oracle_check import compare, duck

ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    res = compare(df, con, ORACLES[name])
    assert res["ok"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 20
    assert df.columns[:3] == ["tenant_id", "tenant_name", "plant_location"]


def test_every_query_has_callable():
    qs = entry.queries()
    assert set(ORACLES) <= set(qs)
    assert len(qs) >= 80
