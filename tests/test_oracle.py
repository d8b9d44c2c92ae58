"""Every query with a SQL counterpart returns the same rows; the others return rows."""

import pytest

from slotwise.plans import ORACLES, QUERIES
from tests.compare import compare, connect

SLOW = {"ml_random_forest", "ml_importance", "ev_model_comparison", "ml_k_sweep"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, sf, con, name):
    result = compare(spark, name, QUERIES[name], ORACLES.get(name), sf, con)
    assert result.startswith(("ok", "rows-only")), result


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 24 and "pct_empty" in df.columns
