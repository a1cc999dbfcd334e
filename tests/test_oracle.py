"""Every registered query with an oracle must return the oracle's rows."""

import pytest
from compare import DATA, compare, connect

from churnlake.plans.catalog import ORACLES, QUERIES

SF_DIR = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name]) == ""


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.queries().keys() >= QUERIES.keys()
    assert entry.oracle_sql().items() >= ORACLES.items()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    out = entry.entry(spark)
    assert out.columns == ["segment", "customers", "churn_rate", "mean_engagement_index"]
    assert out.count() == 5


def test_entry_without_the_training_data_operators(monkeypatch):
    import importlib.util
    import os
    import runpy

    monkeypatch.setattr(importlib.util, "find_spec", lambda name: None)
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "__spark_entry__.py")
    found = runpy.run_path(path)
    assert set(found["queries"]()) == set(QUERIES) and found["oracle_sql"]() == ORACLES
