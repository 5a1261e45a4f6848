"""Every registered query against its SQL, on the smallest test tables."""

import pytest
from compare import duck, mismatch

from tidepanel.catalog import learning
from tidepanel.catalog.registry import registry
from tidepanel.operators.learn import LearnerParams

LEARNING = learning.QUERIES
SF = "/root/testdata/sf0.001"
CHECKED = [name for name, query in registry().items() if query.sql is not None]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, con, name):
    query = registry()[name]
    problem = mismatch(query.run(spark, SF), con, query.sql)
    # A filter on months may leave nothing of the smallest tables; both sides agree on that.
    assert problem in (None, "no rows at all"), problem


# The jobs of many models are tested at small sizes with their operators.
MANY = ("grid_cv", "repeat_trial", "stratified_cv", "bagging", "stacking", "score_and_rank", "param_sweep")


@pytest.mark.parametrize("name", [n for n in LEARNING if LEARNING[n].sql is None and n not in MANY])
def test_learning_query_runs(spark, monkeypatch, name):
    monkeypatch.setattr(learning, "FULL", LearnerParams(iterations=3, depth=3, border_count=32, learning_rate=0.3))
    assert registry()[name].run(spark, SF).count() > 0


def test_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.queries()) >= 140
