"""Every query that has an SQL text agrees with DuckDB; the contract's three functions fit together."""

import pytest
from compare import difference

import __spark_entry__ as contract
from devprism.registry import QUERIES

ORACLE = {name: text for name, text in contract.oracle_sql().items() if name in QUERIES}
SLOW = {"density_grid", "best_density", "developer_clusters", "developer_features", "spectral_grid", "topic_experiments", "issue_topics"}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, db, sf_dir, name):
    assert difference(QUERIES[name].run(spark, sf_dir), db, ORACLE[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE) - SLOW))
def test_without_sql(spark, sf_dir, name):
    assert QUERIES[name].run(spark, sf_dir).count() > 0


def test_contract():
    assert set(QUERIES) <= set(contract.queries())
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    flagship = contract.entry(spark)
    assert len(flagship.columns) == 35
    assert flagship.count() > 0
