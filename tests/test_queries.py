import pytest

import __spark_entry__ as entry_module
from tests.oracle import compare
from veilframe.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, name):
    compare(spark, name, catalog.QUERIES[name], catalog.ORACLE_SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).columns


def test_entry(spark):
    rows = entry_module.entry(spark).collect()
    assert {r.category for r in rows} >= {"email", "credit_card"}
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
