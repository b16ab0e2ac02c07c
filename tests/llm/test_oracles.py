"""The registered queries that SQL can express, compared as the driver does; and that no broken module hides them."""

import pytest

from tests.oracle import compare
from veilframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, name):
    compare(spark, name, QUERIES[name], ORACLE_SQL[name], "/root/testdata/sf0.001")
