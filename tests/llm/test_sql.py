"""The queries that SQL can express, against it."""

from __future__ import annotations

import pytest
from compare import assert_same

from sparkloom.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])
