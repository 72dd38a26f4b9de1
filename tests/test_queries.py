"""Every query of the library's own operators against its SQL on the driver tables."""

from __future__ import annotations

import pytest
from compare import assert_same

from sparkloom.plans import catalog, checks, flows, identity  # noqa: F401  register their queries
from sparkloom.plans.queries import ORACLE_SQL, QUERIES


#: Queries that SQL cannot express; each has a test of its own.
WITHOUT_SQL = {"merged_nodes"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL))
def test_query_equals_sql(name, spark, sf_dir, duck):
    assert name in ORACLE_SQL, "a query without SQL needs a test of its own"
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def test_entry_has_every_query():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_query_runs(spark, sf_dir):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_merged_nodes_equal_a_plain_version(spark, sf_dir):
    got = {(r.kind, r.node_id): r.canonical_id for r in QUERIES["merged_nodes"](spark, sf_dir).collect()}
    owner, want = {}, {}
    for r in sorted(spark.read.parquet(f"{sf_dir}/part.parquet").collect(), key=lambda r: (r.p_name, str(r.p_partkey))):
        names = [(r.p_brand, x) for x in {r.p_name, r.p_type}]
        own = min((want[owner[n]] for n in names if n in owner), default=str(r.p_partkey))
        want[r.p_brand, str(r.p_partkey)] = own
        for n in names:
            owner.setdefault(n, (r.p_brand, str(r.p_partkey)))
    assert got == want
