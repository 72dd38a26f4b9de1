"""Strongly connected components against a plain search."""

from __future__ import annotations

import random

import pytest

from sparkloom.operators.cycles import cycle_components


def table(spark, edges):
    return spark.createDataFrame(edges, "source long, target long")


def expected(edges) -> list[tuple[int, int]]:
    ahead: dict[int, set[int]] = {}
    for a, b in edges:
        if a is not None and b is not None:
            ahead.setdefault(a, set()).add(b)
    reach = {}
    for n in {x for e in edges for x in e if x is not None}:
        seen, stack = set(), list(ahead.get(n, ()))
        while stack:
            x = stack.pop()
            if x not in seen:
                seen.add(x)
                stack += ahead.get(x, ())
        reach[n] = seen
    return sorted((n, min(m for m in reach[n] if n in reach[m])) for n in reach if n in reach[n])


def found(spark, edges):
    return sorted(map(tuple, cycle_components(table(spark, edges)).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    n = rng.choice([8, 15, 30])
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(int(n * rng.choice([0.9, 1.3, 2])))]
    assert found(spark, edges) == expected(edges)


def test_rings_loops_chains_between_cycles_and_nulls(spark):
    edges = [(1, 2), (2, 3), (3, 1)] + [(3, 10), (10, 11), (11, 12), (12, 20)] + [(20, 21), (21, 20), (20, 20)] + [(30, 30), (30, 31)] + [(None, 1), (1, None), (1, 2)] + [(40, 41), (41, 42), (42, 43), (43, 40), (41, 44), (44, 43)]
    assert found(spark, edges) == expected([e for e in edges]) and {n for n, _ in found(spark, edges)} == {1, 2, 3, 20, 21, 30, 40, 41, 42, 43, 44}


def test_a_chain_of_a_hundred_thousand_is_no_cycle_and_a_ring_of_it_is_one(spark):
    chain = spark.range(100_000).selectExpr("id AS source", "id + 1 AS target")
    assert cycle_components(chain).count() == 0
    ring = chain.unionByName(spark.createDataFrame([(100_000, 0), (100_000, 200_000), (200_000, 100_000)], "source long, target long"))
    out = cycle_components(ring)
    assert out.count() == 100_002 and out.where("component <> 0").count() == 0


def test_empty(spark):
    assert found(spark, []) == []
