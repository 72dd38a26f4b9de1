"""Connected components against a union-find."""

from __future__ import annotations

import random

import pytest
from rows import components

from sparkloom.llm.components import connected_components


@pytest.mark.parametrize("kind", ["chain", "star", "random", "cliques"])
def test_components(spark, kind):
    rng = random.Random(3)
    edges = {
        "chain": [(k, k + 1) for k in range(120)],
        "star": [(0, k) for k in range(1, 200)],
        "random": [(rng.randrange(150), rng.randrange(150)) for _ in range(90)],
        "cliques": [(10 * c + i, 10 * c + j) for c in range(6) for i in range(10) for j in range(i)],
    }[kind]
    roots = components(300, edges)
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: roots[n] for n in nodes}


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([(None, 1), (2, 2)], "a long, b long")).collect() == []
