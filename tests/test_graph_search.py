"""Seeds, hops and what is told to be left out, against a plain search."""

from __future__ import annotations

import random

from sparkloom.operators.graph_search import RESULT, search_graph


def plain(nodes, edges, terms, seeds, hops, best):
    def points(label):
        words = "".join(c if c.isalnum() else " " for c in label.lower()).split()
        return sum(30 if label.lower() == t else 20 if t in words else 6 if t in label.lower() else 0 for t in terms)

    hits = sorted(((-points(label), n) for n, _, label in nodes if points(label)), key=lambda x: x)
    front = {n: -s for s, n in hits[:seeds]}
    found, steps, seen = {(0, n, s) for n, s in front.items()}, [(0, len(hits), len(hits) > seeds)], set(front)
    for hop in range(1, hops + 1):
        near: dict[str, int] = {}
        for a, b in [(a, b) for _, a, b in edges] + [(b, a) for _, a, b in edges]:
            if a in front and b not in seen and front[a] // 2 > 0:
                near[b] = max(near.get(b, 0), front[a] // 2)
        kept = sorted(((-s, n) for n, s in near.items()))[:best]
        front = {n: -s for s, n in kept}
        seen |= set(front)
        found |= {(hop, n, s) for n, s in front.items()}
        steps.append((hop, len(near), len(near) > best))
    return found, steps


def test_against_a_plain_search(spark):
    rng = random.Random(6)
    names = ["red box", "red", "big red-box", "box", "blue ring", "ring", "reddish", "green"]
    nodes = [(f"n{k:02d}", rng.choice("ab"), rng.choice(names)) for k in range(60)]
    edges = [(rng.choice("xy"), f"n{rng.randrange(60):02d}", f"n{rng.randrange(60):02d}") for _ in range(90)]
    given = spark.createDataFrame(nodes, "node string, kind string, label string"), spark.createDataFrame(edges, "kind string, source string, target string")
    for seeds, hops, best in ((4, 3, 5), (100, 1, 100), (1, 2, 1)):
        out = search_graph(*given, ["Red", "box"], seeds, hops, best).collect()
        found, steps = plain(nodes, edges, ["red", "box"], seeds, hops, best)
        assert {(r.hop, r.node, r.score) for r in out if r.part in ("match", "expansion")} == found
        assert sorted((r.hop, r.n, bool(r.score)) for r in out if r.part == "step") == steps
        assert sum(r.n for r in out if r.part == "node_kind") == 60 and sum(r.n for r in out if r.part == "edge_kind") == 90
        assert all(r.reached_from for r in out if r.part == "expansion")


def test_no_match_and_empty_tables(spark):
    nodes, edges = spark.createDataFrame([("a", "k", "red")], "node string, kind string, label string"), spark.createDataFrame([], "kind string, source string, target string")
    out = search_graph(nodes, edges, ["none"]).collect()
    assert out[0].__fields__ == RESULT and not [r for r in out if r.part in ("match", "expansion")]
    assert [r.n for r in search_graph(nodes.limit(0), edges, ["red"]).collect() if r.part == "step"] == [0, 0, 0]
