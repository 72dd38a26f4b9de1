"""Search in a graph: scored seeds, bounded widening over edges with the best of each hop, an overview, and what was left out.

Only the first ``seeds`` matches and the first ``best`` nodes of each hop go on, so what a hop sends to the edges is bounded by these; edges themselves are only filtered by a join
with it. How many candidates each step had is told, so that a short answer can be told from a cut one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import search
from .graph import overview
from .shared import written

RESULT = ["part", "hop", "node", "kind", "label", "score", "reached_from", "n"]


def _rows(rows: DataFrame, part: str, hop: int | None = None) -> DataFrame:
    """rows as result rows; columns that they lack are null."""
    kinds = {"hop": "int", "node": "string", "kind": "string", "label": "string", "score": "long", "reached_from": "string", "n": "long"}
    held = {"hop": F.lit(hop), **{c: F.col(c) for c in rows.columns if c in kinds}}
    return rows.select(F.lit(part).alias("part"), *[held.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()])


def search_graph(nodes: DataFrame, edges: DataFrame, terms: Sequence[str], seeds: int = 10, hops: int = 2, best: int = 20, fields: Sequence[str] = ()) -> DataFrame:
    """part, hop, node, kind, label, score, reached_from, n over nodes (node, kind, label) and edges (kind, source, target).

    Parts: node_kind and edge_kind (the overview, with n), match (hop 0), expansion (hop 1 and on: a neighbour has half the score, rounded down, of the best node that leads to it; the least such node is told), and
    step (one row a hop: n candidates, score 1 if some of them were left out). Edges lead both ways; a node is in one hop only; equal scores go by node.
    """
    facts = nodes.select(F.col("node").cast("string").alias("node"), "kind", "label", *fields)
    links = edges.select(F.col("source").cast("string").alias("node"), F.col("target").cast("string").alias("other")).unionByName(edges.select(F.col("target").cast("string").alias("node"), F.col("source").cast("string").alias("other")))
    order = [F.desc("score"), F.asc("node")]
    hits = search.score(facts, [t.lower() for t in terms], "label", fields or ["label"]).select("node", "kind", "label", F.col("score").cast("long").alias("score"))
    kept = written(hits.orderBy(*order).limit(seeds), "graph-seeds")
    view = overview(nodes, edges)
    out = _rows(view.where("what = 'node'").select("kind", "n"), "node_kind").unionByName(_rows(view.where("what = 'edge'").select("kind", "n"), "edge_kind"))
    out = out.unionByName(_rows(kept, "match", 0)).unionByName(_rows(hits.agg(F.count("*").alias("n"), (F.count("*") > seeds).cast("int").alias("score")), "step", 0))
    seen = front = kept.select("node", "score")
    for hop in range(1, hops + 1):
        # front has at most max(seeds, best) rows.
        near = links.join(F.broadcast(front), "node").select(F.col("other").alias("node"), F.expr("score div 2").alias("score"), F.col("node").alias("reached_from")).where("score > 0")
        fresh = near.join(F.broadcast(seen.select("node")), "node", "left_anti").groupBy("node").agg(F.max(F.struct("score")).alias("top"), F.min_by("reached_from", F.struct(-F.col("score"), F.col("reached_from"))).alias("reached_from"))
        reached = written(fresh.select("node", "top.score", "reached_from"), "graph-reached")
        front = written(reached.orderBy(*order).limit(best), "graph-front")
        named = front.join(facts.select("node", "kind", "label"), "node", "left")
        out = out.unionByName(_rows(named, "expansion", hop)).unionByName(_rows(reached.agg(F.count("*").alias("n"), (F.count("*") > best).cast("int").alias("score")), "step", hop))
        seen = seen.unionByName(front.select("node", "score"))
        front = front.select("node", "score")
    return out.select(*RESULT)
