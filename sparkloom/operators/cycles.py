"""Nodes on cycles, exactly, with the least node of each strongly connected component as its witness.

Edges shrink in turns: nodes without incoming or without outgoing edges go; chains of nodes with one edge in and one out become single edges, by pointers that double their reach each
round, so that a chain of any length takes logarithmically many; a ring of such nodes alone is a component. What can't shrink is coloured: the largest node that reaches a node is its
colour, and the nodes of a colour that reach its node are that node's component; with these gone, the rest shrinks again. At last chains come back in reverse order: their nodes
are on a cycle if both ends are in one component. Rounds of colouring grow with the diameter of the dense core only. Every step is written to the shared folder and deleted when no later one reads it.

Defined results: null ends are no edges; repeated edges count once; a node with an edge to itself is on a cycle; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def _peeled(edges: DataFrame) -> DataFrame:
    """Edges without those that start where none ends, or end where none starts; repeated until a round takes few."""
    count = edges.count()
    while count:
        kept = written(edges.join(edges.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(edges.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t"), "cycle-edges")
        dropped(edges)
        edges, before, count = kept, count, kept.count()
        if before - count <= before // 10:
            break
    return edges


def _ends(steps: DataFrame, rounds: int) -> DataFrame:
    """For each node of steps (v, to, least): what to leads to by pointers that double, and the least node passed; pointers that still lead to nodes of steps after the rounds run in rings."""
    for _ in range(rounds):
        ahead = steps.select(F.col("v").alias("to"), F.col("to").alias("_to"), F.col("least").alias("_least"))
        new = written(steps.join(ahead, "to", "left").select("v", F.coalesce("_to", "to").alias("to"), F.least("least", "_least").alias("least"), F.col("_to").isNotNull().alias("moved")), "cycle-steps")
        moved = not new.where("moved").limit(1).isEmpty()
        steps = new.drop("moved")
        if not moved:
            break
    return steps


def _chains(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(edges with chains as single ones, chains: v, head, tail, rings: node, component); None if there is nothing to shorten."""
    outs = edges.groupBy(F.col("s").alias("v")).agg(F.count("*").alias("o"), F.max("t").alias("next"))
    ins = edges.groupBy(F.col("t").alias("v")).agg(F.count("*").alias("i"), F.max("s").alias("last"))
    inner = written(outs.where("o = 1").join(ins.where("i = 1"), "v").select("v", "next", "last"), "cycle-inner")
    n = inner.count()
    if not n:
        dropped(inner)
        return None
    rounds = n.bit_length() + 1
    ahead = _ends(inner.select("v", F.col("next").alias("to"), F.least("v", "next").alias("least")), rounds)
    back = _ends(inner.select("v", F.col("last").alias("to"), F.col("v").alias("least")), rounds)
    names = inner.select(F.col("v").alias("to"))
    rings = written(ahead.join(names, "to", "left_semi").select(F.col("v").alias("node"), F.col("least").alias("component")), "cycle-rings")
    chains = written(ahead.join(names, "to", "left_anti").select("v", F.col("to").alias("tail")).join(back.select("v", F.col("to").alias("head")), "v"), "cycle-chains")
    inside = inner.select("v")
    direct = edges.join(inside.withColumnRenamed("v", "s"), "s", "left_anti").join(inside.withColumnRenamed("v", "t"), "t", "left_anti").select("s", "t")
    short = written(direct.unionByName(chains.select(F.col("head").alias("s"), F.col("tail").alias("t"))).distinct(), "cycle-edges")
    dropped(inner, edges)
    return short, chains, rings


def _coloured(edges: DataFrame) -> DataFrame:
    """node, component of the strongly connected components that hold the largest node of their colour."""
    nodes = edges.select(F.col("s").alias("node")).unionByName(edges.select(F.col("t").alias("node"))).distinct()
    colour = written(nodes.select("node", F.col("node").alias("colour")), "cycle-colours")
    while True:
        sent = edges.join(colour.withColumnsRenamed({"node": "s", "colour": "sent"}), "s").groupBy(F.col("t").alias("node")).agg(F.max("sent").alias("sent"))
        new = written(colour.join(sent, "node", "left").select("node", F.greatest("colour", "sent").alias("colour"), (F.col("sent") > F.col("colour")).alias("moved")), "cycle-colours")
        moved = not new.where("moved").limit(1).isEmpty()
        dropped(colour)
        colour = new
        if not moved:
            break
    own = colour.select("node", "colour")
    within = written(edges.join(own.withColumnsRenamed({"node": "s", "colour": "cs"}), "s").join(own.withColumnsRenamed({"node": "t", "colour": "ct"}), "t").where("cs = ct").select("s", "t"), "cycle-within")
    held = written(own.where("node = colour"), "cycle-held")
    fresh = held
    while True:
        more = within.join(fresh.withColumnsRenamed({"node": "t"}).select("t", "colour"), "t").select(F.col("s").alias("node"), "colour").distinct().join(held.select("node"), "node", "left_anti")
        fresh = written(more, "cycle-fresh")
        if fresh.isEmpty():
            break
        held = written(held.unionByName(fresh), "cycle-held")
    dropped(within, colour)
    return held.select("node", F.col("colour").alias("component"))


def cycle_components(edges: DataFrame) -> DataFrame:
    """node, component (the least node of its strongly connected component) of every node of edges (source, target) that lies on a cycle."""
    left = written(edges.select(F.col("source").alias("s"), F.col("target").alias("t")).where("s IS NOT NULL AND t IS NOT NULL").distinct(), "cycle-edges")
    kind = left.schema["s"].dataType.simpleString()
    known = written(left.where("s = t").select(F.col("s").alias("node"), F.col("s").alias("component")), "cycle-known")
    chains: list[DataFrame | None] = []  # chains to bring back; None where loops have been added
    parts = [known]
    loops: list[DataFrame] = []
    left = written(left.where("s <> t"), "cycle-edges")
    while not left.isEmpty():
        left = _peeled(left)
        if left.isEmpty():
            break
        shorter = _chains(left)
        if shorter is not None:
            left, chain, ring = shorter
            parts.append(ring)
            loops.append(written(left.where("s = t").select(F.col("s").alias("node"), F.col("s").alias("component")), "cycle-loops"))
            chains.append(chain)
            left = written(left.where("s <> t"), "cycle-edges")
            continue
        found = written(_coloured(left), "cycle-found")
        # Nodes that form a component by themselves lie on no cycle of two nodes or more.
        parts.append(found.join(found.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component"), "component", "left_semi").select("node", "component"))
        gone = found.select("node")
        left = written(left.join(gone.withColumnRenamed("node", "s"), "s", "left_anti").join(gone.withColumnRenamed("node", "t"), "t", "left_anti").select("s", "t"), "cycle-edges")
    # A node may be its own loop and in a larger component; the larger one stands.
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    whole = written(whole, "cycle-whole")
    for chain, loop in zip(reversed(chains), reversed(loops)):
        whole = whole.unionByName(loop)
        best = _one(whole)
        head, tail = (best.select(F.col("node").alias(n), F.col("component").alias(f"c_{n}")) for n in ("head", "tail"))
        back = chain.join(head, "head").join(tail, "tail").where("c_head = c_tail").select(F.col("v").alias("node"), F.col("c_head").alias("component"))
        whole = written(whole.unionByName(back), "cycle-whole")
    best = _one(whole)
    least = best.groupBy("component").agg(F.min("node").alias("least"))
    return best.join(least, "component").select(F.col("node").cast(kind), F.col("least").cast(kind).alias("component"))


def _one(rows: DataFrame) -> DataFrame:
    """A component for each node: another one than the node itself, where there is one."""
    own = rows.withColumn("self", F.col("node") == F.col("component"))
    return own.groupBy("node").agg(F.coalesce(F.max(F.when(~F.col("self"), F.col("component"))), F.max("component")).alias("component"))
