"""Connected components of a link table: forests inside the tasks, then alternating star contraction; nothing is collected."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for each node that links (a, b) tie to a smaller one: the components of these links alone."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while ((up := label[label]) != label).any():
            label = up
    tied = label != np.arange(len(nodes))
    return nodes[label[tied]], nodes[tied]


def _contracted(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """The links that a task reads, ``most`` at a time, as forests: paths inside it are gone before anything is shuffled."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        ends = forest(*(np.concatenate([x[k] for x in held]) for k in (0, 1)))
        return pa.RecordBatch.from_arrays(list(map(pa.array, ends)), ["a", "b"])

    for batch in batches:
        held.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n >= most:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones, or smaller ones and itself) are tied to the least of all its neighbours."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        tied = both.join(least, "u").where("v > u").select(F.col("v").alias("b"), F.col("m").alias("a"))
    else:
        least = edges.groupBy("b").agg(F.min("a").alias("m"))
        tied = edges.join(least, "b")
        tied = tied.select(F.col("a").alias("b"), F.col("m").alias("a")).unionByName(least.select("b", F.col("m").alias("a")))
    return tied.where("a < b").select("a", "b").distinct()


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of edges (a, b): root is the smallest node that links reach.

    Self-links, repeated links and both directions are welcome; links with a null end are left out. Each round is written to the
    shared folder; the number of rounds grows with the logarithm of the longest chain.
    """
    clean = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"))
    now, mark = written(clean, "links"), None
    for _ in range(most_rounds):
        new = written(_star(_star(now.mapInArrow(_contracted, "a long, b long"), large=True), large=False), "links")
        dropped(now)
        now = new
        was, mark = mark, now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if was == mark:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
