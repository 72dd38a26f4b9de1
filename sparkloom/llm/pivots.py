"""Embedding near-duplicates through a pivot-permutation index (operator 9).

A vector is described by its nearest reference points, in order of nearness. Vectors with enough reference points in
common are candidates, and candidates are verified by their cosine in double precision. Reference points are
a bounded sample (``pivot_count``: about the square root of the number of vectors, 64 to 4096); every vector is
indexed. Inverted lists are kept for a label and a pivot; since a pair must have ``shared`` of ``nearest``
pivots in common, a vector need be listed only under its nearest - shared + 1 rarest ones. A list of more than ``long_list`` vectors is parted by
the second pivot in common, so that lists stay short when there are many more vectors than pivots. A list is compared in blocks of ``block``
rows by matrix products; a pair counts in the list of its rarest common pivot (and its second rarest) only, and what leaves a block is a count
for each vector and a spanning forest of its links, never the pairs. Long lists become more blocks, not longer tasks.

Recall comes from how often near vectors share pivots; ``recall()`` measures it against brute force (tests hold it over 0.9).

Defined results: a vector that is null, empty, zero, or has null or non-finite components, or whose label is null, links with
nothing; vectors of different lengths never link; equal vectors of a label are one class, and count as links of each other;
repeated vec_ids are separate vectors; a null vec_id takes part but cannot be the component's name unless all are null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import dropped, sendable, with_columns, written


def pivot_count(n: int) -> int:
    return int(min(4096, max(64, 1 << int(max(n, 1) ** 0.5).bit_length())))


def unit_rows(column: pa.Array) -> np.ndarray:
    """Rows of equal length as unit vectors in double precision."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, nearest: int) -> np.ndarray:
    """Each row's nearest pivots, nearest first; only the coordinates that both have are compared."""
    d = min(x.shape[1], pivots.shape[1])
    near = x[:, :d] @ pivots[:, :d].T
    m = min(nearest, near.shape[1])
    top = np.argpartition(-near, m - 1, axis=1)[:, :m]
    return np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)


def describe(classes: DataFrame, pivots: np.ndarray, nearest: int) -> DataFrame:
    """Adds pivots: the ordered nearest reference points."""
    shared = classes.sparkSession.sparkContext.broadcast(pivots)  # at most 4096 vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("embedding")
            size = np.diff(v.offsets.to_numpy())
            out = np.zeros((batch.num_rows, min(nearest, len(shared.value))), np.int32)
            for d in np.unique(size):
                rows = np.flatnonzero(size == d)
                out[rows] = nearest_pivots(unit_rows(v.take(pa.array(rows))), shared.value, nearest)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * out.shape[1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "pivots"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in classes.dtypes)
    return classes.mapInArrow(run, f"{kinds}, pivots array<int>")


def block_links(rows: pa.Table, rank: np.ndarray, least: float, shared: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(links of each row, ends of a forest) inside one pair of blocks of one list."""
    n = rows.num_rows
    pivot, second, side = rows.column("pivot")[0].as_py(), rows.column("second")[0].as_py(), rows.column("side").to_numpy()
    x = unit_rows(rows.column("embedding").combine_chunks())
    names = rows.column("pivots").combine_chunks().flatten().to_numpy().reshape(n, -1)
    # Only pivots that more than one row has can be shared.
    held, at, times = np.unique(names, return_inverse=True, return_counts=True)
    has = np.zeros((n, len(held)), np.float32)
    np.put_along_axis(has, at.reshape(names.shape), 1, axis=1)
    has, order = has[:, times > 1], rank[held[times > 1]]
    earlier = order < rank[pivot]
    if second >= 0:
        earlier |= (order > rank[pivot]) & (order < rank[second])
    rarer = has[:, earlier]
    link = (has @ has.T >= shared) & (rarer @ rarer.T == 0) & (x @ x.T >= least)
    np.fill_diagonal(link, False)
    if side.any():  # two blocks: only pairs across
        link &= side[:, None] != side[None, :]
    copies = rows.column("copies").to_numpy().astype(np.int64)
    count = link @ copies
    busy = np.flatnonzero(link.any(axis=1))
    part, label = link[np.ix_(busy, busy)], np.arange(len(busy))
    while len(busy):
        new = np.minimum(label, np.where(part, label[None, :], len(busy)).min(axis=1))
        new = new[new]
        if (new == label).all():
            break
        label = new
    return count, busy, busy[label]


def near_vectors(
    vectors: DataFrame,
    least: float = 0.98,
    nearest: int = 8,
    shared: int = 3,
    pivots: int | None = None,
    block: int = 1024,
    long_list: int = 65_536,
    hot_copies: int = 10_000,
) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    rows = with_columns(vectors, "vec_id", "embedding", "label")
    sound = F.expr("label IS NOT NULL AND embedding IS NOT NULL AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf')) AND exists(embedding, x -> x <> 0)")
    rows = written(rows.withColumn("key", F.when(sound, F.struct("label", "embedding"))), "vectors")
    classes = written(
        rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least_id")).select(F.monotonically_increasing_id().alias("cls"), "key", "copies", "least_id"),
        "vector-classes",
    )
    n = classes.count()
    count = pivots or pivot_count(n)
    picks = classes.select("key.embedding").orderBy(F.xxhash64("key.embedding"), "key.embedding").limit(count).collect()  # at most 4096 vectors
    if not picks:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    width = max(len(p.embedding) for p in picks)
    refs = np.zeros((len(picks), width))
    for k, p in enumerate(picks):
        refs[k, : len(p.embedding)] = unit_rows(pa.array([p.embedding]))[0]
    m = min(nearest, len(refs))
    need = min(shared, m)
    indexed = written(describe(classes.select("cls", "key.embedding", "key.label", "copies"), refs, m), "vector-index")
    frequency = np.zeros(len(refs), np.int64)
    for r in indexed.select(F.explode("pivots").alias("p")).groupBy("p").agg(F.count("*").alias("n")).collect():
        frequency[r.p] = r.n
    rank = np.empty(len(refs), np.int64)
    rank[np.argsort(frequency, kind="stable")] = np.arange(len(refs))
    ranks = F.array(*[F.lit(int(x)) for x in rank])
    by_rarity = F.array_sort(F.transform("pivots", lambda p: F.struct(F.get(ranks, p).alias("r"), p.alias("p"))))
    keys = ["label", "dim", "pivot"]
    ordered = F.transform(by_rarity, lambda s: s["p"])
    listed = indexed.withColumn("dim", F.size("embedding")).withColumn("_order", ordered).select("*", F.posexplode(F.slice("_order", 1, m - need + 1)).alias("_at", "pivot"))
    counted = written(listed.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("long", F.col("_n") > long_list if need > 1 else F.lit(False)).drop("_n"), "vector-lists")
    # In a long list, vectors meet under the second pivot that they may have in common, too.
    later = F.slice("_order", F.col("_at") + 2, F.greatest(F.lit(m - need + 1) - F.col("_at"), F.lit(0)))
    listed = listed.join(sendable(counted), keys).withColumn("second", F.explode(F.when(F.col("long"), later).otherwise(F.array(F.lit(-1))))).drop("_order", "_at", "long")
    keys.append("second")
    lists = written(listed.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "vector-lists")
    own = F.pmod(F.xxhash64("cls"), "blocks").cast("int")
    meet = (
        listed.join(sendable(lists), keys)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("b1", F.least("own", "other"))
        .withColumn("b2", F.greatest("own", "other"))
        .withColumn("side", (F.col("own") > F.col("b1")).cast("int"))
        .select(*keys, "b1", "b2", "side", "cls", "embedding", "pivots", "copies")
    )

    def compare(table: pa.Table) -> pa.Table:
        count, a, b = block_links(table, rank, least, need)
        cls = table.column("cls").to_numpy()
        hit = np.flatnonzero(count)
        tie = a != b
        return pa.table({"a": np.concatenate([cls[hit], cls[a[tie]]]), "b": np.concatenate([cls[hit], cls[b[tie]]]), "n": np.concatenate([count[hit], np.zeros(int(tie.sum()), np.int64)])})

    found = written(meet.groupBy(*keys, "b1", "b2").applyInArrow(compare, "a long, b long, n long"), "vector-links")
    counts = found.groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("n"))
    roots = connected_components(found.where("a <> b").select("a", "b")).withColumnRenamed("node", "cls")
    named = classes.select("cls", "key", "copies", "least_id").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")).join(counts, "cls", "left")
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    facts = written(named.join(names, "root").select("key", "copies", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "vector-facts")
    # Vectors with very many copies, of which there are few, are looked up where the rows are; only the others are shuffled by their value.
    hot = sendable(facts.where(F.col("copies") >= hot_copies).drop("copies").withColumn("hot", F.lit(True)), most=10_000)
    spread = rows.where("key IS NOT NULL").select("vec_id", "key").join(hot, "key", "left")
    cold = spread.where("hot IS NULL").select("vec_id", "key").join(facts.where(F.col("copies") < hot_copies), "key")
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    told = ["vec_id", "n_links", "component_id"]
    out = spread.where("hot").select(*told).unionByName(cold.select(*told)).unionByName(alone)
    out = written(out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vectors-out")
    dropped(rows, classes, indexed, found, facts, counted, lists)
    return out


def recall(vectors: DataFrame, found: DataFrame, least: float = 0.98) -> float:
    """Share of brute force's links that were found; for tables that fit in one process (tests, measurement)."""
    v = vectors.select("vec_id", "embedding", "label").toPandas()
    got = found.select("vec_id", "n_links").toPandas()["n_links"].sum()
    total = 0
    for _, g in v.groupby("label"):
        x = unit_rows(pa.array(g["embedding"].tolist()))
        total += int((x @ x.T >= least).sum()) - len(x)
    return got / total if total else 1.0
