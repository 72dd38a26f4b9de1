"""Hard negatives by product quantisation with exact bounds (operator 11).

Components are integers, floor(256 x). A row is stored as a code (one centroid for each ``SUB`` coordinates), the norm of its residual, and its integers. For an
anchor a, the table of inner products of a with all centroids gives a row's score up to the residual: |score - looked up| <= |a| |residual|. Centroids are integers,
too, and all sums stay below 2^53, so that looked-up scores are exact and nothing depends on rounding; the bound alone is rounded, upwards.

Search is in blocks: rows lie in blocks of about ``block`` rows by a hash, anchors in blocks of ``anchor_block``; every block of rows meets every block of anchors in
one task, which keeps what can be among the first: positives are the rows whose upper bound is not below the ``k``-th best lower bound; a window's negatives
those whose bounds reach into the window and whose upper bound is not below the ``k``-th best lower bound of rows that lie in it for certain. What is left is scored
exactly, and each block hands on at most k rows a window; the first k of all blocks are taken after that. No label, value or anchor is a group of its own, so a
label or a vector that a third of all rows have makes no longer task.

Centroids are fitted on at most ``sample`` rows, chosen by a hash, of each of the ``MOST_WIDTHS`` commonest lengths of vectors; vectors of other lengths have no code, and
their bound is that of Cauchy and Schwarz alone. Results don't depend on the centroids.

Defined results: rows with a null label, a null or empty vector, null or non-finite components, or an integer square sum beyond 2^50 (their scores would not
stay exact) take no part; vectors of different lengths never meet; repeated vec_ids are separate rows, and a row is not its own positive but its copy is; among equal scores
the smaller vec_id is first, a null one last; windows of negative positives are empty; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, small_batches, tidy, with_columns, written

SUB = 2
CENTROIDS = 256
MOST_WIDTHS = 16
LIMIT = 1 << 50
_CHUNK = 128  # anchors whose tables and scores a task holds at once
_NO_ID = np.iinfo(np.int64).max


def parts(width: int) -> list[slice]:
    """The coordinates of each part of a code."""
    return [slice(k, min(k + SUB, width)) for k in range(0, width, SUB)]


def fit(sample: np.ndarray, rounds: int = 6, centroids: int = CENTROIDS) -> np.ndarray:
    """Integer centroids (part, centroid, SUB), by a few rounds of k-means in each part; the last part may be padded with zeros."""
    n, width = sample.shape
    book = np.zeros((len(parts(width)), centroids, SUB))
    for p, at in enumerate(parts(width)):
        x = sample[:, at].astype(np.float64)
        c = np.unique(x, axis=0)
        c = c[np.linspace(0, len(c) - 1, min(centroids, len(c))).astype(int)]
        for _ in range(rounds):
            own = nearest(x, c)
            size = np.bincount(own, minlength=len(c))
            c = np.stack([np.bincount(own, x[:, d], len(c)) for d in range(x.shape[1])], 1) / np.maximum(size, 1)[:, None]
        book[p, : len(c), : c.shape[1]] = np.rint(c)
        book[p, len(c) :] = book[p, 0]
    return book


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x @ (-2 * c.T) + (c * c).sum(1)).argmin(1)


def encode(x: np.ndarray, book: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, norms of the residuals, rounded upwards) of integer rows."""
    rest = x.astype(np.float64)
    if book is None:
        codes = np.zeros((len(x), 0), np.uint8)
    else:
        codes = np.empty((len(x), len(book)), np.uint8)
        for p, at in enumerate(parts(x.shape[1])):
            c = book[p, :, : at.stop - at.start]
            codes[:, p] = nearest(rest[:, at], c)
            rest[:, at] -= c[codes[:, p]]
    return codes, np.sqrt((rest * rest).sum(1)) * (1 + 1e-12)


class Block:
    """Rows of one length, with their codes; scores with bounds and exact ones for blocks of anchors."""

    def __init__(self, rows: pa.Table, book: np.ndarray | None):
        n = rows.num_rows
        self.q = np.asarray(rows.column("q").combine_chunks().flatten()).reshape(n, -1).astype(np.float64)
        self.label = rows.column("label").to_numpy()
        self.rid = rows.column("rid").to_numpy()
        self.id = rows.column("vec_id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        self.rest = rows.column("rest").to_numpy()
        self.book = book
        if book is not None:
            self.codes = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(n, -1)

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(looked-up scores, greatest errors): a row for each anchor."""
        out = np.zeros((len(self.q), len(anchors)))
        if self.book is not None:
            for p, at in enumerate(parts(self.q.shape[1])):
                table = self.book[p, :, : at.stop - at.start] @ anchors[:, at].T
                out += table[self.codes[:, p]]
        norms = np.sqrt((anchors * anchors).sum(1)) * (1 + 1e-12)
        return np.ascontiguousarray(out.T), norms[:, None] * self.rest[None, :]

    def first(self, which: np.ndarray, anchor: np.ndarray, k: int, low: float = -np.inf, high: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """The first k of the rows ``which`` by exact score, then vec_id, among scores from low to high: (places, scores)."""
        exact = self.q[which] @ anchor
        inside = (exact >= low) & (exact <= high)
        which, exact = which[inside], exact[inside]
        order = np.lexsort((self.rid[which], self.id[which], -exact))[:k]
        return which[order], exact[order]


def may_be_first(lower: np.ndarray, upper: np.ndarray, k: int, sure: np.ndarray | None = None) -> np.ndarray:
    """Rows that can be among the first k: as many of those that count for certain have a lower bound, which the others' upper bounds must reach."""
    held = lower if sure is None else lower[sure]
    if len(held) < k:
        return np.ones(len(upper), bool)
    return upper >= np.partition(held, len(held) - k)[len(held) - k]


def block_positives(block: Block, anchors: pa.Table, k: int) -> list[tuple]:
    """(anchor, 0, row, its vec_id, score) of each anchor's first k rows of its label."""
    label, rid = anchors.column("label").to_numpy(), anchors.column("rid").to_numpy()
    q = np.asarray(anchors.column("q").combine_chunks().flatten()).reshape(len(rid), -1).astype(np.float64)
    out = []
    for s in range(0, len(rid), _CHUNK):
        near, wide = block.bounds(q[s : s + _CHUNK])
        for j in range(len(near)):
            same = np.flatnonzero((block.label == label[s + j]) & (block.rid != rid[s + j]))
            if len(same):
                about, error = near[j, same], wide[j, same]
                which, exact = block.first(same[may_be_first(about - error, about + error, k)], q[s + j], k)
                out += [(rid[s + j], 0, block.rid[i], block.id[i], x) for i, x in zip(which, exact)]
    return out


def block_negatives(block: Block, anchors: pa.Table, k: int, least: int, most: int) -> list[tuple]:
    """(anchor, place of the positive, row, its vec_id, score) of the first k rows of other labels in each window."""
    label, rid = anchors.column("label").to_numpy(), anchors.column("rid").to_numpy()
    q = np.asarray(anchors.column("q").combine_chunks().flatten()).reshape(len(rid), -1).astype(np.float64)
    windows = anchors.column("scores").to_pylist()
    out = []
    for s in range(0, len(rid), _CHUNK):
        near, wide = block.bounds(q[s : s + _CHUNK])
        for j in range(len(near)):
            other = block.label != label[s + j]
            lower, upper = near[j] - wide[j], near[j] + wide[j]
            for place, positive in enumerate(windows[s + j]):
                # least p <= 100 n <= most p, for integers.
                low, high = -(-least * positive // 100), most * positive // 100
                if low > high:
                    continue
                reach = np.flatnonzero(other & (upper >= low) & (lower <= high))
                if len(reach):
                    sure = (lower[reach] >= low) & (upper[reach] <= high)
                    keep = reach[may_be_first(lower[reach], upper[reach], k, sure)]
                    which, exact = block.first(keep, q[s + j], k, low, high)
                    out += [(rid[s + j], place, block.rid[i], block.id[i], x) for i, x in zip(which, exact)]
    return out


FOUND = "anchor long, place int, rid long, vec_id long, score long"


def found_table(rows: list[tuple]) -> pa.Table:
    kinds = (("anchor", pa.int64()), ("place", pa.int32()), ("rid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()))
    columns = list(zip(*rows)) or [()] * 5
    made = {name: pa.array([int(x) for x in c], kind) for (name, kind), c in zip(kinds, columns)}
    made["vec_id"] = pa.array([None if x == _NO_ID else int(x) for x in columns[3]], pa.int64())
    return pa.table(made)


def indexed(vectors: DataFrame, books: dict[int, np.ndarray]) -> DataFrame:
    """vec_id, label, q, width with code and rest (norm of the residual)."""
    shared = vectors.sparkSession.sparkContext.broadcast(books)  # MOST_WIDTHS books at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("q")
            size = np.diff(v.offsets.to_numpy())
            codes: list[bytes] = [b""] * batch.num_rows
            rest = np.zeros(batch.num_rows)
            for width in np.unique(size):
                rows = np.flatnonzero(size == width)
                x = np.asarray(v.take(pa.array(rows)).flatten()).reshape(len(rows), width)
                got, rest[rows] = encode(x, shared.value.get(int(width)))
                for i, r in enumerate(rows):
                    codes[r] = got[i].tobytes()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codes, pa.binary()), pa.array(rest)], [*batch.schema.names, "code", "rest"])

    kinds = ", ".join(f"`{c}` {k}" for c, k in vectors.dtypes)
    return vectors.mapInArrow(tidy(run), f"{kinds}, code binary, rest double")


def first_rows(found: DataFrame, k: int) -> DataFrame:
    """The first k of each (anchor, place), with rank."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "rid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 5,
    least: int = 80,
    most: int = 100,
    sample: int = 4096,
    block: int = 8192,
    anchor_block: int = 16_384,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score over vectors (vec_id, embedding, label); ``anchors`` is a condition on vec_id.

    Negatives are rows of other labels with least * positive_score <= 100 * negative_score <= most * positive_score.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = with_columns(vectors, "vec_id", "embedding", "label")
    sound = F.expr("label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('inf'))")
    scaled = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("double"))
    fits = F.aggregate("scaled", F.lit(0.0), lambda s, x: s + x * x) <= float(LIMIT)
    rows = rows.where(sound).withColumn("scaled", scaled).where(fits).select("vec_id", F.col("label").cast("long").alias("label"), F.transform("scaled", lambda x: x.cast("int")).alias("q"))
    rows = written(rows.withColumn("rid", F.monotonically_increasing_id()).withColumn("width", F.size("q")), "integer-vectors")
    widths = {r["width"]: r["n"] for r in rows.groupBy("width").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "width").limit(MOST_WIDTHS).collect()}
    books = {}
    for width in widths:
        picks = rows.where(F.col("width") == width).select("q").orderBy(F.xxhash64("q"), "q").limit(sample).collect()
        books[width] = fit(np.array([p.q for p in picks]))
    blocks = F.pmod(F.xxhash64("rid"), F.greatest(F.lit(1), F.lit(-(-rows.count() // block)))).cast("int")
    index = written(indexed(rows, books).withColumn("block", blocks), "vector-codes")
    asked = written(index.where(anchors & F.col("vec_id").isNotNull()).select("rid", "vec_id", "label", "q", "width"), "anchors")
    n_asked = asked.count()
    groups = -(-n_asked // anchor_block) or 1
    asked_block = F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(groups)).cast("int").alias("ask")
    places = written(index.select("width", "block").distinct(), "blocks")
    shared = spark.sparkContext.broadcast(books)

    def search(asked: DataFrame, run) -> DataFrame:
        """Every block of rows with every block of anchors of the same length."""
        left = index.withColumn("ask", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        right = asked.withColumn("ask", asked_block).join(places, "width")

        def task(rows: pa.Table, anchors: pa.Table) -> pa.Table:
            if not rows.num_rows or not anchors.num_rows:
                return found_table([])
            return found_table(run(Block(rows, shared.value.get(rows.column("width")[0].as_py())), anchors))

        keys = ["width", "block", "ask"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(task, FOUND)

    pos = written(first_rows(search(asked, lambda b, a: block_positives(b, a, positives)), positives).drop("place"), "positives")
    scores = pos.groupBy("anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "score"))), lambda s: s["score"]).alias("scores"))  # at most ``positives`` of them
    windows = written(asked.join(scores.withColumnRenamed("anchor", "rid"), "rid"), "anchors-with-scores")
    neg = first_rows(search(windows, lambda b, a: block_negatives(b, a, negatives, least, most)), negatives)
    named = pos.join(asked.select(F.col("rid").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    named = named.select("anchor", (F.col("rank") - 1).alias("place"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = named.join(neg.select("anchor", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score")), ["anchor", "place"])
    out = written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "hard-negatives")
    dropped(rows, index, asked, places, pos, windows)
    return out


def hard_negatives(vectors: DataFrame) -> DataFrame:
    """The contract's windows: every hundredth vec_id is an anchor; every seventh has the next label."""
    label = F.col("label").cast("long")
    given = with_columns(vectors, "vec_id", "embedding", "label").withColumn("label", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label))
    return mine_hard_negatives(given, F.col("vec_id") % 100 == 0)
