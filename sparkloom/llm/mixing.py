"""Mixing sources to target weights by weighted fair queueing (operator 7).

Every source is a flow with a weight. Its documents, in shuffled order and repeated up to
``max_repeats`` times, leave the flow at virtual finish times: the source's words so far divided
by the source's target. All flows are range-sorted together by finish time and cut where the words
so far reach the total budget, so a source's share follows its weight whatever its size.

The shuffled order is a hash order, cut into slices of bounded size, and running sums are taken in
two levels (sums of slices, then rows inside a slice): no source, however large, is one group. Sources are rows of a table, however many; the
driver sees sums. The sorted line is cut where the budget runs out by sums of its parts, and the part in which it does is dealt out
anew until it is at most ``most_rows`` long.

Defined results: a null text has size 0 and is taken 0 times over; a null source is a source of its
own and sorts last; rows that share a doc_id are separate documents; an empty table gives no rows; columns
other than doc_id, text and source are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import as_rows, dropped, sendable, with_columns, written

WORD = r"[^\x20\x09-\x0D]+"


def water_fill(sizes: Sequence[float], weights: Sequence[float], budget: float, most: float) -> list[float]:
    """Shares of the budget by weight; none above ``most`` times its size, the excess reshared by weight."""
    target, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = most * sizes[i]
        open_.difference_update(full)
        left = max(0.0, budget - sum(target[i] for i in range(len(sizes)) if i not in open_))
    return target


def numbered(rows: DataFrame, key: str, name: str = "flow") -> DataFrame:
    """rows with their place in the order of key (by code point, null last), from 0: sorted parts are counted, and their rows numbered where they are."""
    line = written(rows.orderBy(F.asc_nulls_last(key)).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "mix-order")
    before, total = [], 0
    for part, n in sorted((r["_part"], r.n) for r in line.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # one number a part
        before.append((part, total))
        total += n
    base = F.broadcast(rows.sparkSession.createDataFrame(before, "_part int, _before long"))
    return line.join(base, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def with_targets(sources: DataFrame, most: float) -> DataFrame:
    """sources (source_size, weight) with target: water_fill() of all sizes, by sums over the table; each round holds some more sources at ``most`` times their size."""
    full, level, closed = F.lit(float(most)) * F.col("source_size"), None, -1
    while True:
        held = F.lit(False) if level is None else level * F.col("weight") >= full
        r = sources.agg(
            F.sum("source_size").alias("budget"), F.count(F.when(held, 1)).alias("closed"), F.sum(F.when(held, full)).alias("given"), F.sum(F.when(~held, F.col("weight"))).alias("open")
        ).head()
        if r.closed == closed or not r.open:
            break
        closed = r.closed
        level = F.lit(max(0.0, float(r.budget) - (r.given or 0.0)) / r.open)
    return sources.withColumn("target", full if level is None or not r.open else F.when(held, full).otherwise(level * F.col("weight")))


def row_hash(seed: int, doc_id: str = "doc_id", text: str = "text"):
    """Column: a row's place in the shuffled order."""
    return F.xxhash64(F.lit(seed), F.col(doc_id), F.xxhash64(text))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5.0, 2.0, 1.0),
    max_repeats: int = 3,
    slice_rows: int = 5000,
    seed: int = 7,
    most_rows: int = 1_000_000,
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken, h (a hash of doc_id and text).

    weights repeat over the sources in code-point order, null last. taken is copies * size.
    """
    sized = written(
        with_columns(docs, "doc_id", "text", "source").select(
            "doc_id",
            "source",
            F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            row_hash(seed).alias("h"),
        ),
        "mix-sized",
    )
    sources = written(numbered(sized.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size")), "source"), "mix-sources")
    share = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("flow") % len(weights) + 1).cast("int"))
    plan = written(with_targets(sources.withColumn("weight", share), max_repeats), "mix-plan")
    facts = plan.agg(F.max("n").alias("largest"), F.sum("source_size").alias("budget")).head()
    budget = int(facts.budget or 0)
    bits = max(0, (int(facts.largest or 1) // slice_rows).bit_length())
    flows = sized.withColumn("slice", F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long"))
    own = sendable(plan.select(F.col("source").alias("_source"), "flow", "source_size", "target"))
    flows = flows.join(own, flows.source.eqNullSafe(own["_source"])).drop("_source")

    before = Window.partitionBy("flow").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = (
        flows.groupBy("flow", "slice")
        .agg(F.sum("size").alias("slice_size"))
        .select("flow", "slice", F.coalesce(F.sum("slice_size").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("flow", "slice").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    # A row number tells rows that are equal in every column apart.
    queued = written(
        flows.join(slices, ["flow", "slice"])
        .withColumn("upto", F.col("base") + F.sum("size").over(inside))
        .withColumn("rank", F.row_number().over(inside))
        .select("doc_id", "source", "size", "source_size", "target", "flow", "slice", "rank", "upto", "h"),
        "mix-queued",
    )
    order = ["finish", "flow", "copy", "slice", "rank"]
    copies = (
        queued.where("size > 0 AND target > 0")
        .select("flow", "slice", "rank", "size", "upto", "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("copy"))
        .withColumn("finish", (F.col("copy") * F.col("source_size") + F.col("upto")) / F.col("target"))
        .select("finish", "flow", "copy", "slice", "rank", "size")
    )
    # One number per sorted part; the part in which the budget runs out is sorted into parts anew, until it is short.
    used, rest, taken, lines = 0, copies, [], []
    while True:
        line = written(rest.orderBy(*order).withColumn("part", F.spark_partition_id()), "mix-line")
        lines.append(line)
        cut, rows = None, 0
        for part, words, n in sorted((r.part, int(r.w), r.n) for r in line.groupBy("part").agg(F.sum("size").alias("w"), F.count("*").alias("n")).collect()):
            if used + words > budget:
                cut, rows = part, n
                break
            used += words
        taken.append((line if cut is None else line.where(F.col("part") < cut)).drop("part"))
        if cut is None or rows <= most_rows:
            break
        rest = line.where(F.col("part") == cut).drop("part")
        if len(lines) > 8:  # 8 sorts leave one part of any table unless its rows are equal in every column
            break
    if cut is not None:
        run = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        taken.append(line.where(F.col("part") == cut).withColumn("run", F.sum("size").over(run)).where(F.col("run") <= budget - used).drop("run", "part"))
    taken = reduce(DataFrame.unionByName, taken)
    counts = taken.groupBy("flow", "slice", "rank").agg(F.count("*").alias("copies"))
    out = queued.join(counts, ["flow", "slice", "rank"], "left").select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.coalesce("copies", F.lit(0)).cast("int").alias("copies"),
        (F.coalesce("copies", F.lit(0)) * F.col("size")).cast("long").alias("taken"),
        "h",
    )
    out = written(out, "mix-out")
    dropped(sized, queued, sources, plan, *lines)
    return out


def mixed_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """The mix itself: the rows of docs, each as often as the mix takes it.

    Rows equal in doc_id, text and source share what the mix takes of them: as often each, and some of them once more. Which of these equal rows those are is
    open; how often they come together is not.
    """
    counts = written(mix_sources(docs, seed=seed).groupBy("h", "source").agg(F.sum("copies").alias("total"), F.count("*").alias("n")).where("total > 0"), "mix-copies")
    rows = as_rows(docs).withColumn("h", row_hash(seed, "row.doc_id", "row.text"))
    known = sendable(counts.withColumnRenamed("h", "_h"))
    rows = rows.join(known, (rows["h"] == known["_h"]) & rows["row.source"].eqNullSafe(known["source"])).select("row", "h", "source", "total", "n")
    taken = rows.where("n = 1").select("row", F.col("total").alias("copies"))
    if not counts.where("n > 1").isEmpty():
        equal = Window.partitionBy("h", "source").orderBy("n")
        shared = rows.where("n > 1").withColumn("k", F.row_number().over(equal)).select("row", F.expr("total div n + IF(k <= total % n, 1, 0)").alias("copies"))
        taken = taken.unionByName(shared.where("copies > 0"))
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
