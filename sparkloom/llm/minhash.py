"""MinHash near-duplicates by an LSH forest (operator 2).

Every document is its set of distinct five-word shingles, as 64-bit hashes. Equal sets are one class from the start. A
class's MinHash signature is written in ``trees`` different orders, and each order is sorted; a region of an
order is a run of classes with the same first ``depth`` values.

1. Neighbours in the sorted orders that lie in one region, by longest common prefix, are candidates. In a few turns, each class's
   likeliest ones in other components (``first_links`` of them) are confirmed on the full sets, and components are formed.
2. Regions that still hold more than one component are looked at again: all pairs of different components in a region are
   compared on the full sets, there and then, by products of 0/1 matrices (a few hundredths of a microsecond a pair). The depth of a region adapts to what the first step left: regions
   of copies, however large, are one component by then and are not opened; only the mixed ones are compared to their full width.
   A mixed region of more than ``block`` classes, or of longer sets than ``block_bytes``, is compared block against block, in separate groups, and
   what leaves a group are links that join components there, never the pairs.

So no pair is left out for the size of its region; a pair of similarity 0.75 escapes all orders with a chance of
(1 - 0.75**depth)**trees = 5e-6.

Defined results: a null text, or one without words, has an empty set, links with nothing and is its own component; with fewer than
five words the whole sequence is the one shingle; repeated doc_ids are separate documents; a null doc_id takes part but
names a component only if all are null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import MOST_BROADCAST, dropped, sendable, tidy, with_columns, written
from .words import Words, mix, text_chunks

WIDTH = 5
_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)


def shingle_hashes(h: np.ndarray, counts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of runs of width words, their number in each text); a shorter text is one run."""
    n = len(h)
    start = np.concatenate([[0], np.cumsum(counts)])
    total = np.zeros(n, _U)
    for k in range(min(width, n)):
        total[: n - k] = total[: n - k] * _M + h[k:]
    made = np.where(counts >= width, counts - width + 1, counts > 0)
    usable = np.zeros(n + 1, np.int64)
    np.add.at(usable, start[:-1][made > 0], 1)
    np.add.at(usable, (start[:-1] + made)[made > 0], -1)
    out = mix(total[np.cumsum(usable[:-1]) > 0])
    short = np.flatnonzero((counts > 0) & (counts < width))
    at = np.concatenate([[0], np.cumsum(made)])[short]
    for p, d in zip(at, short):
        x = _U(counts[d])
        for w in h[start[d] : start[d + 1]]:
            x = x * _M + w
        out[p] = mix(np.array([x ^ _U(0xD1B54A32D192ED03)], _U))[0]
    return out, made


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingle hashes of each text in turn, set sizes)."""
    for i, j, raw, off in text_chunks(column):
        words = Words(raw, off)
        with np.errstate(over="ignore"):
            s, made = shingle_hashes(words.hashes(), words.counts())
        cut = np.concatenate([[0], np.cumsum(made)])
        parts = []
        for a, b in zip(cut[:-1], cut[1:]):
            x = np.sort(s[a:b])
            parts.append(x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) > 1 else x)
        yield i, j, np.concatenate(parts) if parts else s, np.array([len(x) for x in parts], np.int64)


def signatures(sets: np.ndarray, sizes: np.ndarray, count: int) -> np.ndarray:
    """Rows of 32-bit MinHash values of the non-empty sets (zeros for empty ones)."""
    out = np.zeros((len(sizes), count), np.uint32)
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    factors = mix(np.arange(1, count + 1, dtype=_U) * _M) | _U(1)
    start = np.concatenate([[0], np.cumsum(sizes[some])])
    lo = 0
    while lo < len(some):  # in pieces that stay in the processor's cache
        hi = max(lo + 1, int(np.searchsorted(start, start[lo] + 32768, "right")) - 1)
        x, at = sets[start[lo] : start[hi]], start[lo:hi] - start[lo]
        y = np.empty_like(x)
        for k in range(count):
            np.multiply(x, factors[k], out=y)
            out[some[lo:hi], k] = np.minimum.reduceat(y, at) >> _U(32)
        lo = hi
    return out


def _orders(trees: int, depth: int, deep: int) -> np.ndarray:
    """The signature positions that each order reads: its own first ``depth`` ones, then ``deep`` others."""
    rng, own = np.random.default_rng(11), np.arange(trees * depth).reshape(trees, depth)
    rest = [rng.permutation(np.setdiff1d(np.arange(trees * depth), own[t]))[:deep] for t in range(trees)]
    return np.concatenate([own, np.array(rest).reshape(trees, deep)], axis=1)


def sketch(docs: DataFrame, orders: np.ndarray, depth: int) -> DataFrame:
    """doc_id, n_shingles, set_a and set_b (128 bits that name the set), its region in each order, and its signature's low bytes; and copy, where docs has it."""
    trees, kind = len(orders), dict(docs.dtypes)["doc_id"]
    extra = [c for c in ("copy",) if c in docs.columns]
    names = ["doc_id", "n_shingles", "set_a", "set_b", "regions", "signature", *extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, sets, sizes in shingle_sets(batch.column("text")):
                a, b = set_names(sets, sizes)
                sig = signatures(sets, sizes, trees * depth)
                keys = np.empty((j - i, trees), _U)
                for t in range(trees):
                    x = np.full(j - i, t + 1, _U)
                    for c in orders[t, :depth]:
                        x = mix(x * _M + sig[:, c])
                    keys[:, t] = x
                lists = pa.ListArray.from_arrays(pa.array(np.arange(j - i + 1, dtype=np.int32) * trees), pa.array(keys.view(np.int64).ravel()))
                low = np.ascontiguousarray(sig.astype(np.uint8))
                cells = pa.FixedSizeBinaryArray.from_buffers(pa.binary(trees * depth), j - i, [None, pa.py_buffer(low)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(sizes), pa.array(a), pa.array(b), lists, cells, *(batch.column(c).slice(i, j - i) for c in extra)], names)

    return with_columns(docs, "doc_id", "text", *extra).mapInArrow(tidy(run), ", ".join([f"doc_id {kind}, n_shingles long, set_a long, set_b long, regions array<long>, signature binary", *(f"{c} long" for c in extra)]))


def set_names(sets: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name each set; the sets' members come one set after another."""
    end, out = np.cumsum(sizes), []
    for salt in (_U(0), _M):
        sums = np.zeros(len(sets) + 1, _U)
        np.cumsum(mix(sets ^ salt), out=sums[1:])
        out.append(mix(sums[end] - sums[end - sizes] + sizes.astype(_U)).view(np.int64))
    return out[0], out[1]


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Batches sorted by keys, put together so that rows of equal keys stay in one table."""
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        last = [held.column(k)[held.num_rows - 1].as_py() for k in keys]
        same = np.ones(held.num_rows, bool)
        for k, v in zip(keys, last):
            same &= held.column(k).to_numpy() == v
        end = held.num_rows - int(same[::-1].argmin() or (held.num_rows if same.all() else 0))
        if end:
            yield held.slice(0, end)
            held = held.slice(end)
    if held is not None and held.num_rows:
        yield held


def _cells(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def alike(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal signature values of rows a and b."""
    out = np.empty(len(a))
    for lo in range(0, len(a), 8192):
        out[lo : lo + 8192] = (sig[a[lo : lo + 8192]] == sig[b[lo : lo + 8192]]).mean(axis=1)
    return out


def neighbour_pairs(members: DataFrame, orders: np.ndarray, depth: int, reach: int, floor: float) -> DataFrame:
    """(a, b, likeness) of classes at most ``reach`` places apart in a region of a sorted order."""
    def deep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig, tree = _cells(batch.column("signature")), batch.column("tree").to_numpy()
            at = np.ascontiguousarray(np.take_along_axis(sig, orders[tree][:, depth:], 1))
            raw = pa.FixedSizeBinaryArray.from_buffers(pa.binary(at.shape[1]), len(at), [None, pa.py_buffer(at)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("region", "cls", "signature")), raw], ["region", "cls", "signature", "deep"])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if tail is not None:
                table = pa.concat_tables([tail, table])
            new = 0 if tail is None else tail.num_rows
            region, cls, sig = table.column("region").to_numpy(), table.column("cls").to_numpy(), _cells(table.column("signature"))
            for step in range(1, reach + 1):
                b = np.arange(max(new, step), len(region))
                a = b - step
                ok = (region[a] == region[b]) & (cls[a] != cls[b])
                a, b = a[ok], b[ok]
                like = alike(sig, a, b)
                ok = like >= floor
                x, y = cls[a[ok]], cls[b[ok]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(like[ok])], ["a", "b", "likeness"])
            tail = table.slice(max(0, table.num_rows - reach))

    shaped = members.select("region", "tree", "cls", "signature").mapInArrow(tidy(deep), "region long, cls long, signature binary, deep binary")
    return shaped.repartitionByRange("region", "deep", "cls").sortWithinPartitions("region", "deep", "cls").mapInArrow(tidy(pair), "a long, b long, likeness double")


def common(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(x) > len(y):
        x, y = y, x
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0


def intersections(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of the sets numbered left with those numbered right, by products of 0/1 matrices of the members that more than one set has."""
    members, at, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
    column = np.cumsum(n > 1) - 1
    keep = n[at] > 1
    owner, at = owner[keep], column[at[keep]]
    order = np.argsort(at, kind="stable")
    owner, at = owner[order], at[order]
    place = np.full((2, len(sets)), -1)
    place[0, left], place[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)  # counts are far below 2**24
    for lo in range(0, int(column[-1]) + 1 if len(members) else 0, columns):
        a, b = np.searchsorted(at, [lo, lo + columns])
        own, cells = owner[a:b], at[a:b] - lo
        sides = []
        for side, size in ((place[0], len(left)), (place[1], len(right))):
            has = np.zeros((size, columns), np.float32)
            here = side[own] >= 0
            has[side[own[here]], cells[here]] = 1
            sides.append(has)
        out += sides[0] @ sides[1].T
    return out


def region_links(mixed: DataFrame, block: int, block_bytes: int, similarity: float) -> DataFrame:
    """(a, b) of classes in one region whose full sets reach the similarity: links that join the components there.

    mixed: region, tree, cls, root, n (classes in the region), held (their shingles), regions, shingles. Each pair of blocks is one group, whose full sets are
    compared in place, all at once; only what links two components leaves it, at most one row a class. A pair is linked in the first of its regions alone.
    """
    own = F.pmod(F.xxhash64("cls"), "blocks").cast("int")
    meet = (
        mixed.withColumn("blocks", F.ceil(F.greatest(F.col("n") / block, 8 * F.col("held") / block_bytes)).cast("int"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("region", F.least("own", "other").alias("b1"), F.greatest("own", "other").alias("b2"), (F.col("own") > F.col("other")).alias("side"), "tree", "cls", "root", "regions", "shingles")
    )
    need = round(100 * similarity)

    def links(table: pa.Table) -> Iterator[tuple[int, int]]:
        cls, root, side = table.column("cls").to_numpy(), table.column("root").to_numpy(), table.column("side").to_numpy()
        if (root == root[0]).all():
            return
        b1, b2, tree = (table.column(c)[0].as_py() for c in ("b1", "b2", "tree"))
        left, right = (np.flatnonzero(~side), np.flatnonzero(side)) if b1 < b2 else (np.arange(len(cls)),) * 2
        if not len(left) or not len(right):
            return
        sets = [np.frombuffer(x.as_buffer(), _U) for x in table.column("shingles")]
        size = np.array([len(x) for x in sets])
        both = intersections(sets, left, right)
        i, j = np.nonzero((100 * both >= need * (size[left][:, None] + size[right] - both)) & (root[left][:, None] != root[right]))
        a, b = left[i], right[j]
        if b1 == b2:
            a, b = a[i < j], b[i < j]
        keys = table.column("regions").combine_chunks().flatten().to_numpy().reshape(len(cls), -1)
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while x in up:
                x = up[x]
            return x

        for lo in range(0, len(a), 8192):
            x, y = a[lo : lo + 8192], b[lo : lo + 8192]
            first = (keys[x] == keys[y]).argmax(axis=1) == tree
            for i, j in zip(x[first].tolist(), y[first].tolist()):
                p, q = top(root[i]), top(root[j])
                if p != q:
                    up[max(p, q)] = min(p, q)
                    yield int(cls[i]), int(cls[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in whole_groups(batches, "region", "b1", "b2"):
            at = [whole.column(c).to_numpy() for c in ("region", "b1", "b2")]
            cut = np.flatnonzero(np.concatenate([[True], *[np.any([k[1:] != k[:-1] for k in at], axis=0)], [True]]))
            for lo, hi in zip(cut[:-1], cut[1:]):
                if pairs := list(links(whole.slice(lo, hi - lo))):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*pairs)], ["a", "b"])

    return meet.repartition("region", "b1", "b2").sortWithinPartitions("region", "b1", "b2").mapInArrow(tidy(run), "a long, b long").distinct()


def member_sets(docs: DataFrame, wanted: DataFrame, most_broadcast: int) -> DataFrame:
    """cls and shingles (its sorted 64-bit hashes) of the wanted classes: cls, least_id, set_a, set_b."""
    texts = with_columns(docs, "doc_id", "text").join(sendable(wanted, most_broadcast), F.col("doc_id").eqNullSafe(F.col("least_id"))).select("cls", "set_a", "set_b", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, s, sizes in shingle_sets(batch.column("text")):
                a, b = set_names(s, sizes)
                part = batch.slice(i, j - i)
                own = (part.column("set_a").to_numpy() == a) & (part.column("set_b").to_numpy() == b)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                raw = [s[ends[k] : ends[k + 1]].tobytes() for k in np.flatnonzero(own)]
                yield pa.RecordBatch.from_arrays([part.column("cls").filter(pa.array(own)), pa.array(raw, pa.binary())], ["cls", "shingles"])

    return texts.mapInArrow(tidy(sets), "cls long, shingles binary").dropDuplicates(["cls"])


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        need = round(100 * similarity)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[k].as_buffer(), _U) for c in ("sa", "sb"))
                if 100 * min(len(x), len(y)) < need * max(len(x), len(y)):
                    continue
                both = common(x, y)
                keep[k] = 100 * both >= need * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    joined = pairs.select("a", "b").join(sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb")), "b")
    return written(joined.select("a", "b", "sa", "sb").mapInArrow(tidy(check), "a long, b long"), "minhash-confirmed")


def _across(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    a, b = (roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    apart = F.coalesce("root_a", "a") != F.coalesce("root_b", "b")
    return pairs.join(a, "a", "left").join(b, "b", "left").where(apart).select(*pairs.columns)


def near_duplicates(
    docs: DataFrame,
    similarity: float = 0.75,
    trees: int = 32,
    depth: int = 4,
    deep: int = 16,
    reach: int = 1,
    first_links: tuple[int, ...] = (3,),
    block: int = 512,
    block_bytes: int = 4 << 20,
    slack: float = 0.17,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs (doc_id, text)."""
    return _groups(with_columns(docs, "doc_id", "text"), similarity, trees, depth, deep, reach, first_links, block, block_bytes, slack, most_broadcast)


def _groups(docs: DataFrame, similarity: float = 0.75, trees: int = 32, depth: int = 4, deep: int = 16, reach: int = 1, first_links: tuple[int, ...] = (3,), block: int = 512, block_bytes: int = 4 << 20, slack: float = 0.17, most_broadcast: int = MOST_BROADCAST, hot_copies: int = 10_000) -> DataFrame:
    """near_duplicates(); where docs has copy (a hash of the text), also copy, and stays: of each group, the rows of the least doc_id's one text."""
    copies = "copy" in docs.columns
    with_copy = [F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "copy")).alias("first")] if copies else []
    orders = _orders(trees, depth, deep)
    floor = max(0.0, similarity - slack)
    rows = written(sketch(docs, orders, depth), "minhash-rows")
    classes = written(
        rows.where("n_shingles > 0").groupBy("n_shingles", "set_a", "set_b").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("copies"), F.first("regions").alias("regions"), F.first("signature").alias("signature"), *with_copy)
        .select(F.monotonically_increasing_id().alias("cls"), "*"),
        "minhash-classes",
    )
    regions = classes.select("cls", "n_shingles", F.posexplode("regions").alias("tree", "region"))
    shared = regions.groupBy("region").agg(F.count("*").alias("n")).where("n > 1")
    members = written(regions.join(shared, "region"), "minhash-members")
    signed = classes.select("cls", "signature", "regions")
    near = written(neighbour_pairs(members.join(signed.drop("regions"), "cls"), orders, depth, reach, floor).groupBy("a", "b").agg(F.max("likeness").alias("likeness")), "minhash-near")
    linked = near.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    found = classes.select("cls", "least_id", "set_a", "set_b")
    sets = written(member_sets(docs, found.join(linked, "cls", "left_semi"), most_broadcast), "minhash-sets")
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    tried, roots, done = links, None, []
    for most in first_links:
        open_ = near.join(tried, ["a", "b"], "left_anti")
        if roots is not None:
            open_ = _across(open_, roots)
        either = open_.select("a", "b", "likeness", F.col("a").alias("x")).unionByName(open_.select("a", "b", "likeness", F.col("b").alias("x")))
        best = Window.partitionBy("x").orderBy(F.desc("likeness"), "a", "b")
        step = written(either.withColumn("k", F.row_number().over(best)).where(F.col("k") <= most).select("a", "b").distinct(), "minhash-step")
        tried = tried.unionByName(step)
        found_links = confirmed(step, sets, similarity)
        links = links.unionByName(found_links)
        roots = written(connected_components(links), "minhash-roots")
        done += [step, found_links, roots]
    rooted = members.join(roots, members.cls == roots.node, "left").select("region", "tree", "cls", "n_shingles", F.coalesce("root", "cls").alias("root"))
    mixed = rooted.groupBy("region").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"), F.sum("n_shingles").alias("held")).where("lo < hi").select("region", "n", "held")
    opened = written(rooted.join(mixed, "region").select("region", "tree", "cls", "root", "n", "held"), "minhash-opened")
    dropped(members)
    more = opened.select("cls").distinct().join(linked, "cls", "left_anti")
    new_sets = written(member_sets(docs, found.join(more, "cls", "left_semi"), most_broadcast), "minhash-sets")
    facts = signed.drop("signature").join(sets.unionByName(new_sets), "cls")
    rest = written(region_links(opened.join(facts, "cls"), block, block_bytes, similarity), "minhash-rest")
    dropped(near, opened, sets, new_sets)
    roots = connected_components(links.unionByName(rest))
    firsts = ["first"] if copies else []
    named = classes.select("cls", "n_shingles", "set_a", "set_b", "least_id", "copies", *firsts).join(roots, classes.cls == roots.node, "left").withColumn("root", F.coalesce("root", "cls"))
    names = named.groupBy("root").agg(F.min("least_id").alias("component_id"), *[F.min(F.struct("first", "cls")).alias("lead") for _ in firsts])
    lead_copy = [F.when(F.col("cls") == F.col("lead.cls"), F.col("lead.first.copy")).alias("lead_copy") for _ in firsts]
    facts = written(named.join(names, "root").select("n_shingles", "set_a", "set_b", "copies", "component_id", *lead_copy), "minhash-facts")
    own, key, told = ["copy"] if copies else [], ["n_shingles", "set_a", "set_b"], ["component_id"] + ["lead_copy"] * copies
    # Texts with very many copies, of which there are few, are looked up where the rows are; only the others are shuffled by their set.
    hot = sendable(facts.where(F.col("copies") >= hot_copies).drop("copies").withColumn("hot", F.lit(True)))
    held = rows.where("n_shingles > 0").select("doc_id", *key, *own)
    spread = held.join(hot, key, "left")
    cold = spread.where("hot IS NULL").drop("hot", *told).join(facts.where(F.col("copies") < hot_copies).drop("copies"), key)
    empty = rows.where("n_shingles = 0").select("doc_id", *key, *own, *[F.lit(None).cast(facts.schema[c].dataType).alias(c) for c in told])
    out = spread.where("hot").drop("hot").unionByName(cold).unionByName(empty)
    stays = [((F.col("n_shingles") == 0) | (F.col("doc_id").eqNullSafe(F.col("component_id")) & F.col("copy").eqNullSafe(F.col("lead_copy")))).alias("stays") for _ in firsts]
    out = out.select("doc_id", "n_shingles", *own, *stays, F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    out = written(out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))), "minhash-out")
    dropped(rows, classes, rest, facts, *done)
    return out


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the first of its group: of the least doc_id, and of that one text only. Rows that repeat its doc_id and text all stay."""
    copy = F.xxhash64(docs["text"])
    groups = _groups(docs.select(docs["doc_id"], docs["text"], copy.alias("copy")))
    stays = sendable(groups.where("stays").select(F.col("doc_id").alias("_kept_id"), F.col("copy").alias("_kept_copy")).distinct())
    return docs.join(stays, docs["doc_id"].eqNullSafe(stays["_kept_id"]) & (copy == stays["_kept_copy"]), "left_semi")
