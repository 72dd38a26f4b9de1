"""Packing token pieces into sequences of one length by exact complements, then best fit (operator 8).

Sequences are planned on the histogram of piece lengths, which has at most ``capacity`` entries however many documents there are:
for each length, largest first, the gap it leaves is filled by one, two or three shorter lengths whose sum is exactly the
gap, as often as their counts allow; what is left goes by best fit, longest first. The index of sums is the histogram itself: a pair of sum s is a length a
with s - a available, so one look over the lengths finds it, and it is true to the counts at every step, which a table of all sums would have to be made. A plan row says "these lengths
together, so many times". Pieces are numbered within their length in two levels (inside a task, then over tasks), and a
piece's number falls into one slot of the plan. No group of pieces meets in one task.

Defined results: a null or empty text is one piece that holds only the end id; a text longer than the capacity is cut
into pieces of the full capacity, the first of which may be shorter; repeated rows are packed each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, tidy, with_columns, written
from .tokens import MOST_PIECES, Encoder, tokenizer_path

ROWS = 400
END = np.zeros(1, "<u4").tobytes()


def token_pieces(docs: DataFrame, path: str, capacity: int, keep_ids: bool = False, most_pieces: int = MOST_PIECES) -> DataFrame:
    """Pieces of every text's ids and an end id 0: doc_id, piece, start, length, ids_crc32, part, number.

    part is the task that made the row and number counts the task's earlier pieces of the same length.
    keep_ids adds the ids. most_pieces bounds the encoder's cache in a worker (about 200 bytes each).
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(path, most_pieces), TaskContext.get().partitionId()
        made = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                some = batch.slice(lo, ROWS)
                rows: list[tuple[int, int, int, int, int, bytes]] = []
                for k, ids in enumerate(encoder.encode(some.column("text").to_pylist())):
                    ids += END
                    n, first = len(ids) // 4, (len(ids) // 4 - 1) % capacity + 1
                    at = 0
                    for piece, to in enumerate(range(first, n + 1, capacity)):
                        own = ids[4 * at : 4 * to]
                        rows.append((k, piece, at, to - at, zlib.crc32(own), own if keep_ids else b""))
                        at = to
                index, piece, start, length, crc, own = zip(*rows)
                length = np.array(length)
                order = np.argsort(length, kind="stable")
                values, first_at, n = np.unique(length[order], return_index=True, return_counts=True)
                number = np.empty(len(length), np.int64)
                number[order] = np.arange(len(length)) - np.repeat(first_at, n) + np.repeat(made[values], n)
                made[values] += n
                columns = [
                    some.column("doc_id").take(pa.array(index)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(length), part, np.int32)), pa.array(number),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "number"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(own, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, number long" + ", ids binary" * keep_ids
    return with_columns(docs, "doc_id", "text").mapInArrow(tidy(cut, tokenizes=True), schema)


def _pair(have: np.ndarray, total: int, most: int) -> tuple[int, int] | None:
    """Two available lengths with this sum, the larger at most ``most`` and as large as can be."""
    top = min(total - 1, most)
    a = np.arange(top, (total + 1) // 2 - 1, -1)
    if not len(a):
        return None
    ok = (have[a] > 0) & (have[total - a] > 0) & ((2 * a != total) | (have[a] > 1))
    k = int(ok.argmax())
    return (int(a[k]), int(total - a[k])) if ok[k] else None


def complement(have: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths whose sum is the gap."""
    if have[gap] > 0:
        return (gap,)
    if two := _pair(have, gap, gap - 1):
        return two
    for a in np.flatnonzero(have[: max(gap - 1, 0)])[::-1]:
        if 3 * a < gap:
            break
        have[a] -= 1
        two = _pair(have, gap - int(a), int(a))
        have[a] += 1
        if two:
            return (int(a), *two)
    return None


def plan_sequences(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths that share a sequence, number of such sequences) for counts[length] pieces of each length."""
    have, plan, rest = counts.astype(np.int64).copy(), [], []
    if have[capacity]:
        plan.append(((capacity,), int(have[capacity])))
    for length in range(capacity - 1, 0, -1):
        while have[length] > 0:
            have[length] -= 1
            others = complement(have, capacity - length)
            have[length] += 1
            if others is None:
                rest.append((length, int(have[length])))
                have[length] = 0
                break
            group = (length, *others)
            need = {x: group.count(x) for x in group}
            times = min(int(have[x]) // n for x, n in need.items())
            for x, n in need.items():
                have[x] -= n * times
            plan.append((group, times))
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    for length, n in rest:
        while n:
            gap = min((g for g in open_ if g >= length), default=None)
            if gap is None:
                fit = min(capacity // length, n)
                group, times = (length,) * fit, n // fit
                n -= fit * times
            else:
                held, there = open_[gap].pop()
                times = min(there, n)
                if there > times:
                    open_[gap].append((held, there - times))
                if not open_[gap]:
                    del open_[gap]
                group = (*held, length)
                n -= times
            open_.setdefault(capacity - sum(group), []).append((group, times))
    return plan + [x for groups in open_.values() for x in groups]


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """pieces (with length, part and number) and, instead of part and number, sequence_id and offset."""
    tasks = pieces.groupBy("part", "length").agg((F.max("number") + 1).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in tasks.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        counts[r.length] = r.n
    plan = plan_sequences(counts, capacity)
    slots, used, sequence = [], np.zeros(capacity + 1, np.int64), 0
    for group, times in plan:
        at = 0
        for length in group:
            slots.append((length, used[length], sequence - used[length], at))
            used[length] += times
            at += length
        sequence += times
    assert (used == counts).all()
    slots.sort()
    table = np.array(slots, np.int64).reshape(-1, 4)
    key, shift, offset = table[:, 0] << 48 | table[:, 1], table[:, 2], table[:, 3]
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = tasks.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("number"))
    names = [c for c in pieces.columns if c not in ("part", "number")]
    kinds = dict(pieces.dtypes)

    def slot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            k = np.searchsorted(key, batch.column("length").to_numpy() << 48 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(rank + shift[k]), pa.array(offset[k])], [*names, "sequence_id", "offset"])

    return ranked.select(*names, "rank").mapInArrow(tidy(slot), ", ".join(f"{c} {kinds[c]}" for c in names) + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, keep_ids: bool = False, most_pieces: int = MOST_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    pieces = written(token_pieces(docs, tokenizer or tokenizer_path(), capacity, keep_ids, most_pieces), "pack-pieces")
    out = written(place(pieces, capacity), "pack-placed")
    dropped(pieces)
    return out


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id and its ids in order, from pack_documents(..., keep_ids=True); a sequence holds at most capacity ids."""
    held = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("held"))
    return held.select("sequence_id", F.concat(F.lit(b""), F.aggregate("held.ids", F.lit(b""), lambda a, b: F.concat(a, b))).alias("ids"))
