"""Document fingerprints by locally consistent parsing (operator 4).

A text's code points are the symbols of level 0. On each level, runs of one symbol become one symbol; then deterministic coin
tossing gives every symbol a label below 6 from itself and a few symbols to its left (the lowest bit in which it
differs from its neighbour, and that bit, again and again), and a phrase begins wherever a label is larger than both
neighbours'. A phrase is 2 to about 10 symbols; its name, a hash of its symbols, is a symbol of the next level. Where a phrase
begins depends on a bounded neighbourhood alone, so equal substrings are cut alike inside, at whatever offset they stand, and carry
the same names up the levels.

The fingerprint is a MinHash of a text's phrase names from level 2 up (about ten code points and more) and of the
name of the whole: ``CELLS`` cells of 16 bits, as hexadecimal digits. The share of equal cells of two fingerprints estimates
what share of their phrases the two texts have in common.

Defined results: a null text is empty; an empty text has the fingerprint of all f; a null doc_id comes last in descending order; repeated rows are treated each
for itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tidy, with_columns, written
from .slices import sliced
from .words import mix

CELLS = 64
FROM_LEVEL = 2
PIECE = 1 << 18
_U = np.uint64
_M = _U(0x9E3779B97F4A7C15)
_FACTORS = mix(np.arange(1, CELLS + 1, dtype=_U) * _M) | _U(1)
_LOW = np.array([8] + [(b & -b).bit_length() - 1 for b in range(1, 256)], np.uint8)
_POWER = int(_M) * 5 | 1
_up: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _up or len(_up[0]) <= n:
        a, b = np.full(n + 1, _POWER % 2**64, _U), np.full(n + 1, pow(_POWER, -1, 2**64), _U)
        a[0] = b[0] = 1
        _up[:] = [np.cumprod(a, dtype=_U), np.cumprod(b, dtype=_U)]
    return _up[0], _up[1]


def labels(x: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Labels below 6 of symbols, unlike the left neighbour's; head: positions without a left neighbour."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[head] = 0
    left ^= x
    low = np.bitwise_count((left & (~left + _U(1))) - _U(1))
    label = (low << np.uint8(1)) | ((x >> low.astype(_U)) & _U(1)).astype(np.uint8)
    for _ in range(3):  # 7 bits, 4 bits, 3 bits, below 6
        near = np.empty_like(label)
        near[1:] = label[:-1]
        near[head] = ~label[head]
        low = _LOW[near ^ label]
        label = (low << np.uint8(1)) | ((label >> low) & np.uint8(1))
    return label


def _named(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A hash of the symbols of each phrase, from running sums."""
    up, down = _powers(len(x))
    sums = np.zeros(len(x) + 1, _U)
    np.cumsum(x * up[: len(x)], out=sums[1:])
    ends = np.append(starts[1:], len(x))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(_U))


def _level(x: np.ndarray, head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names of the next level, positions of the texts' first symbols in them)."""
    new = np.empty(len(x), bool)
    new[0] = True
    np.not_equal(x[1:], x[:-1], out=new[1:])
    new[head] = True
    if not new.all():
        at = np.flatnonzero(new)
        run = np.diff(np.append(at, len(x)))
        x = x[at]
        many = run > 1
        x[many] = mix(x[many] * _M + run[many].astype(_U))
        head = np.searchsorted(at, head)
    label = labels(x, head)
    peak = np.zeros(len(x), bool)
    peak[1:-1] = (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:])
    peak[head[1:] - 1] = False  # a text's last symbol begins no phrase
    peak[head] = True
    starts = np.flatnonzero(peak)
    return _named(x, starts), np.searchsorted(starts, head)


def phrase_names(symbols: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(level, texts that still have symbols there, their first positions, names); symbols: code points of non-empty texts in turn."""
    x = mix(symbols.astype(_U) + _U(1))
    head, texts, level = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.arange(len(sizes)), 0
    while len(texts):
        x, head = _level(x, head)
        level += 1
        yield level, texts, head, x
        size = np.diff(np.append(head, len(x)))
        go = size > 1
        if not go.all():
            keep = np.repeat(go, size)
            x, texts = x[keep], texts[go]
            head = np.concatenate([[0], np.cumsum(size[go])[:-1]]).astype(np.int64)


def fingerprints(texts: Sequence[np.ndarray]) -> np.ndarray:
    """A row of CELLS 16-bit cells for each text, given as code points."""
    out = np.full((len(texts), CELLS), 0xFFFF, np.uint16)
    size = np.array([len(t) for t in texts], np.int64)
    some, lo = np.flatnonzero(size), 0
    upto = np.concatenate([[0], np.cumsum(size[some])])
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(upto, upto[lo] + PIECE, "right")) - 1)
        own = some[lo:hi]
        least = np.full((len(own), CELLS), ~_U(0), _U)
        for level, which, head, names in phrase_names(np.concatenate([texts[k] for k in own]), size[own]):
            count = np.diff(np.append(head, len(names)))
            if level < FROM_LEVEL:  # of the lower levels, only names of whole texts
                pick = count == 1
                which, names, head = which[pick], names[head[pick]], np.arange(int(pick.sum()))
            if not len(which):
                continue
            y = np.empty_like(names)
            for c in range(CELLS):
                np.multiply(names, _FACTORS[c], out=y)
                least[which, c] = np.minimum(least[which, c], np.minimum.reduceat(y, head))
        out[own] = (mix(least) >> _U(48)).astype(np.uint16)
        lo = hi
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal cells, row by row."""
    return (a == b).mean(axis=1)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)


def _hex(cells: np.ndarray) -> list[str]:
    raw = cells.astype(">u2")
    return [raw[k].tobytes().hex() for k in range(len(raw))]


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, fingerprint of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [code_points(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array(_hex(fingerprints(texts)))], ["doc_id", "n_chars", "fingerprint"])

    kind = dict(docs.dtypes)["doc_id"]
    return with_columns(docs, "doc_id", "text").mapInArrow(tidy(run), f"doc_id {kind}, n_chars long, fingerprint string")


def _digests(texts: list[np.ndarray], cells: np.ndarray) -> list[pa.Array]:
    """What compare_with_next says of each text but the last, whose next one is the text after it: n_chars, edited_sha256, the two fingerprints, the two likenesses."""
    edited = [np.concatenate([a[: len(a) - len(a) // 2], b[: len(a) // 2]]) for a, b in zip(texts, texts[1:])]
    changed, own = fingerprints(edited), cells[:-1]
    sha = [hashlib.sha256(e.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")).digest() for e in edited]
    raw = [pa.array([x.tobytes() for x in c.astype(">u2")], pa.binary()) for c in (own, changed)]
    return [pa.array([len(t) for t in texts[:-1]], pa.int64()), pa.array(sha, pa.binary()), *raw, pa.array(likeness(own, changed)), pa.array(likeness(own, cells[1:]))]


_DIGESTS = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _DIGESTS.split(", ")]


def compare_with_next(docs: DataFrame, slice_chars: int = 8_000_000) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many of the next
    document, in descending order of doc_id (nulls last; rows of one doc_id by a hash of their text). Documents are dealt to range
    partitions in that order. A partition compares all its rows but the last; first and last rows, two a partition, are
    put together afterwards by the partitions' numbers.
    """
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def edge(which: int, doc_id: pa.Array, text: np.ndarray) -> pa.RecordBatch:
            empty = [pa.nulls(1, f.type) for f in done.schema][1:-3]
            whole = pa.array([text.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")], pa.binary())
            return pa.RecordBatch.from_arrays([doc_id, *empty, pa.array([part], pa.int32()), pa.array([which], pa.int32()), whole], done.schema.names)

        ids, texts, cells, done = None, [], np.zeros((0, CELLS), np.uint16), None
        for batch in batches:
            for rows in (batch.slice(lo, 512) for lo in range(0, batch.num_rows, 512)):
                more = [code_points(t) for t in rows.column("text").to_pylist()]
                ids = rows.column("doc_id") if ids is None else pa.concat_arrays([ids, rows.column("doc_id")])
                texts, cells = [*texts, *more], np.concatenate([cells, fingerprints(more)])
                n = len(texts) - 1  # the last one's next text has not come yet
                first, out = done is None, [ids.slice(0, n), *_digests(texts, cells), pa.array([part] * n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
                done = pa.RecordBatch.from_arrays(out, ["doc_id", *_NAMES, "part", "edge", "whole"])
                if first:
                    yield edge(1, ids.slice(0, 1), texts[0])
                yield done
                ids, texts, cells = ids.slice(n), texts[n:], cells[n:]
        if texts:
            yield edge(2, ids, texts[0])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                texts = [code_points(batch.column(c)[k].as_py().decode("utf-8", "surrogatepass")) for c in ("whole", "after")]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(k, 1), *_digests(texts, fingerprints(texts))], ["doc_id", *_NAMES])

    table = written(sliced(docs, slice_chars, descending=True).mapInArrow(tidy(run), f"doc_id {kind}, {_DIGESTS}, part int, edge int, whole binary"), "fingerprints")
    parts = sorted(r.part for r in table.where("edge = 1").select("part").collect())  # one number a partition, which are bounded in number
    follows = docs.sparkSession.createDataFrame([(p, parts[(k + 1) % len(parts)]) for k, p in enumerate(parts)], "part int, then int")
    heads = table.where("edge = 1").select(F.col("part").alias("then"), F.col("whole").alias("after"))
    ends = table.where("edge = 2").select("doc_id", "whole", "part").join(F.broadcast(follows), "part").join(heads, "then").select("doc_id", "whole", "after")
    whole = table.where("edge IS NULL").select("doc_id", *_NAMES).unionByName(ends.mapInArrow(tidy(pairs), f"doc_id {kind}, {_DIGESTS}"))
    return whole.select("doc_id", *[F.lower(F.hex(c)).alias(c) if c.endswith(("sha256", "fingerprint")) else F.col(c) for c in _NAMES])
