"""Language-model scoring with an interpolated modified Kneser-Ney model of order 3 (operator 10).

The model is a trigram model over words and one end for each text; before a text stand two ends. It is counted in Spark:

1. Words are counted over all training texts. The sorted 64-bit hashes are the vocabulary; a word's place is its id.
2. Different pairs (word before, word) are gathered by a hash of their ids. A pair's place in that order is its id.
3. Triples are counted as (left pair, right pair), dealt by the left pair. Each slice has all continuations of its contexts: their total, and how many come
   once, twice, more often. How many different words stand before a right pair is added up over the slices; that is the pair's count in the lower order.
4. The same sums for the lower orders: continuations of a word, and different words before a word.

A map task adds equal keys up first and sends, for each slice of the keys' hash, one compressed block; so hot words, pairs and contexts spread over
all slices, and rows are blocks, not words. A slice is about ``shard_tokens`` tokens, and a reducing task merges one after another: memory is that of one
slice, at any size. The slices of at most ``MOST_FILES`` ranges of the hash are written one behind the other to one file a range, so that the number of files, of
memory maps and of reducing tasks has a bound; beyond about 12 GB of text the files grow instead.

The result is stored as sorted hash arrays in the shared folder: for pairs and triples, a directory of the hash's upper bits and the sorted
next 32 bits (two keys fall together with a chance of about 1 in 10**8), with counts of one byte and a list of the larger ones. Workers map these files into
memory and look keys up by bisection, so a worker holds only the pages that it touches, and the maps end with the task. The shared folder must be
mounted (``file:``), as memory mapping needs.

Defined results: a null or empty text is the end alone; repeated doc_ids are separate documents, and all of them are held out or none; a null
doc_id counts as text without a number (it trains); without any training text N = V = 0 and every token has the uniform probability 1; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, mounted_path, small_batches, tidy, with_columns, written
from .words import Words, mix, text_chunks

_U = np.uint64
END = 0x5BF0A8B1457695F1  # the end token's hash; no word's hash is built this way
_FLUSH = 1 << 21
MOST_FILES = 1024
_RIGHT = 40  # bits of a right pair's id in a triple's key


def held_out(doc_id: str = "doc_id", parts: int = 7, part: int = 2):
    """Column: crc32 of the doc_id as text, modulo parts, is part."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def token_hashes(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of each text and its end, offsets of the texts in them)."""
    words = Words(raw, off)
    counts = words.counts()
    at = np.concatenate([[0], np.cumsum(counts + 1)])
    out = np.full(int(at[-1]), END, _U)
    place = np.ones(len(out), bool)
    place[at[1:] - 1] = False
    out[place] = words.hashes()
    return out, at


def shifted(x: np.ndarray, at: np.ndarray, first: int) -> np.ndarray:
    """What stands before each token of its text; ``first`` before the first ones."""
    out = np.empty_like(x)
    out[1:] = x[:-1]
    out[at[:-1]] = first
    return out


def _packed(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as compressed differences, byte plane by byte plane."""
    d = np.diff(x, prepend=_U(0)).view(np.uint8).reshape(-1, 8)
    return pa.Codec("zstd", 1).compress(np.ascontiguousarray(d.T), asbytes=True)


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    d = np.frombuffer(pa.Codec("zstd").decompress(raw, 8 * n, asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(d.T).view(_U).ravel(), dtype=_U)


def _small(x: np.ndarray) -> bytes:
    return pa.Codec("zstd", 1).compress(x.astype("<u4"), asbytes=True)


def _big(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(raw, 4 * n, asbytes=True), "<u4").astype(np.int64)


@dataclass(frozen=True)
class Cut:
    """Ranges of a 64-bit hash: 2**slice_bits slices, 2**file_bits files of equally many slices, 2**bucket_bits buckets in a slice."""

    slice_bits: int
    file_bits: int
    bucket_bits: int

    @classmethod
    def of(cls, tokens: int, slice_tokens: int) -> Cut:
        bits = max(3, int(tokens // slice_tokens).bit_length())
        return cls(bits, min(bits, MOST_FILES.bit_length() - 1), min(20, max(1, int(slice_tokens).bit_length() - 6)))

    def slice_of(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.slice_bits)).astype(np.int64)

    def file_of(self, slice_: np.ndarray) -> np.ndarray:
        return slice_ >> (self.slice_bits - self.file_bits)

    @property
    def files(self) -> int:
        return 1 << self.file_bits

    @property
    def slices_a_file(self) -> int:
        return 1 << (self.slice_bits - self.file_bits)

    def bucket(self, slice_: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The place in its file's directory of a key of this slice, by the upper bits of h."""
        own = (h >> _U(64 - self.bucket_bits)).astype(np.int64)
        return (slice_ & (self.slices_a_file - 1)) << self.bucket_bits | own

    def low(self, h: np.ndarray) -> np.ndarray:
        """The 32 bits after the bucket's."""
        return (h << _U(self.bucket_bits) >> _U(32)).astype(np.uint32)


_BLOCK = "file int, slice int, n long, keys binary, sums array<binary>"


def _blocks(cut: Cut, slice_: np.ndarray, keys: np.ndarray, sums: Sequence[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """One row for each slice of sorted distinct keys and what is counted of them."""
    if not len(keys):
        return
    order = np.argsort(slice_, kind="stable")
    slice_, keys, sums = slice_[order], keys[order], [s[order] for s in sums]
    begin = np.flatnonzero(np.concatenate([[True], slice_[1:] != slice_[:-1]]))
    end = np.append(begin[1:], len(keys))
    own = slice_[begin]
    for lo in range(0, len(own), 512):
        part = list(zip(begin[lo : lo + 512], end[lo : lo + 512]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(cut.file_of(own[lo : lo + 512]), pa.int32()), pa.array(own[lo : lo + 512], pa.int32()), pa.array([b - a for a, b in part], pa.int64()),
                pa.array([_packed(keys[a:b]) for a, b in part], pa.binary()), pa.array([[_small(s[a:b]) for s in sums] for a, b in part], pa.list_(pa.binary())),
            ],
            ["file", "slice", "n", "keys", "sums"],
        )


def _summed(keys: np.ndarray, sums: Sequence[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], [np.add.reduceat(s[order], first) if len(first) else s for s in sums]


def _merged(rows: list[dict]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The keys of a slice's blocks and their sums."""
    keys = np.concatenate([_unpacked(r["keys"], r["n"]) for r in rows])
    return _summed(keys, [np.concatenate([_big(r["sums"][k], r["n"]) for r in rows]) for k in range(len(rows[0]["sums"]))])


def _flushed(batches: Iterator[pa.RecordBatch], keys_of: Callable) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct keys, their counts) of a task's texts, _FLUSH raw keys at a time."""
    held, n = [], 0
    for batch in batches:
        for _, _, raw, off in text_chunks(batch.column("text")):
            held.append(keys_of(raw, off))
            n += len(held[-1])
            if n >= _FLUSH:
                yield np.unique(np.concatenate(held), return_counts=True)
                held, n = [], 0
    if n:
        yield np.unique(np.concatenate(held), return_counts=True)


def _by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, list[dict]]]]]:
    """(file, its slices (slice, rows)) of blocks sorted by file and slice; one slice is held at a time."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    for file, own in groupby(rows(), key=lambda r: r["file"]):
        yield file, ((s, list(part)) for s, part in groupby(own, key=lambda r: r["slice"]))


class Out:
    """Arrays of one file range, appended to slice by slice. Written under other names first: a task that runs twice leaves one good file."""

    def __init__(self, folder: str, file: int):
        self.folder, self.file, self.own = folder, file, uuid.uuid4().hex
        self.open: dict[str, object] = {}
        self.size: dict[str, int] = {}

    def add(self, name: str, array: np.ndarray) -> None:
        if name not in self.open:
            self.open[name], self.size[name] = open(f"{self.folder}/.{name}-{self.file}-{self.own}", "wb"), 0
        self.open[name].write(np.ascontiguousarray(array).data)
        self.size[name] += len(array)

    def add_small(self, name: str, values: np.ndarray) -> None:
        """Numbers from 0 as bytes; those over 254 go to a list of places and values."""
        large = np.flatnonzero(values > 254)
        base = self.size.get(name, 0)
        self.add(name, np.minimum(values, 255).astype(np.uint8))
        self.add(f"{name}-at", large.astype(np.int64) + base)
        self.add(f"{name}-more", values[large].astype(np.int64))

    def close(self) -> None:
        for name, f in self.open.items():
            f.close()
            os.replace(f.name, f"{self.folder}/{name}-{self.file}")


class Files:
    """The arrays of a model, mapped as they are touched."""

    KINDS = {"words": _U, "counts": np.int64, "facts": np.float64, "pair-dir": np.int64, "triple-dir": np.int64, "pair": np.uint32, "triple": np.uint32}

    def __init__(self, folder: str):
        self.folder = folder
        self.held: dict[tuple[str, int], np.ndarray] = {}

    def __call__(self, name: str, file: int) -> np.ndarray:
        if (name, file) not in self.held:
            path = f"{self.folder}/{name}-{file}"
            kind = self.KINDS.get(name) or (np.int64 if name.endswith(("-at", "-more")) else np.uint8)
            filled = os.path.exists(path) and os.path.getsize(path)
            self.held[name, file] = np.memmap(path, kind, "r") if filled else np.zeros(0, kind)
        return self.held[name, file]

    def small(self, name: str, file: int, at: np.ndarray) -> np.ndarray:
        held = self(name, file)
        if not len(held):
            return np.zeros(len(at), np.int64)
        out = held[at].astype(np.int64)
        large = np.flatnonzero(out == 255)
        if len(large):
            out[large] = self(f"{name}-more", file)[np.searchsorted(self(f"{name}-at", file), at[large])]
        return out

    def find(self, name: str, file: int, bucket: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Places of keys in a hash array of this file, -1 for unseen ones."""
        starts, keys = self(f"{name}-dir", file), self(name, file)
        if not len(keys):
            return np.full(len(bucket), -1, np.int64)
        lo, hi = starts[bucket], starts[bucket + 1]
        end = hi.copy()
        for _ in range(int((hi - lo).max(initial=0)).bit_length()):
            mid = (lo + hi) >> 1
            less = (mid < hi) & (keys[np.minimum(mid, len(keys) - 1)] < low)
            lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
        return np.where((lo < end) & (keys[np.minimum(lo, len(keys) - 1)] == low), lo, -1)


def _directory(cut: Cut, out: Out, name: str, slice_: int, bucket: np.ndarray) -> None:
    """Appends a slice's part of the directory: slices without keys before it, too."""
    width, at = 1 << cut.bucket_bits, out.size.get(f"{name}-dir", 0)
    base, own = out.size.get(name, 0), (slice_ & (cut.slices_a_file - 1)) << cut.bucket_bits
    out.add(f"{name}-dir", np.full(own - at, base, np.int64))
    out.add(f"{name}-dir", base + np.searchsorted(bucket, np.arange(own, own + width)))


def _end_directory(cut: Cut, out: Out, name: str) -> None:
    at = out.size.get(f"{name}-dir", 0)
    out.add(f"{name}-dir", np.full((cut.slices_a_file << cut.bucket_bits) + 1 - at, out.size.get(name, 0), np.int64))


# What follows a context, if little: (total, continuations seen once, twice, more often) by number; 0 is nothing, 255 stands in a list.
_FOLLOWS = [(0, 0, 0, 0)] + [(t, a, b, c) for t in range(1, 11) for b in range(t // 2 + 1) for c in range(t // 3 + 1) for a in range(t - 2 * b + 1) if (a + 2 * b == t if not c else a + 2 * b + 3 * c <= t)]
_FOLLOW_NUMBER = np.full((11, 11, 6, 4), 255, np.uint8)
for _k, _x in enumerate(_FOLLOWS[:255]):
    _FOLLOW_NUMBER[_x] = _k
_FOLLOW_TABLE = np.array(_FOLLOWS[:255] + [(0, 0, 0, 0)] * (256 - len(_FOLLOWS[:255])), np.int64)


@dataclass
class Model:
    """Facts that are a few numbers; the arrays are files in folder."""

    folder: str
    cut: Cut
    first_word: np.ndarray  # words before each file
    first_pair: np.ndarray  # pairs before each file
    n: int
    v: int
    discounts: tuple[tuple[float, float, float], ...]  # of words, pairs, triples
    left: int  # different pairs that follow something, over all words
    base_mass: float  # what the discounts of the left kinds leave for the uniform distribution

    def delete(self) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


class Lookup:
    """Words, pairs and triples of a model, looked up in a worker."""

    def __init__(self, folder: str, cut: Cut, first_word: np.ndarray, first_pair: np.ndarray | None = None):
        self.files, self.cut, self.first_word, self.first_pair = Files(folder), cut, first_word, first_pair

    def _each(self, file: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        order = np.argsort(file, kind="stable")
        begin = np.flatnonzero(np.concatenate([[True], np.diff(file[order]) != 0])) if len(file) else []
        for a, b in zip(begin, [*begin[1:], len(file)]):
            yield int(file[order[a]]), order[a:b]

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Ids of distinct hashes, -1 for unknown words."""
        out = np.full(len(h), -1, np.int64)
        for f, own in self._each(self.cut.file_of(self.cut.slice_of(h))):
            words = self.files("words", f)
            if len(words):
                k = np.minimum(np.searchsorted(words, h[own]), len(words) - 1)
                out[own] = np.where(words[k] == h[own], k + self.first_word[f], -1)
        return out

    def facts(self, ids: np.ndarray) -> np.ndarray:
        """Rows (count, left kinds, continuations' total, back-off weight) of ids; unknown (-1) gives zeros and weight 1."""
        out = np.zeros((len(ids), 4))
        out[:, 3] = 1
        known = np.flatnonzero(ids >= 0)
        for f, own in self._each(np.searchsorted(self.first_word, ids[known], "right") - 1):
            out[known[own]] = self.files("facts", f).reshape(-1, 4)[ids[known[own]] - self.first_word[f]]
        return out

    def pairs(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair ids, -1 for unseen pairs; slices; ids within the slice) of distinct (id before) << 32 | id."""
        h = mix(key)
        slice_ = self.cut.slice_of(h)
        inner = h << _U(self.cut.slice_bits)
        bucket, low = self.cut.bucket(slice_, inner), self.cut.low(inner)
        out, rel = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
        for f, own in self._each(self.cut.file_of(slice_)):
            at = self.files.find("pair", f, bucket[own], low[own])
            starts = self.files("pair-dir", f)
            if len(starts):
                rel[own] = at - starts[bucket[own] >> self.cut.bucket_bits << self.cut.bucket_bits]
            out[own] = np.where(at >= 0, at + self.first_pair[f], -1)
        return out, slice_, rel

    def pair_facts(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words before the pair, rows of what follows it: total, seen once, twice, more often) of pair ids; zeros for -1."""
        before, follows = np.zeros(len(ids), np.int64), np.zeros((len(ids), 4), np.int64)
        known = np.flatnonzero(ids >= 0)
        for f, own in self._each(np.searchsorted(self.first_pair, ids[known], "right") - 1):
            at, to = ids[known[own]] - self.first_pair[f], known[own]
            before[to] = self.files.small("before", f, at)
            code = self.files("follows", f)
            if not len(code):  # no pair of this file is a context
                continue
            code = code[at]
            rows = _FOLLOW_TABLE[code]
            large = np.flatnonzero(code == 255)
            if len(large):
                rows[large] = self.files("follows-more", f).reshape(-1, 4)[np.searchsorted(self.files("follows-at", f), at[large])]
            follows[to] = rows
        return before, follows

    def triples(self, left: np.ndarray, slice_: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Counts of triples of seen pairs, with the slices of the left ones; 0 for unseen ones."""
        h = triple_hash(left, right)
        bucket, low, out = self.cut.bucket(slice_, h), self.cut.low(h), np.zeros(len(left), np.int64)
        for f, own in self._each(self.cut.file_of(slice_)):
            at = self.files.find("triple", f, bucket[own], low[own])
            hit = np.flatnonzero(at >= 0)
            out[own[hit]] = self.files.small("count", f, at[hit])
        return out


def triple_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(mix(left.astype(_U)) + right.astype(_U))


def _discounts(seen: Sequence[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from the numbers of keys seen 1 to 4 times."""
    n1, n2, n3, n4 = seen
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 2 - 3 * y * n3 / n2)
    return tuple(min(max(x, 0.05), k - 0.05) for k, x in zip((1, 2, 3), d))


def _discount(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.where(counts >= 3, d[2], np.where(counts == 2, d[1], d[0]))


def _seen(counts: np.ndarray) -> np.ndarray:
    return np.array([(counts == k).sum() for k in (1, 2, 3, 4)], np.int64)


_DONE = "file int, keys long, total long, seen array<long>"


def _told(file: int, keys: int, total: int, seen: Sequence[int] = (0, 0, 0, 0)) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([file], pa.int32()), pa.array([int(keys)], pa.int64()), pa.array([int(total)], pa.int64()), pa.array([[int(x) for x in seen]], pa.list_(pa.int64()))], ["file", "keys", "total", "seen"])


def train(docs: DataFrame, shard_tokens: int = 2_000_000) -> Model:
    """Counts the texts of docs (text) and writes the model's files."""
    spark = docs.sparkSession
    small_batches(spark)
    folder = mounted_path(spark, "ngram")
    os.makedirs(folder)
    texts = with_columns(docs, "text")
    size = texts.agg(F.sum(F.length("text"))).head()[0] or 0
    cut = Cut.of(int(size / 6), shard_tokens)
    n_files = cut.files

    def gathered(blocks: DataFrame) -> DataFrame:
        return blocks.repartition(n_files, "file").sortWithinPartitions("file", "slice")

    def firsts(done: dict[int, int]) -> np.ndarray:
        return np.concatenate([[0], np.cumsum([done.get(f, 0) for f in range(n_files)])]).astype(np.int64)

    # Words.
    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts in _flushed(batches, lambda raw, off: token_hashes(raw, off)[0]):
            yield from _blocks(cut, cut.slice_of(keys), keys, [counts])

    def save_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, slices in _by_file(batches):
            out, total = Out(folder, file), 0
            for _, rows in slices:
                keys, (counts,) = _merged(rows)
                out.add("words", keys)
                out.add("counts", counts)
                total += int(counts.sum())
            out.close()
            yield _told(file, out.size["words"], total)

    saved = {r.file: r for r in gathered(texts.mapInArrow(tidy(words), _BLOCK)).mapInArrow(tidy(save_words), _DONE).collect()}  # one row a file
    first_word = firsts({f: r["keys"] for f, r in saved.items()})
    total, v = sum(r.total for r in saved.values()), int(first_word[-1])

    # Pairs.
    def token_ids(look: Lookup, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        h, at = token_hashes(raw, off)
        u, back = np.unique(h, return_inverse=True)
        ids = look.ids(u)[back]
        return ids, at, int(ids[at[1] - 1])

    def pair_keys(ids: np.ndarray, at: np.ndarray, end: int) -> np.ndarray:
        return shifted(ids, at, end).astype(_U) << _U(32) | ids.astype(_U)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(folder, cut, first_word)

        def keys_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
            ids, at, end = token_ids(look, raw, off)
            return np.append(pair_keys(ids, at, end), _U(end << 32 | end))  # the two ends before a text are a context

        for keys, _ in _flushed(batches, keys_of):
            yield from _blocks(cut, cut.slice_of(mix(keys)), keys, [])

    def save_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, slices in _by_file(batches):
            out = Out(folder, file)
            for s, rows in slices:
                keys, _ = _merged(rows)
                inner = np.sort(mix(keys)) << _U(cut.slice_bits)
                _directory(cut, out, "pair", s, cut.bucket(np.int64(s), inner))
                out.add("pair", cut.low(inner))
                packed = np.frombuffer(_packed(keys), np.uint8)
                out.add("pair-keys", np.concatenate([np.array([s, len(keys), len(packed)], np.int64).view(np.uint8), packed]))
            _end_directory(cut, out, "pair")
            out.close()
            yield _told(file, out.size["pair"], 0)

    first_pair = firsts({r.file: r["keys"] for r in gathered(texts.mapInArrow(tidy(pairs), _BLOCK)).mapInArrow(tidy(save_pairs), _DONE).collect()})

    # Triples, and what follows a pair.
    def triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(folder, cut, first_word, first_pair)

        def keys_of(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
            ids, at, end = token_ids(look, raw, off)
            u, back = np.unique(np.append(pair_keys(ids, at, end), _U(end << 32 | end)), return_inverse=True)
            pid, slice_, rel = look.pairs(u)
            key = shifted(back[:-1], at, int(back[-1]))  # the left pair's place in u
            return np.stack([slice_[key].astype(_U), rel[key].astype(_U) << _U(_RIGHT) | pid[back[:-1]].astype(_U)], axis=1)

        for keys, counts in _flushed_rows(batches, keys_of):
            yield from _blocks(cut, keys[0].astype(np.int64), keys[1], [counts])

    def slice_starts(files: Files, file: int) -> np.ndarray:
        """The first pair's place in each slice of a file, and the end."""
        return files("pair-dir", file)[:: 1 << cut.bucket_bits]

    def save_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        every = None
        for file, slices in _by_file(batches):
            out, seen, starts = Out(folder, file), np.zeros(4, np.int64), slice_starts(files, file)
            for s, rows in slices:
                keys, (counts,) = _merged(rows)
                k = s & (cut.slices_a_file - 1)
                rel, right = (keys >> _U(_RIGHT)).astype(np.int64), (keys & _U((1 << _RIGHT) - 1)).astype(np.int64)
                h = triple_hash(rel + (starts[k] + first_pair[file]), right)
                order = np.argsort(h)
                _directory(cut, out, "triple", s, cut.bucket(np.int64(s), h[order]))
                out.add("triple", cut.low(h[order]))
                out.add_small("count", counts[order])
                seen += _seen(counts)
                # What follows each pair of the slice, and of slices without triples before it.
                begin = np.flatnonzero(np.concatenate([[True], rel[1:] != rel[:-1]]))
                rows4 = np.stack([np.add.reduceat(x.astype(np.int64), begin) for x in (counts, counts == 1, counts == 2, counts > 2)], axis=1)
                small = (rows4[:, 0] <= 10) & (rows4[:, 2] <= 5) & (rows4[:, 3] <= 3)
                code = np.full(len(rows4), 255, np.uint8)
                code[small] = _FOLLOW_NUMBER[tuple(rows4[small].T)]
                base = out.size.get("follows", 0)
                follows = np.zeros(int(starts[k + 1]) - base, np.uint8)
                at = rel[begin] + int(starts[k])
                follows[at - base] = code
                out.add("follows", follows)
                out.add("follows-at", at[code == 255])
                out.add("follows-more", rows4[code == 255].ravel())
                # How many different words stand before each right pair: one for each triple.
                if every is None:
                    every = np.concatenate([slice_starts(files, f)[:-1] + first_pair[f] if len(slice_starts(files, f)) else np.full(cut.slices_a_file, first_pair[f]) for f in range(n_files)])
                ids, kinds = np.unique(right, return_counts=True)
                to = np.searchsorted(every, ids, "right") - 1
                yield from _blocks(cut, to, (ids - every[to]).astype(_U), [kinds])
            _end_directory(cut, out, "triple")
            out.add("follows", np.zeros(int(starts[-1]) - out.size.get("follows", 0), np.uint8))
            out.close()
            # Numbers of the whole file, as a block of its own kind.
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([file], pa.int32()), pa.array([len(seen)], pa.int64()), pa.array([seen.tobytes()], pa.binary()), pa.array([[]], pa.list_(pa.binary()))], ["file", "slice", "n", "keys", "sums"])

    sent = written(gathered(texts.mapInArrow(tidy(triples), _BLOCK)).mapInArrow(tidy(save_triples), _BLOCK), "ngram-before")
    top = sum((np.frombuffer(r["keys"], np.int64) for r in sent.where("file < 0").select("keys").collect()), np.zeros(4, np.int64))  # one row a file

    # The lower orders: words before a pair; what follows a word, and words before it.
    def save_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        for file, slices in _by_file(batches):
            out, seen, starts = Out(folder, file), np.zeros(4, np.int64), slice_starts(files, file)
            raw, at = files("pair-keys", file), 0
            for s, rows in slices:
                rel, (kinds,) = _merged(rows)
                k = s & (cut.slices_a_file - 1)
                base = out.size.get("before", 0)
                before = np.zeros(int(starts[k + 1]) - base, np.int64)
                before[rel.astype(np.int64) + int(starts[k]) - base] = kinds
                out.add_small("before", before)
                seen += _seen(kinds)
                while True:
                    slice_, n, packed = raw[at : at + 24].view(np.int64)
                    at += 24 + int(packed)
                    if slice_ == s:
                        break
                keys = _unpacked(raw[at - int(packed) : at].tobytes(), int(n))
                keys = keys[np.argsort(mix(keys))][rel.astype(np.int64)]
                yield from _word_blocks(keys, kinds)
            out.add_small("before", np.zeros(int(starts[-1]) - out.size.get("before", 0), np.int64))
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([file], pa.int32()), pa.array([len(seen)], pa.int64()), pa.array([seen.tobytes()], pa.binary()), pa.array([[]], pa.list_(pa.binary()))], ["file", "slice", "n", "keys", "sums"])

    def _word_blocks(keys: np.ndarray, kinds: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Of these pairs with so many words before them: for each word, how many pairs end with it, and the sums of those that begin with it."""
        ones = np.ones(len(keys), np.int64)
        zero = np.zeros(len(keys), np.int64)
        word = np.concatenate([keys & _U(0xFFFFFFFF), keys >> _U(32)])
        sums = [np.concatenate(x) for x in ((ones, zero), (zero, kinds), (zero, (kinds == 1).astype(np.int64)), (zero, (kinds == 2).astype(np.int64)), (zero, (kinds > 2).astype(np.int64)))]
        ids, sums = _summed(word, sums)
        file = np.searchsorted(first_word, ids.astype(np.int64), "right") - 1
        yield from _blocks(cut, file << (cut.slice_bits - cut.file_bits), ids, sums)

    low = written(gathered(sent.where("file >= 0")).mapInArrow(tidy(save_before), _BLOCK), "ngram-words")
    middle = sum((np.frombuffer(r["keys"], np.int64) for r in low.where("file < 0").select("keys").collect()), np.zeros(4, np.int64))  # one row a file
    d3, d2 = _discounts(top), _discounts(middle)

    def save_facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(folder)
        for file, slices in _by_file(batches):
            out, counts = Out(folder, file), files("counts", file)
            facts = np.zeros((len(counts), 6))
            facts[:, 0] = counts
            for _, rows in slices:
                ids, sums = _merged(rows)
                facts[ids.astype(np.int64) - first_word[file], 1:] += np.stack(sums, axis=1)
            made = facts[:, :4].copy()
            with np.errstate(divide="ignore", invalid="ignore"):
                made[:, 3] = np.where(facts[:, 2] > 0, facts[:, 3:] @ np.array(d2) / facts[:, 2], 1.0)
            out.add("facts", made.ravel())
            out.close()
            yield _told(file, int((facts[:, 1] > 0).sum()), facts[:, 1].sum(), _seen(facts[:, 1].astype(np.int64)))

    kept = gathered(low.where("file >= 0")).mapInArrow(tidy(save_facts), _DONE).collect()  # one row a file
    for f in range(n_files):
        if os.path.exists(f"{folder}/pair-keys-{f}"):
            os.remove(f"{folder}/pair-keys-{f}")
    base_seen = sum((np.array(r.seen, np.int64) for r in kept), np.zeros(4, np.int64))
    d1, left, kinds = _discounts(base_seen), sum(r.total for r in kept), sum(r["keys"] for r in kept)
    mass = (d1[0] * base_seen[0] + d1[1] * base_seen[1] + d1[2] * (kinds - base_seen[0] - base_seen[1])) / left if left else 0.0
    dropped(sent, low)
    return Model(folder, cut, first_word, first_pair, total, v, (d1, d2, d3), left, float(mass))


def _flushed_rows(batches: Iterator[pa.RecordBatch], keys_of: Callable) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], np.ndarray]]:
    """As _flushed(), for keys of two numbers, the first of them small: ((first, second), counts), sorted by both."""
    held, n = [], 0

    def counted() -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        both = np.concatenate(held)
        order = np.lexsort((both[:, 1], both[:, 0]))
        a, b = both[order, 0], both[order, 1]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        return (a[first], b[first]), np.diff(np.append(first, len(a)))

    for batch in batches:
        for _, _, raw, off in text_chunks(batch.column("text")):
            held.append(keys_of(raw, off))
            n += len(held[-1])
            if n >= _FLUSH:
                yield counted()
                held, n = [], 0
    if n:
        yield counted()


def probabilities(m: Model, look: Lookup, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets of the texts' tokens, counts of the tokens in training, the model's probabilities of them)."""
    d1, d2, d3 = m.discounts
    h, at = token_hashes(raw, off)
    u, back = np.unique(h, return_inverse=True)
    ids = look.ids(u)
    facts = look.facts(ids)
    if m.left:
        p1 = np.where(facts[:, 1] > 0, (facts[:, 1] - _discount(facts[:, 1], d1)) / m.left, 0.0) + m.base_mass / (m.v + 1)
    else:
        p1 = np.ones(len(u))
    end = int(back[at[1] - 1]) if len(at) > 1 else 0
    # Different pairs of places in u, the pair of two ends last.
    key, pair = np.unique(np.append(shifted(back, at, end) << 32 | back, end << 32 | end), return_inverse=True)
    one, two = key >> 32, key & 0xFFFFFFFF
    known = np.flatnonzero((ids[one] >= 0) & (ids[two] >= 0))
    pid, slice_ = np.full(len(key), -1, np.int64), np.zeros(len(key), np.int64)
    if len(known):
        pid[known], slice_[known], _ = look.pairs(ids[one[known]].astype(_U) << _U(32) | ids[two[known]].astype(_U))
    before, follows = look.pair_facts(pid)
    p2 = facts[one, 3] * p1[two]
    some = np.flatnonzero(before)
    p2[some] += (before[some] - _discount(before[some], d2)) / facts[one[some], 2]
    # Different triples of places in key.
    both, triple = np.unique(shifted(pair[:-1], at, int(pair[-1])) << 32 | pair[:-1], return_inverse=True)
    a, b = both >> 32, both & 0xFFFFFFFF
    p3, held = p2[b], np.flatnonzero(follows[a, 0])
    f = follows[a[held]]
    p3[held] *= f[:, 1:] @ np.array(d3) / f[:, 0]
    seen = held[pid[b[held]] >= 0]
    count = look.triples(pid[a[seen]], slice_[a[seen]], pid[b[seen]])
    hit = np.flatnonzero(count)
    p3[seen[hit]] += (count[hit] - _discount(count[hit], d3)) / follows[a[seen[hit]], 0]
    return at, facts[back, 0], p3[triple]


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The kept columns of docs and n_tokens, n_known, train_tokens, base_score, score of each whole text."""
    m = model
    kinds = dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = Lookup(m.folder, m.cut, m.first_word, m.first_pair)
        for batch in batches:
            for i, j, raw, off in text_chunks(batch.column("text"), 2 << 20):
                at, counts, p = probabilities(m, look, raw, off)
                start = at[:-1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(i, j - i) for c in keep),
                        pa.array(np.diff(at)), pa.array(np.add.reduceat((counts > 0).astype(np.int64), start)), pa.array(np.full(j - i, m.n)),
                        pa.array(np.add.reduceat(np.log10((counts + 1) / (m.n + m.v + 1)), start)), pa.array(np.add.reduceat(np.log10(p), start)),
                    ],
                    [*keep, "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    schema = "".join(f"`{c}` {kinds[c]}, " for c in keep) + "n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return with_columns(docs, *dict.fromkeys([*keep, "text"])).mapInArrow(tidy(run), schema)


def score_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; a model of those not held out."""
    marked = with_columns(docs, "doc_id", "text").withColumn("held_out", held_out())
    model = train(marked.where("NOT held_out"))
    out = written(score(marked, model, "doc_id", "held_out"), "ngram-scores")
    model.delete()
    return out
