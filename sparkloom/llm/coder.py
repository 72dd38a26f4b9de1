"""Token ids in files of independently coded blocks: a context-mixing range coder (operator 5).

An id is predicted by three models of its block alone: the id that followed the same two ids (order 2), the id that followed the same
id (order 1), each with a confidence of 0 to 7, and the counts of all ids that the block has held (order 0). Their shares
are mixed into one distribution: the shares of the predictions, learnt per pair of confidences and by whether both name one id, then the
counts' share; an id that is foretold and held takes the wider of its parts. Ids that the counts do not hold yet have a learnt share of
order 0, dealt by counts of size classes. The range coder narrows down to the id's interval of that one distribution; its intervals are
whole numbers below 2^53 in double precision, so that sums, products and quotients' floors are exact.

A block is cut into strands of about ``_STRAND`` ids, each coded into words of its own, side by side: each step of the coder handles one id of every strand
of every block as numpy arrays. Strands of a block share its models: predictions are learnt after every step, shares and the sorted
order-0 table at fixed steps (``_steps``). Every block starts from the same empty models, so blocks are coded and read each by itself, and a
lost or damaged one costs only itself; a block carries its length and the CRC-32 of its ids.

A file is one slice of doc_ids, made by one Spark task in the shared folder (which must be mounted) and read back by one, section after
section; a task holds one section (``LANES`` blocks, or one document if that is longer).

File: MAGIC, then sections: little-endian int64: documents, blocks; per document doc_id and length (int64), and a byte that tells a null doc_id; per block
number of ids, number of 16-bit words, CRC-32 (uint32); then the blocks' words.

Defined results: a null or empty text has the end id alone; repeated doc_ids stay separate documents, ordered by a hash of their
text; a null doc_id comes last; an empty table makes no file and gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import delete, mounted_path, tidy, written
from .slices import sliced
from .tokens import MOST_STEMS, BatchEncoder, tokenizer_path

MAGIC = b"CMIDS\x03\n\x00"
BLOCK = 16384
LANES = 208  # blocks coded side by side, and about what a task holds of ids
_STRAND = 512
_PART = 8 << 20  # bytes of texts tokenized at once
_BITS1, _BITS2 = 11, 13  # contexts of order 1 and order 2 that a block keeps, as powers of two
_SLOTS = (1 << _BITS1) + (1 << _BITS2)
_CHECK = np.uint32(0xFFF8)
_SURE = 8
_ZEROS = 4  # words that a strand may be read beyond its end, and one
_CELLS = 2 * _SURE * _SURE
_WORD, _LEAST = 65536.0, 2.0**32  # of the coder: a word, and the least width of its interval (the most is 2^48)
# By twice the confidence plus whether the prediction came true: the confidence after it, and whether the predicted id stays.
_NEXT = np.array([x for s in range(_SURE) for x in (s >> 1 if s > 1 else 1, min(s + 1, _SURE - 1))], np.uint32)
_KEEPS = np.array([x for s in range(_SURE) for x in (s > 2, True)])
# Shares that the predictions have before anything is learnt, by their confidences; one without confidence has none.
_FIRST = np.array([0, 0.01, 0.18, 0.3, 0.4, 0.45, 0.47, 0.48])
_WEIGHT = 4.0  # of these shares, in ids
_SIZE = np.frexp(np.arange(65536) + 1.0)[1] - 1  # size class of each id


def _steps(n: int) -> list[int]:
    """Steps at which what the models have seen is taken into the distributions anew, and the last one's end."""
    out = [0, 1]
    while out[-1] < n:
        out.append(max(out[-1] + 1, out[-1] * 2))
    return [*(x for x in out if x < n), n]


class Models:
    """The models of blocks of equally many strands and steps; a lane is a strand, strands of a block share its models and stand side by side."""

    def __init__(self, blocks: int, strands: int):
        m = blocks * strands
        self.blocks, self.strands = blocks, strands
        self.block = np.repeat(np.arange(blocks), strands)
        # Of each context: the id that it predicts (16 bits), 13 bits that check the context, and the confidence (0 to 7; 0 predicts nothing).
        self.table = np.zeros(blocks * _SLOTS, np.uint32)
        self.base = np.stack([self.block * _SLOTS, self.block * _SLOTS + (1 << _BITS1)])
        self.turn = np.array([[32 - _BITS1], [32 - _BITS2]], np.uint32)
        self.cell = self.block * _CELLS
        self.seen = np.zeros((blocks * _CELLS, 4))  # ids by cell and by whether order 2 (2) and order 1 (1) foretold them
        self.last, self.before = np.zeros(m, np.uint32), np.zeros(m, np.uint32)
        self.classes = np.full((blocks, 17), 0.25)
        self.told: list[np.ndarray] = []  # since the last renewal: each step's cells with their hits
        self.novel: list[np.ndarray] = []  # and its blocks and size classes of ids that the counts did not hold
        self.renew(0)

    def renew(self, t: int) -> None:
        """Takes the last steps into the shares; t is the number of ids in each block's counts."""
        g = self.blocks
        new = np.zeros((g, 17))
        fresh, many = np.ones(g), np.zeros(g)
        if self.told:
            hits = np.bincount(np.concatenate(self.told), minlength=g * _CELLS * 4).reshape(-1, 4)
            self.seen += hits
            new = np.bincount(np.concatenate(self.novel), minlength=g * 17).reshape(g, 17)
            fresh, many = new.sum(axis=1), hits[:, 0].reshape(g, -1).sum(axis=1)
        self.told, self.novel = [], []
        self.classes += new
        self.upto = np.cumsum(np.pad(np.floor(self.classes * 64 / self.classes.sum(axis=1, keepdims=True) * 64) + 1, ((0, 0), (1, 0))), axis=1)
        seen = self.seen.reshape(g, 2, _SURE, _SURE, 4)
        total = seen.sum(axis=4) + _WEIGHT
        both, one, two = seen[..., 3], seen[..., 1], seen[..., 2]
        first2, first1 = _FIRST[:, None], _FIRST[None, :] / 2
        share2 = (two + both + _WEIGHT * first2) / total * (first2 > 0)
        share1 = (one + _WEIGHT * first1) / total * (first1 > 0)
        share1[:, 1] *= first2 == 0  # where both foretell one id, order 2 has the whole share
        most = np.maximum(1, (share2 + share1) / (1 - 1 / 2048))
        self.share2 = (share2 / most).ravel()
        self.share = ((share2 + share1) / most).ravel()
        self.t = float(t)
        held = 1 - np.clip((fresh + 0.5) / (many + 1), 1 / 1024, 15 / 16)
        self.held = np.repeat(held / max(t, 1) * (t > 0), self.strands)

    def predict(self, width: np.ndarray) -> None:
        """Looks the contexts up: guesses, and how the intervals of the given widths are parted: order 2, order 1 up to upto, each place of the counts."""
        h = np.stack([self.last, self.last + self.before * np.uint32(0x2545F491)])
        h *= np.uint32(0x9E3779B1)
        self.at = (h >> self.turn) + self.base
        h &= _CHECK
        e = self.table.take(self.at, mode="clip")
        self.check, self.entry = h, e
        self.sure = (e & np.uint32(7)) * ((e & _CHECK) == h)
        self.guess = e >> np.uint32(16)
        one, two = self.sure
        same = (self.guess[0] == self.guess[1]) & (one > 0) & (two > 0)
        self.now = self.cell + (two * np.uint32(_SURE) + one + same * np.uint32(64))
        self.part2 = np.floor(width * self.share2.take(self.now, mode="clip"))
        self.upto_guess = np.floor(width * self.share.take(self.now, mode="clip"))
        self.each = np.floor((width - self.upto_guess) * self.held)
        self.rest = self.upto_guess + self.each * self.t  # here begins the part of ids that are not held

    def learn(self, ids: np.ndarray) -> None:
        hit = (self.guess == ids) & (self.sure > 0)
        code = (self.sure << np.uint32(1)) | hit
        new = np.where(_KEEPS.take(code, mode="clip"), self.entry & np.uint32(0xFFFF0000), ids << np.uint32(16))
        new |= self.check
        new |= _NEXT.take(code, mode="clip")
        self.table[self.at] = new
        self.told.append(self.now * 4 + hit[1] * 2 + hit[0])
        self.before, self.last = self.last, ids


def _runs(known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order 0: of each run of equal ids in each block's sorted ids: block, id, number of smaller ids, number of equal ids."""
    ids = np.sort(known, axis=1, kind="stable")
    new = np.empty(ids.shape, bool)
    new[:, 0] = True
    np.not_equal(ids[:, 1:], ids[:, :-1], out=new[:, 1:])
    at = np.flatnonzero(new)
    block = at // ids.shape[1]
    return block, ids.ravel()[at].astype(np.int64), at - block * ids.shape[1], np.diff(at, append=ids.size)


def _strands(n: int) -> tuple[int, int]:
    """A block's strands and the steps of its longest ones; the last n % strands have one id less."""
    strands = max(1, n // _STRAND)
    return strands, -(-n // strands)


def _groups(lengths: list[int]) -> list[tuple[int, int, np.ndarray]]:
    """Blocks that are coded side by side: strands, steps, numbers of the blocks."""
    found: dict[tuple[int, int], list[int]] = {}
    for k, n in enumerate(lengths):
        if n:
            found.setdefault(_strands(n), []).append(k)
    return [(*key, np.array(ks)) for key, ks in found.items()]


def _inside(lengths: np.ndarray, strands: int, steps: int) -> np.ndarray:
    """By block, strand and step: whether the strand has an id there."""
    each = (lengths // strands)[:, None] + (np.arange(strands) < (lengths % strands)[:, None])
    return np.arange(steps) < each[:, :, None]


def encode_blocks(blocks: list[np.ndarray]) -> list[np.ndarray]:
    """Each block's 16-bit words: numbers of words of all strands but the last, then the strands' words. Blocks hold at most 65535 ids below 65535."""
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(blocks)
    assert all(len(b) < 1 << 16 for b in blocks)
    for strands, steps, ks in _groups([len(b) for b in blocks]):
        g, m = len(ks), len(ks) * strands
        inside = _inside(np.array([len(blocks[k]) for k in ks]), strands, steps)
        ids = np.zeros((g, strands, steps), np.uint16)
        ids[inside] = np.concatenate([blocks[k] for k in ks])
        ids = np.ascontiguousarray(ids.transpose(0, 2, 1))  # block, step, strand
        by_step = np.ascontiguousarray(ids.transpose(1, 0, 2)).reshape(steps, m)
        live = inside[:, :, -1].ravel()
        words, used = _encode(ids, by_step, live)
        for n, k in enumerate(ks):
            some = used[n * strands : (n + 1) * strands]
            out[k] = np.concatenate([some[:-1].astype(np.uint16), *(words[n * strands + j, :u] for j, u in enumerate(some))])
    return out


def _encode(ids: np.ndarray, by_step: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, their number) of each strand."""
    (g, steps, strands), m = ids.shape, by_step.shape[1]
    s = Models(g, strands)
    low, width = np.zeros(m), np.full(m, 2.0**48)
    room = steps * 3 + 4
    words = np.zeros((m, room), np.uint32)
    flat, row = words.ravel(), np.arange(m) * room
    used = row.copy()
    look = np.zeros(1 << 16, np.uint32)  # of a block's ids: number of smaller ids, number of equal ids (0: not held)
    renewals = _steps(steps)

    def emit(low: np.ndarray, width: np.ndarray, lanes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Words out of intervals below the least width; a word above 65535 carries into the one before it, which is settled at the end."""
        narrow = width < _LEAST
        while True:
            top = np.floor(low * (1 / _LEAST))
            if lanes is None:
                flat[used] = top
                np.add(used, narrow, out=used)
            else:
                flat[used[lanes]] = top
                used[lanes] += narrow
            times = narrow * (_WORD - 1) + 1
            low = (low - top * (narrow * _LEAST)) * times
            width = width * times
            narrow = width < _LEAST
            if not narrow.any():
                return low, width

    for t, until in zip(renewals, renewals[1:]):
        if t:
            block, x, less, same = _runs(ids[:, :t].reshape(g, -1))
            s.renew(t * strands)
            cuts, said = np.searchsorted(block, np.arange(g + 1)).tolist(), (less << 16 | same).astype(np.uint32)
        found = np.zeros((until - t, g, strands), np.uint32)
        for n in range(g if t else 0):
            own = x[cuts[n] : cuts[n + 1]]
            look[own] = said[cuts[n] : cuts[n + 1]]
            found[:, n] = look.take(ids[n, t:until], mode="clip")
            look[own] = 0
        found = found.reshape(until - t, m)
        for k in range(t, until):
            x = by_step[k].astype(np.uint32)
            s.predict(width)
            less, same = found[k - t] >> np.uint32(16), found[k - t] & np.uint32(0xFFFF)
            (is1, is2), (sure1, sure2) = s.guess == x, s.sure > 0
            is1 &= sure1
            is2 &= sure2
            # An id that is foretold has its predictions' part or the counts' part, whichever is wider.
            start, by_counts = s.upto_guess + s.each * less, s.each * same
            is1 &= ~is2
            by_guess = s.part2 * is2 + (s.upto_guess - s.part2) * is1
            guessed = by_guess >= by_counts
            new_width = np.maximum(by_guess, by_counts)
            start = start * ~guessed + s.part2 * (guessed & is1)
            rest = np.flatnonzero(new_width == 0)
            start[rest], new_width[rest] = s.rest[rest], width[rest] - s.rest[rest]
            if k == steps - 1:
                start, new_width = start * live, np.where(live, new_width, width)
                rest = rest[live[rest]]
            low, width = emit(low + start, new_width)
            if len(rest):
                x_rest = x[rest].astype(np.int64)
                size, block = _SIZE[x_rest], s.block[rest]
                under, above = s.upto[block, size], s.upto[block, size + 1]
                split = np.floor(width[rest] / s.upto[block, 17])
                span = np.floor(split * (above - under) / (1 << size))
                low[rest], width[rest] = emit(low[rest] + split * under + span * (x_rest + 1 - (1 << size)), span, rest)
                s.novel.append(block * 17 + size)
            else:
                s.novel.append(np.zeros(0, np.int64))
            s.learn(x)
    flat[used] = np.ceil(low * (1 / _LEAST))
    used += 1
    words[np.arange(room) >= (used - row)[:, None]] = 0
    carry = words >> np.uint32(16)
    while carry.any():
        words &= np.uint32(0xFFFF)
        words[:, :-1] += carry[:, 1:]
        carry = words >> np.uint32(16)
    return words.astype(np.uint16), used - row


def decode_blocks(coded: list[np.ndarray], lengths: list[int]) -> list[np.ndarray]:
    """The ids of blocks of the given lengths."""
    out: list[np.ndarray] = [np.zeros(0, np.uint16)] * len(coded)
    for strands, steps, ks in _groups(list(lengths)):
        inside = _inside(np.array([lengths[k] for k in ks]), strands, steps)
        heads = np.array([coded[k][: strands - 1] for k in ks], np.int64).reshape(len(ks), strands - 1)
        size = np.array([[len(coded[k])] for k in ks])
        # A damaged head may point anywhere: the checksum tells.
        begin = np.minimum(np.cumsum(np.pad(heads, ((0, 0), (1, 0))), axis=1) + (strands - 1), size)
        n = np.diff(begin, axis=1, append=size).ravel()
        words = np.zeros(n.sum() + n.size * _ZEROS, np.uint16)
        used = np.cumsum(n + _ZEROS) - (n + _ZEROS)
        words[np.repeat(used - np.cumsum(n) + n, n) + np.arange(n.sum())] = np.concatenate([coded[k][strands - 1 :] for k in ks])[: n.sum()]
        found = _decode(words, used, len(ks), strands, steps, inside[:, :, -1].ravel())
        found = found.transpose(0, 2, 1)
        for n, k in enumerate(ks):
            out[k] = found[n][inside[n]]
    return out


def _decode(words: np.ndarray, used: np.ndarray, g: int, strands: int, steps: int, live: np.ndarray) -> np.ndarray:
    """Ids by block, step and strand. Of strand n the words begin at used[n] and have zeros after them."""
    m = g * strands
    s = Models(g, strands)

    def word(lanes: np.ndarray | None = None) -> np.ndarray:
        return words.take(used if lanes is None else used[lanes], mode="clip")

    code, width = np.zeros(m), np.full(m, 2.0**48)
    for _ in range(3):
        code = code * _WORD + word()
        used = used + 1
    ids = np.zeros((g, steps, strands), np.uint16)
    renewals = _steps(steps)
    places, runs, base, own = np.zeros(1, np.uint16), np.zeros(1, np.int64), np.zeros(m, np.int64), np.zeros(m, np.int64)

    def fill(code: np.ndarray, width: np.ndarray, lanes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        narrow = width < _LEAST
        while True:
            times = narrow * (_WORD - 1) + 1
            code = code * times + word(lanes) * narrow
            width = width * times
            if lanes is None:
                np.add(used, narrow, out=used)
            else:
                used[lanes] += narrow
            narrow = width < _LEAST
            if not narrow.any():
                return code, width

    for t, until in zip(renewals, renewals[1:]):
        if t:
            block, x, less, same = _runs(ids[:, :t].reshape(g, -1))
            own = np.searchsorted(block, np.arange(g))  # a block's first run
            places = np.repeat((np.arange(len(x)) - own[block]).astype(np.uint16), same)
            runs, base, own = x << 32 | less << 16 | same, s.block * (t * strands), own[s.block]
            s.renew(t * strands)
        for k in range(t, until):
            s.predict(width)
            over = code - s.upto_guess
            guessed, none = over < 0, code >= s.rest
            by2 = code < s.part2
            place = np.floor(np.maximum(over, 0.0) / np.maximum(s.each, 1.0))
            p = runs.take(places.take(np.minimum(place, max(s.t - 1, 0)).astype(np.int64) + base, mode="clip") + own, mode="clip")
            by1, counted = guessed & ~by2, ~guessed
            x = s.guess[1] * by2 + s.guess[0] * by1 + (p >> 32) * counted
            start = s.part2 * by1 + (s.upto_guess + s.each * (p >> 16 & 0xFFFF)) * counted
            new_width = s.part2 * by2 + (s.upto_guess - s.part2) * by1 + s.each * (p & 0xFFFF) * counted
            rest = np.flatnonzero(none)
            start[rest], new_width[rest] = s.rest[rest], width[rest] - s.rest[rest]
            if k == steps - 1:
                start, new_width = start * live, np.where(live, new_width, width)
                rest = rest[live[rest]]
            code, width = fill(code - start, new_width)
            if len(rest):
                block, c, r = s.block[rest], code[rest], width[rest]
                upto = s.upto[block]
                split = np.floor(r / upto[:, 17])
                size = np.minimum((upto[:, 1:] * split[:, None] <= c[:, None]).sum(axis=1), 16)
                under, above = s.upto[block, size], s.upto[block, size + 1]
                span = np.floor(split * (above - under) / (1 << size))
                c = c - split * under
                v = np.minimum(np.floor(c / span), (1 << size) - 1.0)
                x[rest] = np.minimum(v.astype(np.int64) + (1 << size) - 1, 65535)
                code[rest], width[rest] = fill(c - v * span, span, rest)
                s.novel.append(block * 17 + size)
            else:
                s.novel.append(np.zeros(0, np.int64))
            x = x.astype(np.uint32)
            ids[:, k] = x.reshape(g, strands)
            s.learn(x)
    return ids


def write_section(f: BinaryIO, doc_ids: list[int | None], ids: list[bytes]) -> None:
    """Documents in their order; ids as little-endian unsigned 32-bit integers."""
    flat = np.frombuffer(b"".join(ids), "<u4")
    blocks = [flat[lo : lo + BLOCK] for lo in range(0, len(flat), BLOCK)]
    coded = [c for lo in range(0, len(blocks), LANES) for c in encode_blocks(blocks[lo : lo + LANES])]
    table = np.array([[len(b), len(c), zlib.crc32(b.tobytes())] for b, c in zip(blocks, coded)], "<u4").reshape(-1, 3)
    f.write(np.array([len(ids), len(blocks)], "<i8").tobytes())
    f.write(np.array([x or 0 for x in doc_ids], "<i8").tobytes())
    f.write(np.array([len(x) // 4 for x in ids], "<i8").tobytes())
    f.write(bytes(x is None for x in doc_ids))
    f.write(table.tobytes())
    for c in coded:
        f.write(c.astype("<u2").tobytes())


def write_documents(path: str, documents: Iterable[tuple[int | None, bytes]]) -> tuple[int, int]:
    """(documents, ids) written, in sections of about LANES blocks. Written whole under another name, then named; without documents no file."""
    own, total, n = f"{os.path.dirname(path)}/.{uuid.uuid4().hex}", 0, 0
    doc_ids: list[int | None] = []
    ids: list[bytes] = []
    size = 0
    with open(own, "wb") as f:
        f.write(MAGIC)
        for doc_id, x in documents:
            if ids and size + len(x) > 4 * BLOCK * LANES:
                write_section(f, doc_ids, ids)
                doc_ids, ids, size = [], [], 0
            doc_ids.append(doc_id)
            ids.append(x)
            n, size, total = n + 1, size + len(x), total + len(x) // 4
        if ids:
            write_section(f, doc_ids, ids)
    if n:
        os.replace(own, path)
    else:
        os.remove(own)
    return n, total


def write_file(path: str, doc_ids: list[int | None], ids: list[bytes]) -> None:
    """One file of documents in their order; ids as little-endian unsigned 32-bit integers."""
    write_documents(path, zip(doc_ids, ids, strict=True))


def read_section(f: BinaryIO, path: str) -> Iterator[tuple[int | None, bytes]]:
    docs, blocks = np.frombuffer(f.read(16), "<i8")
    doc_ids, lengths = np.frombuffer(f.read(8 * int(docs)), "<i8"), np.frombuffer(f.read(8 * int(docs)), "<i8")
    nulls = f.read(int(docs))
    table = np.frombuffer(f.read(12 * int(blocks)), "<u4").reshape(-1, 3).astype(np.int64)
    held, k, lanes = bytearray(), 0, range(0, int(blocks), LANES)
    for part in (table[lo : lo + LANES] for lo in lanes):
        decoded = decode_blocks([np.frombuffer(f.read(2 * int(n)), "<u2") for n in part[:, 1]], part[:, 0].tolist())
        for ids, crc in zip(decoded, part[:, 2]):
            if zlib.crc32(raw := ids.astype("<u4").tobytes()) != crc:
                raise ValueError(f"{path}: a block is damaged")
            held += raw
        done = 0
        while k < docs and done + 4 * lengths[k] <= len(held):
            to = done + 4 * int(lengths[k])
            yield (None if nulls[k] else int(doc_ids[k])), bytes(held[done:to])
            done, k = to, k + 1
        del held[:done]


def read_file(path: str) -> Iterator[tuple[int | None, bytes]]:
    """(doc_id, ids) of a file's documents; raises on a block whose checksum differs."""
    with open(path, "rb") as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{path}: not a file of coded ids")
        while f.peek(1):
            yield from read_section(f, path)


def write_ids(docs: DataFrame, tokenizer: str | None = None, slice_chars: int = 16_000_000) -> tuple[str, list[tuple[int, int, int]]]:
    """Codes every document of docs (doc_id, text) in ascending doc_id order. (folder, [(file number, documents, ids)])."""
    folder, path = mounted_path(docs.sparkSession, "ids"), tokenizer or tokenizer_path()
    os.makedirs(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId()
        n, ids = write_documents(f"{folder}/{number:06d}.ids", _encoded(batches, BatchEncoder.of(path, MOST_STEMS)))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([n], pa.int64()), pa.array([ids], pa.int64())], ["file", "documents", "ids"])

    made = sliced(docs, slice_chars).mapInArrow(tidy(run, tokenizes=True), "file int, documents long, ids long").collect()  # one row a file
    return folder, sorted((r.file, r.documents, r.ids) for r in made)


def _encoded(batches: Iterator[pa.RecordBatch], encoder: BatchEncoder) -> Iterator[tuple[int | None, bytes]]:
    end = np.zeros(1, "<u4").tobytes()
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy().astype(np.int64)) // _PART
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), batch.num_rows]
        for rows in (batch.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:])):
            for doc_id, x in zip(rows.column("doc_id").to_pylist(), encoder.encode(rows.column("text"))):
                yield doc_id, x + end


def read_ids(spark, folder: str, files: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary), read from the files."""
    first, total = [], 0
    for number, _, n in files:
        first.append((number, total))
        total += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column("id").to_pylist():
                number, start = first[k]
                held: list[tuple] = []
                for doc_id, ids in read_file(f"{folder}/{number:06d}.ids"):
                    held.append((doc_id, start, ids))
                    start += len(ids) // 4
                    if len(held) == 1000:
                        yield _rows(held)
                        held = []
                if held:
                    yield _rows(held)

    n = len(files)
    return spark.range(0, n, 1, max(n, 1)).mapInArrow(tidy(run), "doc_id long, start long, ids binary")


def _rows(held: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*held)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], ["doc_id", "start", "ids"])


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that were written."""
    spark = docs.sparkSession
    folder, files = write_ids(docs, tokenizer)
    read = read_ids(spark, folder, files)
    out = written(read.select("doc_id", "start", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")), "ids-read")
    delete(spark, folder)
    return out
