"""Packing: every id once, nothing over the capacity, few sequences."""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from rows import documents, odd_documents

from sparkloom.llm.packing import complement, pack_documents, plan_sequences, sequences
from sparkloom.llm.tokens import tokenizer_path


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids + [0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def check(rows, packed, capacity):
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r.doc_id].append(r)
    wanted = defaultdict(list)
    for row, ids in zip(rows, ids_of([r[1] for r in rows])):
        wanted[row[0]].append(ids)
    assert set(by_doc) == set(wanted)
    for d, lists in wanted.items():
        want = []
        for ids in lists:
            first, at, piece = (len(ids) - 1) % capacity + 1, 0, 0
            while at < len(ids):
                to = first if not at else at + capacity
                want.append((piece, at, to - at, zlib.crc32(np.array(ids[at:to], "<u4").tobytes())))
                at, piece = to, piece + 1
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[d]) == sorted(want)
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence), sum(r.length for r in packed)


def test_odd_documents(spark):
    rows = odd_documents()
    used, total = check(rows, pack_documents(documents(spark, rows)).collect(), 2048)
    assert used <= -(-total // 2048) + 1


def test_small_capacity(spark):
    rows = odd_documents()[:40]
    used, total = check(rows, pack_documents(documents(spark, rows), capacity=100).collect(), 100)
    assert used <= 1.05 * total / 100 + 1


def test_sequences_hold_the_ids(spark):
    rows = odd_documents()[:40]
    packed = pack_documents(documents(spark, rows), keep_ids=True)
    total = sum(len(r.ids) for r in sequences(packed).collect())
    assert total == 4 * sum(map(len, ids_of([r[1] for r in rows])))


def test_empty_table(spark):
    assert pack_documents(documents(spark, [])).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=200))
def test_plans_use_every_piece_once(lengths):
    counts = np.bincount(np.array(lengths, np.int64), minlength=51)
    plan = plan_sequences(counts, 50)
    used = np.zeros(51, np.int64)
    for group, times in plan:
        assert sum(group) <= 50 and times > 0
        for x in group:
            used[x] += times
    assert (used == counts).all()
    # No two sequences could share one: best fit leaves at most one that is not over half full.
    assert sum(times for group, times in plan if 2 * sum(group) <= 50) <= 1


def test_complements_fill_gaps_exactly():
    have = np.zeros(21, np.int64)
    have[[3, 4, 5]] = 1
    assert sum(complement(have, 12)) == 12  # 3 + 4 + 5
    assert complement(have, 6) is None  # 3 + 3 needs two of them
    have[3] = 2
    assert complement(have, 6) == (3, 3)
