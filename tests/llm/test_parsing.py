"""Fingerprints: the contract's digests, equal texts, and what locally consistent parsing promises."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from rows import documents, odd_documents

from sparkloom.llm.parsing import code_points, compare_with_next, fingerprint_documents, fingerprints, labels, likeness, phrase_names


def edited(a: str, b: str) -> str:
    half = len(a) // 2
    return a[: len(a) - half] + b[:half]


def cells(text):
    return fingerprints([code_points(text)])[0]


WORD, STEP = (1 << 64) - 1, 0x9E3779B97F4A7C15


def spread(h: int) -> int:
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & WORD
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & WORD
    return h ^ h >> 31


def toss(own: int, left: int) -> int:
    """Twice the lowest bit in which a number differs from its left neighbour, plus that bit."""
    bit = ((own ^ left) & -(own ^ left)).bit_length() - 1
    return 2 * bit + (own >> bit & 1)


def plain_parse(symbols: list[int]) -> list[int]:
    """The next level's names, by the definition, one symbol after another."""
    runs: list[list[int]] = []
    for x in symbols:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    x = [s if n == 1 else spread((s * STEP + n) & WORD) for s, n in runs]
    tossed = [toss(v, x[k - 1] if k else 0) if k or v else 128 for k, v in enumerate(x)]
    for _ in range(3):
        tossed = [toss(v, tossed[k - 1]) if k else toss(v, ~v & 255) for k, v in enumerate(tossed)]
    starts = [k for k in range(len(x)) if k == 0 or (k < len(x) - 1 and tossed[k - 1] < tossed[k] > tossed[k + 1])]
    power, names = STEP * 5 | 1, []
    for a, b in zip(starts, [*starts[1:], len(x)]):
        names.append(spread((sum(v * pow(power, k, 1 << 64) for k, v in enumerate(x[a:b])) + b - a) & WORD))
    return names


def plain_fingerprint(text: str) -> str:
    if not text:
        return "ffff" * 64
    symbols, level, names = [spread(ord(c) + 1) for c in text], 0, set()
    while level == 0 or len(symbols) > 1:
        symbols, level = plain_parse(symbols), level + 1
        names.update(symbols if level >= 2 or len(symbols) == 1 else [])
    factors = [spread(k * STEP & WORD) | 1 for k in range(1, 65)]
    return "".join(f"{spread(min(n * f & WORD for n in names)) >> 48:04x}" for f in factors)


def plain_likeness(a: str, b: str) -> float:
    return sum(a[4 * k : 4 * k + 4] == b[4 * k : 4 * k + 4] for k in range(64)) / 64


def check(rows, out):
    order = sorted(rows, key=lambda r: -r[0])
    want = []
    for k, r in enumerate(order):
        a, b = r[1] or "", order[(k + 1) % len(order)][1] or ""
        e = edited(a, b)
        x, y, z = map(plain_fingerprint, (a, e, b))
        want.append((r[0], len(a), hashlib.sha256(e.encode()).hexdigest(), x, y, plain_likeness(x, y), plain_likeness(x, z)))
    assert sorted(map(tuple, out)) == sorted(want)


def test_odd_documents(spark):
    rows = odd_documents()[:-1]
    check(rows, compare_with_next(documents(spark, rows)).collect())


def test_slices_change_nothing(spark):
    rows = odd_documents()[:-1]
    check(rows, compare_with_next(documents(spark, rows), slice_chars=5000).collect())


def test_thousands_of_slices(spark):
    rows = [(k, f"text number {k * k}", "", "s", 0, "", 0, 0, 0) for k in range(3200)]
    check(rows, compare_with_next(documents(spark, rows), slice_chars=10).collect())


def test_null_doc_ids_and_repeated_rows(spark):
    """Rows of one doc_id follow one another in some order: their texts' next texts make one ring."""
    texts = [f"nothing {k % 9} but a text" for k in range(40)]
    rows = [(None, x, "", "s", 0, "", 0, 0, 0) for x in texts]
    for slice_chars in (60, 1_000_000):
        out = compare_with_next(documents(spark, rows), slice_chars=slice_chars).collect()
        assert sorted((r.doc_id, r.n_chars, r.fingerprint) for r in out) == sorted((None, len(x), plain_fingerprint(x)) for x in texts)
        ways = {hashlib.sha256(edited(a, b).encode()).hexdigest() for a in texts for b in texts}
        assert all(r.edited_sha256 in ways for r in out)


def test_a_null_doc_id_comes_last(spark):
    rows = [(None, "the last of them", "", "s", 0, "", 0, 0, 0), (5, "the first of them", "", "s", 0, "", 0, 0, 0), (1, "in the middle", "", "s", 0, "", 0, 0, 0)]
    for slice_chars in (5, 1_000_000):
        out = {r.doc_id: r for r in compare_with_next(documents(spark, rows), slice_chars=slice_chars).collect()}
        follows = {5: ("the first of them", "in the middle"), 1: ("in the middle", "the last of them"), None: ("the last of them", "the first of them")}
        assert {d: r.edited_sha256 for d, r in out.items()} == {d: hashlib.sha256(edited(a, b).encode()).hexdigest() for d, (a, b) in follows.items()}


def test_one_document_is_its_own_next(spark):
    rows = [(3, "abcdefgh", "", "s", 0, "", 0, 0, 0)]
    (r,) = compare_with_next(documents(spark, rows)).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdabcd").hexdigest()
    assert r.near_next == 1.0


def test_empty_table(spark):
    assert compare_with_next(documents(spark, [])).collect() == []
    assert fingerprint_documents(documents(spark, [])).collect() == []


def test_labels_differ_from_the_left_neighbour_and_stay_below_six():
    x = np.random.default_rng(1).integers(0, 50, 5000).astype(np.uint64)
    x = x[np.concatenate([[True], x[1:] != x[:-1]])]
    at = labels(x, np.array([0]))
    assert at.max() < 6
    assert (at[1:] != at[:-1]).all()


def test_equal_substrings_share_their_interior_names():
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghij ", k=1))
    shared = "".join(word() for _ in range(3000))
    names = []
    for offset in (0, 1, 17, 240):
        text = "".join(word() for _ in range(offset)) + shared + "".join(word() for _ in range(100))
        points = code_points(text)
        names.append({(level, int(n)) for level, _, _, found in phrase_names(points, np.array([len(points)])) if level <= 3 for n in found})
    for other in names[1:]:
        assert len(names[0] & other) >= 0.9 * len(names[0])


def test_likeness_follows_the_share_in_common():
    rng = random.Random(3)
    text = "".join(rng.choices("etaoin shrdlu", k=20_000))
    other = "".join(rng.choices("etaoin shrdlu", k=20_000))
    mine = cells(text)
    small = likeness(mine[None], cells(text[:10_000] + "X" + text[10_001:])[None])[0]
    half = likeness(mine[None], cells(text[:10_000] + other[:10_000])[None])[0]
    none = likeness(mine[None], cells(other)[None])[0]
    assert small > 0.9 > half > none
    assert half == pytest.approx(1 / 3, abs=0.15)
    assert none < 0.1
