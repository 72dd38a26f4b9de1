"""Near-duplicates against all pairs, one by one."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from rows import components, documents, odd_documents, shingles

from sparkloom.llm.minhash import _groups, deduplicate, intersections, near_duplicates


def expected(rows):
    """A list of (doc_id, n_shingles, component_id, kept) by comparing every pair of different sets."""
    sets = [frozenset(shingles(r[1])) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    links = []
    for a, b in combinations(order, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            links.append((order.index(a), order.index(b)))
    roots = components(len(rows), links)
    out = []
    for place, k in enumerate(order):
        c = rows[order[roots[place]]][0]
        out.append((rows[k][0], len(sets[k]), c, rows[k][0] == c))
    return sorted(out)


def found(df):
    return sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect())


def test_odd_documents_equal_all_pairs(spark):
    rows = odd_documents()
    assert found(near_duplicates(documents(spark, rows))) == expected(rows)


def test_small_blocks_and_one_link_a_turn_change_nothing(spark):
    rows = odd_documents(seed=9)
    assert found(near_duplicates(documents(spark, rows), block=2, first_links=(1,))) == expected(rows)


def test_a_chain_of_copies_is_one_component(spark):
    rng = np.random.default_rng(4)
    text = [f"w{k}" for k in rng.integers(0, 10_000, 120)]
    rows = []
    for k in range(40):  # each differs from the one before by one word, and the first from the last by forty
        rows.append((k, " ".join(text), "", "s", 0, "", 0, 0, 0))
        text[3 * k] = f"new{k}"
    got = found(near_duplicates(documents(spark, rows)))
    assert got == expected(rows)
    assert {c for _, _, c, _ in got} == {0}


def test_pairs_at_the_threshold(spark):
    """16 of 20 and 15 of 20 shingles in common link (80 and 75 of 100); 14 of 20 do not."""
    rows = []
    for k, (both, own) in enumerate([(16, 2), (15, 5), (14, 6)]):
        head = [f"g{k}w{i}" for i in range(both + 4)]
        for side in "ab":
            tail = [f"g{k}{side}{i}" for i in range(own if side == "a" else 20 - both - (own if both == 16 else own))]
            rows.append((len(rows), " ".join(head + tail), "", "s", 0, "", 0, 0, 0))
    assert found(near_duplicates(documents(spark, rows))) == expected(rows)
    got = found(near_duplicates(documents(spark, rows)))
    assert [r[2] for r in got] == [0, 0, 2, 2, 4, 5]


def test_empty_table(spark):
    df = near_duplicates(documents(spark, []))
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert df.collect() == []


def test_null_ids_are_documents_but_name_nothing(spark):
    text = "a b c d e f g h"
    rows = [(None, text, "", "s", 0, "", 0, 0, 0), (7, text, "", "s", 0, "", 0, 0, 0), (None, "p q r s t", "", "s", 0, "", 0, 0, 0)]
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_duplicates(documents(spark, rows)).collect()}
    assert got == {(None, 4): (7, False), (7, 4): (7, True), (None, 1): (None, True)}


def test_deduplicate_keeps_first_rows_and_all_columns(spark):
    rows = odd_documents()
    kept = deduplicate(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    want = sorted(r[0] for r in expected(rows) if r[3])
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_deduplicate_keeps_one_text_of_each_group_where_ids_repeat(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    near = lambda text: text + " and more"
    texts = [(1, a), (1, near(a)), (1, a.upper()), (2, a), (1, b), (3, near(b)), (5, c), (5, near(a)), (6, near(c)), (7, None), (7, near(b)), (None, a), (None, "own words")]
    rows = [(k, t, "", "s", 0, "", 0, 0, 0) for k, t in texts]
    got = [(r.doc_id, r.text) for r in deduplicate(documents(spark, rows)).collect()]
    assert sorted((k, t[0].lower()) for k, t in got if t and k) == [(1, "a"), (1, "b"), (5, "c")]
    assert {(k, t) for k, t in got if not (t and k)} == {(7, None), (None, "own words")}


def test_driver_documents_equal_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    if len(rows) > 1000:
        pytest.skip("all pairs of a large table take too long")
    assert found(near_duplicates(docs)) == expected(rows)


def test_intersections_are_those_of_the_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 300, n)).astype(np.uint64) for n in (1, 40, 200, 3, 90, 150, 260)]
    left, right = np.array([0, 2, 5]), np.array([1, 3, 4, 6])
    got = intersections(sets, left, right, columns=7)
    assert got.tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in right] for a in left]


def test_texts_with_many_copies_are_looked_up_in_place(spark):
    rows = odd_documents(seed=3)
    docs = documents(spark, rows)
    assert found(_groups(docs.select("doc_id", "text"), hot_copies=2)) == expected(rows)


def test_alike_but_unlinked_documents(spark):
    """Documents that share two thirds of their text, and a few that share more: regions full of different components."""
    rng = np.random.default_rng(12)
    shared = [f"s{k}" for k in range(160)]
    rows = [(k, " ".join(shared + [f"own{k}x{i}" for i in range(42)]), "", "s", 0, "", 0, 0, 0) for k in range(1500)]
    for k in range(0, 60, 2):
        words = rows[k][1].split(" ")
        words[int(rng.integers(200))] = "changed"
        rows.append((5000 + k, " ".join(words), "", "s", 0, "", 0, 0, 0))
    got = {r.doc_id: r.component_id for r in near_duplicates(documents(spark, rows), block=128).collect()}
    assert got == {r[0]: r[0] - 5000 if r[0] >= 5000 else r[0] for r in rows}
