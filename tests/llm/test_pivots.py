"""Near vectors against all pairs."""

from __future__ import annotations

import numpy as np
from rows import components

from sparkloom.llm.pivots import near_vectors, recall

VECTORS = "vec_id long, embedding array<float>, label int, key string, n int, cls long"


def vectors(spark, rows):
    return spark.createDataFrame(rows, VECTORS)


def expected(rows, least=0.98):
    ok = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    order = sorted(range(len(rows)), key=lambda k: rows[k][0])
    links, count = [], [0] * len(rows)
    for i, a in enumerate(order):
        for j in range(i + 1, len(order)):
            b = order[j]
            if not (ok[a] and ok[b]) or rows[a][2] != rows[b][2] or len(rows[a][1]) != len(rows[b][1]):
                continue
            x, y = np.array(rows[a][1], np.float32).astype(float), np.array(rows[b][1], np.float32).astype(float)
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= least:
                links.append((i, j))
                count[i] += 1
                count[j] += 1
    roots = components(len(rows), links)
    return sorted((rows[k][0], count[i], rows[order[roots[i]]][0], rows[k][0] == rows[order[roots[i]]][0]) for i, k in enumerate(order))


def found(df):
    return sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())


def odd_rows():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(12, 16))
    rows, k = [], 0
    for b in base:
        for noise in (0, 0, 0.05, 0.1, 0.3):
            rows.append((k * 3, [float(x) for x in b + noise * rng.normal(size=16)], int(k % 2), "k", 1, 2))
            k += 1
    extra = [(500, None, 1), (501, [], 1), (502, [0.0] * 16, 1), (503, [float("nan")] * 16, 1), (504, [None] + [1.0] * 15, 1), (505, rows[0][1], None), (506, rows[0][1][:8], 0), (507, [float("inf")] * 16, 0), (508, [2 * x for x in rows[0][1]], 0)]
    return rows + [(*e, "k", 1, 2) for e in extra] + [rows[4]]


def test_odd_vectors_equal_all_pairs(spark):
    rows = odd_rows()
    assert found(near_vectors(vectors(spark, rows))) == expected(rows)


def test_small_blocks_change_nothing(spark):
    rows = odd_rows()
    assert found(near_vectors(vectors(spark, rows), block=3)) == expected(rows)


def test_lists_parted_by_a_second_pivot_lose_and_double_nothing(spark):
    rng = np.random.default_rng(15)
    base = rng.normal(size=(40, 12))
    rows = [(5 * k + i, [float(x) for x in b + 0.06 * i * rng.normal(size=12)], 1, "k", 1, 2) for k, b in enumerate(base) for i in range(5)]
    whole, parted = (found(near_vectors(vectors(spark, rows), pivots=20, long_list=n)) for n in (10**6, 3))
    assert parted == whole
    assert sum(r[1] for r in whole) > 100


def test_vectors_with_many_copies_are_looked_up_in_place(spark):
    rows = odd_rows()
    assert found(near_vectors(vectors(spark, rows), hot_copies=2)) == expected(rows)


def test_many_copies_are_one_class(spark):
    rows = [(k, [1.0, 2.0, 3.0], 1, "k", 1, 2) for k in range(300)] + [(300, [1.0, 2.0, 3.001], 1, "k", 1, 2)]
    got = found(near_vectors(vectors(spark, rows)))
    assert got == [(k, 300, 0, k == 0) for k in range(301)]


def test_empty_table_and_no_sound_vector(spark):
    assert near_vectors(vectors(spark, [])).collect() == []
    rows = [(1, None, 1, "k", 1, 2), (2, [0.0], 1, "k", 1, 2)]
    assert found(near_vectors(vectors(spark, rows))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_recall_on_driver_vectors(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = near_vectors(table)
    assert got.count() == table.count()
    assert recall(table, got) >= 0.9


def test_recall_on_clusters_near_the_threshold(spark):
    """Pairs whose cosines are spread around 0.98, in 32 dimensions."""
    rng = np.random.default_rng(8)
    base = rng.normal(size=(200, 32))
    rows = []
    for b in base:
        for _ in range(4):
            rows.append((len(rows), [float(x) for x in b + 0.13 * rng.normal(size=32)], 1, "k", 1, 2))
    got = near_vectors(vectors(spark, rows))
    want = {r[0]: r[1] for r in expected(rows)}
    links = {r.vec_id: r.n_links for r in got.collect()}
    assert sum(want.values()) > 300
    assert all(links[k] <= want[k] for k in want)  # no link that is none
    assert sum(links.values()) >= 0.9 * sum(want.values())
