"""Hard negatives against all scores; codes and bounds against exact products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from sparkloom.llm.quantize import LIMIT, encode, fit, hard_negatives, mine_hard_negatives, parts

VECTORS = "vec_id long, embedding array<float>, label int, rid long, block int, q string, place int"


def vectors(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "q", 3) for r in rows], VECTORS)


def expected(rows, k: int = 5) -> list[tuple]:
    ok = []
    for vec_id, e, label in rows:
        if label is None or not e or any(x is None or not np.isfinite(x) for x in e):
            continue
        q = [int(np.floor(256 * float(np.float32(x)))) for x in e]
        if sum(x * x for x in q) <= LIMIT:
            ok.append((vec_id, q, (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    out = []
    for i, (a, q, label) in enumerate(ok):
        if a is None or a % 100:
            continue
        scored = [(-sum(x * y for x, y in zip(q, o)), n is None, n or 0, n, other == label) for j, (n, o, other) in enumerate(ok) if j != i and len(o) == len(q)]
        scored.sort(key=lambda s: s[:3])
        for p in [s for s in scored if s[4]][:k]:
            inside = [s for s in scored if not s[4] and 80 * -p[0] <= 100 * -s[0] <= 100 * -p[0]]
            out += [(a, p[3], rank, s[3], -p[0], -s[0]) for rank, s in enumerate(inside[:k], 1)]
    return sorted(out, key=str)


def found(df) -> list[tuple]:
    return sorted(((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in df.collect()), key=str)


def odd_rows(n: int = 900, width: int = 12, seed: int = 4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, width))
    rows = [(int(k), [float(x) for x in (base[k % 6] + 0.4 * rng.normal(size=width))], int(k % 5)) for k in range(n)]
    rows += [(1000 + k, rows[0][1], 1 + k % 4) for k in range(30)]  # ties
    rows += [rows[100], rows[100], rows[5]]  # repeated rows, an anchor among them
    rows += [(2000, None, 1), (2100, [], 1), (2200, [None] * width, 1), (2300, [float("nan")] * width, 1), (2400, [float("inf")] * width, 1), (2500, rows[3][1], None)]
    rows += [(2600, [1e30] * width, 1), (2700, [0.0] * width, 1), (2800, rows[1][1][:7], 2), (2803, rows[1][1][:7], 2), (2805, rows[1][1][:7], 3), (None, rows[0][1], 0), (None, rows[200][1], 3)]
    return rows


def test_odd_vectors_equal_all_scores(spark):
    rows = odd_rows()
    want = expected(rows)
    assert len(want) > 100
    assert found(hard_negatives(vectors(spark, rows))) == want


def test_small_blocks_change_nothing(spark):
    from pyspark.sql import functions as F

    rows = odd_rows(300)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    given = vectors(spark, rows).withColumn("label", moved)
    assert found(mine_hard_negatives(given, F.col("vec_id") % 100 == 0, sample=32, block=50, anchor_block=2)) == expected(rows)


def test_one_label_and_one_vector_hold_most_rows(spark):
    rng = np.random.default_rng(1)
    same = [float(x) for x in rng.normal(size=8)]
    rows = [(k, same, 1 if k % 3 else 2) for k in range(600)] + [(600 + k, [float(x) for x in rng.normal(size=8)], int(k % 3)) for k in range(300)]
    assert found(hard_negatives(vectors(spark, rows))) == expected(rows)


def test_empty_table_and_no_anchors(spark):
    assert found(hard_negatives(vectors(spark, []))) == []
    assert found(hard_negatives(vectors(spark, [(1, [1.0, 2.0], 1), (2, [2.0, 1.0], 2)]))) == []


@pytest.mark.parametrize("width", [1, 2, 7, 64])
def test_bounds_hold(width):
    rng = np.random.default_rng(width)
    x = np.floor(256 * rng.normal(size=(2000, width)))
    book = fit(x[:500])
    codes, rest = encode(x, book)
    decoded = np.concatenate([book[p, codes[:, p], : at.stop - at.start] for p, at in enumerate(parts(width))], 1)
    a = x[:50]
    assert (np.abs(a @ x.T - a @ decoded.T) <= np.sqrt((a * a).sum(1))[:, None] * (1 + 1e-9) * rest[None, :]).all()
    # The codes are worth having: residuals are far shorter than the vectors.
    assert np.median(rest / np.sqrt((x * x).sum(1))) < 0.15


def test_lookup_filters_most_rows():
    """Of random vectors, which are the worst case, less than a tenth are scored exactly."""
    from sparkloom.llm.quantize import Block, may_be_first

    rng = np.random.default_rng(0)
    x = np.floor(256 * rng.normal(size=(8000, 64)) / 8).astype(np.int64)
    book = fit(x[:4096])
    codes, rest = encode(x, book)
    table = pa.table({"q": pa.array(list(x.astype(np.int32)), pa.list_(pa.int32())), "label": np.zeros(8000, np.int64), "rid": np.arange(8000), "vec_id": np.arange(8000), "rest": rest, "code": [c.tobytes() for c in codes]})
    near, wide = Block(table, book).bounds(x[:100].astype(float))
    kept = [may_be_first(near[j] - wide[j], near[j] + wide[j], 6).sum() for j in range(100)]
    assert np.mean(kept) < 800  # a tenth
