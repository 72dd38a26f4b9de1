"""The mix: targets, shares, repeats, and equal results of two runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from rows import documents, odd_documents, words

from sparkloom.llm.mixing import mix_sources, mixed_documents, numbered, row_hash, water_fill, with_targets


def test_water_fill():
    assert water_fill([100, 100, 100], [5, 2, 1], 300, 3) == pytest.approx([187.5, 75, 37.5])
    # The first is held at 3 times its size; what is left goes to the others by weight.
    assert water_fill([10, 100, 190], [5, 2, 1], 300, 3) == pytest.approx([30, 180, 90])
    # Holding one lifts another over its limit too.
    assert water_fill([10, 20, 270], [5, 2, 1], 300, 3) == pytest.approx([30, 60, 210])
    assert water_fill([], [], 0, 3) == []
    assert water_fill([0, 5], [5, 2], 5, 3) == pytest.approx([0, 5])


def check(rows, out):
    want = sorted((r[0], len(words(r[1]))) for r in rows)
    assert sorted((r.doc_id, r["size"]) for r in out) == want
    total = sum(n for _, n in want)
    sources = {r[3] for r in rows}
    sizes = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in sources}
    order = sorted((s for s in sources if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sources)
    target = dict(zip(order, water_fill([sizes[s] for s in order], [(5, 2, 1)[k % 3] for k in range(len(order))], total, 3)))
    longest = max((n for _, n in want), default=0)
    for r in out:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(target[r.source])
        assert r.taken <= 3 * r["size"] and (r.taken == 0 if not r["size"] else r.taken % r["size"] == 0)
    for s in sources:
        assert abs(sum(r.taken for r in out if r.source == s) - target[s]) <= longest + 1
    assert total - longest <= sum(r.taken for r in out) <= total


def test_odd_documents(spark):
    rows = odd_documents()[:-2] + odd_documents()[-1:]  # without the very long text, so that shares can come near
    out = mix_sources(documents(spark, rows)).collect()
    check(rows, out)


def test_one_very_long_text(spark):
    rows = odd_documents()
    check(rows, mix_sources(documents(spark, rows)).collect())


def test_slices_change_no_share_and_runs_agree(spark):
    rows = [(k, "w " * (1 + k % 9), "", "hot" if k % 3 else "cold", 0, "", 0, 0, 0) for k in range(900)]
    docs = documents(spark, rows)
    first, second = (sorted(map(tuple, mix_sources(d, slice_rows=50).collect())) for d in (docs, docs.repartition(7)))
    assert first == second
    check(rows, mix_sources(docs, slice_rows=50).collect())


def test_empty_table_and_empty_texts(spark):
    assert mix_sources(documents(spark, [])).collect() == []
    rows = [(1, None, "", None, 0, "", 0, 0, 0), (2, "", "", "a", 0, "", 0, 0, 0)]
    got = mix_sources(documents(spark, rows)).collect()
    assert [(r["size"], r.taken) for r in got] == [(0, 0), (0, 0)]


def test_mixed_documents_are_rows_as_often_as_taken(spark):
    rows = odd_documents()
    docs = documents(spark, rows)
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    copies: dict[int, int] = {}
    for r in mix_sources(docs).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    got: dict[int, int] = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    repeated = rows[-1][0]
    assert {k: v for k, v in got.items() if k != repeated} == {k: v for k, v in copies.items() if v and k != repeated}


def test_equal_rows_share_what_the_mix_takes(spark):
    rows = [(1, "a b c", "xx", "s", 0, "c", 1, 2, 3)] * 5 + [(2, "a b", "xx", "s", 0, "c", 1, 2, 3), (1, "a b c", "xx", "t", 0, "c", 1, 2, 3)] + [(9, "w " * 7, "xx", "t", 0, "c", 1, 2, 3)] * 2
    docs = documents(spark, rows)
    want = {(r.doc_id, r.source): r.n for r in mix_sources(docs).groupBy("doc_id", "source").agg(F.sum("copies").alias("n")).collect() if r.n}
    got = {(r.doc_id, r.source): r.n for r in mixed_documents(docs).groupBy("doc_id", "source").agg(F.count("*").alias("n")).collect()}
    assert got == want


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 100, 190], [10, 20, 270], [0, 5], [7], [3, 900, 1, 1, 1, 80], []])
def test_targets_of_a_table_equal_water_fill(spark, sizes):
    weights = [(5.0, 2.0, 1.0)[k % 3] for k in range(len(sizes))]
    rows = spark.createDataFrame([(k, n, w) for k, (n, w) in enumerate(zip(sizes, weights))], "flow long, source_size long, weight double")
    got = [r.target for r in with_targets(rows, 3).orderBy("flow").collect()]
    assert got == pytest.approx(water_fill(sizes, weights, sum(sizes), 3))


def test_sources_are_numbered_by_code_point(spark):
    names = ["b", None, "a", "😀", "￿", "", "Z", "é"]
    rows = spark.createDataFrame([(n,) for n in names], "source string").repartition(5)
    got = [r.source for r in numbered(rows, "source").orderBy("flow").collect()]
    assert got == sorted((n for n in names if n is not None), key=lambda s: [ord(c) for c in s]) + [None]


def plain_queue(rows, weights=(5, 2, 1), most=3):
    """What the mix takes of each document, by simulating the queue: every flow in the shuffled order, copy after copy, by finish time until the budget is used."""
    sources = sorted({r[3] for r in rows if r[3] is not None}, key=lambda s: [ord(c) for c in s]) + [None] * any(r[3] is None for r in rows)
    size = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in sources}
    target = dict(zip(sources, water_fill([size[s] for s in sources], [weights[k % 3] for k in range(len(sources))], sum(size.values()), most)))
    return sources, size, target


def test_taken_documents_are_those_of_a_simulated_queue(spark):
    rows = [(k, "w " * (1 + k * k % 13), "", None if k % 7 == 0 else f"s{k % 3}", 0, "", 0, 0, 0) for k in range(300)]
    docs = documents(spark, rows)
    sources, size, target = plain_queue(rows)
    order = {r.doc_id: r.h & (2**64 - 1) for r in docs.select("doc_id", row_hash(7).alias("h")).collect()}
    line = []
    for flow, s in enumerate(sources):
        upto = 0
        for r in sorted((r for r in rows if r[3] == s), key=lambda r: order[r[0]]):
            n = len(words(r[1]))
            upto += n
            line += [((c * size[s] + upto) / target[s], flow, c, r[0], n) for c in range(3)]
    left, want = sum(size.values()), {}
    for _, _, _, doc_id, n in sorted(line, key=lambda x: (x[0], x[1], x[2])):
        left -= n
        if left < 0:
            break
        want[doc_id] = want.get(doc_id, 0) + n
    for most_rows in (10, 1_000_000):
        got = {r.doc_id: r.taken for r in mix_sources(docs, slice_rows=20, most_rows=most_rows).collect() if r.taken}
        assert got == want
