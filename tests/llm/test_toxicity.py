"""The classifier chain: held-out accuracy, out-of-fold features, and odd rows."""

from __future__ import annotations

import numpy as np
import pytest
from rows import documents, odd_documents
from pyspark.sql import functions as F

from sparkloom.llm.toxicity import category_labels, fit_chain, logistic, score_toxicity, without_toxic


def accuracy(spark, at):
    docs = spark.read.parquet(f"{at}/documents.parquet")
    labels = category_labels(spark.read.parquet(f"{at}/labels.parquet"))
    test = F.pmod(F.xxhash64("doc_id"), F.lit(4)) == 0
    scored = score_toxicity(docs, labels.where(~test))
    rows = scored.join(labels.where(test & F.col("toxic").isNotNull()), "doc_id").select("toxic", "p_toxic", "rejected").collect()
    return np.array([(r.toxic, r.p_toxic, r.rejected) for r in rows], float)


def test_held_out_documents(spark, sf_dir):
    """On labels that the chain has not seen."""
    got = accuracy(spark, sf_dir.replace("sf0.001", "sf0.1").replace("sf0.01", "sf0.1"))  # smaller tables have too few labels
    assert (got[:, 0] == got[:, 2]).mean() >= 0.97
    assert got[got[:, 0] == 1, 2].mean() >= 0.85  # of the toxic ones, those that are rejected
    assert got[got[:, 0] == 0, 2].mean() <= 0.01  # of the others


def test_logistic_is_the_least_loss():
    """Against plain gradient descent with tiny steps."""
    rng = np.random.default_rng(2)
    n, k = 80, 5
    x = rng.random((n, k)) < 0.4
    y = (rng.random(n) < 1 / (1 + np.exp(-(x @ rng.normal(size=k))))).astype(float)
    doc, col = np.nonzero(x)
    w = logistic(doc, col, n, k, np.zeros((n, 0)), y, ridge=1.0)
    z = np.column_stack([x.astype(float), np.ones(n)])
    v = np.zeros(k + 1)
    for _ in range(20_000):
        r = 1 / (1 + np.exp(-z @ v)) - y
        v -= 0.01 * (z.T @ r + np.append(v[:-1], 0))
    assert w == pytest.approx(v, abs=1e-3)


def test_a_later_category_uses_an_earlier_one():
    """The second label equals the first: its model gives the earlier probability a positive weight."""
    rng = np.random.default_rng(5)
    n = 400
    hit = rng.random(n) < 0.5
    doc = np.flatnonzero(hit)
    labels = np.column_stack([hit, hit]).astype(int)
    first, second = fit_chain(doc, np.zeros(len(doc), np.int64), 1, labels)
    assert first[0] > 0 and len(second) == 3 and second[1] > 0


def test_odd_rows_and_missing_labels(spark):
    rows = odd_documents()
    docs = documents(spark, rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, category_labels(none)).collect()
    assert len(got) == len(rows)
    assert {(r.p_toxic < 1e-6, r.rejected) for r in got} == {(True, False)}
    one_class = spark.createDataFrame([(rows[4][0], 1, 1), (rows[5][0], 1, 1), (None, 1, 1), (rows[6][0], None, 0), (rows[5][0], 1, None)], "doc_id long, quality int, toxic int")
    got = score_toxicity(docs, category_labels(one_class)).collect()
    assert all(r.rejected for r in got)
    assert score_toxicity(documents(spark, []), category_labels(none)).collect() == []


def test_filter_keeps_rows_and_columns(spark):
    rows = [(k, f"{'vile' if k % 2 else 'kind'} words here {k}", "", None if k % 5 else "s", 0, "", 0, 0, 0) for k in range(80)]
    docs = documents(spark, rows).withColumn("rejected", F.lit("mine")).withColumn("p_toxic", F.lit(None).cast("int")).withColumn("y0", F.lit(1)).withColumn("n", F.lit(2))
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    out = without_toxic(docs, category_labels(labels))
    assert out.schema.names == docs.schema.names
    assert sorted(r.doc_id for r in out.collect()) == [k for k in range(80) if not k % 2]


def test_long_text_is_read_to_its_end(spark):
    labels = spark.createDataFrame([(k, 1, k % 2) for k in range(60)], "doc_id long, quality int, toxic int")
    rows = [(k, f"{'vile' if k % 2 else 'kind'} words here {k}", "", "s", 0, "", 0, 0, 0) for k in range(60)]
    rows.append((100, "neutral " * 300_000 + "vile", "", "s", 0, "", 0, 0, 0))
    got = {r.doc_id: r.rejected for r in score_toxicity(documents(spark, rows), category_labels(labels)).collect()}
    assert got[100]


def test_several_texts_of_a_doc_id_and_any_order_of_rows_learn_the_same(spark):
    rows = [(k % 70, f"{'vile' if k % 70 % 3 == 1 else 'kind'} words {k * k % 101} of text {k}", "xx", "s", 0, "c", 1, 2, 3) for k in range(140)]
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 1)) for k in range(60)], "doc_id long, low_quality int, toxic int")
    first, second = (sorted(map(tuple, score_toxicity(documents(spark, r).repartition(n), labels).collect())) for r, n in ((rows, 3), (rows[::-1], 5)))
    assert first == second


def test_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, low_quality int, toxic int")
    assert score_toxicity(documents(spark, []), labels).collect() == []
    assert without_toxic(documents(spark, []), labels).collect() == []
