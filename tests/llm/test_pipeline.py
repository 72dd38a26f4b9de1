"""The pipeline's stages, each against a brute-force version on its own input."""

from __future__ import annotations

from collections import Counter

import pytest
from rows import documents, odd_documents
from test_minhash import expected
from test_packing import check as check_packing

import corpus_pipeline
from sparkloom.llm.mixing import mix_sources
from sparkloom.llm.toxicity import category_labels, score_toxicity


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """The stages over odd documents with toxic ones among them, each written and read again."""
    at = str(tmp_path_factory.mktemp("tables"))
    docs = documents(spark, odd_documents() + [(5000 + k, f"{'vile' if k % 4 == 1 else 'kind'} words of document {k}", "xx", "t", 0, "c", 1, 2, 3) for k in range(80)])
    docs.write.parquet(f"{at}/documents.parquet")
    labels = spark.createDataFrame([(5000 + k, 1, int(k % 4 == 1)) for k in range(60)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{at}/labels.parquet")
    held, out = [spark.read.parquet(f"{at}/documents.parquet")], []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, held[-1], at).write.parquet(f"{at}/{name}")
        held.append(spark.read.parquet(f"{at}/{name}"))
        out.append(name)
    return at, held


def rows_of(df):
    return [tuple(r) for r in df.collect()]


def test_stages_and_columns(run):
    at, held = run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "mixing", "packing"]
    for df in held[1:-1]:
        assert df.schema.names == held[0].schema.names


def test_toxic_documents_go_and_others_stay(spark, run):
    at, held = run
    rejected = score_toxicity(held[0], category_labels(spark.read.parquet(f"{at}/labels.parquet"))).where("rejected").collect()
    gone = Counter(r.doc_id for r in rejected)
    assert {5000 + k for k in range(1, 80, 4)} == set(gone)
    assert Counter(r[0] for r in rows_of(held[1])) == Counter(r[0] for r in rows_of(held[0])) - gone


def test_one_of_each_group_stays(run):
    at, held = run
    assert sorted(r[0] for r in rows_of(held[2])) == sorted(r[0] for r in expected(rows_of(held[1])) if r[3])


def test_mix_takes_effect(run):
    at, held = run
    want = {r.doc_id: r.copies for r in mix_sources(held[2]).collect() if r.copies}
    got = Counter(r[0] for r in rows_of(held[3]))
    repeated = {d for d, n in Counter(r[0] for r in rows_of(held[2])).items() if n > 1}
    assert {d: n for d, n in got.items() if d not in repeated} == {d: n for d, n in want.items() if d not in repeated}


def test_packing_holds_every_piece(run):
    at, held = run
    check_packing(rows_of(held[3]), held[4].collect(), 2048)


def test_run_is_the_stages_in_turn(spark, run):
    at, held = run
    assert sorted(rows_of(corpus_pipeline.run(spark, at).select("doc_id", "piece", "start", "length", "ids_crc32"))) == sorted(rows_of(held[4].select("doc_id", "piece", "start", "length", "ids_crc32")))


def test_empty_tables_and_nulls(spark, tmp_path):
    at = str(tmp_path)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{at}/labels.parquet")
    documents(spark, []).write.parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).collect() == []
    rows = [(None, "a b c", "xx", None, 0, "c", 1, 2, 3), (1, None, "xx", None, 0, "c", 1, 2, 3), (2, "", "xx", "s", 0, "c", 1, 2, 3), (3, "d e f g", None, "s", 0, "c", 1, 2, 3)]
    documents(spark, rows).write.mode("overwrite").parquet(f"{at}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.run(spark, at).collect()} <= {None, 3}
