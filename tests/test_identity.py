"""Identities, comparisons with reference documents, and rewritten documents on small rows."""

from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sparkloom.operators import golden, identity
from sparkloom.sources import blueprints as b


def leaves(spark, *roots):
    return b.leaves(spark.createDataFrame([(f"d{k}", json.dumps(r)) for k, r in enumerate(roots)], "bp_id string, raw string"))


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


def test_findings_below_a_changed_type_are_hidden_and_arrays_report_their_length(spark):
    old = {"a": {"b": {"c": 1}}, "list": [1, {"x": 1}, 3], "n": 1, "same": None, "gone": {"deep": [1]}, "metadata": {"designer": {"x": 1}}}
    new = {"a": {"b": [1]}, "list": [2, {"x": 1}], "n": 1.0, "same": None, "more": [], "metadata": {"designer": {"x": 9}}}
    got = {(r.path, r.code) for r in golden.semantic_findings(leaves(spark, old), leaves(spark, new), ["bp_id"]).collect()}
    assert got == {("a.b", "semantic.type"), ("list.0", "semantic.value"), ("list", "semantic.length"), ("n", "semantic.type"), ("gone", "semantic.missing"), ("more", "semantic.added")}
    assert [r.path for r in golden.layout_findings(leaves(spark, old), leaves(spark, new), ["bp_id"]).collect()] == ["metadata.designer"]
    assert {(r.path, r.accepted) for r in golden.drift(leaves(spark, {"flow": [{"metadata": {"designer": {"x": 1, "z": 1}}}]}), leaves(spark, {"flow": [{"metadata": {"designer": {"x": 2, "z": 2}}}]}), ["bp_id"]).collect()} == {("flow.0.metadata.designer.x", True), ("flow.0.metadata.designer.z", False)}


def test_equal_and_empty_documents(spark):
    doc = {"flow": [{"id": 1, "module": "a:b"}]}
    assert golden.semantic_findings(leaves(spark, doc), leaves(spark, doc), ["bp_id"]).count() == 0
    assert golden.semantic_findings(leaves(spark), leaves(spark), ["bp_id"]).count() == 0


def test_match_keys(spark):
    assert value(spark, identity.match_keys(F.lit("Search-Rows v2"))) == ["searchrowsv2", "rowsv2"]
    assert value(spark, identity.match_keys(F.lit("trigger"))) == ["trigger"]
    assert value(spark, identity.match_keys(F.lit(" -- "))) == []


def test_scopes_of_expressions(spark):
    ask = lambda p: value(spark, identity.expressions_allowed(F.lit(p)))
    assert [ask(p) for p in ("mapper.url", "id", "metadata.mapper.x", "routes.0.filter.name", "routes.0.flow.0.mapper.a", "onerror.0.mapper.a", "mapper.flow")] == [True, False, False, True, False, False, True]


def test_ids_are_rewritten_in_templates_and_nodes(spark):
    doc = {"flow": [{"id": 1, "module": "a:b", "mapper": {"t": "{{1.x}} {{11.x}} {{f(1.y; \"1.z\")}} 1.x"}}, {"id": "1", "module": "c:d"}, {"id": 2, "module": "e:f"}]}
    docs = spark.createDataFrame([("d", json.dumps(doc)), ("bad", "{"), ("other", json.dumps(doc))], "bp_id string, raw string")
    out = {r.bp_id: r.raw for r in b.rewrite_ids(docs, spark.createDataFrame([("d", "1", "7")], "bp_id string, old string, new string")).collect()}
    new = json.loads(out["d"])
    assert new["flow"][0]["mapper"]["t"] == "{{7.x}} {{11.x}} {{f(7.y; \"1.z\")}} 1.x"
    assert [n["id"] for n in new["flow"]] == [7, "7", 2]
    assert out["bad"] == "{" and json.loads(out["other"]) == doc


def test_rewritten_references_equal_those_of_the_rewritten_documents(spark):
    inner = {"id": 3, "module": "x", "mapper": {"a": "{{2.v}} {{ 11.w[].x }} {{2}}", "b": ["{{1.y}}", {"c": "{{2.v}}"}], "": None, "n": {}}}
    doc = {"name": "{{2.top}}", "flow": [
        {"id": 2, "module": "builtin:BasicRouter", "routes": [{"flow": [inner, 5], "filter": {"name": "{{2.f}}"}}], "onerror": [{"id": "2", "module": "y", "t": "{{2.v}}"}]}, {"id": None, "t": "{{\u00a01.x}} {{\u0661.x}}"}, {"t": '{{f("2.x"; 2.y)}}'}, {"id": 2.5}, {"id": True},
    ]}
    rows = [("a", json.dumps(doc), {"2": "052", "1": "x1"}), ("b", json.dumps(doc), {"11": "2"}), ("c", json.dumps(doc), None), ("d", json.dumps(doc), {}), ("e", "{", {"2": "5"}), ("f", None, {"2": "5"}), ("g", '{"flow":[]}', {"2": "5"})]
    docs = spark.createDataFrame(rows, "bp_id string, raw string, ids map<string,string>").coalesce(1)
    new = b.rewrite_ids(docs, docs.select("bp_id", F.explode("ids").alias("old", "new")))
    refs = b.references(b.leaves(new)).select("bp_id", "node_path", "source_node_id")
    want = b.nodes(new).select("bp_id", "node_path", "depth", "node_id").join(refs, ["bp_id", "node_path"], "left")
    got = b.rewritten_references(docs, F.col("ids"))
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.where("source_node_id IS NOT NULL").count() > 20
    assert b.rewritten_references(docs.limit(0), F.col("ids")).count() == 0


def test_ids_of_deep_documents_are_rewritten(spark):
    deep = '{"flow":[{"id":1,"module":"x","mapper":' + "[" * 1500 + '"{{1.v}}"' + "]" * 1500 + "}]}"
    docs = spark.createDataFrame([("d", deep)], "bp_id string, raw string")
    (r,) = b.rewrite_ids(docs, spark.createDataFrame([("d", "1", "7")], "bp_id string, old string, new string")).collect()
    assert r.raw == deep.replace('"id":1,', '"id":7,').replace("{{1.v}}", "{{7.v}}")
    (r,) = b.rewritten_references(docs, F.create_map(F.lit("1"), F.lit("7"))).collect()
    assert (r.node_id, r.source_node_id) == ("7", "7")


def test_a_node_that_is_not_there_raises(spark):
    nodes = b.nodes(spark.createDataFrame([("d", '{"flow":[{"id":1,"module":"a:b"}]}')], "bp_id string, raw string"))
    assert b.node_of(nodes, "d", "1").head().module_token == "a:b"
    with pytest.raises(PySparkException, match="has no node"):
        b.node_of(nodes, "d", "2").collect()
