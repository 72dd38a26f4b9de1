"""Specifications as catalog tables: first of a name, nested fields, constraints, and what is wrong."""

from __future__ import annotations

import hashlib
import json

from sparkloom.sources import specs


def rows(spark, *roots):
    texts = [(f"app {k}", "1.0", r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(roots)]
    return specs.compile_specs(spark.createDataFrame(texts, "app_slug string, app_version string, raw string"))


def test_modules_fields_and_constraints(spark):
    spec = {"app": {"searches": [{"name": " Find ", "expect": [{"name": "q", "required": True, "options": [1], "fields": [{"name": "x", "schema": [{"name": "y"}]}]}]}], "modules": [{"name": "Find"}]}}
    out = rows(spark, spec)
    assert {(r.id, r.kind, r.label) for r in specs.part(out, "module").collect()} == {("module:app%200:1.0:search:Find", "search", "Find"), ("module:app%200:1.0:unknown:Find", "unknown", "Find")}
    assert {(r.path, r.kind, r.required) for r in specs.part(out, "field").collect()} == {("q", "expect", True), ("q.x", "expect", False), ("q.x.y", "expect", False)}
    assert [(r.name, r.value) for r in specs.part(out, "constraint").collect()] == [("options", "[1]")]
    assert specs.part(out, "problem").count() == 0


def test_what_is_wrong_is_reported(spark):
    out = rows(spark, None, "{", "[]", {"app": {}}, {"app": {"actions": {"a": 1}}}, {"app": {"actions": [3, {"name": " "}, {"name": "A", "parameters": [1, {"name": "f", "spec": 2}]}]}})
    got = sorted((r.app_slug, r.code, r.path) for r in specs.part(out, "problem").collect())
    assert got == [
        ("app 0", "raw_spec.invalid_json", ""), ("app 1", "raw_spec.invalid_json", ""), ("app 2", "raw_spec.app_missing", ""), ("app 3", "raw_spec.module_collection_empty", ""),
        ("app 4", "raw_spec.module_collection_empty", ""), ("app 4", "raw_spec.module_collection_shape_invalid", "actions"), ("app 5", "raw_spec.field_item_shape_invalid", "parameters.0"),
        ("app 5", "raw_spec.module_name_missing", "actions.0"), ("app 5", "raw_spec.module_name_missing", "actions.1"), ("app 5", "raw_spec.nested_field_collection_shape_invalid", "parameters.1.spec"),
    ]


def test_snapshots_keep_every_row(spark):
    out = rows(spark, {"app": {"actions": [{"name": "A|B", "label": None, "parameters": [{"name": "é", "default": None}]}]}})
    again = specs.from_json(specs.to_json(out))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, out.collect()), key=str)
    assert specs.compile_specs(out.limit(0).selectExpr("app_slug", "app_version", "value AS raw")).count() == 0


def test_names_that_repeat_are_made_safe_once(monkeypatch):
    asked = []
    monkeypatch.setattr(specs, "quote", lambda text, safe: asked.append(text) or text)
    specs._part.cache_clear()
    spec = specs._Spec("app", "1.0")
    spec.modules({"actions": [{"name": f"m {k}", "parameters": [{"name": "a", "max": 1, "spec": [{"name": "b"}]}]} for k in range(50)]})
    specs._part.cache_clear()
    assert len(spec.rows) == 50 * 4 and len(asked) == len(set(asked)) == 50 + 5


def test_fingerprints_parse_a_line_once_and_keep_their_values(spark):
    spec = {"app": {"actions": [{"name": "A", "parameters": [{"name": "é", "default": None}, {"name": "x", "max": 5}, {}]}]}}
    out = rows(spark, spec, "{")
    lines = specs.to_json(out)
    got = specs.fingerprints(specs.from_json(lines))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    hashes = []
    for r in out.where("what <> 'problem'").collect():
        cells = {k: v for k, v in r.asDict().items() if k != "code"}
        hashes.append(hashlib.sha256(json.dumps(cells, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest())
    sums = [str(sum(int(h[15 * k : 15 * k + 15], 16) for h in hashes)) for k in range(4)]
    want = [("app 0", "1.0", hashlib.sha256(",".join([str(len(hashes)), *sums]).encode()).hexdigest(), len(hashes))]
    assert list(map(tuple, got.collect())) == want == list(map(tuple, specs.fingerprints(out).collect()))
