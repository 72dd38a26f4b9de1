"""Depth and fields of GraphQL texts, and findings of single requests."""

from __future__ import annotations

import json
import time

import pyarrow as pa
import pytest

from sparkloom.operators import graphql
from sparkloom.plans.handover import GRAPHQL_CASES


@pytest.mark.parametrize(
    ("text", "depth", "fields"),
    [
        ("", 0, 0), ("{a}", 1, 1), ("query Q { a { b c } d }", 2, 4), ("{x: a y: b}", 1, 2), ("{a(f: {g: {h: 1}}, l: [{m: 2}]) {b}}", 2, 2), ('{a(s: "}{{") {b}}', 2, 2), ('{a(s: """ " } { """) {b}}', 2, 2), ("{a # } {c {d\n b}", 1, 2),
        ("{a(x: {{1.x}}) {b}}", 2, 2), ("{a {{1.more}} b}", 1, 2), ("query Q($v: [T!]! = {a: 1}) @d(x: {y: 1}) {a}", 1, 1), ("{...F} fragment F on T {a {b}}", 3, 2), ("{...F ...F} fragment F on T {a b}", 2, 4), ("{... on T {a} ... @include(if: $x) {b}}", 2, 2),
        ("{...F} fragment F on T {a ...G} fragment G on T {b ...F}", 3, 2), ("{...Lost a}", 1, 1), ("{a {b", 2, 2), ("}}} {a}", 1, 1), ("query A {a} query B {b {c}}", 2, 3), ("fragment F on T {a {b}}", 2, 2), ("{on fragment query}", 1, 3), ("{ünï a}", 1, 3),
    ],
)
def test_measure(text, depth, fields):
    if "ü" in text:
        assert graphql.measure(text)[0] == depth  # other letters are no names; nothing breaks
    else:
        assert graphql.measure(text) == (depth, fields)


def test_depth_of_plain_queries_is_that_of_their_braces():
    for text in ("query A{a{b{c}}}", "{a{b}c{d{e}}}", "mutation M{x{y}}"):
        deep, most = 0, 0
        for c in text:
            deep += (c == "{") - (c == "}")
            most = max(most, deep)
        assert graphql.measure(text)[0] == most


@pytest.mark.parametrize("text", ["{{" * 100_000, "{a" * 100_000, '"' * 300_001, '"""' * 100_001, "{" + "...F " * 100_000 + "} fragment F on T {a}", "{...F0}" + "".join(f" fragment F{i} on T {{...F{i + 1} ...F{i + 1}}}" for i in range(20_000))])
def test_time_is_linear(text):
    began = time.perf_counter()
    graphql.measure(text)
    assert time.perf_counter() - began < 5


def docs(spark, *roots):
    return spark.createDataFrame([(f"d{k}", r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(roots)], "bp_id string, raw string")


def test_every_case_by_itself(spark):
    got = sorted(map(tuple, graphql.report(docs(spark, *[c for c, _ in GRAPHQL_CASES])).collect()))
    assert got == sorted((f"d{k}", *f) for k, (_, findings) in enumerate(GRAPHQL_CASES) for f in findings)


def test_the_first_budget_counts(spark):
    root = {"flow": [{"id": 1, "metadata": {"maxDepth": 1}, "mapper": {"x": {"maxDepth": "none", "max depth": 9}, "maxDepth": 1, "query": "query A{a{b} }"}, "parameters": {"maxDepth": -1}}]}
    assert graphql.report(docs(spark, root)).count() == 0
    assert graphql.report(docs(spark, "{").limit(0)).collect() == []


def test_a_text_that_repeats_in_a_batch_is_measured_once(monkeypatch):
    asked, own = [], graphql.measure
    monkeypatch.setattr(graphql, "measure", lambda text: asked.append(text) or own(text))
    texts = ["{a}", "{a {b c}}", "", "{a}", "{a {b c}}", "{a}"]
    depth, fields = graphql.measured(pa.array(texts, pa.string()))
    assert list(zip(depth.to_pylist(), fields.to_pylist())) == [own(t) for t in texts]
    assert sorted(asked) == sorted(set(texts))
    assert [len(x) for x in graphql.measured(pa.array([], pa.string()))] == [0, 0]
