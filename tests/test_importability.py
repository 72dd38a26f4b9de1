"""Importability findings of single documents, with and without a catalog, and of odd tables."""

from __future__ import annotations

import json

import pytest

from sparkloom.operators import importability
from sparkloom.plans.handover import CASES, CATALOG, tokens


def docs(spark, *roots):
    return spark.createDataFrame([(f"d{k}", r if isinstance(r, str) or r is None else json.dumps(r)) for k, r in enumerate(roots)], "bp_id string, raw string")


def found(rows) -> list[tuple]:
    return sorted(((r.bp_id, r.node_path, r.path, r.code, r.severity) for r in rows.collect()), key=str)


def test_every_case_by_itself(spark):
    rows = importability.report(docs(spark, *[c for c, _ in CASES]), tokens(spark, CATALOG), tokens(spark, ("local:Stub",)))
    assert found(rows) == sorted([(f"d{k}", *f) for k, (_, findings) in enumerate(CASES) for f in findings], key=str)


def test_offline_warns_of_stubs_and_leaves_notes_alone(spark):
    rows = found(importability.report(docs(spark, {"flow": [{"id": 1, "module": "local:Stub", "metadata": {"notes": "x"}}]}), tokens(spark, CATALOG), tokens(spark, ("local:Stub",)), offline=True))
    assert rows == [("d0", "flow.0", "flow.0", "importability.module.operator_approved_stub", "warning")]


def test_documents_that_do_not_parse_and_empty_tables(spark):
    assert found(importability.report(docs(spark, "{", "", None, "[]"), tokens(spark, CATALOG))) == []
    assert found(importability.report(docs(spark, "{").limit(0), tokens(spark, CATALOG))) == []


@pytest.mark.parametrize(
    ("text", "sources"),
    [
        ("{{1.email}}", ["1"]), ("{{lower(1.email; 2.name)}} and {{3.x}}", ["1", "2", "3"]), ('{{concat("4.x"; \'5.y\'; 6.z)}}', ["6"]), ("{{1.a}} {{1.b}}", ["1", "1"]), ("1.email", []), ("{{1.5 + 2}}", []), ("{{x1.email}}", []),
        ('{{7["a b"]}}', ["7"]), ("{{8[1].x}}", ["8"]), ('{{f("}}"; 9.x)}}', ["9"]), ("{{ 10.x", []), ("{{a.11.b}}", []),
    ],
)
def test_references_in_templates(spark, text, sources):
    leaves = importability.tables(docs(spark, {"flow": [{"id": 1, "module": "a:b", "mapper": {"x": text}}]}))[1]
    assert sorted(r.source_id for r in importability.references(leaves).collect()) == sources


def test_references_count_in_filters_and_not_in_metadata(spark):
    root = {"flow": [{"id": 1, "module": "m:Router", "metadata": {"mapper": "{{9.x}}"}, "label": "{{9.x}}", "routes": [{"filter": {"conditions": [[{"a": "{{2.x}}"}]]}, "flow": [{"id": 3, "mapper": "{{1.x}}"}]}]}]}
    leaves = importability.tables(docs(spark, root))[1]
    assert sorted((r.node_path, r.source_id) for r in importability.references(leaves).collect()) == [("flow.0", "2"), ("flow.0.routes.0.flow.0", "1")]


def test_an_id_of_several_nodes_is_there_if_one_of_them_has_run(spark):
    root = {"flow": [{"id": 1, "module": "a:b"}, {"id": 2, "mapper": {"a": "{{1.x}}"}}, {"id": 1, "module": "a:b"}]}
    assert found(importability.report(docs(spark, root))) == []
