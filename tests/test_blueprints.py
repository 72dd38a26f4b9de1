"""Workflow documents as flat tables."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import diff, graph, rules, shapes
from sparkloom.plans import estimate
from sparkloom.sources import blueprints as b
from sparkloom.sources.expressions import calls_of, templates_of

FLOW = {
    "name": "Leads",
    "flow": [
        {"id": 1, "module": "gateway:CustomWebHook", "parameters": {"hook": "h"}, "metadata": {"designer": {"x": 0, "y": 0}}},
        {
            "id": 2, "module": "builtin:BasicRouter", "metadata": {"designer": {"x": 300, "y": 0}}, "surprise": True,
            "routes": [
                {"flow": [{"id": 3, "module": "http:ActionSendData", "mapper": {"url": "https://example.com/{{1.id}}"}, "onerror": [{"id": 9, "module": "builtin:Ignore"}]}], "filter": {"name": "big", "conditions": [[{"a": "{{1.score}}", "o": "number:greater", "b": "5"}]]}},
                {"flow": [{"id": 4, "module": "gateway:WebhookRespond", "mapper": {"body": "{{3.data}} and {{7.x}}"}}], "disabled": "true"},
            ],
        },
        {"id": 5, "module": "json:Aggregator", "mapper": {"a": [1, None, {"b": False}]}, "disabled": True},
    ],
}


def documents(spark, *texts):
    return spark.createDataFrame([(f"d{k}", t) for k, t in enumerate(texts)], "bp_id string, raw string")


def test_nodes_in_preorder(spark):
    rows = b.nodes(documents(spark, json.dumps(FLOW))).orderBy("pos").collect()
    assert [r.node_id for r in rows] == ["1", "2", "3", "9", "4", "5"]
    assert [r.node_path for r in rows] == ["flow.0", "flow.1", "flow.1.routes.0.flow.0", "flow.1.routes.0.flow.0.onerror.0", "flow.1.routes.1.flow.0", "flow.2"]
    assert [r.kind for r in rows] == ["webhook", "router", "http_api", "error_handler", "webhook", "aggregator"]
    assert [r.depth for r in rows] == [0, 0, 1, 2, 1, 0]
    assert [(r.parent_path, r.container, r.route) for r in rows][2:4] == [("flow.1", "routes", 0), ("flow.1.routes.0.flow.0", "onerror", 0)]
    assert [r.disabled for r in rows] == [False] * 5 + [True]
    assert (rows[1].x, rows[1].y, rows[2].x) == (300.0, 0.0, None)


def test_bad_documents_are_diagnosed_and_give_no_rows(spark):
    docs = documents(spark, None, "", "{", "[1]", '{"flow": 5}', '{"a": NaN}', json.dumps(FLOW), '{"flow": [3, null, "x"]}')
    got = {r.bp_id: r.problem for r in b.diagnostics(docs).collect()}
    assert got == {"d0": "empty", "d1": "empty", "d2": "invalid_json", "d3": "root_not_object", "d5": "number_not_finite"}
    assert {r.bp_id for r in b.nodes(docs).collect()} == {"d6"}
    assert b.nodes(docs.limit(0)).count() == 0


def test_leaves_hold_every_value_with_its_node(spark):
    leaves = {r.path: r for r in b.leaves(documents(spark, json.dumps(FLOW))).collect()}
    assert (leaves["flow.1.routes.0.flow.0.mapper.url"].node_path, leaves["flow.1.routes.0.flow.0.mapper.url"].json_type) == ("flow.1.routes.0.flow.0", "string")
    assert leaves["name"].node_path is None
    assert (leaves["flow.2.mapper.a.1"].json_type, leaves["flow.2.mapper.a.2.b"].value) == ("null", "false")
    assert leaves["flow.2.mapper.a"].json_type == "array" and leaves["flow.2.mapper.a"].value is None
    assert len(leaves) == sum(1 for _ in _values(FLOW)) - 1


def _values(v):
    yield v
    for x in v.values() if isinstance(v, dict) else v if isinstance(v, list) else ():
        yield from _values(x)


def test_routes_and_their_filters(spark):
    rows = b.routes(documents(spark, json.dumps(FLOW))).orderBy("route").collect()
    assert [(r.owner_path, r.route, r.disabled, r.filter_name) for r in rows] == [("flow.1", 0, False, "big"), ("flow.1", 1, True, None)]
    assert json.loads(rows[0].conditions)[0][0]["o"] == "number:greater"


def test_unknown_fields(spark):
    got = b.unknown_fields(b.leaves(documents(spark, json.dumps(FLOW)))).collect()
    assert [(r.node_path, r.key) for r in got] == [("flow.1", "surprise")]


def test_references_paths_and_problems(spark):
    docs = documents(spark, json.dumps(FLOW))
    nodes, refs = b.nodes(docs), b.references(b.leaves(docs))
    assert sorted((r.node_path, r.source_node_id, r.field_path) for r in refs.where("node_path <> 'flow.1'").collect()) == [("flow.1.routes.0.flow.0", "1", "id"), ("flow.1.routes.1.flow.0", "3", "data"), ("flow.1.routes.1.flow.0", "7", "x")]
    walkable = nodes.where("container <> 'onerror'").select("bp_id", "node_path", "parent_path", F.when(F.col("container") == "routes", F.col("route")).alias("route"), "pos")
    paths = graph.execution_paths(walkable)
    by_path = {}
    for r in paths.orderBy("path_id", "pos").collect():
        by_path.setdefault(r.path_id, []).append(r.node_path)
    assert list(by_path.values()) == [["flow.0", "flow.1", "flow.1.routes.0.flow.0", "flow.2"], ["flow.0", "flow.1", "flow.1.routes.1.flow.0", "flow.2"]]
    ready = graph.available_before(paths.select("bp_id", "path_id", "pos", F.col("node_path").alias("node_id")), ["bp_id"])
    got = b.reference_problems(nodes, refs, ready).where("node_path <> 'flow.1'").collect()
    assert sorted((r.node_path, r.source_node_id, r.problem) for r in got) == [("flow.1.routes.1.flow.0", "3", "unavailable"), ("flow.1.routes.1.flow.0", "7", "missing")]


def test_responses_on_all_and_any_path(spark):
    docs = documents(spark, json.dumps(FLOW))
    nodes = b.nodes(docs)
    walkable = nodes.where("container <> 'onerror'").select("bp_id", "node_path", "parent_path", F.when(F.col("container") == "routes", F.col("route")).alias("route"), "pos")
    (r,) = graph.responds(graph.execution_paths(walkable), nodes.where("module_token = 'gateway:WebhookRespond'")).collect()
    assert (r.on_all_paths, r.on_any_path) == (False, True)


def test_path_explosion_is_cut_and_told(spark):
    router = lambda k: {"id": k, "module": "builtin:BasicRouter", "routes": [{"flow": [{"id": 100 * k + i, "module": "x"}]} for i in range(3)]}
    docs = documents(spark, json.dumps({"flow": [router(k) for k in range(1, 6)]}))
    walkable = b.nodes(docs).select("bp_id", "node_path", "parent_path", F.when(F.col("container") == "routes", F.col("route")).alias("route"), "pos")
    assert graph.execution_paths(walkable).select("path_id").distinct().count() == 3**5
    cut = graph.execution_paths(walkable, most=50)
    assert cut.select("path_id").distinct().count() == 50 and cut.where("NOT truncated").count() == 0


FLOWS = "bp_id string, node_path string, parent_path string, route int, pos int"


def test_availability_and_responses_equal_those_of_all_paths(spark):
    rng, rows = random.Random(7), []
    for d in range(30):
        made = [(None, None)]  # (node, its parent)
        for k in range(rng.randrange(1, 14)):
            parent = rng.choice([None, None, *[n for n, _ in made[-4:]]])
            rows.append((f"d{d}", f"n{k}", parent, None if parent is None else rng.choice([0, 0, 1, 2, None]), k))
            made.append((f"n{k}", parent))
        rows.append((f"d{d}", "lost", "nowhere", 0, 99))  # no path reaches it
    nodes = spark.createDataFrame(rows, FLOWS)
    responders = nodes.where("pos % 6 = 4 OR node_path = 'lost'")
    paths = graph.execution_paths(nodes)
    assert paths.where("truncated").count() == 0
    want = graph.available_before(paths.withColumnRenamed("node_path", "node_id"), ["bp_id"])
    assert sorted(map(tuple, graph.available_in_flows(nodes).collect())) == sorted(map(tuple, want.collect()))
    got = sorted(map(tuple, graph.responds_in_flows(nodes, responders).collect()))
    assert got == sorted(map(tuple, graph.responds(paths, responders).collect()))
    assert {r[1:] for r in got} == {(True, True), (False, True), (False, False)}
    assert graph.available_in_flows(nodes.limit(0)).collect() == graph.responds_in_flows(nodes.limit(0), responders).collect() == []


def test_sixteen_thousand_paths_lose_nothing(spark):
    """14 two-way routers in a row; the second way of the first one, which no path of the first 8,192 takes, does not respond."""
    router = lambda k: {"id": k, "module": "builtin:BasicRouter", "routes": [{"flow": [{"id": 100 * k + i, "module": "gateway:WebhookRespond" if (k, i) == (1, 0) else "x"}]} for i in range(2)]}
    docs = documents(spark, json.dumps({"flow": [*map(router, range(1, 15)), {"id": 15, "module": "x", "mapper": {"a": "{{100.v}} {{14.v}}"}}]}))
    nodes, refs = b.nodes(docs), b.references(b.leaves(docs))
    walkable = nodes.select("bp_id", "node_path", "parent_path", F.when(F.col("container") == "routes", F.col("route")).alias("route"), "pos")
    ready = graph.available_in_flows(walkable)
    assert sorted((r.source_node_id, r.problem) for r in b.reference_problems(nodes, refs, ready).collect()) == [("100", "unavailable")]
    assert ready.where("node_id = 'flow.14'").count() == 14
    responders = nodes.where("module_token = 'gateway:WebhookRespond'")
    assert [(r.on_all_paths, r.on_any_path) for r in graph.responds_in_flows(walkable, responders).collect()] == [(False, True)]
    cut = graph.execution_paths(walkable, most=100)
    for of in (lambda: graph.responds(cut, responders), lambda: graph.available_before(cut.withColumnRenamed("node_path", "node_id"), ["bp_id"])):
        with pytest.raises(Exception, match="cut short"):
            of().collect()


def test_control_edges(spark):
    edges = b.control_edges(b.nodes(documents(spark, json.dumps(FLOW)))).collect()
    assert sorted((r.kind, r.source, r.target) for r in edges) == [
        ("control", "flow.0", "flow.1"), ("control", "flow.1", "flow.1.routes.0.flow.0"), ("control", "flow.1", "flow.1.routes.1.flow.0"), ("control", "flow.1", "flow.2"),
        ("error", "flow.1.routes.0.flow.0", "flow.1.routes.0.flow.0.onerror.0"),
    ]


def test_operations_of_a_day(spark):
    """Every 30 minutes over 24 hours are 48 runs; routers cost nothing and disabled nodes are skipped."""
    docs = documents(spark, json.dumps(FLOW), json.dumps({"flow": [{"id": 1, "module": "x"}]}))
    cadence = spark.createDataFrame([("d0", "30 minutes"), ("d1", "when it rains")], "bp_id string, interval string")
    got = {r.bp_id: (r.runs, r.per_run, r.operations) for r in estimate.operations(b.nodes(docs), cadence).collect()}
    assert got == {"d0": (48, 4, 192), "d1": (1, 1, 1)}


def test_delta_reports_the_top_of_what_is_missing(spark):
    new = json.loads(json.dumps(FLOW))
    del new["flow"][1]["routes"][0]
    new["flow"][0]["metadata"]["designer"]["x"] = 7
    new["flow"][2]["mapper"]["more"] = {"deep": {"er": 1}}
    old, now = (b.leaves(documents(spark, json.dumps(x))) for x in (FLOW, new))
    got = {r.path: r.change for r in diff.leaf_delta(old, now, ["bp_id"]).collect()}
    assert got["flow.0.metadata.designer.x"] == "value"
    assert got["flow.1.routes.1"] == "removed"
    assert got["flow.2.mapper.more"] == "added"
    assert "flow.2.mapper.more.deep" not in got and "flow.1.routes.1.flow" not in got


def test_required_fields(spark):
    docs = documents(spark, json.dumps(FLOW))
    required = spark.createDataFrame([("http:ActionSendData", "url"), ("http:ActionSendData", "method")], "module_token string, field string")
    got = rules.required_missing(b.nodes(docs), required, b.leaves(docs)).collect()
    assert [(r.node_path, r.field) for r in got] == [("flow.1.routes.0.flow.0", "method")]


@pytest.mark.parametrize(
    ("text", "bodies", "broken"),
    [
        ("a {{1.x}} b {{ 2.y }}", ["1.x", " 2.y "], False), ('{{if(1.a = "}}"; "{{"; 2)}}', ['if(1.a = "}}"; "{{"; 2)'], False), ("{{1.x", [], True), ("x}} {{1}}", [], True), ("{{}}", [""], False), ("none", [], False),
        ("it's {{1.x}} isn't it", ["1.x"], False), ("{{a {{b}}", [], True), ("{{1}} }}", ["1"], True),
    ],
)
def test_templates(text, bodies, broken):
    assert templates_of(text) == (bodies, broken)


@pytest.mark.parametrize(
    ("body", "calls"),
    [
        ("lower(1.x)", [("lower", 1)]), ("now()", [("now", 0)]), ('if(a; "x;(y"; join(b, ","))', [("if", 3), ("join", 2)]), ("get(map(1.a[]; x); 1)", [("get", 2), ("map", 2)]), ("(1 + 2) * 3", []), ("f(", []), ("f(1))g(2)", [("f", 1)]), ("f(;)", [("f", 2)]),
        ("f((1; 2); 3)", [("f", 2)]),
    ],
)
def test_calls(body, calls):
    assert calls_of(body) == calls


def test_shape_findings(spark):
    bad = {
        "flow": [
            {"id": True, "module": 5, "metadata": [], "mapper": [1], "parameters": "x"}, {"id": 0, "module": "x"}, {"id": " ", "module": "x"}, {"id": None, "module": "x"}, {"id": 1.5, "module": "x"}, {"id": "ok", "module": "x", "version": True},
            {"id": 7, "module": "x", "version": None, "metadata": {"designer": {"x": "1", "y": 2, "messages": {}}}}, {"id": 7, "module": "builtin:BasicRouter", "mapper": {"a": "{{nope(1)}} {{lower()}}", "b": "{{1"}}, {"id": 7, "module": "x", "metadata": {"designer": 1}},
            {"id": 8, "module": "router:x", "routes": [{"flow": [], "filter": {"name": "n" * 121, "conditions": [[{"a": "1", "o": "Equal To ", "b": "2"}]]}}]},
        ]
    }
    got = sorted((r.node_path.removeprefix("flow."), r.code) for r in shapes.report(documents(spark, json.dumps(bad), json.dumps(FLOW))).where("bp_id = 'd0'").collect())
    assert got == sorted([
        ("0", "ast.node_id_boolean"), ("0", "ast.module_token_invalid"), ("0", "ast.metadata_invalid"), ("0", "mapping.mapper_not_object"), ("0", "mapping.parameters_not_object"), ("1", "ast.node_id_invalid"), ("2", "ast.node_id_invalid"), ("3", "ast.node_id_invalid"),
        ("4", "ast.node_id_invalid"), ("5", "ast.node_version_invalid"), ("6", "ast.designer_coordinates_invalid"), ("6", "ast.designer_messages_invalid"), ("7", "ast.node_id_duplicate"), ("7", "router.routes_missing"), ("7", "mapping.function_unknown"),
        ("7", "mapping.function_argument_count"), ("7", "mapping.expression_unbalanced"), ("8", "ast.designer_invalid"), ("9", "route.empty_flow"), ("9", "filter.label_overlong"),
    ])


def test_shape_findings_of_odd_routes_fields_and_texts(spark):
    ask = lambda o: {"a": "1", "o": o, "b": "2"}
    doc = {
        "name": "{{", "flow": [
            {"id": 1, "module": "x", "routes": [{"flow": [None, "{{"], "filter": {"conditions": [[ask("no"), ask(" EXIST"), ask("no")], [ask("nor")]], "name": " "}}, {"flow": [], "filter": {"conditions": [], "name": "n"}}, {"filter": {}}]},
            {"id": "1", "module": "x", "branches": [{"flow": [{"id": 1, "module": "a:router", "branches": [{"flow": [{}], "filter": 5}]}], "filter": {"name": "n", "conditions": {"o": "no"}}}]},
            {"id": 0.0, "version": "1", "module": "x", "metadata": {"designer": {"x": True, "y": None, "messages": {"x": "no field"}}}, "mapper": None, "t": {"metadata": [1, ["}}", "{{f()}}{{ }}{{f()}}"]], "id": "no field"}},
            {"id": "", "module": "builtin:BasicRouter", "routes": [5, {"flow": 5}], "x": "{{md5()}}{{lower(1)}}" + "{{lower()}}" * 100},
        ],
    }
    rows = documents(spark, json.dumps(doc), None, "{", '{"flow":[]}', json.dumps(doc))
    found = [(r.node_path.removeprefix("flow."), r.code) for r in shapes.report(rows).where("bp_id = 'd0'").collect()]
    want = [
        ("0", "route.empty_flow"), ("0", "route.empty_flow"), ("0", "route.routes_on_non_router"), ("0", "filter.label_missing"), ("0", "filter.empty_conditions"), *[("0", "filter.operator_unsupported")] * 3, ("0", "mapping.expression_unbalanced"),
        ("1", "ast.node_id_duplicate"), ("1", "filter.empty_conditions"), ("2", "ast.node_id_invalid"), ("2", "ast.node_version_invalid"), ("2", "ast.designer_coordinates_invalid"), ("2", "ast.designer_messages_invalid"),
        ("2", "mapping.expression_unbalanced"), ("2", "mapping.function_unknown"), ("2", "mapping.function_unknown"), ("2", "mapping.expression_empty"), ("3", "ast.node_id_invalid"), ("3", "router.routes_missing"), *[("3", "mapping.function_argument_count")] * 100,
    ]
    assert sorted(found) == sorted(want)
    catalog = spark.createDataFrame([("x",), ("x",), (None,)], "module_token string")
    every = shapes.report(rows, catalog)
    assert {(r.bp_id, r.node_path) for r in every.where("code = 'module.unresolved'").collect()} == {(d, p) for d in ("d0", "d4") for p in ("flow.1.branches.0.flow.0", "flow.3")}
    assert every.count() == 2 * len(want) + 4
