"""Interval numbers of nodes, escaped paths, flags, and comparison of documents in one pass."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import compare, golden
from sparkloom.plans import estimate
from sparkloom.sources import blueprints as b


def docs(spark, *roots):
    return spark.createDataFrame([(f"d{k}", r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(roots)], "bp_id string, raw string")


def random_flow(rng: random.Random, ids: list[int], depth: int) -> list[dict]:
    flow = []
    for _ in range(rng.randint(0 if depth else 1, 3)):
        ids[0] += 1
        node: dict = {"id": ids[0], "module": rng.choice(["a:b", "builtin:BasicRouter"])}
        if depth < 3 and rng.random() < 0.5:
            node["routes"] = [{"flow": random_flow(rng, ids, depth + 1)} for _ in range(rng.randint(1, 2))]
        if depth < 3 and rng.random() < 0.2:
            ids[0] += 1
            node["onerror"] = [{"id": ids[0], "module": "x:y"}]
        flow.append(node)
    return flow


def paths(flow: list[dict]) -> list[list[str]]:
    """Every way through a flow."""
    out: list[list[str]] = [[]]
    for node in flow:
        inner = [p for r in node.get("routes", []) for p in paths(r["flow"])] or [[]]
        out = [[*p, str(node["id"]), *q] for p in out for q in inner]
    return out


def available(flow: list[dict]) -> dict[str, set[str]]:
    """For every node that a way holds, the nodes before it on all such ways."""
    found: dict[str, set[str]] = {}
    for p in paths(flow):
        for k, node in enumerate(p):
            found[node] = found[node] & set(p[:k]) if node in found else set(p[:k])
    return found


def test_reach_tells_what_has_run_on_every_way(spark):
    rng = random.Random(4)
    roots = []
    while len(roots) < 60:
        ids = [0]
        flow = random_flow(rng, ids, 0)
        if ids[0] <= 14:
            roots.append({"flow": flow})
    rows = b.places(docs(spark, *roots)).collect()
    for k, root in enumerate(roots):
        own = [r for r in rows if r.bp_id == f"d{k}"]
        got = {c.node_id: {u.node_id for u in own if u.on_path and u.enter < c.enter <= u.reach} for c in own if c.on_path}
        assert got == available(root["flow"]), root


def test_intervals_hold_what_is_inside_and_the_nearest_router(spark):
    root = {"flow": [{"id": 1, "module": "a:b"}, {"id": 2, "module": "builtin:BasicRouter", "routes": [{"flow": [{"id": 3, "module": "a:b", "onerror": [{"id": 4, "module": "c:d"}]}]}, {"flow": []}]}, {"id": 5, "module": "a:b"}]}
    rows = {r.node_id: r for r in b.places(docs(spark, root, "{")).collect()}
    assert {(k, r.enter, r.leave) for k, r in rows.items()} == {("1", 0, 0), ("2", 1, 3), ("3", 2, 3), ("4", 3, 3), ("5", 4, 4)}
    assert {k: r.router for k, r in rows.items()} == {"1": None, "2": None, "3": 1, "4": 1, "5": None}
    assert [k for k, r in rows.items() if not r.on_path] == ["4"]
    assert rows["3"].reach == 3  # the other route is a way without it


def test_paths_of_odd_keys_stay_apart(spark):
    root = {"a.b": 1, "a": {"b": 2}, "": {"": 3}, "~": 4, "~1": 5, "designer.x": 6, "1": [7]}
    rows = b.leaves(docs(spark, root)).where("value IS NOT NULL").select("path", b.path_keys(F.col("path")).alias("keys"), "value").collect()
    assert len({r.path for r in rows}) == len(rows) == 7
    assert {tuple(r["keys"]): r.value for r in rows} == {("a.b",): "1", ("a", "b"): "2", ("", ""): "3", ("~",): "4", ("~1",): "5", ("designer.x",): "6", ("1", "0"): "7"}
    node = {"flow": [{"id": 1, "module": "a:b", "x.y": 1, "mapper": {"x.y": 2}}]}
    assert [r.key for r in b.unknown_fields(b.leaves(docs(spark, node))).collect()] == ["x.y"]


def test_a_document_with_dotted_keys_equals_itself_and_its_changes_count_once(spark):
    old, new = {"a.b": 1, "a": {"b": 2}, "designer.x": 1}, {"a.b": 1, "a": {"b": 3}, "designer.x": 2}
    for find in (lambda x, y: golden.semantic_findings(b.leaves(x), b.leaves(y), ["bp_id"]), lambda x, y: compare.compare(x, y, ["semantic"])):
        assert find(docs(spark, old), docs(spark, old)).count() == 0
        assert sorted((r.path, r.code) for r in find(docs(spark, old), docs(spark, new)).collect()) == [("a.b", "semantic.value"), ("designer~1x", "semantic.value")]
    assert sorted((r.path, r.change, r.accepted) for r in golden.drift(b.leaves(docs(spark, old)), b.leaves(docs(spark, new)), ["bp_id"]).collect()) == [("a.b", "value", False), ("designer~1x", "value", False)]


def test_flags(spark):
    flag = lambda v: (b._flag(v), b._unset(v))
    assert [flag(v) for v in (True, False, "Yes ", "1", 1, 0, "on", "off", "no", " FALSE", None, [True])] == [
        (True, False), (False, True), (True, False), (True, False), (False, False), (False, False), (False, False), (False, False), (False, True), (False, True), (False, False), (False, False),
    ]
    cases = spark.createDataFrame([("true", "boolean"), ("1", "number"), ("1", "string"), ("on", "string"), ("no", "string"), (None, "null")], "v string, t string")
    out = cases.select(estimate.truthy(F.col("v"), F.col("t")).alias("yes"), estimate.unset(F.col("v"), F.col("t")).alias("no")).collect()
    assert [tuple(r) for r in out] == [(True, False), (False, False), (True, False), (False, False), (False, True), (False, False)]
    root = {"flow": [{"id": 1, "module": "m:Router", "routes": [{"flow": [], "enabled": False}, {"flow": [], "enabled": "no"}, {"flow": [], "enabled": 0}, {"flow": [], "disabled": True}, {"flow": []}]}]}
    assert [r.disabled for r in sorted(b.routes(docs(spark, root)).collect(), key=lambda r: r.route)] == [True, True, False, True, False]


def random_value(rng: random.Random, depth: int):
    if depth and rng.random() < 0.6:
        if rng.random() < 0.4:
            return [random_value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: random_value(rng, depth - 1) for k in rng.sample(["a", "b", "a.b", "designer", "metadata", "x", "~", ""], rng.randint(0, 4))}
    return rng.choice([None, True, False, 0, 1, 1.0, 1.5, "1", "", "{{1.a}}"])


def changed(rng: random.Random, v):
    if rng.random() < 0.08:
        return random_value(rng, 2)
    if isinstance(v, list):
        return [changed(rng, x) for x in v][: len(v) - (rng.random() < 0.1)]
    return {k: changed(rng, x) for k, x in v.items() if rng.random() > 0.05} if isinstance(v, dict) else v


@pytest.mark.parametrize("what", ["semantic", "drift"])
def test_one_pass_finds_what_the_joins_of_leaves_find(spark, what):
    rng = random.Random(11)
    old = [{"flow": [random_value(rng, 3)], "top": random_value(rng, 3), "a": random_value(rng, 2)} for _ in range(150)]
    new = [v if isinstance(v := changed(rng, x), dict) else x for x in old]
    one = compare.compare(docs(spark, *old), docs(spark, *new), [what])
    if what == "semantic":
        many = golden.semantic_findings(b.leaves(docs(spark, *old)), b.leaves(docs(spark, *new)), ["bp_id"]).select("bp_id", "path", "code")
    else:
        many = golden.drift(b.leaves(docs(spark, *old)), b.leaves(docs(spark, *new)), ["bp_id"]).select("bp_id", "path", F.col("change").alias("code"))
    got, want = (sorted(tuple(r) for r in x.select("bp_id", "path", "code").collect()) for x in (one, many))
    assert len(want) > 40 and got == want


def test_removed_nodes_layout_and_documents_that_do_not_parse(spark):
    old = {"flow": [{"id": 1, "metadata": {"designer": {"x": 1}}}, {"id": 2, "designer": 1}, {"id": 3}]}
    new = {"flow": [{"id": 1, "metadata": {"designer": {"x": 1.0}}}, {"id": 4, "designer": 1}]}
    rows = compare.compare(docs(spark, old, "{", old), docs(spark, new, new, old))
    found = sorted((r.what, r.path, r.code) for r in rows.where("what IN ('layout', 'removed')").collect())
    assert found == [("layout", "flow.0.metadata.designer", "layout.changed"), ("removed", "2", "node.removed"), ("removed", "3", "node.removed")]
    assert {r.bp_id for r in rows.collect()} == {"d0"}
    assert compare.compare(docs(spark, old).limit(0), docs(spark, new)).collect() == []


def test_edges_and_responses_of_the_walk(spark):
    rng = random.Random(9)
    roots = []
    while len(roots) < 40:
        ids = [0]
        flow = random_flow(rng, ids, 0)
        if ids[0] <= 14:
            roots.append({"flow": flow})
    given = docs(spark, *roots, "{")
    assert sorted(map(tuple, b.edges(given).collect())) == sorted(map(tuple, b.control_edges(b.nodes(given)).collect()))
    for k, root in enumerate(roots):
        for node in [n for n, *_ in b.walk(root)]:
            node["module"] = rng.choice(["x:Respond", "a:b", "a:b"])
    got = {r.bp_id: (r.on_all_paths, r.on_any_path) for r in b.responses(docs(spark, *roots), ("x:Respond",)).collect()}
    for k, root in enumerate(roots):
        kinds = {str(n["id"]): n["module"] for n, *_ in b.walk(root)}
        hit = [any(kinds[i] == "x:Respond" for i in p) for p in paths(root["flow"])]
        assert got[f"d{k}"] == (all(hit), any(hit)), root


def test_renumbered_documents_do_not_differ_and_moves_are_told_once(spark):
    from sparkloom.plans.handover import DIFF_CASES

    for k, (sides, want) in enumerate(DIFF_CASES):
        got = compare.three_way(*[docs(spark, s) for s in sides])
        assert sorted((r.comparison, r.path, r.code) for r in got.collect()) == sorted(want), k
    a = {"flow": [{"id": 1, "module": "a:b", "n": 1}, {"id": 2, "module": "m:Router", "routes": [{"flow": [{"id": 3, "module": "a:b", "n": 2, "x": "{{1.v}}"}]}, {"flow": []}]}]}
    b_ = {"flow": [{"id": 9, "module": "a:b", "n": 1}, {"id": 8, "module": "m:Router", "routes": [{"flow": []}, {"flow": [{"id": 7, "module": "a:b", "n": 2, "x": "{{9.v}}"}]}]}]}
    rows = compare.compare(docs(spark, a), docs(spark, b_), ["canonical"]).collect()
    assert ("flow.1.routes.0.flow.0", "node.moved") in {(r.path, r.code) for r in rows}
    assert {r.code for r in rows} == {"node.moved", "semantic.length"}
    groups = compare.grouped(compare.three_way(docs(spark, a, a), docs(spark, b_, b_), docs(spark, a, a))).collect()
    assert {(r.comparison, r.code, r.documents) for r in groups} >= {("generated_vs_exported", "node.moved", 2), ("exported_vs_known_good", "node.moved", 2)}
