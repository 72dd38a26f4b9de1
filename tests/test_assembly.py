"""Documents built of their leaves, and workflows compiled from plans."""

from __future__ import annotations

import json
import random

from sparkloom.operators import assembly
from sparkloom.sources import blueprints as b


def docs(spark, *roots):
    return spark.createDataFrame([(f"d{k}", r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(roots)], "bp_id string, raw string")


def value(rng: random.Random, depth: int):
    if depth and rng.random() < 0.6:
        if rng.random() < 0.4:
            return [value(rng, depth - 1) for _ in range(rng.randint(0, 3))]
        return {k: value(rng, depth - 1) for k in rng.sample(["a", "b", "a.b", "~", "", "0", "é\"", "flow", "id", "module"], rng.randint(0, 4))}
    return rng.choice([None, True, False, 0, -1, 1.5, 1e-7, 12345678901234567890, "", "x", "\"\\ \n\t  é🙂", "{{1.a}}"])


def test_leaves_of_what_was_built_are_the_leaves(spark):
    rng = random.Random(2)
    roots = [{"flow": [value(rng, 3)], "x": value(rng, 4), "y": value(rng, 2)} for _ in range(80)] + [{}, {"a": {}}, {"a": []}, {"": {"": []}}]
    given = docs(spark, *roots)
    built = assembly.build(assembly.all_leaves(given), given)
    assert {r.bp_id: json.loads(r.raw) for r in built.collect()} == {f"d{k}": root for k, root in enumerate(roots)}
    assert sorted(map(tuple, b.leaves(built).collect()), key=str) == sorted(map(tuple, b.leaves(given).collect()), key=str)
    # The order of members is kept, too.
    assert all(list(json.loads(r.raw)) == list(roots[int(r.bp_id[1:])]) for r in built.collect())


def test_documents_that_do_not_parse_are_empty_objects(spark):
    given = docs(spark, "{", {"a": 1})
    assert sorted(map(tuple, assembly.build(assembly.all_leaves(given), given).collect())) == [("d0", "{}"), ("d1", '{"a":1}')]
    assert assembly.build(assembly.all_leaves(given.limit(0)), given.limit(0)).collect() == []


def plan(spark, rows):
    return spark.createDataFrame(rows, assembly.PLAN)


def modules(spark):
    return spark.createDataFrame([("m:1", "app:One"), ("m:2", 'app:"Two"')], "module_id string, module_token string")


def test_nested_plans(spark):
    rows = [
        ("p", 1, None, None, None, 2, "m:1", 1, '{"x":1}', None), ("p", 2, None, None, None, 1, "m:2", 3, None, None), ("p", 3, 1, "routes", 1, 1, "m:1", 1, None, None), ("p", 4, 1, "routes", 0, 1, "m:1", 1, None, '{"q":[]}'),
        ("p", 5, 4, "onerror", 0, 2, "m:2", 1, None, None), ("p", 6, 4, "onerror", 0, 1, "m:1", 1, None, None), ("p", 7, 6, "routes", 0, 1, "m:1", 1, None, None), ("p", 8, None, None, None, 3, "m:9", 1, None, None), ("p", 9, 8, "routes", 0, 1, "m:1", 1, None, None), ("q", 1, None, None, None, 1, "m:9", 1, None, None),
    ]
    out = {r.bp_id: json.loads(r.raw) for r in assembly.assemble(plan(spark, rows), modules(spark)).collect()}
    node = lambda k, token="app:One", version=1, **more: {"id": k, "module": token, "version": version, **more}
    four = node(4, parameters={"q": []}, onerror=[node(6, routes=[{"flow": [node(7)]}]), node(5, 'app:"Two"')])
    assert out == {"p": {"name": "p", "flow": [node(2, 'app:"Two"', 3), node(1, mapper={"x": 1}, routes=[{"flow": [four]}, {"flow": [node(3)]}])]}, "q": {"name": "q", "flow": []}}
    assert sorted(map(tuple, assembly.unknown_modules(plan(spark, rows), modules(spark)).collect())) == [("p", 8, "m:9"), ("q", 1, "m:9")]


def test_nodes_that_hold_one_another_are_in_no_flow(spark):
    rows = [("p", 1, 2, "routes", 0, 1, "m:1", 1, None, None), ("p", 2, 1, "routes", 0, 1, "m:1", 1, None, None), ("p", 3, None, None, None, 1, "m:1", 1, None, None)]
    assert [json.loads(r.raw)["flow"] for r in assembly.assemble(plan(spark, rows), modules(spark)).collect()] == [[{"id": 3, "module": "app:One", "version": 1}]]
    assert assembly.assemble(plan(spark, []), modules(spark)).collect() == []
