"""A table of rules against a plain judge, and what a new row changes."""

from __future__ import annotations

import json
import random
import re

from sparkloom.operators import rulebook
from sparkloom.plans.handover import RULE_CASES, RULE_ROWS
from sparkloom.sources import blueprints as b


def docs(spark, *roots):
    return spark.createDataFrame([(f"d{k}", r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(roots)], "bp_id string, raw string")


def rules(spark, rows):
    return spark.createDataFrame(list(rows), rulebook.RULES)


def found(df):
    return sorted(tuple(r) for r in df.collect())


def values(node, field):
    """(path, value) of a field inside a node."""
    held = [("", node)]
    for part in field.split("."):
        held = [(f"{p}.{k}", x) for p, v in held for k, x in ([(k, x) for k, x in enumerate(v)] if part == "*" and isinstance(v, list) else [(part, v[part])] if isinstance(v, dict) and part in v else [])]
    return held


def text(v):
    return "" if v is None else v if isinstance(v, str) else str(len(v)) if isinstance(v, (list, dict)) else json.dumps(v)


def number(v):
    try:
        return None if isinstance(v, (bool, list, dict)) or v is None else float(str(v).strip())
    except ValueError:
        return None


def passes(test, want, v):
    said = bool(v.strip()) if isinstance(v, str) else v if isinstance(v, bool) else v is not None and (not isinstance(v, (list, dict)) or bool(v))
    if test in ("required", "forbidden"):
        return said == (test == "required")
    if test in ("equals", "one_of"):
        return text(v) in ([want] if test == "equals" else want.split("|"))
    if test in ("matches", "not_matches"):
        return (isinstance(v, str) and re.search(want, v) is not None) == (test == "matches")
    if test == "type":
        return b._type(v) in want.split("|")
    return number(v) is not None and (number(v) >= float(want) if test == "at_least" else number(v) <= float(want))


def judged(k, root, rows):
    spots = list(b.walk(root))
    names = []
    for node, *_ in spots:
        token = node.get("module") if isinstance(node.get("module"), str) else ""
        names.append({"any", f"kind:{b.kind_of(token or None)}", f"app:{token.split(':')[0]}", f"module:{token}"})
    out = []
    for code, who, field, test, want, severity, gf, gt, gv in set(rows):
        for i, (node, path, *_) in enumerate(spots):
            if who not in names[i] or (gf is not None and not any(passes(gt, gv, v) for _, v in values(node, gf))):
                continue
            at = [v for v in values(node, field)] if field else []
            if test == "required":
                out += [] if any(passes(test, want, v) for _, v in at) else [(f"d{k}", path, f"{path}.{field}", code, severity)]
            elif test in rulebook.FIELD_TESTS:
                out += [(f"d{k}", path, path + p, code, severity) for p, v in at if not passes(test, want, v)]
            else:
                others = [j for j, n in enumerate(names) if want in n]
                bad = {"needs_node": not others, "needs_after": not any(j > i for j in others), "alone": any(j != i for j in others)}[test]
                out += [(f"d{k}", path, path, code, severity)] if bad else []
    return out


def test_every_case_by_itself(spark):
    assert found(rulebook.judge(docs(spark, *[c for c, _ in RULE_CASES]), rules(spark, RULE_ROWS))) == sorted((f"d{k}", *f) for k, (_, findings) in enumerate(RULE_CASES) for f in findings)


def test_random_documents_and_rules_equal_a_plain_judge(spark):
    rng = random.Random(5)

    def value(depth=2):
        pick = rng.random()
        if depth and pick < 0.3:
            return [value(depth - 1) for _ in range(rng.randint(0, 2))]
        if depth and pick < 0.5:
            return {x: value(depth - 1) for x in rng.sample("ab", rng.randint(0, 2))}
        return rng.choice([None, True, False, 0, 3, 2.5, "", " ", "abc", "7", "https://x", "b"])

    def node(depth=1):
        n = {"module": rng.choice(["x:One", "x:Two", "m:Router", "http:Send"]), **{k: value() for k in rng.sample(["p", "q", "r"], rng.randint(0, 3))}}
        if depth and rng.random() < 0.4:
            n["routes"] = [{"flow": [node(0) for _ in range(rng.randint(0, 2))]}]
        return n

    roots = [{"flow": [node() for _ in range(rng.randint(0, 3))]} for _ in range(60)]
    field = lambda: rng.choice(["p", "q", "r", "p.*", "p.a", "q.b.*", "r.*.a"])
    wants = {"required": None, "forbidden": None, "equals": "7", "one_of": "abc|3|true", "matches": "^[a-z]", "not_matches": "b", "at_least": "3", "at_most": "2.5", "type": "string|array"}
    rows = []
    for k in range(120):
        who, test = rng.choice(["any", "app:x", "module:x:One", "kind:router", "kind:module"]), rng.choice([*wants, "needs_node", "needs_after", "alone"])
        guard = (field(), t := rng.choice([*wants]), wants[t]) if rng.random() < 0.3 else (None, None, None)
        own = (field(), test, wants[test]) if test in wants else (None, test, rng.choice(["module:x:Two", "kind:router", "app:http"]))
        rows.append((f"c{k}", who, *own, "error", *guard))
    want = sorted(x for k, root in enumerate(roots) for x in judged(k, root, rows))
    assert len(want) > 300
    assert found(rulebook.judge(docs(spark, *roots), rules(spark, rows))) == want


def test_a_new_row_is_a_new_rule_and_repeats_count_once(spark):
    one = docs(spark, {"flow": [{"id": 1, "module": "x:One"}]})
    row = ("c", "any", "p", "required", None, "error", None, None, None)
    assert found(rulebook.judge(one, rules(spark, [row, row]))) == [("d0", "flow.0", "flow.0.p", "c", "error")]
    assert len(found(rulebook.judge(one, rules(spark, [row, ("d", *row[1:])])))) == 2
    assert found(rulebook.judge(one, rules(spark, []))) == found(rulebook.judge(one.limit(0), rules(spark, [row]))) == []


def test_many_rules_are_joined_by_a_shuffle_with_equal_results(spark, monkeypatch):
    few = found(rulebook.judge(docs(spark, *[c for c, _ in RULE_CASES]), rules(spark, RULE_ROWS)))
    monkeypatch.setattr(rulebook, "MOST_SENT", 1)
    assert found(rulebook.judge(docs(spark, *[c for c, _ in RULE_CASES]), rules(spark, RULE_ROWS))) == few
