"""Findings about single agents and tools, and odd tables."""

from __future__ import annotations

import json

from sparkloom.operators import agents
from sparkloom.plans.handover import AGENT_CASES
from sparkloom.sources import blueprints as b


def docs(spark, *roots):
    return spark.createDataFrame([(f"d{k}", r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(roots)], "bp_id string, raw string")


def test_every_case_by_itself(spark):
    got: dict[str, list] = {f"d{k}": [] for k in range(len(AGENT_CASES))}
    for r in agents.report(docs(spark, *[c for c, _ in AGENT_CASES])).collect():
        got[r.bp_id].append(tuple(r)[1:])
    for k, (case, findings) in enumerate(AGENT_CASES):
        assert sorted(got[f"d{k}"]) == sorted(findings), (k, case)


def test_nodes_in_the_flows_of_tools_are_nodes(spark):
    tool = {"name": "t", "flow": [{"id": 2, "module": "a:b"}, {"id": 3, "module": "a:b"}]}
    root = {"flow": [{"id": 1, "module": "ai-agent:Run", "tools": [tool, {"id": 4, "module": "c:d"}, {"flow": []}]}]}
    assert sorted((r.node_id, r.node_path, r.container, r.route) for r in b.nodes(docs(spark, root)).collect()) == [
        ("1", "flow.0", "flow", None), ("2", "flow.0.tools.0.flow.0", "tools", 0), ("3", "flow.0.tools.0.flow.1", "tools", 0), ("4", "flow.0.tools.1", "tools", -1),
    ]


def test_two_agents_keep_their_evidence_apart_and_an_agent_in_a_tool_has_its_own(spark):
    whole = AGENT_CASES[0][0]["flow"][0]
    inner = {"id": 9, "module": "ai-agent:Run"}
    root = {"flow": [whole, {"id": 5, "module": "ai-agent:Run", "tools": [{"name": "Find row", "description": "Looks for the row of one number in a sheet", "inputs": [{"a": 1}], "outputs": [{"a": 1}], "flow": [inner]}]}]}
    rows = agents.report(docs(spark, root)).collect()
    assert {r.node_path for r in rows} == {"flow.1", "flow.1.tools.0.flow.0"}
    assert "ai_agent.tools_missing" in {r.code for r in rows if r.node_path == "flow.1.tools.0.flow.0"}
    assert "ai_agent.tools_missing" not in {r.code for r in rows if r.node_path == "flow.1"}


def test_empty_tables_and_documents_without_agents(spark):
    assert agents.report(docs(spark, "{", {"flow": [{"id": 1, "module": "a:b"}]})).collect() == []
    assert agents.report(docs(spark, "{").limit(0)).collect() == []
