"""Documents with one defect each, made of the parts table, and the rules that keep documents from being handed over, each with SQL for the same rows."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agents, assembly, compare, graphql, importability, rulebook, volume
from ..sources.tables import dealt, table
from .queries import query

_STEP = {"id": 1, "module": "gateway:CustomWebHook", "parameters": {"hook": "h"}}
_ENTRY = {"placeholder": "runtime.hook", "kind": "setup", "target_path": "/flow/0/parameters/hook", "required": True, "expected_type": "hook_id", "handoff_instructions": "Paste the hook."}
_OPEN, _UNKNOWN, _LOST, _META, _NEST = "importability.placeholder_unresolved", "importability.module.unknown", "importability.reference_unavailable", "importability.metadata_invalid", "importability.error_handler.nested_unsupported"
_REGISTRY = "importability.placeholder_"


def _write(n: int, source: int, **more) -> dict:
    return {"id": n, "module": "datastore:AddRecord", "mapper": {"a": f"{{{{{source}.email}}}}"}, **more}


def _router(*flows: list[dict], n: int = 2) -> dict:
    return {"id": n, "module": "builtin:BasicRouter", "routes": [{"filter": {"conditions": [[{"a": "{{1.email}}"}]]}, "flow": flow} for flow in flows]}


#: Documents, and the findings (node, path, code, severity) of each.
CASES: tuple[tuple[dict, tuple[tuple[str | None, str, str, str], ...]], ...] = (
    ({"flow": [_STEP, _router([_write(3, 1)], [_write(4, 1)])]}, ()),
    # A reader in the second branch asks for a node of the first; one after the router asks for either.
    ({"flow": [_STEP, _router([_write(3, 1)], [_write(4, 3)])]}, (("flow.1.routes.1.flow.0", "flow.1.routes.1.flow.0.mapper.a", _LOST, "error"),)),
    ({"flow": [_STEP, _router([_write(3, 1)], []), _write(5, 3)]}, (("flow.2", "flow.2.mapper.a", _LOST, "error"),)),
    ({"flow": [_STEP, _router([_write(3, 1)]), _write(5, 3)]}, ()),  # one branch alone is always passed
    ({"flow": [_write(1, 2), _write(2, 1), _write(3, 2, onerror=[_write(4, 1)])]}, (("flow.0", "flow.0.mapper.a", _LOST, "error"), ("flow.2.onerror.0", "flow.2.onerror.0.mapper.a", _LOST, "error"))),
    ({"flow": [{**_STEP, "mapper": {"a": "{{concat(\"2.x\"; 2.y)}}"}}, _write(2, 1)]}, (("flow.0", "flow.0.mapper.a", _LOST, "error"),)),
    ({"flow": [{**_STEP, "parameters": {"hook": "{{TODO: hook}}", "deep": [{"x": "__todo__"}]}}]}, (("flow.0", "flow.0.parameters.hook", _OPEN, "error"), ("flow.0", "flow.0.parameters.deep.0.x", _OPEN, "error"))),
    ({"flow": [{**_STEP, "parameters": ["TODO: not an object"]}]}, ()),
    ({"flow": [{**_STEP, "module": "unknown:Imaginary"}, {"id": 2, "module": "local:Stub"}]}, (("flow.0", "flow.0", _UNKNOWN, "error"), ("flow.1", "flow.1", "importability.module.operator_approved_stub", "error"))),
    (
        {"flow": [{**_STEP, "metadata": {"expect": {"x": 1}, "interface": [{}, "text"], "restore": [], "notes": ["plain", {"text": " "}, {"html": "<SCRIPT >"}]}}], "metadata": {"notes": ["plain", {"content": "{{1.x}}"}], "parameters": 1}},
        (
            ("flow.0", "flow.0.metadata.expect", _META, "error"), ("flow.0", "flow.0.metadata.interface.1", _META, "error"), ("flow.0", "flow.0.metadata.restore", _META, "error"), ("flow.0", "flow.0.metadata.notes.0", "ast.note_invalid", "error"),
            ("flow.0", "flow.0.metadata.notes.1.text", "ast.note_content_invalid", "error"), ("flow.0", "flow.0.metadata.notes.2.html", _META, "error"), (None, "metadata.notes.1.content", _META, "error"), (None, "metadata.parameters", _META, "error"),
        ),
    ),
    ({"flow": [{**_STEP, "metadata": {"notes": "one"}}]}, (("flow.0", "flow.0.metadata.notes", "ast.notes_invalid", "error"),)),
    ({"flow": [{**_STEP, "onerror": [{"id": 2, "module": "builtin:Ignore", "onerror": [{"id": 3, "module": "builtin:Break"}]}]}]}, (("flow.0.onerror.0", "flow.0.onerror.0.onerror", _NEST, "error"),)),
    ({"flow": [{**_STEP, "on_error": {"flow": [{"id": 2, "on_error": []}]}}]}, (("flow.0", "flow.0.on_error.flow.0.on_error", _NEST, "error"),)),
    ({"flow": [{**_STEP, "parameters": {"hook": "{{runtime.hook}}"}}]}, (("flow.0", "flow.0.parameters.hook", _REGISTRY + "unregistered", "error"),)),
    ({"flow": [{**_STEP, "parameters": {"hook": "{{ runtime.hook }}"}}], "metadata": {"placeholder_registry": [_ENTRY]}}, ()),
    ({"flow": [_STEP], "metadata": {"placeholder_registry": [_ENTRY]}}, ((None, "metadata.placeholder_registry.0", _REGISTRY + "registry_unused", "warning"),)),
    (
        {"flow": [{**_STEP, "parameters": {"hook": "{{runtime.hook}}"}}], "metadata": {"placeholder_registry": [_ENTRY, {**_ENTRY, "target_path": "/flow/0/mapper/x"}, {**_ENTRY, "required": "yes"}, "text"]}},
        (
            (None, "metadata.placeholder_registry.1", _REGISTRY + "registry_conflict", "error"), (None, "metadata.placeholder_registry.1", _REGISTRY + "registry_target_mismatch", "error"),
            (None, "metadata.placeholder_registry.2", _REGISTRY + "registry_incomplete", "error"), (None, "metadata.placeholder_registry.3", _REGISTRY + "registry_incomplete", "error"),
        ),
    ),
    ({"flow": [{**_STEP, "parameters": {"a/b": {"x.y": "{{runtime.hook}}"}}}], "metadata": {"placeholder_registry": [{**_ENTRY, "target_path": "/flow/0/parameters/a~1b/x.y"}]}}, ()),
    ({"flow": [_STEP], "metadata": {"placeholder_registry": {}}}, ((None, "metadata.placeholder_registry", _REGISTRY + "registry_incomplete", "error"),)),
)
CATALOG = ("gateway:CustomWebHook", "datastore:AddRecord", "builtin:BasicRouter", "builtin:Ignore", "builtin:Break")


def _sql(x: object) -> str:
    return "NULL" if x is None else "'" + str(x).replace("'", "''") + "'"


def expected(cases, key: str = "p_partkey", rows: str = "part", columns: str = "node_path, path, code, severity") -> str:
    """SQL for the findings of a table whose rows have the cases in turn."""
    found = ", ".join(f"({k}, {', '.join(map(_sql, f))})" for k, (_, findings) in enumerate(cases) for f in findings)
    return f"SELECT CAST({key} AS VARCHAR) AS bp_id, {columns} FROM {rows} JOIN (VALUES {found}) v(k, {columns}) ON k = {key} % {len(cases)}"


def case_documents(spark: SparkSession, d: str, cases) -> DataFrame:
    """A document for each part: the cases in turn, with the part's name in it."""
    texts = F.array(*[F.lit(json.dumps({**case, "name": "@"})) for case, _ in cases])
    raw = F.replace(F.element_at(texts, (F.col("p_partkey") % len(cases) + 1).cast("int")), F.lit('"@"'), F.concat(F.lit('"'), F.col("p_name"), F.lit('"')))
    return dealt(table(spark, d, "part", ["p_partkey", "p_name"]), "p_partkey").select(F.col("p_partkey").cast("string").alias("bp_id"), raw.alias("raw"))


def tokens(spark: SparkSession, names) -> DataFrame:
    return spark.createDataFrame([(n,) for n in names], "module_token string")


@query(expected(CASES))
def importability_findings(spark: SparkSession, d: str) -> DataFrame:
    """What keeps documents from being handed over."""
    return importability.report(case_documents(spark, d, CASES), tokens(spark, CATALOG), tokens(spark, ("local:Stub",)))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS bp_id, v.enter, v.leave, v.reach, v.router FROM part JOIN (VALUES (0, 0, 0, 3, NULL), (0, 1, 3, 3, NULL), (0, 2, 2, 2, 1), (0, 3, 3, 3, 1), (3, 0, 0, 3, NULL), (3, 1, 2, 3, NULL), (3, 2, 2, 3, 1), (3, 3, 3, 3, NULL)) v(k, enter, leave, reach, router) ON k = p_partkey % {len(CASES)}")
def flow_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Interval numbers of nodes in documents with a router of two branches and of one."""
    from ..sources import blueprints

    own = case_documents(spark, d, CASES).where(F.col("bp_id").cast("long") % len(CASES) % 3 == 0).where(F.col("bp_id").cast("long") % len(CASES) < 4)
    return blueprints.places(own).select("bp_id", "enter", "leave", "reach", "router")


def _ask(query: str, **more) -> dict:
    return {"flow": [{"id": 1, "module": "http:Send", "mapper": {"graphqlQuery": query, **more}}]}


_G = "graphql."


def _at(*codes: str, path: str = "flow.0.mapper.graphqlQuery") -> tuple:
    return tuple(("flow.0", path, _G + c, "warning") for c in codes)


_LIVE = {"environment": "Production (EU)", "errorsPath": "$.errors", "partialData": "stop", "schemaVersion": 3, "requestId": "r1"}
#: Requests, and the findings of each.
GRAPHQL_CASES: tuple[tuple[dict, tuple[tuple[str | None, str, str, str], ...]], ...] = (
    (_ask("query Names{user{name} }"), ()),
    (_ask("query Names{user{name}}"), _at("dynamic_query_without_variables")),  # two braces together may be a mapped value's
    (_ask("query Names {\n  user { name }\n}"), _at("query_minification_suggested")),
    (_ask('query Names{user(id:"{{1.id}}"){name}}'), _at("dynamic_query_without_variables")),
    (_ask('query Names($id:ID!){user(id:$id){name} }', variables={"id": "{{1.id}}"}), ()),
    (_ask("query Names{user(id:$id){name} }", variables={"id": 1}), _at("variable_type_declaration_missing")),
    (_ask("query Names{user(id:$id){name} }", variables={}), ()),
    (_ask("{user{name} }"), _at("operation_name_missing")),
    (_ask("mutation{drop}"), _at("operation_name_missing")),
    (_ask("query A{a{b{c} } }", maxDepth=2), _at("depth_budget_exceeded")),
    (_ask("query A{a{b} }", max_depth="2"), ()),
    (_ask('query A{a(x:"{{{{") {b} # {c {d\n}', maxDepth=2), _at("query_minification_suggested", "dynamic_query_without_variables")),  # braces in strings and comments hold nothing
    (_ask("query A{a(in:{x:{y:{z:1} } }){b} }", maxDepth=2), ()),
    (_ask("query A{...F}fragment F on T{a{b{c} } }", maxDepth=3), _at("depth_budget_exceeded")),
    (_ask("query A{...F}fragment F on T{a{b} }", maxDepth=3), ()),
    (_ask("query A{a b c}", maxFields=2), _at("field_count_budget_exceeded")),
    (_ask("query A{x:a(first:3) @include(if:true) y:b}", maxFields=2), ()),
    (_ask("query A{p{...F}q{...F} }fragment F on T{a b}", maxFields=5), _at("field_count_budget_exceeded")),
    (_ask("query A{a}", **{**_LIVE, "errorsPath": "off", "schemaVersion": 0}), _at("error_array_guard_missing", "schema_version_missing")),
    (_ask("query A{__schema{types} }", **_LIVE), _at("production_introspection_query")),
    (_ask("mutation Add{add}", **{**_LIVE, "requestId": None}), _at("mutation_idempotency_missing")),
    (_ask("mutation Add{add(operationId:1)}", **{**_LIVE, "requestId": None}), ()),
    ({**_ask("query A{a}"), "metadata": {"scenario": {"stage": ["pre", "production"]}}}, _at("error_array_guard_missing", "partial_data_guard_missing", "schema_version_missing")),
    ({"flow": [{"id": 1, "parameters": {"query": ["{a}", "SELECT 1"], "label": "{a}"}, "metadata": {"query": "{a}"}}]}, _at("operation_name_missing", path="flow.0.parameters.query.0")),
)


@query(expected(GRAPHQL_CASES))
def graphql_request_findings(spark: SparkSession, d: str) -> DataFrame:
    """Shapes, budgets and missing guards of GraphQL requests."""
    return graphql.report(case_documents(spark, d, GRAPHQL_CASES))


_TOOL = {"name": "Find row", "description": "Looks for the row of one number in a sheet", "inputs": [{"name": "n", "type": "text", "required": True}], "outputs": [{"name": "row", "type": "text"}], "flow": [{"id": 2, "module": "sheets:SearchRows"}]}
_SPOKEN = "Extract the goal as a json object. Role: clerk. Fallback: stop."


def _agent(say: str = "", tools: tuple | None = ({},), drop: tuple[str, ...] = (), node: dict | None = None, **more) -> dict:
    """A document of one agent whose contract is whole, with more to say, other tools, and parameters left out or added."""
    parameters = {"model": "m", "instructions": f"{_SPOKEN} {say}", "input": "{{1.text}}", "test_cases": ["ok"], **more}
    held = {} if tools is None else {"tools": [{k: v for k, v in {**_TOOL, **t}.items() if v is not None} for t in tools]}
    return {"flow": [{"id": 1, "module": "ai-agent:Run", "parameters": {k: v for k, v in parameters.items() if k not in drop}, **held, **(node or {})}]}


def _about(*codes: str, path: str = "flow.0") -> tuple:
    return tuple(("flow.0", path, f"ai_agent.{code}", "optimization" if code in _MILD else "warning") for code in codes)


_MILD = {
    "scope_too_broad", "multi_tool_plan_missing", "context_structure_missing", "configure_appropriate_step_timeout", "apply_300_second_default", "deterministic_temperature_high", "production_metrics_missing", "conversation_history_limit_high",
    "knowledge_source_missing", "knowledge_retrieval_scope_missing", "knowledge_retrieval_test_missing", "test_cases_missing", "response_field_description_missing", "optional_parameter_default_missing", "tool_output_filter_missing",
}
_TOOL_AT = "flow.0.tools.0"
#: Agents, and the findings of each.
AGENT_CASES: tuple[tuple[dict, tuple[tuple[str | None, str, str, str], ...]], ...] = (
    (_agent(), ()),
    ({"flow": [{"id": 1, "module": "http:Send", "parameters": {"instructions": "do anything"}}]}, ()),
    (_agent(tools=None, drop=("model", "input", "test_cases")), _about("tools_missing", "provider_missing", "instructions_inputs_mixed", "test_cases_missing")),
    (_agent(model=" ", input=""), _about("provider_missing", "instructions_inputs_mixed")),
    (_agent("Handle everything."), _about("scope_too_broad", "objective_missing")),
    (_agent(instructions="Write a poem."), _about("objective_missing", "fallback_missing", "response_format_missing")),
    (_agent("Look at bank accounts.", instructions="Extract a goal for the bank as a json object, fallback: stop."), _about("context_structure_missing", "security_guardrails_missing")),
    (_agent("Read bank accounts of the current user."), ()),
    (_agent(tools=({}, {"name": "Other"})), _about("multi_tool_plan_missing")),
    (_agent("First find it.", tools=({}, {"name": "find  ROW"})), _about("tool_name_duplicate", path="flow.0.tools.1.name")),
    (_agent("This is long-running."), _about("configure_appropriate_step_timeout")),
    (_agent("This is long-running.", stepTimeout=""), _about("apply_300_second_default")),
    (_agent(stepTimeout="11 min", max_run_time=90), _about("exceed_600_seconds")),
    (_agent(options={"execution_time": "600 s", "timeout": "900000 ms"}), _about("exceed_600_seconds")),
    (_agent(temperature=0.9), _about("deterministic_temperature_high")),
    (_agent("A creative text.", temperature="high"), ()),
    (_agent(temperature="0.7"), ()),
    (_agent("Deploy it."), _about("production_metrics_missing")),
    (_agent("Deploy it.", node={"metadata": {"evaluationAccuracy": 0.9}}), ()),
    (_agent("Remember previous talks.", sessionId="s"), _about("conversation_memory_policy_missing")),
    (_agent("Remember previous talks.", sessionId="s", historyLimit=11), _about("conversation_history_limit_high")),
    (_agent("Remember previous talks.", thread_id="s", reply_limit="Unlimited"), _about("conversation_history_limit_high")),
    (_agent("Avoid carryover."), _about("session_isolation_missing")),
    (_agent("Avoid carryover: clear context."), ()),
    (_agent("Analyze files."), _about("file_processing_capability_missing")),
    (_agent("Analyze files.", tools=({"flow": [{"id": 2, "module": "m:Router", "routes": [{"flow": [{"id": 3, "module": "x:Y", "mapper": {"kind": "PDF"}}]}]}]},)), ()),
    (_agent("Use domain knowledge."), _about("knowledge_source_missing")),
    (_agent(base="a knowledge base"), _about("knowledge_retrieval_scope_missing", "knowledge_retrieval_test_missing")),
    (_agent(base="a knowledge base", mode="relevant parts", test_cases=["Retrieve the policy"]), ()),
    (_agent("Change the billing."), _about("sensitive_action_approval_missing")),
    (_agent("Take the dataset with full access."), _about("knowledge_attachment_review")),
    (_agent(response_format={"fields": [{"name": "a", "description": "A."}, {"name": "b"}], "x": 1}, jsonSchema={"properties": {"c": {"type": "text"}, "d": "text", "e": {"helpText": "E."}}}), _about(*["response_field_description_missing"] * 3)),
    (_agent(tools=({"name": " ", "description": "Short."},)), (*_about("tool_name_missing", path=_TOOL_AT + ".name"), *_about("tool_description_unclear", path=_TOOL_AT))),
    (_agent(tools=({"name": "Call +49 (0)30 1234567", "description": "Asks for rows at a@example.com, by mail"},)), (*_about("tool_text_sensitive_literal", path=_TOOL_AT + ".name"), *_about("tool_text_sensitive_literal", path=_TOOL_AT + ".description"))),
    (_agent(tools=({"inputs": None, "outputs": []},)), _about("tool_contract_missing", path=_TOOL_AT)),
    (_agent(tools=({"inputs": {"fields": [{"name": "a", "required": "no"}, {"name": "b", "optional": True, "default": 1}]}},)), _about("optional_parameter_default_missing", path=_TOOL_AT)),
    (_agent(tools=({"inputs": {"name": "a", "optional": "yes", "defaultValue": "x"}},)), ()),
    (_agent(tools=({"description": "Sends the row to a person by mail"},)), _about("mutating_tool_guard_missing", path=_TOOL_AT)),
    (_agent(tools=({"description": "Sends the row only after a person confirmed it"},)), ()),
    (_agent(tools=({"outputs": [{"name": "rawResponse", "type": "Object"}, {"name": "x"}]},)), _about("tool_output_filter_missing", path=_TOOL_AT)),
    (_agent(tools=({"outputs": [{"name": "raw", "type": "text"}]},)), ()),
    (_agent(tools=({"kind": "scenario", "outputs": None},)), (*_about("tool_contract_missing", "tool_not_on_demand", "tool_output_missing", path=_TOOL_AT),)),
    (_agent(tools=({"outputs": None, "schedule": {"type": "on-demand"}, "flow": [{"id": 2, "module": "scenarios:Run"}, {"id": 3, "module": "m:Router", "routes": [{"flow": [{"id": 4, "module": "scenario:ReturnOutput"}]}]}]},)), _about("tool_contract_missing", path=_TOOL_AT)),
)


@query(expected(AGENT_CASES))
def agent_contract_findings(spark: SparkSession, d: str) -> DataFrame:
    """What AI agents and their tools leave undeclared."""
    return agents.report(case_documents(spark, d, AGENT_CASES))


def _rule(code: str, who: str, field: str | None, test: str, value: str | None = None, severity: str = "error", when: tuple[str, str, str | None] = (None, None, None)) -> tuple:
    return (code, who, field, test, value, severity, *when)


_POST = ("parameters.method", "one_of", "POST|PUT|PATCH")
#: Rules of the store: code, for whom, field, test, value, severity, guard.
RULE_ROWS: tuple[tuple, ...] = (
    *[_rule(f"http.{f}_missing", "app:http", f"parameters.{f}", "required") for f in ("url", "method")],
    _rule("http.url_scheme", "app:http", "parameters.url", "matches", r"^(https://|\{\{)"), _rule("http.url_credentials", "app:http", "parameters.url", "not_matches", r"://[^/@]+:[^/@]+@"),
    _rule("http.method_unknown", "app:http", "parameters.method", "one_of", "GET|POST|PUT|PATCH|DELETE|HEAD"), _rule("http.body_missing", "app:http", "parameters.body", "required", when=_POST),
    _rule("http.body_on_get", "app:http", "parameters.body", "forbidden", severity="warning", when=("parameters.method", "equals", "GET")), _rule("http.timeout_low", "app:http", "parameters.timeout", "at_least", "1"),
    _rule("http.timeout_high", "app:http", "parameters.timeout", "at_most", "300"), _rule("http.header_name", "app:http", "parameters.headers.*.name", "matches", r"^[A-Za-z][A-Za-z0-9-]*$"),
    _rule("http.header_type", "app:http", "parameters.headers", "type", "array"), _rule("http.redirects", "app:http", "parameters.followRedirects", "type", "boolean", "warning"),
    _rule("http.retries", "app:http", "parameters.retries", "at_most", "5", "warning"), _rule("http.certificate", "app:http", "parameters.verify", "equals", "true", when=("parameters.url", "matches", "^https")),
    *[_rule(f"webhook.{f}_missing", "module:gateway:CustomWebHook", f"parameters.{f}", "required") for f in ("hook", "maxResults")],
    _rule("webhook.not_alone", "module:gateway:CustomWebHook", None, "alone", "module:gateway:CustomWebHook"), _rule("webhook.response_missing", "module:gateway:CustomWebHook", None, "needs_after", "module:gateway:WebhookRespond", "warning", ("parameters.responds", "equals", "true")),
    _rule("webhook.results", "module:gateway:CustomWebHook", "parameters.maxResults", "at_least", "1"), _rule("webhook.secret", "module:gateway:CustomWebHook", "parameters.secret", "not_matches", r"^[A-Za-z0-9]{0,7}$"),
    _rule("respond.hook_missing", "module:gateway:WebhookRespond", None, "needs_before", "module:gateway:CustomWebHook"), _rule("respond.status", "module:gateway:WebhookRespond", "mapper.status", "matches", r"^([1-5]\d\d|\{\{.*)$"),
    *[_rule(f"iterator.{f}_missing", "kind:iterator", f"mapper.{f}", "required") for f in ("array",)], _rule("iterator.limit", "kind:iterator", "parameters.limit", "at_most", "1000", "warning"), _rule("iterator.aggregator_missing", "kind:iterator", None, "needs_after", "kind:aggregator", "warning"),
    _rule("aggregator.source_missing", "kind:aggregator", "parameters.feeder", "required"), _rule("aggregator.iterator_before", "kind:aggregator", None, "needs_before", "kind:iterator"), _rule("aggregator.stop", "kind:aggregator", "parameters.stopIfEmpty", "type", "boolean", "warning"),
    *[_rule(f"datastore.{f}_missing", "kind:data_store", f"parameters.{f}", "required") for f in ("datastore", "key")], _rule("datastore.overwrite", "kind:data_store", "parameters.overwrite", "type", "boolean"), _rule("datastore.limit", "kind:data_store", "parameters.limit", "at_most", "100", "warning"),
    _rule("json.text_missing", "module:json:ParseJSON", "mapper.json", "required"), _rule("json.structure", "module:json:ParseJSON", "parameters.type", "type", "number|string"), _rule("text.pattern", "module:regexp:Parser", "parameters.pattern", "required"),
    _rule("text.pattern_open", "module:regexp:Parser", "parameters.pattern", "not_matches", r"\(\.\*\)\+|\(\.\+\)\+"), _rule("text.text_missing", "module:regexp:Parser", "mapper.text", "required"), _rule("mcp.scope_missing", "kind:mcp_tool", "parameters.scope", "required"),
    _rule("mcp.server", "kind:mcp_tool", "parameters.server", "matches", "^https://"), _rule("mcp.agent_missing", "kind:mcp_tool", None, "needs_node", "kind:ai_agent", "warning"), _rule("any.id_missing", "any", "id", "required"), _rule("any.id_type", "any", "id", "type", "number|string"),
    _rule("any.label_type", "any", "label", "type", "string", "warning"), _rule("any.label_long", "any", "label", "not_matches", "^.{81,}", "warning"), _rule("any.version", "any", "version", "at_least", "1"), _rule("any.connection", "any", "parameters.connection", "type", "number|string"),
    _rule("any.test_flag", "any", "parameters.testMode", "forbidden"), _rule("any.owner", "any", "metadata.owner", "matches", "@", "warning"), _rule("router.no_mapper", "kind:router", "mapper", "forbidden", None, "warning"), _rule("router.route_label", "kind:router", "routes.*.label", "required", None, "warning"),
    _rule("schedule.unit", "kind:schedule_trigger", "parameters.unit", "one_of", "minutes|hours|days"),
)


def _send(**parameters) -> dict:
    return {"flow": [{"id": 1, "module": "http:Send", "parameters": {"url": "https://a.example/x", "method": "GET", **parameters}}]}


def _hold(*codes: str, path: str, node: str = "flow.0") -> tuple:
    kinds = {r[0]: r[5] for r in RULE_ROWS}
    return tuple((node, f"{node}.{path}" if path else node, c, kinds[c]) for c in codes)


#: Documents, and what the rules find.
RULE_CASES: tuple[tuple[dict, tuple[tuple[str | None, str, str, str], ...]], ...] = (
    (_send(), ()),
    (_send(url="", method=None), (*_hold("http.url_missing", "http.url_scheme", path="parameters.url"), *_hold("http.method_missing", "http.method_unknown", path="parameters.method"))),
    (_send(url="http://u:p@a.example"), _hold("http.url_scheme", "http.url_credentials", path="parameters.url")),
    (_send(method="POST"), _hold("http.body_missing", path="parameters.body")),
    (_send(method="PUT", body={"a": 1}), ()),
    (_send(body="x", timeout="soon"), (*_hold("http.body_on_get", path="parameters.body"), *_hold("http.timeout_low", "http.timeout_high", path="parameters.timeout"))),
    (_send(headers=[{"name": "Accept"}, {"name": "Bad name"}, {"name": "1"}], timeout=0), (*_hold("http.header_name", path="parameters.headers.1.name"), *_hold("http.header_name", path="parameters.headers.2.name"), *_hold("http.timeout_low", path="parameters.timeout"))),
    (_send(verify=False, followRedirects="yes", retries=6), (*_hold("http.certificate", path="parameters.verify"), *_hold("http.redirects", path="parameters.followRedirects"), *_hold("http.retries", path="parameters.retries"))),
    (_send(url="{{1.url}}", verify=False), ()),
    ({"flow": [{"id": 1, "module": "gateway:CustomWebHook", "parameters": {"hook": "h", "maxResults": 1, "responds": True}}, {"id": 2, "module": "gateway:WebhookRespond", "mapper": {"status": "200"}}]}, ()),
    ({"flow": [{"id": 1, "module": "gateway:CustomWebHook", "parameters": {"hook": "h", "maxResults": 0, "responds": True, "secret": "abc"}}]}, (*_hold("webhook.results", path="parameters.maxResults"), *_hold("webhook.response_missing", path=""), *_hold("webhook.secret", path="parameters.secret"))),
    ({"flow": [{"id": 1, "module": "gateway:WebhookRespond", "mapper": {"status": "999"}}, {"id": 2, "module": "gateway:CustomWebHook", "parameters": {"hook": "h", "maxResults": 1}}]}, (*_hold("respond.hook_missing", path=""), *_hold("respond.status", path="mapper.status"))),
    ({"flow": [{"id": k, "module": "gateway:CustomWebHook", "parameters": {"hook": "h", "maxResults": 1}} for k in (1, 2)]}, tuple(x for k in (0, 1) for x in _hold("webhook.not_alone", path="", node=f"flow.{k}"))),
    ({"flow": [{"id": 1, "module": "builtin:BasicFeeder", "mapper": {"array": [1]}}, {"id": 2, "module": "util:TextAggregator", "parameters": {"feeder": 1}}]}, ()),
    ({"flow": [{"id": 1, "module": "util:TextAggregator", "parameters": {"stopIfEmpty": 1}}]}, (*_hold("aggregator.source_missing", path="parameters.feeder"), *_hold("aggregator.iterator_before", path=""), *_hold("aggregator.stop", path="parameters.stopIfEmpty"))),
    ({"flow": [{"id": 1, "module": "builtin:BasicRouter", "mapper": {"a": 1}, "routes": [{"label": "x", "flow": [{"id": 2, "module": "builtin:BasicFeeder", "mapper": {"array": "{{1.a}}"}}]}, {"flow": [{"id": 3, "module": "util:TextAggregator", "parameters": {"feeder": 2}}]}]}]}, (*_hold("router.no_mapper", path="mapper"), *_hold("aggregator.iterator_before", path="", node="flow.0.routes.1.flow.0"))),
    ({"flow": [{"id": None, "module": "x:Y", "label": 7, "version": 0, "parameters": {"testMode": True}, "metadata": {"owner": "nobody"}}]}, (*_hold("any.id_missing", "any.id_type", path="id"), *_hold("any.label_type", path="label"), *_hold("any.version", path="version"), *_hold("any.test_flag", path="parameters.testMode"), *_hold("any.owner", path="metadata.owner"))),
    ({"flow": [{"id": 1, "module": "mcp:Call", "parameters": {"server": "http://x"}}]}, (*_hold("mcp.scope_missing", path="parameters.scope"), *_hold("mcp.server", path="parameters.server"), *_hold("mcp.agent_missing", path=""))),
)


@query(expected(RULE_CASES))
def rulebook_findings(spark: SparkSession, d: str) -> DataFrame:
    """Documents against a table of rules."""
    return rulebook.judge(case_documents(spark, d, RULE_CASES), spark.createDataFrame(list(RULE_ROWS), rulebook.RULES))


def _timed(schedule: dict | None, *nodes: dict) -> dict:
    return {"flow": list(nodes), **({} if schedule is None else {"metadata": {"schedule": schedule}})}


_H, _W = {"id": 1, "module": "http:Send"}, {"every": 30, "unit": "minutes"}
_FORK = {"id": 2, "module": "builtin:BasicRouter", "routes": [{"flow": [{"id": 3, "module": "a:B"}, {"id": 4, "module": "m:Router", "routes": [{"flow": [{"id": 5, "module": "a:B"}]}]}]}, {"disabled": "yes", "flow": [{"id": 6, "module": "a:B", "routes": [{"flow": [{"id": 7, "module": "a:B"}]}]}]}, {"enabled": False, "flow": [{"id": 8, "module": "a:B"}]}]}
_SAVED = {"id": 1, "module": "http:Send", "onerror": [{"id": 2, "module": "builtin:Break", "retry": {"count": 3}}, {"id": 3, "module": "builtin:Resume", "retry": True}]}
_E = "estimate."
#: Documents, and (runs, least a run, overhead a run, warnings) by mode and profile: scheduled and minimum_known, scheduled and worst_reasonable_local_safety, module_only and configured_profile for node 1.
VOLUME_CASES: tuple[tuple[dict, tuple[tuple[int | None, int | None, int | None, tuple[str, ...]], ...]], ...] = (
    (_timed(_W, _H), ((48, 1, 0, ()), (48, 1, 1, ("safety_handler_overhead_included",)), (1, 1, 0, ()))),
    (_timed(None, _H), ((1, 1, 0, ("schedule_missing",)), (1, 1, 1, ("schedule_missing", "safety_handler_overhead_included")), (1, 1, 0, ()))),
    (_timed({"interval": 90}, _H), ((960, 1, 0, ()), (960, 1, 1, ("safety_handler_overhead_included", "large_test_cost")), (1, 1, 0, ()))),
    (_timed({"interval": True, "note": "at noon"}, _H), ((1, 1, 0, ("schedule_unknown",)), (1, 1, 1, ("schedule_unknown", "safety_handler_overhead_included")), (1, 1, 0, ()))),
    (_timed({"interval": "weekly"}, _H), ((1, 1, 0, ()), (1, 1, 1, ("safety_handler_overhead_included",)), (1, 1, 0, ()))),
    (_timed({"text": "runs every 1.5 hours"}, _H), ((16, 1, 0, ()), (16, 1, 1, ("safety_handler_overhead_included",)), (1, 1, 0, ()))),
    (_timed({"every_minutes": "7"}, _H), ((206, 1, 0, ()), (206, 1, 1, ("safety_handler_overhead_included",)), (1, 1, 0, ()))),
    (_timed(_W, _H, _FORK), ((48, 3, 0, ("disabled_route_skipped",)), (48, 3, 3, ("disabled_route_skipped", "safety_handler_overhead_included")), (1, 1, 0, ()))),
    (_timed(_W, _SAVED), ((48, 3, 0, ("error_routes_included",)), (48, 3, 6, ("error_routes_included", "configured_retry_overhead_included", "retry_count_unknown", "safety_handler_overhead_included")), (1, 1, 4, ("configured_retry_overhead_included", "retry_count_unknown")))),
    (_timed(_W, {**_H, "on_error": {"strategy": "retry", "count": "2"}}), ((48, 1, 0, ()), (48, 1, 3, ("configured_retry_overhead_included", "safety_handler_overhead_included")), (1, 1, 2, ("configured_retry_overhead_included",)))),
    (_timed(_W, {"id": 2, "module": "builtin:BasicFeeder"}, {"id": 3, "module": "util:TextAggregator"}), ((48, 2, 0, ("iterator_multiplier_unknown", "aggregator_multiplier_unknown")), (48, 2, 2, ("iterator_multiplier_unknown", "aggregator_multiplier_unknown", "safety_handler_overhead_included")), (None, None, None, ("module_unknown",)))),
    (_timed(_W, {**_H, "mapper": {"x": ["next Page"]}, "routes": [{"label": "page", "flow": []}]}), ((48, 1, 0, ("pagination_volume_unknown",)), (48, 1, 1, ("pagination_volume_unknown", "safety_handler_overhead_included")), (1, 1, 0, ()))),
    (_timed(_W, {**_H, "routes": [{"label": "page", "flow": []}]}), ((48, 1, 0, ()), (48, 1, 1, ("safety_handler_overhead_included",)), (1, 1, 0, ()))),
    (_timed(_W, {**_H, "tools": [{"flow": [{"id": 2, "module": "a:B"}]}]}), ((48, 2, 0, ("ai_tool_usage",)), (48, 2, 2, ("ai_tool_usage", "safety_handler_overhead_included")), (1, 1, 0, ()))),
    (_timed(_W), ((48, 0, 0, ()), (48, 0, 0, ()), (None, None, None, ("module_unknown",)))),
)
VOLUME_MODES = (("scheduled", "minimum_known", None), ("scheduled", "worst_reasonable_local_safety", None), ("module_only", "configured_profile", "1"))


def _volume_rows() -> str:
    number = lambda x: "NULL" if x is None else str(x)
    gap = lambda w: w.endswith("_multiplier_unknown") or _E + w in volume.GAPS
    return ", ".join(
        f"({k}, '{VOLUME_MODES[m][0]}', '{VOLUME_MODES[m][1]}', {number(runs)}, {number(least)}, {number(extra)}, '{','.join(_E + w for w in warned)}', '{'conservative_with_evidence_gaps' if any(map(gap, warned)) else 'exact_static_model'}')"
        for k, (_, found) in enumerate(VOLUME_CASES)
        for m, (runs, least, extra, warned) in enumerate(found)
    )


@query(f"""
SELECT CAST(p_partkey AS VARCHAR) AS bp_id, mode, profile, CAST(runs AS BIGINT) AS runs, CAST(least AS BIGINT) AS minimum_per_run, CAST(extra AS BIGINT) AS overhead_per_run, CAST(runs * (least + extra) AS BIGINT) AS operations, warned AS warnings, precision
FROM part JOIN (VALUES {_volume_rows()}) v(k, mode, profile, runs, least, extra, warned, precision) ON k = p_partkey % {len(VOLUME_CASES)}""")
def operation_volumes(spark: SparkSession, d: str) -> DataFrame:
    """Operations of a day by mode and safety profile, with warnings and the precision they leave."""
    docs = case_documents(spark, d, VOLUME_CASES)
    read = volume.tables(docs)
    parts = [volume.estimate(docs, 24, mode, profile, module, read).withColumn("mode", F.lit(mode)).withColumn("profile", F.lit(profile)) for mode, profile, module in VOLUME_MODES]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.select("bp_id", "mode", "profile", "runs", "minimum_per_run", "overhead_per_run", "operations", F.array_join("warnings", ",").alias("warnings"), "precision")


_STEPS = [{"id": 1, "module": "a:One", "mapper": {"x": 1}}, {"id": 2, "module": "a:Two", "mapper": {"x": "{{1.v}}"}}, {"id": 3, "module": "a:Three", "mapper": {"x": "{{2.v}}"}}]
_DOC = {"flow": _STEPS, "metadata": {"instant": True}}


def _renumbered(by: int) -> dict:
    """_DOC with other ids, and saved at another time."""
    flow = [{**n, "id": n["id"] + by, "updatedAt": by, "mapper": {"x": f"{{{{{n['id'] - 1 + by}.v}}}}" if n["id"] > 1 else 1}} for n in _STEPS]
    return {"flow": flow, "metadata": {"instant": True, "lastModified": by}}


def _with(k: int, **more) -> dict:
    return {**_DOC, "flow": [{**n, **more} if n["id"] == k else n for n in _STEPS]}


#: (generated, exported, known good) and the findings of each pair.
DIFF_CASES: tuple[tuple[tuple[dict, dict, dict], tuple[tuple[str, str, str], ...]], ...] = (
    ((_DOC, _renumbered(10), _renumbered(200)), ()),
    ((_DOC, {**_DOC, "flow": [_STEPS[1], _STEPS[0], _STEPS[2]]}, _DOC), tuple((c, f"flow.{k}", "node.moved") for c in ("generated_vs_exported", "exported_vs_known_good") for k in (0, 1))),
    ((_with(2, mapper={"x": 5}), _DOC, _renumbered(30)), tuple((c, "flow.1.mapper.x", "semantic.type") for c in ("generated_vs_exported", "generated_vs_known_good"))),
    ((_DOC, {**_renumbered(40), "flow": _renumbered(40)["flow"][:2]}, _DOC), (("generated_vs_exported", "flow", "semantic.length"), ("exported_vs_known_good", "flow", "semantic.length"))),
    (({**_DOC, "metadata": {"instant": False}}, {**_DOC, "metadata": {}}, _DOC), (("generated_vs_known_good", "metadata.instant", "semantic.added"), ("exported_vs_known_good", "metadata.instant", "semantic.added"))),
    ((_with(3, mapper={"x": "{{1.v}}"}), _renumbered(7), _with(3, mapper={"x": "{{1.v}}"})), tuple((c, "flow.2.mapper.x", "semantic.value") for c in ("generated_vs_exported", "exported_vs_known_good"))),
)


@query(expected(tuple((None, found) for _, found in DIFF_CASES), columns="comparison, path, code"))
def diff_findings(spark: SparkSession, d: str) -> DataFrame:
    """Generated, exported and known good documents against each other: other ids and saves are no change, moved nodes are told as moved."""
    sides = [case_documents(spark, d, tuple((docs[k], ()) for docs, _ in DIFF_CASES)) for k in range(3)]
    return compare.three_way(*sides).select("bp_id", "comparison", "path", "code")


_TEXT = """'{"id":' || p_partkey || ',"name":"' || p_name || ' \\"' || p_brand || '\\"","tags":[' || p_size || ',[],{"a.b":null,"":{}}],"price":' || CAST(p_size AS VARCHAR) || '.5,"flow":[{"id":1,"mapper":{"x":"{{' || p_size || '.y}}","ok":true}}]}'"""


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS bp_id, {_TEXT} AS raw FROM part")
def rebuilt_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents taken apart into leaves and built again."""
    part = dealt(table(spark, d, "part", ["p_partkey", "p_name", "p_brand", "p_size"]), "p_partkey")
    size = F.col("p_size").cast("string")
    raw = F.concat(
        F.lit('{"id":'), F.col("p_partkey").cast("string"), F.lit(',"name":"'), "p_name", F.lit(' \\"'), "p_brand", F.lit('\\"","tags":['), size, F.lit(',[],{"a.b":null,"":{}}],"price":'), size,
        F.lit('.5,"flow":[{"id":1,"mapper":{"x":"{{'), size, F.lit('.y}}","ok":true}}]}'),
    )
    docs = part.select(F.col("p_partkey").cast("string").alias("bp_id"), raw.alias("raw"))
    return assembly.build(assembly.all_leaves(docs), docs)


@query("""
SELECT CAST(o_orderkey AS VARCHAR) AS bp_id, '{"name":"' || o_orderkey || '","flow":[' || string_agg('{"id":' || pos || ',"module":"app:' || l_returnflag || '","version":1,"parameters":{"q":' || CAST(l_quantity AS BIGINT) || '}' ||
  CASE WHEN pos = n THEN ',"routes":[{"flow":[{"id":100,"module":"app:A","version":2,"mapper":{"s":"' || o_orderstatus || '"}}]},{"flow":[{"id":101,"module":"app:N","version":2,"onerror":[{"id":102,"module":"app:R","version":3}]}]}]' ELSE '' END || '}', ',' ORDER BY pos) || ']}' AS raw
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS pos, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY o_orderkey""")
def assembled_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents compiled from plans: a node for each line, and two branches and an error handler below the last; a node of an unknown module is left out."""
    from pyspark.sql import Window

    lines = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag"])
    status = table(spark, d, "orders", ["o_orderkey", "o_orderstatus"])
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
    none, text = F.lit(None), lambda c: F.col(c).cast("string")
    quantity = F.concat(F.lit('{"q":'), F.col("l_quantity").cast("long").cast("string"), F.lit("}"))
    placed = lines.join(status, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("n", F.row_number().over(own))
    main = placed.select(text("l_orderkey").alias("bp_id"), F.col("n").cast("long").alias("node_id"), none.cast("long").alias("parent_id"), none.cast("string").alias("container"), none.cast("int").alias("route"), F.col("n").cast("int").alias("place"), F.concat(F.lit("m:"), "l_returnflag").alias("module"), F.lit(1).alias("version"), none.cast("string").alias("mapper"), quantity.alias("parameters"))
    last = placed.groupBy(text("l_orderkey").alias("bp_id")).agg(F.max("n").cast("long").alias("n"), F.max("o_orderstatus").alias("st"))
    extra = F.array(*[
        F.struct(F.lit(i).cast("long").alias("node_id"), parent.alias("parent_id"), F.lit(c).alias("container"), F.lit(r).alias("route"), F.lit(1).alias("place"), F.lit(m).alias("module"), F.lit(v).alias("version"), (F.concat(F.lit('{"s":"'), "st", F.lit('"}')) if i == 100 else none.cast("string")).alias("mapper"), none.cast("string").alias("parameters"))
        for i, parent, c, r, m, v in ((100, F.col("n"), "routes", 0, "m:A", 2), (101, F.col("n"), "routes", 1, "m:N", 2), (102, F.lit(101).cast("long"), "onerror", 0, "m:R", 3), (103, F.col("n"), "routes", 1, "m:unknown", 1))
    ])
    plan = main.unionByName(last.select("bp_id", F.explode(extra).alias("x")).select("bp_id", "x.*"))
    return assembly.assemble(plan, spark.createDataFrame([(f"m:{k}", f"app:{k}") for k in "ANR"], "module_id string, module_token string"))
