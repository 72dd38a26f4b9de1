"""Contracts of AI agents in workflow documents: what an agent and its tools must declare.

The documents are parsed once into their nodes (with interval numbers) and the leaves at and below agents. What a leaf says (words in its text, keys above it) becomes flags; flags are rolled
up to the agent that holds the leaf, from a tool's flow by the intervals of its nodes, and to each tool by its place. A rule is a condition on an agent's, a tool's or a field's flags. Findings: bp_id,
node_path, path, code, severity.

Words count inside one value; keys are compared by their letters and digits, and count with a value below them that says something (text, true, a number other than zero).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import blueprints
from .evidence import plain_keys, plain_text
from .shared import written

# Bounds.
DESCRIPTION_LEAST, PLAN_TOOLS, TEMPERATURE_MOST, TIMEOUT_MOST, REPLIES_MOST, PHONE_DIGITS = 24, 2, 0.7, 600, 10, 10
# Words in an agent's texts, by what they tell.
WORDS = {
    "objective": ("classify", "decide", "extract", "goal", "objective", "prioritize", "research", "score", "summarize", "task"),
    "structure": ("constraint", "limitation", "role", "rule", "style", "tone"),
    "risk": ("bank", "credential", "customer", "personal information", "pii", "private", "secret", "sensitive", "token", "user data"),
    "guardrail": ("authenticated", "authorization", "current user", "decline", "least privilege", "permission", "validate"),
    "format": ("json object", "output format", "response format", "return json", "return a json", "return fields", "schema", "structured output"),
    "exact": ("classify", "extract", "json", "parse", "route", "score", "structured", "validate"),
    "creative": ("brainstorm", "creative", "draft", "variation", "write content"),
    "launch": ("deploy", "launch", "production", "production readiness", "ready to go live"),
    "memory": (
        "conversation history", "memory across", "multi-step conversation", "multistep conversation", "past interaction", "previous exchange", "previous interaction", "remember context", "remember past", "remember previous",
        "same conversation", "stored conversation",
    ),
    "carryover": ("avoid carryover", "carryover between sessions", "clear context", "different customer", "new customer", "separate conversation", "separate session"),
    "cleared": ("clear context",),
    "files": (
        "analyze file", "analyze files", "process file", "process files", "read document", "read documents", "summarize file", "summarize files", "uploaded file", "uploaded files",
    ),
    "attachment": ("dataset", "file", "knowledge", "vector"),
    "exposed": (
        "all data", "confidential", "customer data", "full access", "harmful instruction", "harmful instructions", "personal information", "pii", "prompt injection", "private", "sensitive", "unauthorized",
    ),
    "needs_knowledge": ("business knowledge", "current knowledge", "domain knowledge", "domain-specific", "knowledge file", "knowledge source", "latest information", "specialized knowledge"),
    "plan": ("after", "before", "depends", "dependency", "expected output", "first", "next", "order", "output from", "sequence", "then call"),
    "grave": (
        "approve payment", "billing", "cancel account", "change customer", "customer record", "delete", "financial", "modify data", "payment", "sensitive action", "sensitive operation", "sensitive step",
        "update customer", "write access",
    ),
    "approval": ("approval", "approved by", "authorization", "authorize", "human review", "manual approval", "review and approve", "user approval"),
    "broad": ("do anything", "handle everything", "all tasks", "whatever is needed"),
    "long": ("long reasoning", "long-running", "long running", "multi-step", "multistep", "large research", "research many"),
    "fallback": ("fallback", "if unable"),
}
# Words that are looked for in other parts of an agent and in its tools.
METRICS = ("accuracy", "benchmark", "cost", "eval", "evaluation", "failure", "latency", "metric", "test result")
FILE_WORDS = ("attachment", "document", "file", "knowledge", "pdf")
KNOWLEDGE_WORDS = ("document", "file", "knowledge", "rag", "source", "vector")
SCOPE_NEED, SCOPE_SHOWN = ("context", "document", "knowledge base", "knowledge file", "knowledge source"), ("chunk", "filter", "only", "query", "rag", "relevant", "retrieve", "retrieves", "specific")
TEST_OBJECTS, TEST_ACTIONS = ("document", "file", "knowledge", "policy", "rag", "reference", "source"), ("look up", "lookup", "query", "queries", "retrieval", "retrieve", "retrieves", "use", "uses")
MUTATING = ("cancel", "change", "create", "delete", "modify", "payment", "send", "update", "write")
MUTATING_GUARDS = ("approval", "approved", "condition", "confirm", "confirmed", "only after", "validate", "validated", "validation")
OUTPUT_FILTERS = ("field", "filter", "limit", "only", "relevant", "select", "top")
BROAD_NAMES, BROAD_TYPES = ("body", "data", "items", "payload", "raw", "rawresponse", "response", "responsebody", "results"), ("array", "collection", "json", "object")
# Plain names that keys hold, by what they declare.
KEYS = {
    "provider": ("provider", "model", "llm"), "instruction": ("instruction", "systemprompt", "developerprompt"), "input": ("input", "userprompt", "prompt"), "tests": ("testcases",),
    "conversation": ("conversationid", "sessionid", "threadid"), "history": ("conversationhistorylimit", "historylimit", "maxconversationhistory", "maximumconversationhistory", "maxhistory", "replylimit"),
    "isolation": ("clearcontext", "conversationid", "sessionid", "threadid"),
}
FORMAT_KEYS = ("jsonschema", "outputformat", "outputschema", "responseformat", "responseschema", "structuredoutput")
SECRET_TEXT = (
    r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", r"\b(?:Bearer|Basic)\s+[A-Za-z0-9._~+/=-]{12,}", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\b", r"\bsk-[A-Za-z0-9_-]{20,}\b",
)
PHONE = r"(?<!\w)\+?\d[\d .()/-]{8,}\d(?!\w)"


def _agent_leaves(bp_id: str, root: dict) -> Iterator[tuple]:
    """The leaves at and below agents; none of a document without one."""
    agents = tuple(path for node, path, *_ in blueprints.walk(root) if isinstance(node.get("module"), str) and blueprints.kind_of(node["module"]) == "ai_agent")
    if agents:
        heads = tuple(f"{a}." for a in agents)
        yield from (row for row in _ROWS(bp_id, root) if row[3].startswith(heads))


_ROWS = blueprints.local_rows(lambda inside, kind, text: True)[1]


def tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with intervals, leaves at and below agents) of documents (bp_id, raw), parsed once."""
    rows = written(blueprints.flat(docs, {"places": (blueprints.PLACES, blueprints._place_rows), "leaves": (blueprints.LOCAL, _agent_leaves)}), "agents")
    return blueprints.part(rows, "places", blueprints.PLACES), blueprints.part(rows, "leaves", blueprints.LOCAL)


def _any(words: Sequence[str]) -> str:
    return "|".join(map(re.escape, words))


def _says(words: Sequence[str]) -> Column:
    return F.coalesce(F.col("text").rlike(_any(words)), F.lit(False))


def _flag(*conditions: Column) -> Column:
    """Whether a row of the group meets all conditions."""
    return F.coalesce(F.max(reduce(lambda a, b: a & b, conditions)), F.lit(False))


def _number(text: Column) -> Column:
    return F.trim(text).try_cast("double")


def _timeout_seconds(kind: Column, value: Column) -> Column:
    low = F.lower(F.trim(value))
    amount, unit = F.regexp_extract(low, r"^(\d+(?:\.\d+)?)\s*([a-z]*)$", 1).try_cast("double"), F.regexp_extract(low, r"^(\d+(?:\.\d+)?)\s*([a-z]*)$", 2)
    factor = F.when(unit.isin("", "s", "sec", "secs", "second", "seconds"), 1.0).when(unit.isin("m", "min", "mins", "minute", "minutes"), 60.0).when(unit.isin("ms", "millisecond", "milliseconds"), 0.001)
    return F.when(kind == "number", value.try_cast("double")).when(kind == "string", amount * factor)


def _marked(leaves: DataFrame) -> DataFrame:
    """Leaves with text (in lower case, of scalars), keys (plain, of their path), last (the plain last key), top, tool (its place), told (whether the value says something)."""
    kind, value = F.col("json_type"), F.col("value")
    scalar = ~kind.isin("object", "array", "null")
    told = F.when(kind == "string", F.trim(F.regexp_replace(value, r"\s+", " ")) != "").when(kind == "boolean", value == "true").when(kind == "number", value.try_cast("double") != 0).otherwise(F.lit(False))
    tool = F.regexp_extract("local", r"^tools\.(\d+)(?:\.|$)", 1)
    keys = plain_keys(F.col("local"))
    return (
        leaves.withColumn("keys", keys).withColumn("text", F.when(scalar, F.lower(value))).withColumn("told", told).withColumn("last", F.element_at("keys", -1)).withColumn("top", F.substring_index("local", ".", 1))
        .withColumn("tool", F.when(tool != "", tool.cast("int"))).withColumn("path_keys", F.array_join(F.filter("keys", lambda k: ~k.rlike(r"^\d+$")), "/"))
    )


def agent_facts(places: DataFrame, leaves: DataFrame) -> DataFrame:
    """A row for each agent: flags of its own data and of what its tools hold."""
    agents = places.where("kind = 'ai_agent'").select("bp_id", "node_path", "enter", "leave")
    kind, value = F.col("json_type"), F.col("value")
    mapped, meta = F.col("top").isin("parameters", "mapper"), F.col("top") == "metadata"
    prompt = F.get("keys", 1).rlike("prompt|instruction|message") & mapped
    stated = (mapped & ~F.coalesce(prompt, F.lit(False))) | meta
    has_key = {name: F.coalesce(F.col("path_keys").rlike(_any(words)), F.lit(False)) & F.col("told") for name, words in KEYS.items()}
    tests = has_key["tests"] & (mapped | meta)
    in_test = F.col("path_keys").contains("testcase") & (mapped | meta)
    timeout = mapped & F.col("last").rlike("timeout|maxtime|maxruntime|execution.*time|time.*execution")
    empty = (kind == "null") | ((kind == "string") & (F.trim(value) == "")) | (kind.isin("object", "array") & (value == "0"))
    low = F.regexp_replace(F.trim("text"), r"\s+", " ")
    hot = mapped & F.col("last").isin("creativity", "temperature") & F.coalesce(kind.isin("number", "string") & (low.isin("creative", "high", "high creativity", "maximum") | (_number(value) > TEMPERATURE_MOST)), F.lit(False))
    deep = mapped & F.col("last").isin(*KEYS["history"]) & F.coalesce(kind.isin("number", "string") & (low.isin("all", "full", "no limit", "none", "unbounded", "unlimited") | (_number(value) > REPLIES_MOST)), F.lit(False))
    form = F.col("path_keys").rlike(_any(FORMAT_KEYS)) & F.col("told") & (mapped | F.col("keys")[0].rlike(_any(FORMAT_KEYS)))
    flags = {f"w_{name}": _flag(mapped, _says(words)) for name, words in WORDS.items()}
    flags |= {f"k_{name}": _flag(mapped, c) for name, c in has_key.items() if name != "tests"}
    flags |= {
        "k_tests": _flag(tests), "k_format": _flag(form), "timeout": _flag(timeout), "timeout_empty": _flag(timeout, empty), "timeout_high": _flag(timeout, F.coalesce(_timeout_seconds(kind, value) > TIMEOUT_MOST, F.lit(False))),
        "hot": _flag(hot), "deep": _flag(deep), "metrics": _flag(stated, _says(METRICS) | (F.col("path_keys").rlike(_any(METRICS)) & F.col("told"))), "file_shown": _flag(stated, _says(FILE_WORDS)),
        "knowledge_shown": _flag(stated, _says(KNOWLEDGE_WORDS)), "scope_need": _flag(mapped | meta, _says(SCOPE_NEED)), "scope_shown": _flag(mapped | meta, _says(SCOPE_SHOWN)),
        "test_object": _flag(in_test, _says(TEST_OBJECTS)), "test_action": _flag(in_test, _says(TEST_ACTIONS)), "tools": F.coalesce(F.max(F.when((F.col("local") == "tools") & (kind == "array"), value.cast("int"))), F.lit(0)),
    }
    own = leaves.groupBy("bp_id", "node_path").agg(*[c.alias(n) for n, c in flags.items()])
    # What the tools hold: an agent's own leaves below tools, and those of the nodes in their flows, whose intervals lie inside the agent's.
    shown = {"tool_file": FILE_WORDS, "tool_knowledge": KNOWLEDGE_WORDS, "tool_need": SCOPE_NEED, "tool_scope": SCOPE_SHOWN}
    wrapped = leaves.where("tool IS NOT NULL").groupBy("bp_id", "node_path").agg(*[_flag(_says(w)).alias(f"{n}_0") for n, w in shown.items()])
    numbers = places.select("bp_id", "node_path", F.col("enter").alias("at"))
    said = leaves.join(numbers, ["bp_id", "node_path"]).groupBy("bp_id", "at").agg(*[_flag(_says(w)).alias(n) for n, w in shown.items()])
    starts = places.where("container = 'tools'").select("bp_id", F.col("parent_path").alias("node_path"), F.col("enter").alias("first"), F.col("leave").alias("final"))
    flows = agents.select("bp_id", "node_path").join(starts, ["bp_id", "node_path"]).join(said, "bp_id").where("first <= at AND at <= final")
    rolled = flows.groupBy("bp_id", "node_path").agg(*[F.max(n).alias(f"{n}_1") for n in shown])
    on = ["bp_id", "node_path"]
    out = agents.join(own, on, "left").join(wrapped, on, "left").join(rolled, on, "left")
    return out.withColumns({n: F.coalesce(f"{n}_0", F.lit(False)) | F.coalesce(f"{n}_1", F.lit(False)) for n in shown})


def agent_findings(facts: DataFrame) -> DataFrame:
    c = lambda name: F.coalesce(F.col(name), F.lit(False))
    tools = F.coalesce("tools", F.lit(0))
    broad, knows = c("w_broad"), c("knowledge_shown") | c("tool_knowledge")
    rules = [
        ("tools_missing", "warning", tools == 0), ("provider_missing", "warning", ~c("k_provider")), ("instructions_inputs_mixed", "warning", ~(c("k_instruction") & c("k_input"))), ("scope_too_broad", "optimization", broad),
        ("multi_tool_plan_missing", "optimization", (tools >= PLAN_TOOLS) & ~c("w_plan")), ("objective_missing", "warning", broad | ~c("w_objective")),
        ("context_structure_missing", "optimization", (broad | c("w_risk")) & ~c("w_structure")), ("security_guardrails_missing", "warning", c("w_risk") & ~c("w_guardrail")),
        ("configure_appropriate_step_timeout", "optimization", ~c("timeout") & c("w_long")), ("apply_300_second_default", "optimization", c("timeout_empty")), ("exceed_600_seconds", "warning", c("timeout_high")),
        ("fallback_missing", "warning", ~c("w_fallback")), ("response_format_missing", "warning", ~(c("k_format") | c("w_format"))), ("deterministic_temperature_high", "optimization", c("hot") & c("w_exact") & ~c("w_creative")),
        ("production_metrics_missing", "optimization", c("w_launch") & ~c("metrics")), ("conversation_memory_policy_missing", "warning", c("w_memory") & ~(c("k_conversation") & c("k_history"))),
        ("conversation_history_limit_high", "optimization", c("deep")), ("session_isolation_missing", "warning", c("w_carryover") & ~(c("k_isolation") | c("w_cleared"))),
        ("file_processing_capability_missing", "warning", c("w_files") & ~(c("file_shown") | c("tool_file"))), ("knowledge_source_missing", "optimization", c("w_needs_knowledge") & ~knows),
        ("knowledge_retrieval_scope_missing", "optimization", knows & (c("scope_need") | c("tool_need")) & ~(c("scope_shown") | c("tool_scope"))),
        ("knowledge_retrieval_test_missing", "optimization", knows & c("k_tests") & ~(c("test_object") & c("test_action"))), ("sensitive_action_approval_missing", "warning", c("w_grave") & ~c("w_approval")),
        ("test_cases_missing", "optimization", ~c("k_tests")), ("knowledge_attachment_review", "warning", c("w_attachment") & c("w_exposed")),
    ]
    return _exploded(facts.withColumn("path", F.col("node_path")), rules)


def _exploded(rows: DataFrame, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """A finding for each rule that a row meets."""
    hits = F.array_compact(F.array(*[F.when(condition, F.struct(F.lit(f"ai_agent.{code}").alias("code"), F.lit(severity).alias("severity"))) for code, severity, condition in rules]))
    return rows.withColumn("hit", F.explode(hits)).select("bp_id", "node_path", "path", "hit.code", "hit.severity")


def response_fields(agents: DataFrame, leaves: DataFrame) -> DataFrame:
    """Fields of agents' response formats that have no description."""
    named = F.transform("keys", lambda k: k.isin(*FORMAT_KEYS))
    at = F.array_position(named, True)
    inside = leaves.join(agents.select("bp_id", "node_path"), ["bp_id", "node_path"], "left_semi").where(F.col("top").isin("parameters", "mapper") | F.get("keys", 0).isin(*FORMAT_KEYS)).withColumn("at", at.cast("int")).where("at > 0")
    rest = F.slice("keys", F.col("at") + 1, F.size("keys"))
    width = F.when(F.get(rest, 0).isin("fields", "properties"), 2).otherwise(1)
    place = F.get(rest, width - 1)
    part = inside.withColumn("rest", rest).withColumn("width", width).where((F.size("rest") >= F.col("width")) & (place.rlike(r"^\d+$") | (F.get("rest", 0) == "properties")))
    field = F.array_join(F.slice(F.split("local", r"\."), F.lit(1), F.col("at") + F.col("width")), ".")
    described = (F.size("rest") > F.col("width")) & F.get("rest", F.col("width")).isin("description", "desc", "helptext") & F.col("told")
    own = (F.size("rest") == F.col("width")) & ((F.col("json_type") == "object") | (F.get("rest", 0) == "properties"))
    fields = part.groupBy("bp_id", "node_path", field.alias("field")).agg(F.max(described).alias("described"), F.max(own).alias("is_field")).where("is_field AND NOT described")
    return fields.select("bp_id", "node_path", F.col("node_path").alias("path"), F.lit("ai_agent.response_field_description_missing").alias("code"), F.lit("optimization").alias("severity"))


def tool_facts(places: DataFrame, leaves: DataFrame) -> DataFrame:
    """A row for each tool (a wrapper with a flow) of an agent."""
    agents = places.where("kind = 'ai_agent'").select("bp_id", "node_path")
    below = leaves.where("tool IS NOT NULL").join(agents, ["bp_id", "node_path"], "left_semi")
    sub = F.regexp_replace("local", r"^tools\.\d+\.?", "")
    below = below.withColumn("sub", sub).withColumn("head", F.substring_index("sub", ".", 1))
    kind, value, head = F.col("json_type"), F.col("value"), F.col("head")
    direct = F.col("sub") == head

    def text_of(name: str) -> Column:
        return F.max(F.when(direct & (head == name) & (kind == "string") & (F.trim(value) != ""), F.trim(value)))

    named = head.isin("name", "description", "type", "kind", "tool_type", "module")
    schema = {side: direct & head.isin(*keys) & kind.isin("object", "array") & (value != "0") for side, keys in (("inputs", ("inputs", "input_schema")), ("outputs", ("outputs", "output_schema")))}
    listed = {side: F.col("sub").rlike(rf"^({'|'.join(keys)})\.\d+$") & (((kind == "object") & (value != "0")) | ((kind == "string") & F.col("told"))) for side, keys in (("inputs", ("inputs", "input_schema")), ("outputs", ("outputs", "output_schema")))}
    demand = plain_text(F.lower(value)) == "ondemand"
    modes = F.col("sub").rlike(r"^(metadata\.)?(execution_mode|mode|(schedule|scheduling)\.(mode|type))$|^(schedule|scheduling)$")
    facts = below.groupBy("bp_id", "node_path", "tool").agg(
        _flag((F.col("sub") == "flow") & (kind == "array")).alias("wrapper"), text_of("name").alias("name"), text_of("description").alias("description"),
        *[_flag((schema[s] & (kind == "object")) | listed[s]).alias(s) for s in schema],
        _flag(named, _says(MUTATING)).alias("mutating"), _flag(head.isin("description", "guardrails", "metadata", "validation"), _says(MUTATING_GUARDS)).alias("guarded"),
        _flag(head.isin("description", "metadata", "outputs", "output_schema"), _says(OUTPUT_FILTERS)).alias("filtered"), _flag(named, _says(("scenario",))).alias("scenario"), _flag(modes, F.coalesce((kind == "string") & demand, F.lit(False))).alias("on_demand"),
    )
    fields = tool_fields(below).groupBy("bp_id", "node_path", "tool").agg(
        _flag(F.col("side") == "in", F.col("optional"), ~F.col("has_default")).alias("bare_option"), _flag(F.col("side") == "in", ~F.col("optional")).alias("required_input"), _flag(F.col("side") == "out", F.col("broad")).alias("broad_output")
    )
    # Modules in a tool's flow, however deep: nodes whose numbers lie in the intervals of the flow's own nodes.
    tops = places.where("container = 'tools' AND route >= 0").select("bp_id", F.col("parent_path").alias("node_path"), F.col("route").alias("tool"), "enter", "leave")
    token = F.lower("module_token")
    within = places.where("module_token IS NOT NULL").select("bp_id", F.col("enter").alias("at"), token.contains("scenario").alias("starts"), (token.contains("return") & token.contains("output")).alias("returns")).where("starts OR returns")
    rolled = tops.join(within, "bp_id").where("enter <= at AND at <= leave").groupBy("bp_id", "node_path", "tool").agg(F.max("starts").alias("starts"), F.max("returns").alias("returns"))
    on = ["bp_id", "node_path", "tool"]
    return facts.where("wrapper").join(fields, on, "left").join(rolled, on, "left").withColumn("path", F.concat("node_path", F.lit(".tools."), F.col("tool").cast("string")))


def tool_fields(below: DataFrame) -> DataFrame:
    """Fields of tools' inputs and outputs: side, optional, has_default, broad. A schema is a list of fields, an object that lists them, or one field."""
    sub, kind = F.col("sub"), F.col("json_type")
    inside = below.where(F.col("head").isin("inputs", "input_schema", "outputs", "output_schema"))
    shape = inside.where(sub.rlike(r"^\w+(\.fields)?$")).groupBy("bp_id", "node_path", "tool", "head").agg(_flag(sub == F.col("head"), kind == "array").alias("is_list"), _flag(sub.rlike(r"\.fields$"), kind == "array").alias("lists"))
    rows = inside.join(shape, ["bp_id", "node_path", "tool", "head"])
    at = F.when(F.col("is_list"), F.regexp_extract(sub, r"^\w+\.(\d+)\.", 1)).when(F.col("lists"), F.regexp_extract(sub, r"^\w+\.fields\.(\d+)\.", 1)).otherwise(F.when(sub != F.col("head"), F.lit("-")).otherwise(F.lit("")))
    own = F.when(F.col("is_list"), F.regexp_extract(sub, r"^\w+\.\d+\.([^.]+)", 1)).when(F.col("lists"), F.regexp_extract(sub, r"^\w+\.fields\.\d+\.([^.]+)", 1)).otherwise(F.regexp_extract(sub, r"^\w+\.([^.]+)", 1))
    rows = rows.withColumn("at", at).withColumn("own", own).where("at <> ''")
    name, text, kept = F.col("own"), F.lower(F.trim("value")), F.col("told")

    def said(*keys: str) -> Column:
        return F.max_by(F.trim("value"), -F.array_position(F.array(*map(F.lit, keys)), name)) if len(keys) == 1 else F.coalesce(*[F.max(F.when((name == k) & (kind == "string") & kept, F.trim("value"))) for k in keys])

    no = (name == "required") & (((kind == "boolean") & (F.col("value") == "false")) | ((kind == "string") & text.isin("false", "no", "optional")))
    yes = (name == "optional") & (((kind == "boolean") & (F.col("value") == "true")) | ((kind == "string") & text.isin("true", "yes", "optional")))
    held = rows.groupBy("bp_id", "node_path", "tool", "head", "at").agg(
        _flag(no | yes).alias("optional"), _flag(name.isin("default", "defaultValue", "default_value"), kept).alias("has_default"), said("name", "key").alias("name"), said("type", "datatype").alias("type")
    )
    label, sort = plain_text(F.coalesce("name", F.lit(""))), plain_text(F.coalesce("type", F.lit("")))
    broad = label.rlike(_any(BROAD_NAMES)) & ((sort == "") | sort.rlike(_any(BROAD_TYPES)))
    return held.withColumn("side", F.when(F.col("head").startswith("in"), "in").otherwise("out")).withColumn("broad", broad)


def _sensitive(text: Column) -> Column:
    phones = F.exists(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), lambda p: F.length(F.regexp_replace(p, r"\D", "")) >= PHONE_DIGITS)
    return F.coalesce(reduce(lambda a, b: a | b, [text.rlike(p) for p in SECRET_TEXT]) | phones, F.lit(False))


def tool_findings(facts: DataFrame) -> DataFrame:
    c = lambda name: F.coalesce(F.col(name), F.lit(False))
    label = F.regexp_replace(F.trim(F.lower("name")), r"\s+", " ")
    again = F.row_number().over(Window.partitionBy("bp_id", "node_path", "label").orderBy("tool")) > 1
    rows = facts.withColumn("label", label).withColumn("again", F.col("label").isNotNull() & again)
    text = F.coalesce("description", F.lit(""))
    scenario = c("scenario") | c("starts")
    whole = [
        ("tool_description_unclear", "warning", (F.length(text) < DESCRIPTION_LEAST) | (text == "Auto-derived tool flow.")), ("tool_contract_missing", "warning", ~(c("inputs") & c("outputs"))),
        ("optional_parameter_default_missing", "optimization", c("bare_option")), ("mutating_tool_guard_missing", "warning", c("mutating") & ~(c("required_input") & c("guarded"))),
        ("tool_output_filter_missing", "optimization", c("broad_output") & ~c("filtered")), ("tool_not_on_demand", "warning", scenario & ~c("on_demand")), ("tool_output_missing", "warning", scenario & ~(c("outputs") | c("returns"))),
    ]
    of_name = [("tool_name_missing", "warning", F.col("name").isNull()), ("tool_name_duplicate", "warning", c("again")), ("tool_text_sensitive_literal", "warning", _sensitive(F.col("name")))]
    named = _exploded(rows.withColumn("path", F.concat("path", F.lit(".name"))), of_name)
    told = _exploded(rows.withColumn("path", F.concat("path", F.lit(".description"))), [("tool_text_sensitive_literal", "warning", _sensitive(F.col("description")))])
    return _exploded(rows, whole).unionByName(named).unionByName(told)


def report(docs: DataFrame) -> DataFrame:
    """All findings about agents, their response fields and their tools in documents (bp_id, raw)."""
    places, leaves = tables(docs)
    leaves = _marked(leaves)
    agents = places.where("kind = 'ai_agent'")
    return agent_findings(agent_facts(places, leaves)).unionByName(response_fields(agents, leaves)).unionByName(tool_findings(tool_facts(places, leaves)))
