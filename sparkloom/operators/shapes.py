"""Rules over workflow documents: shapes of nodes, routes, filters, mappings and references.

A walk of each document tells what the rules judge as rows of a few tables (fields, nodes, routes, templates, calls), with what a node or route needs of its neighbours beside it:
how often its id has come, its routes, their nodes. Each rule is a condition on one such row, and report() gives bp_id, node_path, code, severity of all that hold. A null value counts
as absent. Rules that ask for a catalog or for other nodes of a document are joins of flat tables.
"""

from __future__ import annotations

from functools import lru_cache, partial
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.palette import ARITY, call_problem
from ..sources import blueprints, expressions
from .shared import written

# Fields of a node, the JSON types that they may have, and the code if they have another.
FIELD_TYPES = (
    ("module", ("string",), "ast.module_token_invalid"), ("metadata", ("object",), "ast.metadata_invalid"), ("metadata.designer", ("object",), "ast.designer_invalid"),
    ("metadata.designer.messages", ("array",), "ast.designer_messages_invalid"), ("metadata.designer.x", ("number",), "ast.designer_coordinates_invalid"), ("metadata.designer.y", ("number",), "ast.designer_coordinates_invalid"),
    ("mapper", ("object",), "mapping.mapper_not_object"), ("parameters", ("object",), "mapping.parameters_not_object"),
)
# Comparisons that filters may use (space around them does not count).
FILTER_OPERATORS = (
    "contains", "contains (case insensitive)", "does not exist", "equal", "equal to", "equal to (case insensitive)", "exist", "exists", "gt", "gte", "less than", "lt", "lte", "not equal", "not equal to", "not equal to (case insensitive)",
    "notexist", "number:equal", "number:greater", "number:greaterorequal", "number:less", "number:lessorequal", "text:contains", "text:contains:ci", "text:equal", "text:equal:ci", "text:notequal", "text:notequal:ci",
)
FILTER_LABEL_MOST = 120
CONDITIONS = "array<array<struct<a:string,o:string,b:string>>>"
# What a walk tells, by table. The tables share columns, as each costs time in every row: n is how often a node's id has come (0 for the first time), a route's nodes, a call's arguments; value a field's text or a filter's
# conditions; name a field's path, a filter's name, a template's problem, a function or a module token.
TABLES = {
    "fields": "bp_id string, node_path string, name string, kind string, value string",
    "nodes": "bp_id string, node_path string, kind string, n int, n_routes int, n_branches int",
    "routes": "bp_id string, node_path string, has_filter boolean, name string, value string, n int",
    "templates": "bp_id string, node_path string, name string",
    "calls": "bp_id string, node_path string, name string, n int",
    "tokens": "bp_id string, node_path string, name string",
}
_NONE: dict = {}
_NO_KEYS = repeat(None)
_PYTHON = {"string": (str,), "object": (dict,), "array": (list,), "number": (int, float)}


def _expected(before: str = "") -> dict[str, tuple[str, frozenset, dict]]:
    """By key: a field's path, the Python types that it may have without a finding, and the fields inside it; of ids and versions every value is judged."""
    own = {name.removeprefix(before): types for name, types, _ in FIELD_TYPES if name.startswith(before) and "." not in name.removeprefix(before)}
    fine = {key: (before + key, frozenset((type(None), *(p for t in types for p in _PYTHON[t]))), _expected(f"{before}{key}.")) for key, types in own.items()}
    return fine if before else {"id": ("id", frozenset(), {}), "version": ("version", frozenset(), {}), **fine}


_EXPECTED = _expected()


def _own(node: dict, nodes: set[int]) -> tuple[list[tuple], list[str]]:
    """Fields of a node that a rule may object to, with their type and text (of another type than theirs, ids and versions that are no plain numbers), and its texts with templates; nodes inside it (nodes: the id() of each) have their own."""
    odd: list[tuple] = []
    texts: list[str] = []
    stack: list[tuple] = [(node, _EXPECTED)]
    while stack:
        held, expected = stack.pop()
        # A list's values have no fields; None is no key.
        for key, v in held.items() if type(held) is dict else zip(_NO_KEYS, held):
            kind, inner = type(v), _NONE
            if key in expected:
                name, fine, inner = expected[key]
                if kind not in fine and (fine or kind is not int or v <= 0):
                    odd.append((name, blueprints._type(v), blueprints._scalar(v)))
            if kind is str:
                if "{{" in v or "}}" in v:
                    texts.append(v)
            elif (kind is dict or kind is list) and v and id(v) not in nodes:
                stack.append((v, inner))
    return odd, texts


def _read(text: str) -> list[tuple[str, tuple]]:
    """Problems of a text's templates, and those of its calls that a rule may object to: of functions without a known number of arguments, or with another number."""
    problems = [("templates", (problem,)) for _, problem in expressions.judged(text) if problem]
    calls = [call for body in expressions.templates_of(text)[0] for call in expressions.calls_of(body)]
    return problems + [("calls", (name, n)) for name, n in calls if name not in ARITY or not ARITY[name][0] <= n <= (ARITY[name][1] or n)]


_read_short = lru_cache(maxsize=1024)(_read)  # equal texts are read once; long ones are not kept


def _walked(bp_id: str, root: dict, held: dict[str, list[tuple]], tokens: bool = False) -> None:
    """Adds what a rule may object to in a document to the lists of TABLES; with tokens, the module token of every node, too."""
    spots = list(blueprints.walk(root))
    nodes = {id(spot[0]) for spot in spots}
    seen: set[str] = set()
    again: dict[str, int] = {}
    for node, path, _, _, _, _ in spots:
        odd, texts = _own(node, nodes)
        for name, kind, text in odd:
            held["fields"].append((bp_id, path, name, kind, text))
        for text in texts:
            for what, row in _read_short(text) if len(text) <= 500 else _read(text):
                held[what].append((bp_id, path, *row))
        n, own, token = 0, node.get("id"), node.get("module")
        if own is not None:
            own = str(own)
            if own in seen:
                n = again[own] = again.get(own, 1) + 1
            seen.add(own)
        token = token if type(token) is str else None
        kind = blueprints.kind_of(token)
        routes = () if blueprints._HOLDERS.isdisjoint(node) else [c for c in blueprints._children(node) if c[0] in ("routes", "branches")]
        if n > 1 or (kind == "router") != bool(routes):
            n_routes = sum(container == "routes" for container, *_ in routes)
            held["nodes"].append((bp_id, path, kind, n, n_routes, len(routes) - n_routes))
        for _, _, flow, route in routes:
            n = sum(isinstance(x, dict) for x in flow)
            if not n or "filter" in route:
                held["routes"].append((bp_id, path, *blueprints._filter_of(route), n))
        if tokens and token is not None:
            held["tokens"].append((bp_id, path, token))


def _finding(code: str | Column, severity: str = "error") -> Column:
    return F.struct((F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"))


def _where(*rules: tuple[Column, Column]) -> Column:
    """The findings of the rules, as an array; null for those whose conditions do not hold."""
    return F.array(*[F.when(condition, finding) for condition, finding in rules])


def field_shapes() -> Column:
    """Findings of a row of fields: a wrong JSON type, ids and versions of a wrong value."""
    field, kind, value = F.col("name"), F.col("kind"), F.col("value")
    whole = (kind == "number") & value.rlike(r"^[0-9]+$") & (value.cast("decimal(38,0)") > 0)
    code = F.when(kind == "null", F.when(field == "id", "ast.node_id_invalid"))
    for name, types, own in FIELD_TYPES:
        code = code.when((field == name) & ~kind.isin(*types), own)
    code = (
        code.when((field == "id") & (kind == "boolean"), "ast.node_id_boolean")
        .when((field == "id") & ~whole & ~((kind == "string") & (F.trim(value) != "")), "ast.node_id_invalid")
        .when((field == "version") & ~whole, "ast.node_version_invalid")
    )
    return F.array(_finding(code))


def node_shapes() -> Column:
    """Findings of a row of nodes: an id that its document uses more than once (one finding, at the second node), routes outside routers, routers without routes."""
    router = F.col("kind") == "router"
    return _where(
        (F.col("n") == 2, _finding("ast.node_id_duplicate")),
        (~router & (F.col("n_routes") > 0), _finding("route.routes_on_non_router")),
        (router & (F.col("n_routes") + F.col("n_branches") == 0), _finding("router.routes_missing")),
    )


def compared(rows: DataFrame) -> DataFrame:
    """rows with what route_shapes() asks of conditions: n_asked (comparisons; 0 where conditions are no lists of lists) and n_unsupported (those that filters may not use).

    Functions with lambdas stand in a projection of their own: where they stand among the rules, Spark makes no code for these.
    """
    asked = F.when(F.col("has_filter"), F.transform(F.flatten(F.from_json("value", CONDITIONS)), lambda c: F.lower(F.trim(c["o"]))))
    unsupported = F.filter("_asked", lambda o: o.isNotNull() & ~o.isin(*FILTER_OPERATORS))
    return rows.withColumn("_asked", asked).withColumns({"n_asked": F.coalesce(F.size("_asked"), F.lit(0)), "n_unsupported": F.coalesce(F.size(unsupported), F.lit(0))}).drop("_asked")


def route_shapes() -> Column:
    """Findings of a row of routes (of compared()): routes without nodes, and labels and conditions of filters, one for each comparison that filters may not use."""
    filtered, name = F.col("has_filter"), F.col("name")
    own = _where(
        (F.col("n") == 0, _finding("route.empty_flow", "warning")),
        (filtered & (F.col("n_asked") <= 0), _finding("filter.empty_conditions")),
        (filtered & (F.trim(F.coalesce(name, F.lit(""))) == ""), _finding("filter.label_missing", "warning")),
        (filtered & (F.length(name) > FILTER_LABEL_MOST), _finding("filter.label_overlong", "warning")),
    )
    return F.concat(own, F.array_repeat(_finding("filter.operator_unsupported"), F.col("n_unsupported")))


def call_shapes() -> Column:
    """Findings of a row of calls: unknown functions, wrong numbers of arguments."""
    problem = call_problem(F.col("name"), F.col("n"))
    return _where((problem == "arity", _finding("mapping.function_argument_count")), (problem == "unknown_function", _finding("mapping.function_unknown", "warning")))


def _found(rows: DataFrame, code: str | Column, severity: str = "error") -> DataFrame:
    return rows.select("bp_id", "node_path", (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit(severity).alias("severity"))


def reference_shapes(nodes: DataFrame, refs: DataFrame, available: DataFrame) -> DataFrame:
    """References to nodes that are not there, or not ready on every path; and to ids that more than one node has."""
    bad = blueprints.reference_problems(nodes, refs, available)
    twice = nodes.groupBy("bp_id", F.col("node_id").alias("source_node_id")).agg(F.count("*").alias("_n")).where("_n > 1")
    return _found(bad, "importability.reference_unavailable").unionByName(_found(refs.join(twice, ["bp_id", "source_node_id"], "left_semi"), "output.reference_duplicate_node_id"))


def unresolved(nodes: DataFrame, modules: DataFrame) -> DataFrame:
    """Nodes whose module token is in no catalog row (module_token)."""
    return _found(nodes.where("module_token IS NOT NULL").join(modules.select("module_token").distinct(), "module_token", "left_anti"), "module.unresolved")


def report(docs: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """All findings of documents (bp_id, raw) that need no paths; with a catalog, unresolved modules too.

    Documents are parsed and walked once, and a row meets its rules in the task that made it: nothing of a document is shuffled or written. Only with a catalog the walk's rows are written, for both readers.
    """
    tables = {what: schema for what, schema in TABLES.items() if what != "tokens" or modules is not None}
    rows = blueprints.flat_walk(docs, tables, partial(_walked, tokens=modules is not None))
    if modules is not None:
        rows = written(rows, "shapes")
    what = F.col("what")
    codes = F.when(what == "fields", field_shapes()).when(what == "nodes", node_shapes()).when(what == "routes", route_shapes()).when(what == "templates", F.array(_finding(F.col("name")))).when(what == "calls", call_shapes())
    found = compared(rows).select("bp_id", "node_path", F.explode(codes).alias("_f")).where("_f.code IS NOT NULL").select("bp_id", "node_path", "_f.code", "_f.severity")
    return found if modules is None else found.unionByName(unresolved(blueprints.part(rows, "tokens", TABLES["tokens"]).withColumnRenamed("name", "module_token"), modules))
