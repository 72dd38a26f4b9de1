"""Workflow documents (JSON) as flat tables: nodes, routes and leaves.

One pass over each document walks its tree with an explicit stack, in page order, and writes every value as a leaf
row (containers too), so that rules become filters and joins instead of walks. Rows leave a task as Arrow columns; what a caller asks for (keys,
marks in a text) is picked during the walk.

Paths are keys and places joined by dots. A key's own dots and tildes are written ~1 and ~0 (an empty key is ~), so that different paths never look alike; see path_part().
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Container, Iterable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAVES = "bp_id string, path string, node_path string, key string, json_type string, value string"
NODES = "bp_id string, node_path string, parent_path string, container string, route int, pos int, depth int, node_id string, module_token string, kind string, label string, x double, y double, disabled boolean"
ROUTES = "bp_id string, owner_path string, container string, route int, disabled boolean, has_filter boolean, filter_name string, conditions string"
DIAGNOSTICS = "bp_id string, problem string"
# Containers of child flows in a node, in traversal order.
CONTAINERS = ("routes", "branches", "tools", "onerror")
_HOLDERS = frozenset(CONTAINERS)
# Fields of a node that have a meaning; others are kept as unknown fields.
KNOWN_FIELDS = frozenset(("id", "module", "version", "parameters", "mapper", "metadata", "filter", "label", "name", "disabled", *CONTAINERS))
# Module words that tell a node's kind, the first that fits.
KINDS = (
    ("router", ("router",)), ("iterator", ("feeder", "iterator")), ("aggregator", ("aggregator",)), ("webhook", ("webhook", "gateway")), ("http_api", ("http",)),
    ("data_store", ("datastore", "data-store")), ("ai_agent", ("ai-agent", "agent")), ("mcp_tool", ("mcp",)), ("error_handler", ("error", "rollback", "resume", "ignore")), ("schedule_trigger", ("schedule",)),
)


@lru_cache(maxsize=4096)
def kind_of(token: str | None) -> str:
    if not token:
        return "unresolved"
    low = token.lower()
    return next((kind for kind, words in KINDS if any(w in low for w in words)), "module")


def _type(v) -> str:
    return "null" if v is None else "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object"



def _refused(name: str) -> float:
    raise _NotFinite


class _NotFinite(Exception):
    """NaN or an infinity stands in the text."""


def _finite(text: str) -> float:
    v = float(text)
    if math.isinf(v):
        raise _NotFinite
    return v


_DECODER = json.JSONDecoder(parse_float=_finite, parse_constant=_refused)  # numbers are judged as they are read: no second pass over the text


def _infinite(root: dict) -> bool:
    """Whether a number that the document holds (not one that a repeated key hides) is infinite."""
    stack: list = [root]
    while stack:
        v = stack.pop()
        if isinstance(v, float) and not math.isfinite(v):
            return True
        stack.extend(v.values() if isinstance(v, dict) else v if isinstance(v, list) else ())
    return False


def _load(text: str | None) -> tuple[dict | None, str | None]:
    """The root object, or what is wrong with the text."""
    if not text:
        return None, "empty"
    try:
        root = _DECODER.decode(text)
    except _NotFinite:
        try:
            whole = json.loads(text)
        except (ValueError, RecursionError):
            return None, "invalid_json"
        if not isinstance(whole, dict):
            return None, "root_not_object"
        try:
            root = json.loads(text, parse_constant=_refused)
        except _NotFinite:
            return None, "number_not_finite"
        return (None, "number_not_finite") if _infinite(root) else (root, None)
    except (ValueError, RecursionError):
        return None, "invalid_json"
    return (root, None) if isinstance(root, dict) else (None, "root_not_object")


def _children(node: dict) -> Iterator[tuple[str, int, list, dict]]:
    """(container, route number, nodes, the route) of each child flow."""
    for container in CONTAINERS:
        held = node.get(container)
        if not isinstance(held, list):
            continue
        if container in ("routes", "branches"):
            for k, route in enumerate(held):
                if isinstance(route, dict) and isinstance(route.get("flow"), list):
                    yield container, k, route["flow"], route
        elif container == "tools":
            # A tool is a wrapper around a flow, or a node itself.
            flows = [k for k, tool in enumerate(held) if isinstance(tool, dict) and isinstance(tool.get("flow"), list)]
            for k in flows:
                yield container, k, held[k]["flow"], held[k]
            if alone := [None if k in flows else tool for k, tool in enumerate(held)]:
                if any(isinstance(tool, dict) for tool in alone):
                    yield container, -1, alone, {}
        else:
            yield container, 0, held, {}


def walk(root: dict) -> Iterator[tuple[dict, str, str | None, str, int | None, int]]:
    """(node, path, parent's path, container, route, depth) of each node in preorder."""
    flow = root.get("flow") if isinstance(root.get("flow"), list) else []
    stack = [(n, f"flow.{k}", None, "flow", None, 0) for k, n in reversed(list(enumerate(flow)))]
    while stack:
        spot = stack.pop()
        node, path, _, _, _, depth = spot
        if not isinstance(node, dict):
            continue
        yield spot
        if _HOLDERS.isdisjoint(node):
            continue
        inner = []
        for name, k, nodes, wrapper in _children(node):
            at = f"{path}.{name}.{k}.flow" if wrapper else f"{path}.{name}"
            inner += [(n, f"{at}.{i}", path, name, k, depth + 1) for i, n in enumerate(nodes)]
        stack.extend(reversed(inner))


def key_part(key: str) -> str:
    """A key as it stands in a path."""
    return key.replace("~", "~0").replace(".", "~1") or "~"


def path_part(key: Column) -> Column:
    """key_part() of a column."""
    text = F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("."), F.lit("~1"))
    return F.when(text == "", "~").otherwise(text)


def path_keys(path: Column) -> Column:
    """The keys and places of a path, as array<string>."""
    return F.transform(F.split(path, r"\."), lambda p: F.when(p == "~", "").otherwise(F.replace(F.replace(p, F.lit("~1"), F.lit(".")), F.lit("~0"), F.lit("~"))))


def _number(v) -> float | None:
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else None


def _flag(v) -> bool:
    """Whether a flag is set: true, or one of the texts for it; numbers are no flags."""
    return v if isinstance(v, bool) else isinstance(v, str) and v.strip().lower() in ("1", "true", "yes")


def _unset(v) -> bool:
    """Whether a flag is there and not set."""
    return not v if isinstance(v, bool) else isinstance(v, str) and v.strip().lower() in ("0", "false", "no")


def _node_rows(bp_id: str, root: dict) -> Iterator[tuple]:
    for pos, (node, path, parent, container, route, depth) in enumerate(walk(root)):
        meta, token, label = node.get("metadata"), node.get("module"), node.get("label")
        spot = meta.get("designer") if isinstance(meta, dict) else None
        spot = spot if isinstance(spot, dict) else {}
        token = token if isinstance(token, str) else None
        yield (
            bp_id, path, parent, container, route, pos, depth, None if node.get("id") is None else str(node["id"]), token, kind_of(token), label if isinstance(label, str) else None,
            _number(spot.get("x")), _number(spot.get("y")), _flag(node.get("disabled")),
        )


def _leaf_rows(bp_id: str, root: dict, keys: frozenset[str] | None = None, marks: Sequence[str] | None = None) -> Iterator[tuple]:
    owners = {spot[1] for spot in walk(root)}
    stack: list[tuple[str, str, str | None, object]] = [("", "", None, root)]
    while stack:
        path, key, owner, v = stack.pop()
        if isinstance(v, dict) and path in owners:
            owner = path
        kind = _type(v)
        if path and (keys is None or key in keys) and (marks is None or (kind == "string" and any(m in v for m in marks))):
            yield bp_id, path, owner, key, kind, None if kind in ("object", "array", "null") else v if kind == "string" else json.dumps(v)
        if kind == "object" or kind == "array":
            at = f"{path}." if path else ""
            # Values that neither are wanted nor hold any stay here: no path is made for them.
            members = [(k, str(k), x) for k, x in enumerate(v)] if kind == "array" else [(key_part(k) if "." in k or "~" in k or not k else k, k, x) for k, x in v.items()]
            if keys is not None:
                members = [m for m in members if m[1] in keys or isinstance(m[2], (dict, list))]
            if marks is not None:
                members = [m for m in members if isinstance(m[2], (dict, list)) or (isinstance(m[2], str) and any(s in m[2] for s in marks))]
            stack.extend([(f"{at}{part}", k, owner, x) for part, k, x in reversed(members)])


_SORTED = json.JSONEncoder(sort_keys=True)


def _filter_of(route: dict) -> tuple[bool, str | None, str | None]:
    """Whether a route has a filter, its name and its conditions as JSON."""
    rule = route.get("filter")
    held = rule if isinstance(rule, dict) else {}
    return isinstance(rule, dict), held["name"] if isinstance(held.get("name"), str) else None, _SORTED.encode(held["conditions"]) if "conditions" in held else None


def _route_rows(bp_id: str, root: dict) -> Iterator[tuple]:
    for node, path, *_ in walk(root):
        for name, k, _, route in _children(node):
            if name in ("routes", "branches"):
                yield bp_id, path, name, k, _flag(route.get("disabled")) or _unset(route.get("enabled")), *_filter_of(route)


def _place_rows(bp_id: str, root: dict) -> Iterator[tuple]:
    spots = list(walk(root))
    at = {spot[1]: k for k, spot in enumerate(spots)}
    leave, last = list(range(len(spots))), {}
    for k in range(len(spots) - 1, -1, -1):
        _, _, parent, container, route, _ = spots[k]
        flow = (parent, container, route)
        last[flow] = max(last.get(flow, 0), leave[k])
        if parent is not None:
            leave[at[parent]] = max(leave[at[parent]], leave[k])
    reach, on_path, router = {}, [], []
    for k, (node, path, parent, container, route, _) in enumerate(spots):
        flow, up = (parent, container, route), None if parent is None else at[parent]
        if flow not in reach:
            # Every way through a node with one flow passes that flow, so that its nodes are there for what comes after the node, too.
            only = up is not None and sum(name != "onerror" for name, *_ in _children(spots[up][0])) == 1
            reach[flow] = reach[(spots[up][2], spots[up][3], spots[up][4])] if only else last[flow]
        on_path.append(container != "onerror" and (up is None or on_path[up]))
        router.append(None if up is None else up if kind_of(spots[up][0].get("module") if isinstance(spots[up][0].get("module"), str) else None) == "router" else router[up])
        token = node.get("module") if isinstance(node.get("module"), str) else None
        yield bp_id, path, None if node.get("id") is None else str(node["id"]), token, kind_of(token), container, route, parent, up, router[k], k, leave[k], reach[flow], on_path[k]


PLACES = "bp_id string, node_path string, node_id string, module_token string, kind string, container string, route int, parent_path string, parent int, router int, enter int, leave int, reach int, on_path boolean"


def places(docs: DataFrame) -> DataFrame:
    """The nodes of each document with interval numbers, so that questions about their places are comparisons of integers.

    enter and leave: numbers of the node and of the last node inside it, in preorder. Node a is inside b if b.enter < a.enter <= b.leave. reach: the last node for which the node has
    run on every way that leads there, so that u stands before c on all ways if both are on_path (not in error handlers) and u.enter < c.enter <= u.reach. parent and router: the
    numbers of the node that holds it and of the nearest router above.
    """
    return _emit(docs, PLACES, _place_rows)


_TABLES = {"nodes": (NODES, _node_rows), "leaves": (LEAVES, _leaf_rows), "routes": (ROUTES, _route_rows)}
_KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}


def _columns(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(c.split()[0], _KINDS[c.split()[1]]) for c in schema.split(", ")]


def _emit(docs: DataFrame, schema: str, rows_of: Callable[[str, dict], Iterator[tuple]], only: Sequence[str] | None = None) -> DataFrame:
    """Rows of each document that parses, as columns of the schema; with only, just these columns leave the task (Spark cannot prune what a task's code makes)."""
    columns = _columns(schema)
    kept = [k for k, (n, _) in enumerate(columns) if only is None or n in only]
    schema = ", ".join(schema.split(", ")[k] for k in kept)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cells = list(zip(*rows)) if rows else [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(cells[k], columns[k][1]) for k in kept], [columns[k][0] for k in kept])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            for bp_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                root, _ = _load(text)
                if root is not None:
                    out.extend(rows_of(bp_id, root))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    return docs.select(F.col("bp_id").cast("string").alias("bp_id"), F.col("raw").cast("string").alias("raw")).mapInArrow(run, schema)


def nodes(docs: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """One row per node of each document (bp_id, raw), in preorder. Documents that do not parse give none; see diagnostics(). With only, just these columns."""
    return _emit(docs, NODES, _node_rows, only)


def leaves(docs: DataFrame, keys: Iterable[str] | None = None, marks: Sequence[str] | None = None, only: Sequence[str] | None = None) -> DataFrame:
    """Every value of each document: path, the node it belongs to, key, type and text (null for containers). With keys, only values under these; with marks, only texts that hold one of them; with only, just these columns."""
    wanted = None if keys is None else frozenset(keys)
    return _emit(docs, LEAVES, lambda bp_id, root: _leaf_rows(bp_id, root, wanted, marks), only)


def routes(docs: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """Routes and branches, with their filters; with only, just these columns."""
    return _emit(docs, ROUTES, _route_rows, only)


def fields_unknown(docs: DataFrame) -> DataFrame:
    """unknown_fields() of documents (bp_id, raw), told while they are walked: no other value leaves the task."""
    return _emit(docs, "bp_id string, node_path string, key string", lambda bp_id, root: ((bp_id, path, k) for node, path, *_ in walk(root) for k in node if k not in KNOWN_FIELDS))


def pairs_available(docs: DataFrame) -> DataFrame:
    """bp_id, pairs: how many pairs (node, node that stands before it on every way) each document has, where it has any; graph.available_by_reach() lists them."""

    def rows(bp_id: str, root: dict) -> Iterator[tuple]:
        places = list(_place_rows(bp_id, root))
        step = [0] * (len(places) + 1)  # a node that runs on every way counts from the next one to the last that it reaches
        for *_, enter, _leave, reach, on_path in places:
            if on_path and reach > enter:
                step[enter + 1] += 1
                step[reach + 1] -= 1
        pairs = before = 0
        for k, place in enumerate(places):
            before += step[k]
            pairs += before if place[-1] else 0
        if pairs:
            yield bp_id, pairs

    return _emit(docs, "bp_id string, pairs long", rows)


def fields_missing(docs: DataFrame, required: Iterable[tuple[str, str]]) -> DataFrame:
    """(bp_id, node_path, field) of required (module, field) that a node of the module does not hold anywhere in its own data: rules.required_missing(), told while documents are walked."""
    wanted: dict[str, list[str]] = {}
    for token, field in dict.fromkeys(required):
        wanted.setdefault(token, []).append(field)
    keys = frozenset(f for fields in wanted.values() for f in fields)

    def rows(bp_id: str, root: dict) -> Iterator[tuple]:
        held = {(path, key) for _, _, path, key, _, value in _leaf_rows(bp_id, root, keys) if value is not None and value != ""}
        for node, path, *_ in walk(root):
            token = node.get("module")
            for field in wanted.get(token, ()) if isinstance(token, str) else ():
                if (path, field) not in held:
                    yield bp_id, path, field

    return _emit(docs, "bp_id string, node_path string, field string", rows)


def flat(docs: DataFrame, tables: dict[str, tuple[str, Callable[[str, dict], Iterator[tuple]]]] | None = None) -> DataFrame:
    """Several tables of documents that are parsed once, in one: what (nodes, leaves, routes, or the given names of (schema, rows of a document)) and the columns of all; see part()."""
    tables = tables or _TABLES

    def walks(bp_id: str, root: dict, held: dict[str, list[tuple]]) -> None:
        for what, (_, own) in tables.items():
            held[what].extend(own(bp_id, root))

    return flat_walk(docs, {what: schema for what, (schema, _) in tables.items()}, walks)


def flat_walk(docs: DataFrame, tables: dict[str, str], walked: Callable[[str, dict, dict[str, list[tuple]]], None]) -> DataFrame:
    """flat() where one walk of a document adds the rows of all tables (names and schemas) to their lists."""
    order: dict[str, str] = {}
    for schema in tables.values():
        order |= dict(c.split() for c in schema.split(", "))
    whole = "what string, " + ", ".join(f"{n} {k}" for n, k in order.items())
    columns = _columns(whole)

    def batch_of(what: str, rows: list[tuple]) -> pa.RecordBatch:
        """Rows of one table; the columns of the others are null arrays, not cells."""
        own = dict(zip((n for n, _ in _columns(tables[what])), zip(*rows) if rows else iter(lambda: (), None)))
        cells = [pa.array([what] * len(rows), pa.string())] + [pa.array(own[n], t) if n in own else pa.nulls(len(rows), t) for n, t in columns[1:]]
        return pa.RecordBatch.from_arrays(cells, [n for n, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {what: [] for what in tables}
        for batch in batches:
            for bp_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                root, _ = _load(text)
                if root is None:
                    continue
                walked(bp_id, root, held)
                for what, rows in held.items():
                    if len(rows) > 20_000:
                        yield batch_of(what, rows)
                        held[what] = []
        for what, rows in held.items():
            yield batch_of(what, rows)

    return docs.select(F.col("bp_id").cast("string").alias("bp_id"), F.col("raw").cast("string").alias("raw")).mapInArrow(run, whole)


def part(rows: DataFrame, what: str, schema: str | None = None) -> DataFrame:
    """One of the tables of flat()."""
    return rows.where(F.col("what") == what).select(*[n for n, _ in _columns(schema or _TABLES[what][0])])


LOCAL = "bp_id string, seq int, node_path string, path string, local string, key string, json_type string, value string"


def _scalar(v) -> str | None:
    """A value's text; of an array or object the number of its members."""
    return None if v is None else v if isinstance(v, str) else str(len(v)) if isinstance(v, (dict, list)) else json.dumps(v)


def local_rows(keep: Callable[[list[str], str, str | None], bool]) -> tuple[str, Callable[[str, dict], Iterator[tuple]]]:
    """A table for flat(): leaves with their number in page order and their path inside their node (of the document outside nodes), where keep(parts of that path, type, text) says so.

    The value of an array or object is the number of its members.
    """

    def rows(bp_id: str, root: dict) -> Iterator[tuple]:
        owners = {spot[1] for spot in walk(root)}
        stack: list[tuple[str, str, str | None, list[str], object]] = [("", "", None, [], root)]
        seq = 0
        while stack:
            path, key, owner, inside, v = stack.pop()
            if path in owners:
                owner, inside = path, []
            kind = _type(v)
            text = _scalar(v)
            seq += 1
            if inside and keep(inside, kind, text):
                yield bp_id, seq, owner, path, ".".join(inside), key, kind, text
            if kind == "object" or kind == "array":
                at = f"{path}." if path else ""
                inner = [(key_part(k), k, x) for k, x in v.items()] if kind == "object" else [(str(k), str(k), x) for k, x in enumerate(v)]
                stack.extend([(at + part, k, owner, [*inside, part], x) for part, k, x in reversed(inner)])

    return LOCAL, rows


def diagnostics(docs: DataFrame) -> DataFrame:
    """What is wrong with documents that do not parse."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(b, problem) for b, text in zip(*(c.to_pylist() for c in batch.columns)) if (problem := _load(text)[1])]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], ["bp_id", "problem"])

    return docs.select(F.col("bp_id").cast("string").alias("bp_id"), F.col("raw").cast("string").alias("raw")).mapInArrow(run, DIAGNOSTICS)


EDGES = "bp_id string, kind string, source string, target string"


def _edge_rows(bp_id: str, root: dict) -> Iterator[tuple]:
    last: dict[tuple, str] = {}
    for _, path, parent, container, route, _ in walk(root):
        flow = (parent, container, route)
        if flow in last:
            yield bp_id, "control", last[flow], path
        elif parent is not None:
            yield bp_id, "error" if container == "onerror" else "control", parent, path
        last[flow] = path


def edges(docs: DataFrame) -> DataFrame:
    """control_edges() of documents (bp_id, raw), told while they are walked."""
    return _emit(docs, EDGES, _edge_rows)


RESPONSES = "bp_id string, on_all_paths boolean, on_any_path boolean"


def responses(docs: DataFrame, modules: Iterable[str]) -> DataFrame:
    """Per document: whether all, and whether any, of its ways hold a node of one of the modules. A way through a node goes through one of its flows; an empty flow is a way, too, and error handlers are none."""
    wanted = frozenset(modules)

    def rows(bp_id: str, root: dict) -> Iterator[tuple]:
        spots = [s for s in walk(root)]
        at = {s[1]: k for k, s in enumerate(spots)}
        # By flow: whether it is sure to respond, and whether it may; children come before their parents.
        sure: dict[tuple, bool] = {}
        may: dict[tuple, bool] = {}
        of: dict[int, list[tuple]] = {}
        for _, _, parent, container, route, _ in spots:
            flow = (parent, container, route)
            if parent is not None and container != "onerror" and flow not in sure:
                of.setdefault(at[parent], []).append(flow)
            sure.setdefault(flow, False)
            may.setdefault(flow, False)
        for k in range(len(spots) - 1, -1, -1):
            node, _, parent, container, route, _ = spots[k]
            own = node.get("module") in wanted if isinstance(node.get("module"), str) else False
            flows, every = of.get(k, []), sum(name != "onerror" for name, *_ in _children(node))
            flow = (parent, container, route)
            sure[flow] = sure[flow] or own or (every > 0 and len(flows) == every and all(sure[f] for f in flows))
            may[flow] = may[flow] or own or any(may[f] for f in flows)
        top = (None, "flow", None)
        yield bp_id, sure.get(top, False), may.get(top, False)

    return _emit(docs, RESPONSES, rows)


def unknown_fields(leaf_rows: DataFrame) -> DataFrame:
    """Fields directly in a node that have no known meaning."""
    own = F.col("path") == F.concat("node_path", F.lit("."), path_part(F.col("key")))
    return leaf_rows.where(own & ~F.col("key").isin(*KNOWN_FIELDS)).select("bp_id", "node_path", "key")


def orphan_groups(leaf_rows: DataFrame) -> DataFrame:
    """bp_id, group_index, position, node_id, module_token of nodes that a document's designer keeps outside the flow; those without id or module are left out."""
    at = r"^metadata\.designer\.orphans\.(\d+)\.(\d+)\.(id|module)$"
    own = leaf_rows.where(F.col("path").rlike(at)).withColumn("group_index", F.regexp_extract("path", at, 1).cast("int")).withColumn("position", F.regexp_extract("path", at, 2).cast("int"))
    held = own.groupBy("bp_id", "group_index", "position").agg(
        F.max(F.when((F.col("key") == "id") & F.col("json_type").isin("number", "string"), F.col("value"))).alias("node_id"), F.max(F.when((F.col("key") == "module") & (F.col("json_type") == "string"), F.col("value"))).alias("module_token")
    )
    return held.where("trim(node_id) <> '' AND trim(module_token) <> ''")


def node_of(node_rows: DataFrame, bp_id: str, node_id: str) -> DataFrame:
    """The node of this id; raises where the row is read if the document has none."""
    found = node_rows.where((F.col("bp_id") == bp_id) & (F.col("node_id") == node_id))
    n = found.agg(F.count("*").alias("n")).select(F.when(F.col("n") == 0, F.raise_error(F.lit(f"document {bp_id} has no node {node_id}"))).alias("_none"))
    return found.join(F.broadcast(n), F.col("_none").isNull()).drop("_none")


_TEMPLATE = re.compile(r"\{\{(.*?)\}\}", re.S)
_ID_IN_TEMPLATE = re.compile(r"""("[^"]*"|'[^']*')|(?<![\w.])(\d+)(?=\.[A-Za-z_`\[])""")


def _text_renamed(text: str, ids: dict[str, str]) -> str:
    """A text with the ids of its templates replaced; quoted text in a template stays."""
    return _TEMPLATE.sub(lambda t: "{{" + _ID_IN_TEMPLATE.sub(lambda m: m[1] or ids.get(m[2], m[2]), t[1]) + "}}", text) if "{{" in text else text


def _renamed(v, ids: dict[str, str]):
    """A copy of a value with the ids of its templates replaced."""
    if isinstance(v, str):
        return _text_renamed(v, ids)
    if isinstance(v, list):
        return [_renamed(x, ids) for x in v]
    return {k: _renamed(x, ids) for k, x in v.items()} if isinstance(v, dict) else v


def _new_id(own, ids: dict[str, str]):
    """A node's id after the replacement: numbers stay numbers where they can."""
    new = ids.get(str(own))
    return own if new is None else int(new) if isinstance(own, int) and new.isdecimal() else new


def _put_ids(root: dict, ids: dict[str, str]) -> None:
    """Replaces the ids of a document's templates and nodes, in place and however deep they stand."""
    stack: list = [root]
    while stack:
        held = stack.pop()
        for k, v in held.items() if isinstance(held, dict) else enumerate(held):
            if isinstance(v, str):
                if "{{" in v:
                    held[k] = _text_renamed(v, ids)
            elif isinstance(v, (dict, list)):
                stack.append(v)
    for node, *_ in walk(root):
        if node.get("id") is not None:
            node["id"] = _new_id(node["id"], ids)


def rewrite_ids(docs: DataFrame, mapping: DataFrame) -> DataFrame:
    """docs (bp_id, raw) with node ids and the references to them replaced by mapping (bp_id, old, new); documents that do not parse, or that it does not name, stay as they are."""
    held = mapping.groupBy("bp_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("old", "new")))).alias("ids"))
    both = docs.select(F.col("bp_id").cast("string").alias("bp_id"), F.col("raw").cast("string").alias("raw")).join(held, "bp_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, pairs in zip(batch.column("raw").to_pylist(), batch.column("ids").to_pylist()):
                root, _ = _load(text)
                if root is not None and pairs:
                    _put_ids(root, dict(pairs))
                    text = json.dumps(root, ensure_ascii=False, separators=(",", ":"))
                out.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("bp_id"), pa.array(out, pa.string())], ["bp_id", "raw"])

    return both.mapInArrow(run, "bp_id string, raw string")


def own_texts(node: dict, nodes: Container[int], marks: Sequence[str]) -> list[str]:
    """Texts of a node that hold one of the marks, in no order; those of nodes inside it (nodes: the id() of each node of the document) are theirs."""
    found: list[str] = []
    stack: list = [node]
    while stack:
        held = stack.pop()
        for v in held.values() if type(held) is dict else held:
            kind = type(v)
            if kind is str:
                for mark in marks:
                    if mark in v:
                        found.append(v)
                        break
            elif (kind is dict or kind is list) and v and id(v) not in nodes:
                stack.append(v)
    return found


REFERENCE = r"\{\{\s*(\d+)\.([A-Za-z0-9_.\[\]]+)\s*\}\}"
_REFERENCE = re.compile(REFERENCE, re.ASCII)


def rewritten_references(docs: DataFrame, ids: Column) -> DataFrame:
    """bp_id, node_path, depth, node_id, source_node_id: nodes, and the references in their texts, of the documents that rewrite_ids() makes of docs (bp_id, raw), where ids is each row's map of old to new. A node without references has one row, with null.

    The map stands beside its document, and rows are told while ids are replaced: no document is written out, parsed again or shuffled, and no node has to meet its references by a join.
    """
    schema = "bp_id string, node_path string, depth int, node_id string, source_node_id string"
    columns = _columns(schema)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cells = zip(*rows) if rows else [()] * len(columns)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(cells, columns)], [n for n, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for batch in batches:
            pairs: list[tuple] | None = None
            known: dict[str, list[str]] = {}  # equal texts of a batch are read once for each map
            held = batch.column("ids")
            ends, old, new = held.offsets.to_pylist(), held.keys.to_pylist(), held.items.to_pylist()
            for bp_id, text, a, b in zip(batch.column("bp_id").to_pylist(), batch.column("raw").to_pylist(), ends, ends[1:]):
                root, _ = _load(text)
                if root is None:
                    continue
                if pairs != (pairs := list(zip(old[a:b], new[a:b]))):
                    known.clear()
                to = dict(pairs)
                spots = list(walk(root))
                nodes = {id(spot[0]) for spot in spots}
                for node, path, _, _, _, depth in spots:
                    own = node.get("id")
                    node_id = None if own is None else str(_new_id(own, to))
                    empty = True
                    for held_text in own_texts(node, nodes, ("{{",)):
                        sources = known.get(held_text)
                        if sources is None:
                            sources = known[held_text] = [m[1] for m in _REFERENCE.finditer(_text_renamed(held_text, to))]
                        for source in sources:
                            out.append((bp_id, path, depth, node_id, source))
                            empty = False
                    if empty:
                        out.append((bp_id, path, depth, node_id, None))
                if len(out) > 20_000:
                    yield batch_of(out)
                    out = []
        yield batch_of(out)

    return docs.select(F.col("bp_id").cast("string").alias("bp_id"), F.col("raw").cast("string").alias("raw"), ids.cast("map<string,string>").alias("ids")).mapInArrow(run, schema)


def references(leaf_rows: DataFrame) -> DataFrame:
    """bp_id, node_path, source_node_id, field_path of every {{id.field}} in a node's text."""
    found = leaf_rows.where("json_type = 'string' AND node_path IS NOT NULL").select("bp_id", "node_path", F.explode(F.regexp_extract_all("value", F.lit(REFERENCE), F.lit(0))).alias("expression"))
    return found.select("bp_id", "node_path", F.regexp_extract("expression", REFERENCE, 1).alias("source_node_id"), F.regexp_extract("expression", REFERENCE, 2).alias("field_path"), "expression")


def reference_problems(node_rows: DataFrame, refs: DataFrame, available: DataFrame) -> DataFrame:
    """References to a node that does not exist (missing) or does not stand before the reader on every path (unavailable); available: of graph.available_in_flows()."""
    ids = node_rows.select("bp_id", F.col("node_id").alias("source_node_id"), F.col("node_path").alias("earlier"))
    at = refs.join(ids, ["bp_id", "source_node_id"], "left")
    ready = available.select("bp_id", F.col("node_id").alias("node_path"), "earlier").withColumn("_ok", F.lit(True))
    out = at.join(ready, ["bp_id", "node_path", "earlier"], "left")
    return out.withColumn("problem", F.when(F.col("earlier").isNull(), "missing").when(F.col("_ok").isNull(), "unavailable")).where("problem IS NOT NULL").select("bp_id", "node_path", "source_node_id", "problem")


def control_edges(node_rows: DataFrame) -> DataFrame:
    """The graph of a document: each node to the next of its flow, and each node to the first of each child flow."""
    from pyspark.sql import Window

    flow = Window.partitionBy("bp_id", "parent_path", "container", "route").orderBy("pos")
    placed = node_rows.withColumn("_next", F.lead("node_path").over(flow)).withColumn("_first", F.row_number().over(flow) == 1)
    along = placed.where("_next IS NOT NULL").select("bp_id", F.lit("control").alias("kind"), F.col("node_path").alias("source"), F.col("_next").alias("target"))
    kind = F.when(F.col("container") == "onerror", "error").otherwise("control")
    down = placed.where("_first AND parent_path IS NOT NULL").select("bp_id", kind.alias("kind"), F.col("parent_path").alias("source"), F.col("node_path").alias("target"))
    return along.unionByName(down)
