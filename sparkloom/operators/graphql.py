"""GraphQL requests in workflow documents: shapes of the queries, budgets of depth and fields, and what a production scenario must declare.

A query's text is cut into tokens by a lexer that knows strings, block strings, comments, variables, arguments, directives and mapped values ({{...}}); depth and selected
fields are counted over its nested selections with fragment spreads put in. All else is DataFrame work: the documents are parsed once into the leaves that these
rules read, queries are rows, what a node declares is rolled up to the node, and each rule is a condition on their join. Every finding is a warning.

Depth is that of nested selections, an inline fragment or a spread being one; a field with an alias is one field; a fragment counts where it is spread, as often as it is (in a cycle: once).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import blueprints
from .evidence import plain, plain_keys, plain_text, positive_int, says_something, under
from .shared import written

# Plain names of keys, by what a value under them tells.
QUERY_KEYS = ("graphql", "graphqlquery", "query")
VARIABLES_KEYS = ("graphqlvariables", "variables")
DEPTH_KEYS = ("depthbudget", "graphqlmaxdepth", "graphqldepthbudget", "maxdepth", "maxgraphqldepth")
FIELD_KEYS = ("fieldbudget", "fieldcountbudget", "graphqlfieldbudget", "graphqlfieldcountbudget", "maxfields", "maxgraphqlfields")
ERROR_KEYS = (
    "errorarrayguard", "errorarrayhandling", "errorbranch", "errorhandling", "errorpolicy", "errorsguard", "errorspath", "graphqlerrorarrayguard", "graphqlerrorarrayhandling", "graphqlerrorhandling", "graphqlerrorsguard", "graphqlerrorspath",
)
PARTIAL_KEYS = (
    "datacompletenessguard", "datanullguard", "graphqlpartialdata", "graphqlpartialdataguard", "graphqlpartialdatahandling", "graphqlpartialdatapolicy", "missingdataguard", "partialdata", "partialdataguard", "partialdatahandling",
    "partialdatapolicy", "requiredgraphqldata",
)
SCHEMA_KEYS = ("apischemarevision", "apischemaversion", "graphqlschemahash", "graphqlschemaid", "graphqlschemarevision", "graphqlschemaversion", "schemaetag", "schemahash", "schemarevision", "schemaversion")
ONCE_KEYS = ("clientmutationid", "dedupekey", "graphqlidempotencykey", "graphqlmutationidempotency", "idempotency", "idempotencykey", "mutationidempotency", "operationid", "requestid", "transactionid")
PROFILE_KEYS = ("deployment", "environment", "env", "profile", "stage")
_ALL_KEYS = frozenset((*QUERY_KEYS, *VARIABLES_KEYS, *DEPTH_KEYS, *FIELD_KEYS, *ERROR_KEYS, *PARTIAL_KEYS, *SCHEMA_KEYS, *ONCE_KEYS, *PROFILE_KEYS))

OPERATION = r"(?i)^\s*\{|\b(?:fragment|mutation|query|subscription)\b"
_TOKEN = re.compile(
    r'''"""(?:[^"\\]|\\.|"(?!""))*+(?:"""|\Z)|"(?:[^"\\\n]|\\.)*+"?|\#[^\n]*|(?P<mapped>\{\{)|(?P<spread>\.\.\.)|\$[_A-Za-z]\w*|@[_A-Za-z]\w*|(?P<name>[_A-Za-z]\w*)|(?P<sign>[{}():])''',
    re.S,
)


class Selection:
    """Fields, nested selections and spreads of one pair of braces."""

    __slots__ = ("fields", "inner", "spreads")

    def __init__(self) -> None:
        self.fields, self.inner, self.spreads = 0, [], []


def parse(text: str) -> tuple[list[Selection], dict[str, Selection]]:
    """(selections of the operations, fragments by name) of a query's text."""
    operations: list[Selection] = []
    fragments: dict[str, Selection] = {}
    stack: list[Selection] = []
    head: list[str] = []  # names since the last definition ended
    rounds, at, before = 0, 0, ""
    mapped = True
    while (m := _TOKEN.search(text, at)) is not None:
        at = m.end()
        if m["mapped"]:
            end = text.find("}}", at) if mapped else -1
            mapped = end >= 0
            if mapped:
                at = end + 2
                continue
            at = m.start() + 1
        sign = "{" if m["mapped"] else m["sign"]
        if sign == "(" or (sign == ")" and rounds):
            rounds += 1 if sign == "(" else -1
        elif rounds:
            continue
        elif m["spread"]:
            before = "..."
            continue
        elif m["name"]:
            if not stack:
                head.append(m["name"])
            elif before == "..." and m["name"] == "on":
                before = "... on"
                continue
            elif before == "...":
                stack[-1].spreads.append(m["name"])
            elif before != "... on":
                if before == ":":
                    stack[-1].fields -= 1  # the name before the colon was an alias
                stack[-1].fields += 1
            before = m["name"]
            continue
        elif sign == "{":
            own = Selection()
            if stack:
                stack[-1].inner.append(own)
            elif len(head) > 1 and head[0].lower() == "fragment":
                fragments.setdefault(head[1], own)
            else:
                operations.append(own)
            stack.append(own)
        elif sign == "}":
            if stack:
                stack.pop()
            if not stack:
                head = []
        before = sign or ""
    return operations, fragments


def measure(text: str) -> tuple[int, int]:
    """(depth, selected fields) of a query's text, spreads put in."""
    operations, fragments = parse(text)
    known: dict[int, tuple[int, int]] = {}

    def whole(root: Selection) -> tuple[int, int]:
        # Children first, without recursion; a selection that is being measured already (a cycle of fragments) adds nothing.
        stack, busy = [(root, False)], set()
        while stack:
            own, ready = stack.pop()
            if id(own) in known or (not ready and id(own) in busy):
                continue
            below = [*own.inner, *(fragments[s] for s in own.spreads if s in fragments)]
            if not ready:
                busy.add(id(own))
                stack.append((own, True))
                stack += [(b, False) for b in below]
                continue
            sizes = [known.get(id(b), (0, 0)) for b in below]
            known[id(own)] = 1 + max((d for d, _ in sizes), default=0), own.fields + sum(f for _, f in sizes)
        return known[id(root)]

    found = [whole(o) for o in operations or fragments.values()]
    return max((d for d, _ in found), default=0), min(sum(f for _, f in found), 1 << 62)


def _keep(inside: list[str], kind: str, text: str | None) -> bool:
    return inside[0] in ("parameters", "mapper", "metadata") and len(inside) > 1 and any(plain(p) in _ALL_KEYS for p in inside[1:])


def tables(docs: DataFrame) -> DataFrame:
    """The leaves of documents (bp_id, raw) that these rules read, parsed once, with the plain keys of their path."""
    rows = written(blueprints.flat(docs, {"leaves": blueprints.local_rows(_keep)}), "graphql")
    return blueprints.part(rows, "leaves", blueprints.LOCAL).withColumn("top", F.substring_index("local", ".", 1)).withColumn("keys", plain_keys(F.col("local")))


def measured(texts: pa.Array) -> list[pa.Array]:
    """measure() of a batch's texts, depths and fields: of each different text once."""
    held = texts.dictionary_encode()
    sizes = [measure(v) for v in held.dictionary.to_pylist()]
    return [pa.array([s[k] for s in sizes], pa.int64()).take(held.indices) for k in (0, 1)]


def queries(leaves: DataFrame) -> DataFrame:
    """bp_id, node_path, path, value, depth, fields of each query's text in a node's parameters and mapper."""
    texts = leaves.where(F.col("node_path").isNotNull() & (F.col("json_type") == "string") & F.col("top").isin("parameters", "mapper") & under(F.col("keys"), QUERY_KEYS) & F.col("value").rlike(OPERATION))
    names = ["bp_id", "node_path", "path", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *measured(batch.column("value"))], [*names, "depth", "fields"])

    return texts.select(*names).mapInArrow(run, "bp_id string, node_path string, path string, value string, depth long, fields long")


def declared(leaves: DataFrame) -> DataFrame:
    """Per node: has_variables, most_depth, most_fields, guards_errors, guards_parts, names_schema, runs_once, in_production."""
    keys, kind, value = F.col("keys"), F.col("json_type"), F.col("value")
    order = F.struct(F.array_position(F.array(*map(F.lit, ("parameters", "mapper", "metadata"))), F.col("top")), "seq")
    last = F.element_at("keys", -1)
    number = positive_int(kind, value)
    said = says_something(kind, value)

    def budget(names: tuple[str, ...]):
        here = F.when(last.isin(*names), number)
        return F.min(F.when(here.isNotNull(), F.struct(order.alias("o"), here.alias("n"))))["n"]

    mapped = F.col("top").isin("parameters", "mapper")
    return leaves.where("node_path IS NOT NULL").groupBy("bp_id", "node_path").agg(
        F.max(mapped & last.isin(*VARIABLES_KEYS) & (kind == "object") & (value != "0")).alias("has_variables"),
        budget(DEPTH_KEYS).alias("most_depth"), budget(FIELD_KEYS).alias("most_fields"),
        F.max(under(keys, ERROR_KEYS) & said).alias("guards_errors"), F.max(under(keys, PARTIAL_KEYS) & said).alias("guards_parts"), F.max(under(keys, SCHEMA_KEYS) & said).alias("names_schema"), F.max(under(keys, ONCE_KEYS) & said).alias("runs_once"),
        F.max(_production(keys, kind, value)).alias("in_production"),
    )


def _production(keys, kind, value):
    return F.coalesce(under(keys, PROFILE_KEYS) & (kind == "string") & F.contains(plain_text(value), F.lit("production")), F.lit(False))


def report(docs: DataFrame) -> DataFrame:
    """bp_id, node_path, path, code, severity of documents (bp_id, raw)."""
    leaves = tables(docs)
    scenario = leaves.where("node_path IS NULL AND top = 'metadata'").where(_production(F.col("keys"), F.col("json_type"), F.col("value"))).select("bp_id", F.lit(True).alias("scenario")).distinct()
    rows = queries(leaves).join(declared(leaves), ["bp_id", "node_path"], "left").join(scenario, "bp_id", "left")
    text, no = F.col("value"), lambda c: ~F.coalesce(F.col(c), F.lit(False))
    live = F.coalesce(F.col("in_production"), F.lit(False)) | F.coalesce(F.col("scenario"), F.lit(False))
    start = F.ltrim(F.regexp_replace(text, r"^\s+", ""))
    low, bare = F.lower(text), plain_text(text)
    once = reduce(lambda a, b: a | b, [F.contains(bare, F.lit(k)) for k in ONCE_KEYS])
    rules = {
        "query_minification_suggested": text.rlike(r"[\n\t]|  "),
        "dynamic_query_without_variables": no("has_variables") & (F.contains(text, F.lit("{{")) | F.contains(text, F.lit("}}"))),
        "operation_name_missing": F.startswith(start, F.lit("{")) | (start.rlike(r"(?i)^(?:mutation|query|subscription)\b") & ~start.rlike(r"(?i)^(?:mutation|query|subscription)\s+[_A-Za-z][_0-9A-Za-z]*\b")),
        "variable_type_declaration_missing": ~no("has_variables") & text.rlike(r"\$[_A-Za-z]") & ~text.rlike(r"(?is)^\s*(?:mutation|query|subscription)\b(?:\s+[_A-Za-z][_0-9A-Za-z]*)?\s*\([^)]*\$[_A-Za-z][_0-9A-Za-z]*\s*:"),
        "depth_budget_exceeded": F.col("depth") > F.col("most_depth"),
        "field_count_budget_exceeded": F.col("fields") > F.col("most_fields"),
        "production_introspection_query": live & (F.contains(low, F.lit("__schema")) | F.contains(low, F.lit("__type")) | F.contains(bare, F.lit("introspectionquery"))),
        "error_array_guard_missing": live & no("guards_errors"),
        "partial_data_guard_missing": live & no("guards_parts"),
        "schema_version_missing": live & no("names_schema"),
        "mutation_idempotency_missing": live & no("runs_once") & text.rlike(r"(?i)^\s*mutation\b") & ~once,
    }
    codes = F.array_compact(F.array(*[F.when(condition, F.lit(f"graphql.{name}")) for name, condition in rules.items()]))
    return rows.select("bp_id", "node_path", "path", F.explode(codes).alias("code"), F.lit("warning").alias("severity"))
