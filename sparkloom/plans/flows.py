"""Workflow documents made of orders and their lines, and the document operators over them, each with SQL for the same rows.

An order is a document; each line is a node, in order of line number, and a router stands after them. Some documents have the
defects that the shape rules look for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes
from ..sources import blueprints, expressions
from ..sources.tables import table
from . import estimate
from .queries import query

# Module tokens by return flag.
MODULES = {"A": "http:ActionSendData", "N": "gateway:CustomWebHook", "R": "util:TextAggregator"}


def documents(spark: SparkSession, d: str) -> DataFrame:
    """bp_id, raw of each order that has lines."""
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"])

    def node(line: Column) -> Column:
        n, flag = line["l_linenumber"], line["l_returnflag"]
        module = F.when(flag == "A", MODULES["A"]).when(flag == "N", MODULES["N"]).otherwise(MODULES["R"])
        mapper = F.when(line["l_linestatus"] == "F", F.concat(F.lit('{"qty":"{{'), (n - 1).cast("string"), F.lit('.value}}","part":'), line["l_partkey"].cast("string"), F.lit("}"))).otherwise(F.lit('"{{lower(\\"a;b\\")}} {{upper(1; 2)}} {{ }}"'))
        return F.concat(
            F.lit('{"id":'), n.cast("string"), F.lit(',"module":"'), module, F.lit('","version":'), (n - 1).cast("string"), F.lit(',"mapper":'), mapper,
            F.lit(',"metadata":{"designer":{"x":'), F.when(n == 7, '"far"').otherwise(line["l_quantity"].cast("long").cast("string")), F.lit(',"y":0}}}'),
        )

    # The lines' columns are shuffled and sorted, not the texts that are made of them.
    held = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"))).alias("nodes"))
    orders = table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_orderstatus"])
    status = F.col("o_orderstatus")
    conditions = F.when(status == "O", "[]").otherwise(F.concat(F.lit('[[{"a":"{{1.value}}","o":"'), F.when(status == "F", "number:greater ").otherwise("is like"), F.lit('","b":"5"}]]')))
    label = F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority"))
    router = F.concat(
        F.lit('{"id":100,"module":"'), F.when(F.col("o_orderpriority") == "5-LOW", "util:Plain").otherwise("builtin:BasicRouter"), F.lit('","routes":[{"flow":[{"id":101,"module":"http:ActionSendData"}],"filter":{"name":"'), label, F.lit('","conditions":'),
        conditions, F.lit('}},{"disabled":'), F.when(status == "P", "true").otherwise("false"), F.lit(',"flow":['), F.when(F.col("o_orderpriority") == "2-HIGH", "").otherwise('{"id":102,"module":"gateway:WebhookRespond"}'), F.lit("]}]}"),
    )
    rows = held.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderkey").cast("string").alias("bp_id"), F.concat(F.lit('{"name":"o","flow":['), F.array_join(F.transform("nodes", node), ","), F.lit(","), router, F.lit("]}")).alias("raw"))


LINES = "(SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1 AS pos FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"
HEADS = "(SELECT l_orderkey, any_value(o_orderpriority) AS pri, any_value(o_orderstatus) AS st, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)"
KIND = "CASE l_returnflag WHEN 'A' THEN 'http_api' WHEN 'N' THEN 'webhook' ELSE 'aggregator' END"


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS bp_id, kind, depth, count(*) AS n, CAST(sum(CAST(node_id AS BIGINT)) AS BIGINT) AS ids FROM (
SELECT l_orderkey, {KIND} AS kind, 0 AS depth, l_linenumber AS node_id FROM {LINES}
UNION ALL SELECT l_orderkey, CASE pri WHEN '5-LOW' THEN 'module' ELSE 'router' END, 0, 100 FROM {HEADS}
UNION ALL SELECT l_orderkey, 'http_api', 1, 101 FROM {HEADS}
UNION ALL SELECT l_orderkey, 'webhook', 1, 102 FROM {HEADS} WHERE pri <> '2-HIGH') GROUP BY 1, 2, 3""")
def flow_nodes(spark: SparkSession, d: str) -> DataFrame:
    return blueprints.nodes(documents(spark, d), only=("bp_id", "kind", "depth", "node_id")).groupBy("bp_id", "kind", "depth").agg(F.count("*").alias("n"), F.sum(F.col("node_id").cast("long")).alias("ids"))


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS bp_id, 'control' AS kind, 'flow.' || pos AS source, 'flow.' || (pos + 1) AS target FROM {LINES}
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'control', 'flow.' || n, 'flow.' || n || '.routes.0.flow.0' FROM {HEADS}
UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'control', 'flow.' || n, 'flow.' || n || '.routes.1.flow.0' FROM {HEADS} WHERE pri <> '2-HIGH'""")
def flow_edges(spark: SparkSession, d: str) -> DataFrame:
    return blueprints.edges(documents(spark, d))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS bp_id, 'flow.' || pos AS node_path, CAST(l_linenumber - 1 AS VARCHAR) AS source_node_id, 'value' AS field_path FROM {LINES} WHERE l_linestatus = 'F' UNION ALL SELECT CAST(l_orderkey AS VARCHAR), 'flow.' || n, '1', 'value' FROM {HEADS} WHERE st <> 'O'")
def flow_references(spark: SparkSession, d: str) -> DataFrame:
    return blueprints.references(blueprints.leaves(documents(spark, d), marks=("{{",), only=("bp_id", "node_path", "json_type", "value"))).select("bp_id", "node_path", "source_node_id", "field_path")


@query(f"SELECT json_type, key, count(*) AS n FROM (SELECT unnest(CASE WHEN l_linestatus = 'F' THEN ['number:part', 'string:qty', 'object:mapper'] ELSE ['string:mapper'] END) AS k FROM {LINES}) JOIN (SELECT 1) ON true, LATERAL (SELECT split_part(k, ':', 1) AS json_type, split_part(k, ':', 2) AS key) GROUP BY 1, 2")
def flow_leaves(spark: SparkSession, d: str) -> DataFrame:
    return blueprints.leaves(documents(spark, d), keys=("part", "qty", "mapper"), only=("json_type", "key")).groupBy("json_type", "key").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS bp_id, 'flow.' || n AS owner_path, r AS route, r = 1 AND st = 'P' AS disabled, CASE r WHEN 0 THEN CASE pri WHEN '1-URGENT' THEN '' ELSE pri END END AS filter_name FROM {HEADS}, (SELECT unnest([0, 1]) AS r)")
def flow_routes(spark: SparkSession, d: str) -> DataFrame:
    return blueprints.routes(documents(spark, d), only=("bp_id", "owner_path", "route", "disabled", "filter_name")).select("bp_id", "owner_path", "route", "disabled", "filter_name")


@query(f"SELECT name, CAST(n_args AS INTEGER) AS n_args, count(*) AS n FROM {LINES}, (SELECT unnest(['lower', 'upper']) AS name, unnest([1, 2]) AS n_args) WHERE l_linestatus <> 'F' GROUP BY 1, 2")
def flow_calls(spark: SparkSession, d: str) -> DataFrame:
    """Quoted separators do not part arguments."""
    return expressions.calls(blueprints.leaves(documents(spark, d), marks=("{{", "}}"), only=("bp_id", "node_path", "path", "json_type", "value"))).groupBy("name", "n_args").agg(F.count("*").alias("n"))


_AT = "SELECT CAST(l_orderkey AS VARCHAR) AS bp_id, 'flow.' || {pos} AS node_path, '{code}' AS code, '{severity}' AS severity FROM {rows} WHERE {where}"
_RULES = (
    ("ast.node_version_invalid", "error", LINES, "pos", "l_linenumber = 1"), ("ast.designer_coordinates_invalid", "error", LINES, "pos", "l_linenumber = 7"), ("mapping.mapper_not_object", "error", LINES, "pos", "l_linestatus <> 'F'"),
    ("ast.node_id_duplicate", "error", f"(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY pos) AS k FROM {LINES})", "pos", "k = 2"), ("mapping.expression_empty", "error", LINES, "pos", "l_linestatus <> 'F'"),
    ("mapping.function_argument_count", "error", LINES, "pos", "l_linestatus <> 'F'"), ("route.routes_on_non_router", "error", HEADS, "n", "pri = '5-LOW'"), ("route.empty_flow", "warning", HEADS, "n", "pri = '2-HIGH'"),
    ("filter.empty_conditions", "error", HEADS, "n", "st = 'O'"), ("filter.label_missing", "warning", HEADS, "n", "pri = '1-URGENT'"), ("filter.operator_unsupported", "error", HEADS, "n", "st = 'P'"),
)


@query(" UNION ALL ".join(_AT.format(code=c, severity=s, rows=r, pos=p, where=w) for c, s, r, p, w in _RULES))
def flow_findings(spark: SparkSession, d: str) -> DataFrame:
    return shapes.report(documents(spark, d))


@query(f"SELECT CAST(l_orderkey AS VARCHAR) AS bp_id, 'flow.' || pos AS node_path, 'module.unresolved' AS code, 'error' AS severity FROM {LINES} WHERE l_returnflag = 'R'")
def flow_unresolved(spark: SparkSession, d: str) -> DataFrame:
    catalog = spark.createDataFrame([(m,) for m in (MODULES["A"], MODULES["N"], "builtin:BasicRouter", "util:Plain", "gateway:WebhookRespond")], "module_token string")
    return shapes.unresolved(blueprints.nodes(documents(spark, d)), catalog)


@query(f"""
SELECT CAST(l_orderkey AS VARCHAR) AS bp_id, CAST(CASE l_orderkey % 3 WHEN 0 THEN 48 WHEN 1 THEN 2 ELSE 1 END AS BIGINT) AS runs, per_run, per_run * CASE l_orderkey % 3 WHEN 0 THEN 48 WHEN 1 THEN 2 ELSE 1 END AS operations
FROM (SELECT l_orderkey, n + 1 + CASE pri WHEN '5-LOW' THEN 1 ELSE 0 END + CASE pri WHEN '2-HIGH' THEN 0 ELSE 1 END AS per_run FROM {HEADS})""")
def flow_operations(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    k = F.col("bp_id").cast("long") % 3
    cadence = docs.select("bp_id", F.when(k == 0, "30 minutes").when(k == 1, "12 hours").otherwise("now and then").alias("interval"))
    return estimate.operations(blueprints.nodes(docs), cadence)
