"""Documents put together from flat rows: JSON built bottom up from leaves, and workflows from nodes.

Rows are dealt by document once; each level then joins the texts of a container's members, deepest first, so rounds are the depth of the deepest document and nothing is shuffled between
them but a document's own rows. Numbers, escapes and the order of members are those of the leaves: leaves of what was built are the leaves that it was built of.

Defined results: a container without members is empty; a document without leaves is an empty object; leaves whose container has no row are left out; repeated rows give repeated members; a null text is null.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import blueprints
from .shared import written


LEAVES = "bp_id string, seq int, node_path string, path string, key string, json_type string, value string"


def quoted(text: Column) -> Column:
    """Text as a JSON string."""
    array = F.to_json(F.array(text))
    return F.substr(array, F.lit(2), F.length(array) - 2)


def literal(kind: Column, value: Column) -> Column:
    """A leaf's JSON text; null for arrays and objects."""
    return F.when(kind == "string", quoted(F.coalesce(value, F.lit("")))).when(kind.isin("number", "boolean"), value).when(kind == "null", F.lit("null"))


def all_leaves(docs: DataFrame) -> DataFrame:
    """bp_id, seq, node_path, path, key, json_type, value: every value of documents (bp_id, raw), with its number in page order."""

    def rows(bp_id: str, root: dict) -> Iterator[tuple]:
        for seq, (_, path, node_path, key, kind, value) in enumerate(blueprints._leaf_rows(bp_id, root)):
            yield bp_id, seq, node_path, path, key, kind, value

    return blueprints.part(blueprints.flat(docs, {"leaves": (LEAVES, rows)}), "leaves", LEAVES)


def _joined(members: Column, kind: Column) -> Column:
    inside = F.array_join(F.transform(F.array_sort(members), lambda m: F.when(kind == "object", F.concat(quoted(m["key"]), F.lit(":"), m["text"])).otherwise(m["text"])), ",")
    return F.when(kind == "object", F.concat(F.lit("{"), inside, F.lit("}"))).otherwise(F.concat(F.lit("["), inside, F.lit("]")))


def build(leaves: DataFrame, documents: DataFrame) -> DataFrame:
    """bp_id, raw of documents (bp_id): the JSON whose leaves (bp_id, seq, path, key, json_type, value) these are."""
    depth = F.size(F.split("path", r"\."))
    parent = F.when(F.col("path").contains("."), F.regexp_replace("path", r"\.[^.]*$", "")).otherwise("")
    rows = written(leaves.select("bp_id", "seq", "path", "key", "json_type", literal(F.col("json_type"), F.col("value")).alias("text"), depth.alias("depth"), parent.alias("parent")).repartition("bp_id"), "assembly")
    deepest = rows.agg(F.max("depth")).head()[0] or 0
    members: DataFrame | None = None
    for d in range(deepest, 0, -1):
        here = rows.where(F.col("depth") == d)
        if members is not None:
            here = here.join(members.withColumnRenamed("parent", "path"), ["bp_id", "path"], "left")
        else:
            here = here.withColumn("members", F.array().cast("array<struct<seq:int,key:string,text:string>>"))
        held = F.coalesce("members", F.array().cast("array<struct<seq:int,key:string,text:string>>"))
        text = F.coalesce("text", _joined(held, F.col("json_type")))
        members = here.groupBy("bp_id", "parent").agg(F.collect_list(F.struct("seq", "key", text.alias("text"))).alias("members"))  # members of one container
    ids = documents.select(F.col("bp_id").cast("string").alias("bp_id")).distinct()
    if members is None:
        return ids.withColumn("raw", F.lit("{}"))
    whole = ids.join(members.drop("parent"), "bp_id", "left")
    return whole.select("bp_id", F.coalesce(_joined(F.col("members"), F.lit("object")), F.lit("{}")).alias("raw"))


PLAN = "bp_id string, node_id long, parent_id long, container string, route int, place int, module string, version int, mapper string, parameters string"


def assemble(plan: DataFrame, modules: DataFrame, name: Column | None = None) -> DataFrame:
    """bp_id, raw: workflow documents compiled from plans (see PLAN) and the modules that they name (module_id, module_token).

    A plan's row is a node: the module's id, its data as JSON texts, and where it stands: in the main flow, or in the flow of its parent's route, or as its parent's error handler
    (container onerror), in the order of place. Nodes whose module no row knows, and whatever they hold, are left out; see unknown_modules(). Nodes that hold one another hang on no main flow and are left out, too.
    """
    known = modules.select(F.col("module_id").alias("module"), "module_token").distinct()
    rows = plan.join(known, "module").withColumn("key", F.coalesce("parent_id", F.lit(-1)))
    head = [F.concat(F.lit('"id":'), F.col("node_id").cast("string")), F.concat(F.lit('"module":'), quoted(F.col("module_token"))), F.concat(F.lit('"version":'), F.col("version").cast("string"))]
    data = [F.concat(F.lit(f'"{c}":'), F.col(c)) for c in ("parameters", "mapper")]
    rows = rows.select("bp_id", "node_id", "key", F.coalesce("container", F.lit("flow")).alias("container"), F.coalesce("route", F.lit(0)).alias("route"), "place", F.concat_ws(",", *head, *data).alias("own"))
    # Depths from the main flow down: a node whose parents do not lead there is in none of the levels. The plan is read once; only nodes below others look for their parents.
    rows = written(rows, "assembly-plan")
    levels, lower = [rows.where("key = -1")], rows.where("key <> -1")
    most = rows.count()
    while not levels[-1].isEmpty():
        if len(levels) > most:
            raise ValueError("nodes of a plan hold one another")
        above = levels[-1].select("bp_id", F.col("node_id").alias("key"))
        levels.append(written(lower.join(above, ["bp_id", "key"], "left_semi"), "assembly-level"))
    texts: DataFrame | None = None
    for level in reversed(levels[:-1]):
        if texts is not None:
            level = level.join(texts, ["bp_id", "node_id"], "left")
            level = level.withColumn("own", F.concat_ws(",", "own", "below"))
        flows = level.groupBy("bp_id", "key", "container", "route").agg(F.array_sort(F.collect_list(F.struct("place", "node_id", F.concat(F.lit("{"), "own", F.lit("}")).alias("text")))).alias("nodes"))
        flow = flows.withColumn("flow", F.concat(F.lit("["), F.array_join(F.transform("nodes", lambda n: n["text"]), ","), F.lit("]")))
        kept = flow.groupBy("bp_id", "key").agg(F.array_sort(F.collect_list(F.when(F.col("container") != "onerror", F.struct("route", "flow")))).alias("routes"), F.max(F.when(F.col("container") == "onerror", F.col("flow"))).alias("handlers"))
        routes = F.when(F.size("routes") > 0, F.concat(F.lit('"routes":['), F.array_join(F.transform("routes", lambda r: F.concat(F.lit('{"flow":'), r["flow"], F.lit("}"))), ","), F.lit("]")))
        below = F.concat_ws(",", routes, F.when(F.col("handlers").isNotNull(), F.concat(F.lit('"onerror":'), "handlers")))
        texts = kept.select("bp_id", F.col("key").alias("node_id"), below.alias("below"), F.get("routes", 0)["flow"].alias("main"))
    label = F.col("bp_id") if name is None else name
    ids = plan.select("bp_id").distinct()
    if texts is None:
        return ids.select("bp_id", F.concat(F.lit('{"name":'), quoted(label), F.lit(',"flow":[]}')).alias("raw"))
    whole = ids.join(texts.where("node_id = -1").select("bp_id", "main"), "bp_id", "left")
    return whole.select("bp_id", F.concat(F.lit('{"name":'), quoted(label), F.lit(',"flow":'), F.coalesce("main", F.lit("[]")), F.lit("}")).alias("raw"))


def unknown_modules(plan: DataFrame, modules: DataFrame) -> DataFrame:
    """bp_id, node_id, module of a plan's rows whose module is not known."""
    return plan.join(modules.select(F.col("module_id").alias("module")), "module", "left_anti").select("bp_id", "node_id", "module")
