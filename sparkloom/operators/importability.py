"""Importability of workflow documents: what keeps one from being handed over, as joins of its nodes' interval numbers and its leaves.

The documents are parsed once into two tables (nodes with intervals, and the leaves that these rules read); every rule is a filter or a join on them. A
reference is available if an earlier node's interval reaches the reader; an error handler inside an error handler is a path inside its node; placeholders meet their registry by
document and name. Findings: bp_id, node_path (null for the document itself), path, code, severity.

Defined results: documents that do not parse give no findings; a reference to an id that no node has is another rule's; one to an id that several nodes have is available if one of them is;
readers in error handlers have nothing available; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import blueprints
from .identity import expressions_allowed
from .shared import shuffled, written

# Metadata that must be lists of objects, metadata that must be objects, and texts of placeholders that were left open.
COLLECTIONS = ("parameters", "expect", "interface")
OBJECTS = ("restore",)
NOTE_TEXTS = ("content", "html", "text")
OPEN_TOKENS = ("{{todo", "__todo__", "<todo", "todo:")
# What a note's text must not hold when it is handed over.
ACTIVE_MARKS = ("<script", "</script", "<iframe", "</iframe", "<object", "</object", "<embed", "</embed ", "javascript:", "{{", "}}", "{%", "%}")
# Fields of an entry of the placeholder registry, and the name that it registers.
ENTRY_TEXTS = ("placeholder", "kind", "target_path", "expected_type", "handoff_instructions")
PLACEHOLDER = r"^runtime(\.[A-Za-z0-9_]+)+$"
# Parts of a node in which runtime placeholders count.
PLACEHOLDER_PARTS = ("parameters", "mapper", "metadata", "expect", "interface")

#: A template's body: no quote inside it ends it, and no single brace.
BODY = r"""(?s)\{\{((?:"(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'|[^"'}]|\}(?!\}))*+)\}\}"""
QUOTED = r""""(?:[^"\\]|\\.)*+"|'(?:[^'\\]|\\.)*+'"""
SOURCE = r"""(?<![\w.$])(\d+)(?=\s*(?:\.[A-Za-z_]|\[\s*['\d]))"""


def _keep(inside: list[str], kind: str, text: str | None) -> bool:
    """Leaves that a rule reads: open texts, metadata that has a shape, containers of mapped data, and error handlers."""
    first = inside[0]
    if kind == "string" and ("{{" in text or "todo" in text.lower()):
        return True
    if first == "metadata" and len(inside) > 1:
        return (inside[1] in COLLECTIONS or inside[1] in OBJECTS) and len(inside) <= 3 or inside[1] in ("notes", "placeholder_registry") and len(inside) <= 4
    return first in ("parameters", "mapper") and len(inside) == 1 or inside[-1] in ("onerror", "on_error")


def tables(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with intervals, the leaves that the rules read) of documents (bp_id, raw), parsed once."""
    rows = written(blueprints.flat(docs, {"places": (blueprints.PLACES, blueprints._place_rows), "leaves": blueprints.local_rows(_keep)}), "importability")
    return blueprints.part(rows, "places", blueprints.PLACES), blueprints.part(rows, "leaves", blueprints.LOCAL)


def _found(rows: DataFrame, code: str | Column, severity: str | Column = "error") -> DataFrame:
    own = [F.lit(x) if isinstance(x, str) else x for x in (code, severity)]
    return rows.select("bp_id", "node_path", "path", own[0].alias("code"), own[1].alias("severity"))


def _bodies(value: Column) -> Column:
    return F.regexp_extract_all(value, F.lit(BODY), F.lit(1))


def references(leaves: DataFrame) -> DataFrame:
    """bp_id, node_path, path, source_id of each reference to another node's output in the mapped data of a node and the filters of its routes; quoted text refers to nothing."""
    text = leaves.where(F.col("node_path").isNotNull() & (F.col("json_type") == "string") & F.contains("value", F.lit("{{")) & expressions_allowed(F.col("local")))
    body = text.select("bp_id", "node_path", "path", F.explode(_bodies(F.col("value"))).alias("body"))
    plain = F.regexp_replace("body", QUOTED, "''")
    return body.select("bp_id", "node_path", "path", F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(SOURCE), F.lit(1)))).alias("source_id"))


def unavailable(places: DataFrame, leaves: DataFrame) -> DataFrame:
    """References to nodes of the document that have not run on every way to the reader."""
    node = places.select("bp_id", "node_path", F.col("node_id").alias("own_id"), "enter", F.col("on_path").alias("runs"))
    usage = references(leaves).join(shuffled(node), ["bp_id", "node_path"]).where("NOT source_id <=> own_id")
    source = places.select("bp_id", F.col("node_id").alias("source_id"), (F.when(F.col("on_path"), F.col("enter"))).alias("first"), "reach")
    ready = F.max(F.coalesce(F.col("runs") & (F.col("first") < F.col("enter")) & (F.col("enter") <= F.col("reach")), F.lit(False)))
    met = usage.join(shuffled(source), ["bp_id", "source_id"]).groupBy("bp_id", "node_path", "path", "source_id").agg(ready.alias("ready"))
    return _found(met.where("NOT ready"), "importability.reference_unavailable")


def open_placeholders(leaves: DataFrame) -> DataFrame:
    """Texts in a node's parameters or mapper that still say what is to be filled in."""
    low = F.lower("value")
    held = reduce(lambda a, b: a | b, [F.contains(low, F.lit(t)) for t in OPEN_TOKENS])
    top = F.substring_index("local", ".", 1)
    texts = leaves.where((F.col("json_type") == "string") & F.col("local").rlike(r"^(parameters|mapper)\.") & held & F.col("node_path").isNotNull()).withColumn("top", top)
    objects = leaves.where(F.col("local").isin("parameters", "mapper") & (F.col("json_type") == "object")).select("bp_id", "node_path", F.col("local").alias("top"))
    return _found(texts.join(shuffled(objects), ["bp_id", "node_path", "top"], "left_semi"), "importability.placeholder_unresolved")


def metadata_shapes(leaves: DataFrame, strict: bool = True) -> DataFrame:
    """Metadata of nodes and documents that has another shape than it must; strict: also notes with another shape (of nodes) or with active content."""
    local, kind = F.col("local"), F.col("json_type")
    lists, objects = "|".join(COLLECTIONS), "|".join(OBJECTS)
    bad = (local.rlike(rf"^metadata\.({lists})$") & (kind != "array")) | (local.rlike(rf"^metadata\.({lists})\.\d+$") & (kind != "object")) | (local.rlike(rf"^metadata\.({objects})$") & (kind != "object"))
    # Places below something that is no list are not looked at.
    arrays = leaves.where(local.rlike(rf"^metadata\.({lists}|notes)$") & (kind == "array")).select("bp_id", "node_path", local.alias("list"))
    item = F.regexp_extract("local", r"^(metadata\.\w+)\.\d+", 1)

    def in_list(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("list", item).alias("r")
        on = (F.col("r.bp_id") == F.col("a.bp_id")) & F.col("r.node_path").eqNullSafe(F.col("a.node_path")) & (F.col("r.list") == F.col("a.list"))
        return rows.join(shuffled(arrays.alias("a")), on, "left_semi").select("r.*")

    shapes = leaves.where(bad)
    parts = [_found(shapes.where(~local.rlike(r"\.\d+$")), "importability.metadata_invalid"), _found(in_list(shapes.where(local.rlike(r"\.\d+$"))), "importability.metadata_invalid")]
    if strict:
        note = F.col("node_path").isNotNull()
        parts.append(_found(leaves.where((local == "metadata.notes") & (kind != "array") & note), "ast.notes_invalid"))
        parts.append(_found(in_list(leaves.where(local.rlike(r"^metadata\.notes\.\d+$") & (kind != "object") & note)), "ast.note_invalid"))
        texts = in_list(leaves.where(local.rlike(rf"^metadata\.notes\.\d+\.({'|'.join(NOTE_TEXTS)})$") & (kind != "null")))
        low = F.lower("value")
        active = reduce(lambda a, b: a | b, [F.contains(low, F.lit(m)) for m in ACTIVE_MARKS])
        blank = (kind != "string") | (F.trim(F.regexp_replace("value", r"\s+", " ")) == "")
        parts.append(_found(texts.where(blank), "ast.note_content_invalid"))
        parts.append(_found(texts.where(~blank & active), "importability.metadata_invalid"))
    return reduce(DataFrame.unionByName, parts)


def nested_handlers(places: DataFrame, leaves: DataFrame) -> DataFrame:
    """Error handlers of error handlers."""
    keys = leaves.where(F.col("local").rlike(r"(^|\.)(onerror|on_error)$") & F.col("node_path").isNotNull())
    handler = places.where("container = 'onerror'").select("bp_id", "node_path", F.lit(True).alias("handles"))
    rows = keys.join(shuffled(handler), ["bp_id", "node_path"], "left")
    own = F.coalesce("handles", F.lit(False)) & F.col("local").rlike(r"^(flow\.\d+\.)*(onerror|on_error)$")
    below = F.col("local").rlike(r"^(onerror|on_error)(\.\d+)?(\.flow\.\d+)*\.(onerror|on_error)$")
    return _found(rows.where(own | below), "importability.error_handler.nested_unsupported")


def unknown_modules(places: DataFrame, catalog: DataFrame, stubs: DataFrame | None = None, offline: bool = False) -> DataFrame:
    """Nodes whose module is in no row of the catalog (module_token); those that an operator approved as stubs (module_token) are told apart, and only warned of offline."""
    missing = places.where("module_token <> ''").join(catalog.select("module_token").distinct(), "module_token", "left_anti").withColumn("path", F.col("node_path"))
    if stubs is None:
        return _found(missing, "importability.module.unknown")
    marked = missing.join(stubs.select("module_token", F.lit(True).alias("stub")).distinct(), "module_token", "left")
    code = F.when(F.col("stub"), "importability.module.operator_approved_stub").otherwise("importability.module.unknown")
    return _found(marked, code, F.when(F.col("stub"), "warning" if offline else "error").otherwise("error"))


def placeholder_usages(leaves: DataFrame) -> DataFrame:
    """bp_id, node_path, path, seq, placeholder, pointer (JSON pointer of the text) of the runtime placeholders that a document uses."""
    own = F.col("node_path").isNotNull() & (F.substring_index("local", ".", 1).isin(*PLACEHOLDER_PARTS) | F.col("local").rlike(r"^(routes|branches|tools)\.\d+\.filter(\.|$)"))
    of_document = F.col("node_path").isNull() & F.startswith("local", F.lit("metadata.")) & ~F.startswith("local", F.lit("metadata.placeholder_registry"))
    texts = leaves.where((F.col("json_type") == "string") & F.contains("value", F.lit("runtime.")) & (own | of_document))
    used = texts.select("bp_id", "node_path", "path", "seq", F.explode(F.transform(_bodies(F.col("value")), lambda x: F.trim(x))).alias("placeholder")).where("startswith(placeholder, 'runtime.')")
    pointer = F.concat(F.lit("/"), F.array_join(F.transform(blueprints.path_keys(F.col("path")), lambda p: F.replace(F.replace(p, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))), "/"))
    return used.withColumn("pointer", pointer)


def registry_entries(leaves: DataFrame) -> DataFrame:
    """bp_id, entry (its place), path, valid, placeholder, kind, target_path, required, expected_type of a document's placeholder registry."""
    rows = leaves.where(F.col("node_path").isNull() & F.col("local").rlike(r"^metadata\.placeholder_registry\.\d+(\.[^.]*)?$"))
    place = F.regexp_extract("local", r"registry\.(\d+)", 1).cast("int")
    text = {name: F.max(F.when((F.col("key") == name) & (F.col("json_type") == "string") & F.col("local").rlike(r"\d+\.\w+$"), F.trim("value"))) for name in ENTRY_TEXTS}
    required = F.max(F.when((F.col("key") == "required") & (F.col("json_type") == "boolean"), F.col("value")))
    held = rows.groupBy("bp_id", place.alias("entry")).agg(*[c.alias(n) for n, c in text.items()], required.alias("required"))
    valid = F.col("required").isNotNull() & F.col("placeholder").rlike(PLACEHOLDER)
    for name in ENTRY_TEXTS[1:]:
        valid = valid & (F.coalesce(F.col(name), F.lit("")) != "")
    return held.withColumn("valid", F.coalesce(valid, F.lit(False))).withColumn("path", F.concat(F.lit("metadata.placeholder_registry."), F.col("entry").cast("string")))


def placeholder_registry(leaves: DataFrame) -> DataFrame:
    """Runtime placeholders against the registry of their document: unregistered, unused, incomplete, in conflict, or registered for another place."""
    registry = leaves.where(F.col("node_path").isNull() & (F.col("local") == "metadata.placeholder_registry"))
    listed = registry.where("json_type = 'array'").select("bp_id")
    entries = registry_entries(leaves).join(shuffled(listed), "bp_id", "left_semi").withColumn("node_path", F.lit(None).cast("string"))
    good, used = entries.where("valid"), placeholder_usages(leaves)
    names = used.select("bp_id", "placeholder").distinct()
    first = Window.partitionBy("bp_id", "placeholder").orderBy("entry")
    signature = F.struct("kind", "target_path", "required", "expected_type")
    other = good.withColumn("odd", signature != F.first(signature).over(first)).where("odd").withColumn("k", F.row_number().over(first)).where("k = 1")
    elsewhere = good.join(shuffled(names), ["bp_id", "placeholder"], "left_semi").join(shuffled(used.select("bp_id", "placeholder", F.col("pointer").alias("target_path")).distinct()), ["bp_id", "placeholder", "target_path"], "left_anti")
    lone = used.join(shuffled(good.select("bp_id", "placeholder").distinct()), ["bp_id", "placeholder"], "left_anti")
    lone = lone.withColumn("k", F.row_number().over(Window.partitionBy("bp_id", "placeholder").orderBy(F.col("node_path").isNotNull(), "seq"))).where("k = 1")
    parts = [
        _found(registry.where("json_type NOT IN ('array', 'null')"), "importability.placeholder_registry_incomplete"),
        _found(entries.where("NOT valid"), "importability.placeholder_registry_incomplete"),
        _found(other, "importability.placeholder_registry_conflict"),
        _found(elsewhere, "importability.placeholder_registry_target_mismatch"),
        _found(lone, "importability.placeholder_unregistered"),
        _found(good.join(shuffled(names), ["bp_id", "placeholder"], "left_anti"), "importability.placeholder_registry_unused", "warning"),
    ]
    return reduce(DataFrame.unionByName, parts)


def report(docs: DataFrame, catalog: DataFrame | None = None, stubs: DataFrame | None = None, offline: bool = False) -> DataFrame:
    """All findings of documents (bp_id, raw); with a catalog (module_token), unknown modules too. offline leaves out what only a handover asks for."""
    places, leaves = tables(docs)
    parts = [open_placeholders(leaves), metadata_shapes(leaves, strict=not offline), nested_handlers(places, leaves), placeholder_registry(leaves), unavailable(places, leaves)]
    if catalog is not None:
        parts.append(unknown_modules(places, catalog, stubs, offline))
    return reduce(DataFrame.unionByName, parts)
