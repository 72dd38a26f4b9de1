"""Comparison of documents with reference versions, as joins of their leaves: semantic and layout findings, removed nodes, and drift that is accepted."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .diff import leaf_delta


def in_layout(path: Column) -> Column:
    """Whether a path goes through a key named designer."""
    return path.rlike(r"(^|\.)designer(\.|$)")


def strip_layout(leaves: DataFrame) -> DataFrame:
    return leaves.where(~in_layout(F.col("path")))


def _both(reference: DataFrame, generated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Leaves of both sides by path: types (whole numbers apart from others) and values."""
    on = [*by, "path"]
    kind = F.when(F.col("json_type") == "number", F.when(F.col("value").rlike(r"^-?\d+$"), "integer").otherwise("float")).otherwise(F.col("json_type"))
    a, b = (rows.select(*on, kind.alias(f"t{s}"), F.col("value").alias(f"v{s}")) for rows, s in ((reference, "a"), (generated, "b")))
    return a.join(b, on, "full_outer").withColumn("parent", F.when(F.col("path").contains("."), F.regexp_replace("path", r"\.[^.]*$", "")).otherwise(""))


def semantic_findings(reference: DataFrame, generated: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, path, code (semantic.type, .missing, .added, .length, .value) of leaves (by, path, json_type, value); layout is left out.

    Below a path whose type changed, or that one side does not have, nothing is reported; of arrays only their common places and their length are.
    """
    by = list(by)
    both = _both(strip_layout(reference), strip_layout(generated), by)
    parents = both.select(*by, F.col("path").alias("parent"), F.col("ta").alias("pa"), F.col("tb").alias("pb"))
    sizes = both.groupBy(*by, "parent").agg(F.count("ta").alias("na"), F.count("tb").alias("nb")).withColumnRenamed("parent", "path")
    rows = both.join(parents, [*by, "parent"], "left").join(sizes, [*by, "path"], "left")
    one_sided = F.col("ta").isNull() | F.col("tb").isNull()
    in_object = (F.col("parent") == "") | ((F.col("pa") == "object") & (F.col("pb") == "object"))
    code = (
        F.when(one_sided, F.when(in_object, F.when(F.col("tb").isNull(), "semantic.missing").otherwise("semantic.added")))
        .when(F.col("ta") != F.col("tb"), "semantic.type")
        .when((F.col("ta") == "array") & (F.coalesce("na", F.lit(0)) != F.coalesce("nb", F.lit(0))), "semantic.length")
        .when(~F.col("va").eqNullSafe(F.col("vb")), "semantic.value")
    )
    found = rows.select(*by, "path", code.alias("code")).where("code IS NOT NULL")
    tops = rows.where(one_sided | (F.col("ta") != F.col("tb"))).select(*by, F.col("path").alias("up")).distinct()
    parts = F.split("path", r"\.")
    above = found.where(F.col("path").contains(".")).withColumn("up", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "."))))
    hidden = above.join(tops, [*by, "up"], "left_semi").select(*by, "path").distinct()
    return found.join(hidden, [*by, "path"], "left_anti")


def layout_findings(reference: DataFrame, generated: DataFrame, by: Sequence[str]) -> DataFrame:
    """by and path of each designer object that changed, in documents' parts that both sides have."""
    by = list(by)
    top = F.regexp_extract("path", r"^((?:.*?\.)?designer)(?:\.|$)", 1)
    both = _both(*(rows.where(in_layout(F.col("path"))) for rows in (reference, generated)), by)
    changed = both.where("NOT (ta <=> tb AND va <=> vb)").select(*by, top.alias("path")).distinct()
    owner = F.when(F.col("path").contains("."), F.regexp_replace("path", r"\.designer$", ""))
    shared = reference.where("json_type = 'object'").select(*by, F.col("path").alias("owner")).join(generated.where("json_type = 'object'").select(*by, F.col("path").alias("owner")), [*by, "owner"])
    return changed.withColumn("owner", owner).join(shared, [*by, "owner"], "left_semi").select(*by, "path")


def removed_nodes(reference: DataFrame, generated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Ids of nodes (by, node_id) that the generated document no longer has."""
    return reference.select(*by, "node_id").where("node_id IS NOT NULL").distinct().join(generated.select(*by, "node_id"), [*by, "node_id"], "left_anti")


def drift(before: DataFrame, after: DataFrame, by: Sequence[str]) -> DataFrame:
    """Changes between two versions' leaves (by, path, change), and whether they are accepted: a changed coordinate of a designer is, nothing else."""
    changes = leaf_delta(before, after, by)
    coordinate = F.col("path").rlike(r"(^|\.)metadata\.designer\.[xy]$")
    return changes.select(*by, "path", "change", (coordinate & F.col("change").isin("value", "type")).alias("accepted"))


def completion(findings: DataFrame, by: Sequence[str], documents: DataFrame) -> DataFrame:
    """Per document: whether it may be called done; it may without semantic findings."""
    blocked = findings.select(*by).distinct().withColumn("_found", F.lit(True))
    return documents.select(*by).distinct().join(blocked, list(by), "left").select(*by, F.col("_found").isNull().alias("completion_allowed"))
