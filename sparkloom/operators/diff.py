"""Differences: entity drift, JSON deltas, classified changes, missing references."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def drift(old: DataFrame, new: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Added, removed and changed entities; a changed one names its changed fields."""
    a = old.select(key, *[F.col(f).alias(f"old_{f}") for f in fields], F.lit(True).alias("_old"))
    b = new.select(key, *[F.col(f).alias(f"new_{f}") for f in fields], F.lit(True).alias("_new"))
    both = a.join(b, key, "full_outer")
    names = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"old_{f}").eqNullSafe(F.col(f"new_{f}")), F.lit(f)) for f in fields])), ",")
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("changed")
    return both.select(key, kind.alias("change"), F.when(kind == "changed", names).otherwise(F.lit("")).alias("changed_fields")).where("change <> 'changed' OR changed_fields <> ''")


def leaf_delta(old: DataFrame, new: DataFrame, by: Sequence[str]) -> DataFrame:
    """Leaves (by, path, json_type, value) that differ. Under a path that was added or removed whole, only that path is reported.

    Leaves hold containers too (json_type object or array), so that a missing container hides its descendants.
    """
    on = [*by, "path"]
    a = old.select(*on, F.col("json_type").alias("_ta"), F.col("value").alias("_va"))
    b = new.select(*on, F.col("json_type").alias("_tb"), F.col("value").alias("_vb"))
    kind = F.when(F.col("_ta").isNull(), "added").when(F.col("_tb").isNull(), "removed").when(F.col("_ta") != F.col("_tb"), "type").when(~F.col("_va").eqNullSafe(F.col("_vb")), "value")
    found = a.join(b, on, "full_outer").withColumn("change", kind).where("change IS NOT NULL")
    tops = found.where("change IN ('added', 'removed') OR change = 'type'").select(*by, F.col("path").alias("_top")).distinct()
    parents = found.withColumn("_up", F.explode_outer(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("path", r"\.")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", r"\."), 1, n), "."))))
    hidden = parents.where("_up <> path").join(tops.withColumnRenamed("_top", "_up"), [*by, "_up"]).select(*on).distinct()
    return found.join(hidden, on, "left_anti").select(*on, "change", F.col("_va").alias("old_value"), F.col("_vb").alias("new_value"))


# Parts of a changed path that tell its class, and keys and roots of layout.
ROUTE_PARTS = (".routes", ".branches", ".tools", ".filter", ".conditions")
CONNECTION_PARTS = (".connection", ".connections", ".source", ".target", ".from", ".to", ".next", ".flow[", ".routes[", ".branches[", ".tools[", ".onerror[")
SEMANTIC_PARTS = (".module", ".mapper", ".parameters", ".schedule", ".onerror", ".on_error")
LAYOUT_ROOTS = ("$.metadata.groups", "$.metadata.notes", "$.metadata.orphans")
LAYOUT_KEYS = ("designer", "groups", "notes", "orphans")


def classify(path: Column, before: Column, after: Column) -> Column:
    """The class of a changed path ($.a.b[0]), given the JSON text of the two values (null if there is none)."""
    low = F.lower(path)

    def holds(parts: Sequence[str]) -> Column:
        return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])

    def either(test: Callable[[Column], Column]) -> Column:
        return F.coalesce(test(before), F.lit(False)) | F.coalesce(test(after), F.lit(False))

    layout_value = either(lambda v: F.arrays_overlap(F.transform(F.json_object_keys(v), F.lower), F.array(*map(F.lit, LAYOUT_KEYS))))
    layout = F.contains(low, F.lit(".metadata.designer")) | reduce(lambda a, b: a | b, [F.startswith(low, F.lit(r)) for r in LAYOUT_ROOTS]) | layout_value
    version = F.endswith(low, F.lit(".version")) | F.contains(low, F.lit("module_version")) | F.contains(low, F.lit("app_version"))
    placeholder = either(lambda v: F.contains(v, F.lit("{{")) | F.contains(v, F.lit("}}")))
    return (
        F.when(layout, "designer-layout")
        .when(holds(ROUTE_PARTS), "route/filter")
        .when(version, "module-version")
        .when(placeholder, "placeholder")
        .when(holds(CONNECTION_PARTS), "connection")
        .when((low == "$.metadata") | F.startswith(low, F.lit("$.metadata.")), "metadata")
        .when(holds(SEMANTIC_PARTS), "semantic")
        .otherwise("unknown")
    )


def dangling(child: DataFrame, parent: DataFrame, reference: str, key: str) -> DataFrame:
    """Rows whose reference names no parent."""
    return child.join(parent.select(F.col(key).alias(reference)).distinct(), reference, "left_anti")


def revalidate(targets: DataFrame, known: DataFrame, key: str, required: str, present: str) -> DataFrame:
    """Issues of targets: an unknown key, or a required name that is not present, one row each."""
    joined = targets.join(known, key, "left")
    missing = F.when(F.col(present).isNull(), F.array(F.lit("<unknown>"))).otherwise(F.array_except(F.col(required), F.col(present)))
    return joined.select(key, F.explode(missing).alias("missing"))
