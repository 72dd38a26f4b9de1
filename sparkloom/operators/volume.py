"""Operations that a workflow document will use in a span of time: modes, safety profiles, warnings and gaps of evidence.

A document is parsed once into its nodes (with interval numbers), its wrappers of flows (routes, branches, tools), and the leaves that tell of schedules, retries and
pages. A disabled wrapper takes the interval of its nodes out of the count, with whatever those hold; everything else is counting, rolled up to the document.

Modes: scheduled (runs of the schedule in the span), run_once, module_only (one named node). Profiles: minimum_known, configured_profile (with the retries that error handlers declare),
worst_reasonable_local_safety (and one operation for each node that has no error handler). Precision is exact_static_model unless a warning is a gap of evidence.

Defined results: routers cost nothing; error handlers count; a schedule that cannot be read, or none, gives one run; nodes that are disabled themselves still count, as only wrappers are switched
off; documents that do not parse give no row.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import blueprints
from .shared import written

MODES = ("scheduled", "run_once", "module_only")
PROFILES = ("minimum_known", "configured_profile", "worst_reasonable_local_safety")
# A large test, and the warnings that are gaps of evidence (as all of unknown multipliers are).
LARGE = 1_000
GAPS = ("estimate.ai_tool_usage", "estimate.module_only_target_missing", "estimate.pagination_volume_unknown", "estimate.retry_count_unknown", "estimate.schedule_missing", "estimate.schedule_unknown")
# Minutes of units by the first letters that name them (plural s aside).
UNITS = {"m": 1.0, "min": 1.0, "minute": 1.0, "h": 60.0, "hr": 60.0, "hour": 60.0, "d": 1440.0, "day": 1440.0, "daily": 1440.0, "w": 10080.0, "week": 10080.0, "weekly": 10080.0, "s": 1 / 60, "sec": 1 / 60, "second": 1 / 60}
TEXT_INTERVAL = r"(?i)(?<![\w.])(\d+(?:\.\d+)?)\s*(mins?|minutes?|m|hrs?|hours?|h|days?|d|weeks?|w|secs?|seconds?|s)\b"
_DIRECTIVE = frozenset(("strategy", "directive", "name", "module", "count", "retry"))
WRAPPERS = "bp_id string, owner_path string, container string, route int, off boolean"


def _wrapper_rows(bp_id: str, root: dict) -> Iterator[tuple]:
    for node, path, *_ in blueprints.walk(root):
        for name, k, _, wrapper in blueprints._children(node):
            if wrapper:
                yield bp_id, path, name, k, blueprints._flag(wrapper.get("disabled")) or blueprints._unset(wrapper.get("enabled"))


def _keep(inside: list[str], kind: str, text: str | None) -> bool:
    first = inside[0]
    if first == "metadata" and len(inside) > 1 and inside[1] in ("schedule", "trigger"):
        return len(inside) <= 3
    if first in ("onerror", "on_error") or first in _DIRECTIVE:  # handlers in lists are nodes themselves
        return len(inside) <= 6
    return kind == "string" and "page" in text.lower() and first not in ("routes", "branches", "tools")


def _documents(bp_id: str, root: dict) -> Iterator[tuple]:
    yield (bp_id,)


def tables(docs: DataFrame) -> dict[str, DataFrame]:
    own = {"documents": ("bp_id string", _documents), "places": (blueprints.PLACES, blueprints._place_rows), "wrappers": (WRAPPERS, _wrapper_rows), "leaves": blueprints.local_rows(_keep)}
    rows = written(blueprints.flat(docs, own), "volume")
    return {name: blueprints.part(rows, name, schema) for name, (schema, _) in own.items()}


def _positive(kind: Column, value: Column) -> Column:
    x = F.trim(value).try_cast("double")
    return F.when(kind.isin("number", "string") & (x > 0) & (x < float("inf")), x)


def unit_minutes(unit: Column) -> Column:
    """Minutes of a unit; 0 if it is none."""
    name = F.regexp_replace(F.lower(F.trim(unit)), "s+$", "")
    out = F.lit(0.0)
    for text, minutes in UNITS.items():
        out = F.when(name == text, minutes).otherwise(out)
    return F.when(F.lower(F.trim(unit)) == "s", 1 / 60).otherwise(out)


def schedules(leaves: DataFrame) -> DataFrame:
    """bp_id, minutes of each document that declares a schedule (or, without one, a trigger); null minutes where it cannot be read."""
    rows = leaves.where(F.col("node_path").isNull() & F.col("local").rlike(r"^metadata\.(schedule|trigger)(\.|$)")).withColumn("block", F.regexp_extract("local", r"^metadata\.(\w+)", 1))
    blocks = rows.where("local IN ('metadata.schedule', 'metadata.trigger') AND json_type = 'object'").groupBy("bp_id").agg(F.min("block").alias("block"))  # schedule comes first
    held = rows.where("local NOT IN ('metadata.schedule', 'metadata.trigger')").join(blocks, ["bp_id", "block"])
    kind, value, key = F.col("json_type"), F.col("value"), F.col("key")

    def number(name: str) -> Column:
        return F.max(F.when(key == name, _positive(kind, value)))

    def text(name: str) -> Column:
        return F.max(F.when((key == name) & ~kind.isin("null", "object", "array") & (F.trim(value) != ""), F.trim(value)))

    amount = _positive(F.lit("string"), F.regexp_extract("value", TEXT_INTERVAL, 1))
    said = F.when((kind == "string") & amount.isNotNull(), F.struct("seq", (amount * unit_minutes(F.regexp_extract("value", TEXT_INTERVAL, 2))).alias("minutes")))
    parts = held.groupBy("bp_id").agg(number("every_minutes").alias("plain"), number("every").alias("every"), text("unit").alias("unit"), number("interval").alias("seconds"), text("interval").alias("interval"), F.min(said)["minutes"].alias("said"))
    named = unit_minutes(F.col("interval"))
    minutes = F.coalesce("plain", F.when(F.col("unit").isNotNull(), F.col("every") * unit_minutes(F.col("unit"))), F.col("seconds") / 60, F.when(named > 0, named), F.col("said"))
    return blocks.select("bp_id").join(parts.withColumn("minutes", F.when(minutes > 0, minutes)).select("bp_id", "minutes"), "bp_id", "left")


def counted(places: DataFrame, wrappers: DataFrame) -> DataFrame:
    """The nodes that a run may pass: those in no interval of a disabled wrapper."""
    off = wrappers.where("off").select("bp_id", F.col("owner_path").alias("parent_path"), "container", "route")
    gone = places.join(off, ["bp_id", "parent_path", "container", "route"], "left_semi").select("bp_id", F.col("enter").alias("first"), F.col("leave").alias("final"))
    node, hole = places.alias("n"), gone.alias("g")
    inside = (F.col("n.bp_id") == F.col("g.bp_id")) & (F.col("g.first") <= F.col("n.enter")) & (F.col("n.enter") <= F.col("g.final"))
    return node.join(hole, inside, "left_anti")


def directives(leaves: DataFrame) -> DataFrame:
    """bp_id, node_path, attempts, retry of each error directive: an item of a node's onerror or on_error that names a strategy."""
    at = r"^(.*)\.((?:onerror|on_error)(?:\.\d+)*)\.(strategy|directive|name|module|count|retry|retry\.count)$"
    rows = leaves.where(F.col("path").rlike(at) & F.col("node_path").isNotNull()).select("bp_id", "json_type", "value", *[F.regexp_extract("path", at, k).alias(n) for k, n in ((1, "node_path"), (2, "item"), (3, "below"))])
    kind, value, below = F.col("json_type"), F.col("value"), F.col("below")
    whole = F.when(kind.isin("number", "string") & F.trim(value).rlike(r"^\d+$"), F.trim(value).try_cast("long"))
    named = F.max(below.isin("strategy", "directive", "name", "module") & (kind == "string") & (F.trim(value) != ""))
    attempts = F.coalesce(F.max(F.when(below == "retry.count", whole)), F.max(F.when(below == "count", whole)))
    said = ((kind == "object") & (value != "0")) | ((kind == "boolean") & (value == "true")) | ((kind == "string") & F.lower(F.trim(value)).isin("true", "yes", "1"))
    held = rows.groupBy("bp_id", "node_path", "item").agg(named.alias("named"), attempts.alias("attempts"), F.coalesce(F.max((below == "retry") & said), F.lit(False)).alias("retry"))
    return held.where("named").drop("named", "item")


def estimate(docs: DataFrame, hours: int = 24, mode: str = "scheduled", profile: str = "minimum_known", module: str | None = None, read: dict[str, DataFrame] | None = None) -> DataFrame:
    """bp_id, runs, minimum_per_run, overhead_per_run, operations, precision, gaps, warnings (codes, each once, in order) of documents (bp_id, raw).

    read: what tables() gave for the documents, so that several estimates parse them once. module: the id of the node of module_only; documents without that node give an error of their own, as an empty estimate would mislead: their row has null counts and the warning estimate.module_unknown.
    """
    if isinstance(hours, bool) or not isinstance(hours, int) or hours <= 0:
        raise ValueError("hours must be a whole number above zero")
    if mode not in MODES or profile not in PROFILES:
        raise ValueError(f"mode is one of {MODES} and profile one of {PROFILES}")
    t = tables(docs) if read is None else read
    alone = mode == "module_only"
    every = t["places"] if alone else counted(t["places"], t["wrappers"])
    here = every.where(F.col("node_id") == module) if alone and module is not None else every
    kind = F.col("kind")
    handled = t["places"].where("container = 'onerror'").select("bp_id", F.col("parent_path").alias("node_path"), F.lit(True).alias("handled")).distinct()
    tooled = t["wrappers"].where("container = 'tools'").select("bp_id", F.col("owner_path").alias("node_path"), F.lit(True).alias("tooled")).distinct()
    paged = t["leaves"].where(F.col("node_path").isNotNull() & (F.col("json_type") == "string") & F.lower("value").contains("page") & ~F.col("local").rlike("^(routes|branches|tools|onerror|on_error)(\\.|$)")).select("bp_id", "node_path", F.lit(True).alias("paged")).distinct()
    on = ["bp_id", "node_path"]
    marked = here.join(handled, on, "left").join(tooled, on, "left").join(paged, on, "left")
    bare = (kind != "router") & (F.coalesce("module_token", F.lit("")) != "") & F.col("handled").isNull()
    sums = marked.groupBy("bp_id").agg(
        F.sum((kind != "router").cast("long")).alias("steps"), F.sum(bare.cast("long")).alias("bare"), F.count("*").alias("found"), F.max((kind == "ai_agent") | F.col("tooled").isNotNull()).alias("tools"),
        F.max(kind == "iterator").alias("iterates"), F.max(kind == "aggregator").alias("aggregates"), F.max(F.col("paged").isNotNull()).alias("pages"), F.max(F.col("handled").isNotNull()).alias("handles"),
    )
    own = directives(t["leaves"])
    if alone:
        own = own.join(t["places"].where(F.col("node_id") == module).select(*on), on, "left_semi") if module is not None else own.limit(0)
    retries = own.groupBy("bp_id").agg(F.sum(F.when(F.col("attempts") > 0, F.col("attempts")).when(F.col("retry"), 1).otherwise(0)).alias("retries"), F.max(~F.coalesce(F.col("attempts") > 0, F.lit(False)) & F.col("retry")).alias("uncounted"))
    off = t["wrappers"].where("off").select("bp_id", F.lit(True).alias("skips")).distinct()
    plan = schedules(t["leaves"]).withColumn("planned", F.lit(True))
    rows = t["documents"].join(sums, "bp_id", "left").join(retries, "bp_id", "left").join(off, "bp_id", "left").join(plan, "bp_id", "left")
    no, is_true = lambda c: F.coalesce(F.col(c), F.lit(0)), lambda c: F.coalesce(F.col(c), F.lit(False))
    lost = F.lit(alone and module is not None) & (no("found") == 0)
    runs = F.when(F.lit(mode != "scheduled") | F.col("minutes").isNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(F.lit(hours * 60.0) / F.col("minutes")))).cast("long")
    least = F.lit(1).cast("long") if alone else no("steps").cast("long")
    extra = F.lit(0) if profile == PROFILES[0] else no("retries") + (no("bare") if profile == PROFILES[2] and not (alone and module is None) else F.lit(0))
    rows = rows.withColumn("runs", F.when(~lost, runs)).withColumn("minimum_per_run", F.when(~lost, least)).withColumn("overhead_per_run", F.when(~lost, extra.cast("long")))
    rows = rows.withColumn("operations", F.col("runs") * (F.col("minimum_per_run") + F.col("overhead_per_run")))
    whole, safe = F.lit(not alone), F.lit(profile != PROFILES[0])
    codes = [
        ("module_unknown", lost), ("schedule_missing", F.lit(mode == "scheduled") & F.col("planned").isNull()), ("schedule_unknown", F.lit(mode == "scheduled") & F.col("planned").isNotNull() & F.col("minutes").isNull()),
        ("module_only_target_missing", F.lit(alone and module is None)), ("ai_tool_usage", whole & is_true("tools")), ("iterator_multiplier_unknown", whole & is_true("iterates")), ("aggregator_multiplier_unknown", whole & is_true("aggregates")),
        ("pagination_volume_unknown", whole & is_true("pages")), ("disabled_route_skipped", whole & is_true("skips")), ("error_routes_included", whole & is_true("handles")), ("configured_retry_overhead_included", safe & (no("retries") > 0)),
        ("retry_count_unknown", safe & is_true("uncounted")), ("safety_handler_overhead_included", F.lit(profile == PROFILES[2] and not (alone and module is None)) & (no("bare") > 0)), ("large_test_cost", F.col("operations") > LARGE),
    ]
    warnings = F.array_compact(F.array(*[F.when(condition, F.lit(f"estimate.{code}")) for code, condition in codes]))
    gaps = F.filter("warnings", lambda w: w.isin(*GAPS) | w.endswith("_multiplier_unknown"))
    rows = rows.withColumn("warnings", warnings).withColumn("gaps", gaps)
    precision = F.when(F.size("gaps") > 0, "conservative_with_evidence_gaps").otherwise("exact_static_model")
    return rows.select("bp_id", "runs", "minimum_per_run", "overhead_per_run", "operations", precision.alias("precision"), "gaps", "warnings")
