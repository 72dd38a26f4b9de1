"""Rules as rows: what nodes must hold, judged by a table of rules, so that a new rule is a new row.

A rule names whom it is for (``who``: any, kind:router, app:http, module:http:Send), a field (a path inside the node, * for places of lists), a test and its value,
and maybe a guard (another field, test and value, which must hold for the rule to apply). The documents are parsed once, and of their leaves only those under keys that
some rule names are read; nodes meet their rules by an equal join on who they are, and rules meet leaves by (document, node, field). Tests of another node ask for the
nodes' interval numbers.

Tests of a field: required, forbidden, equals, one_of (values parted by |), matches and not_matches (a regular expression somewhere in the text), at_least, at_most (numbers),
type (JSON types parted by |). Tests of other nodes, named as in ``who`` by the value: needs_node (in the document), needs_before (on every way to the node), needs_after (later on), alone (no other of that name).

Defined results: required fails where no value under the field says something (text, true, a number; arrays and objects with members); all other tests of a field pass where it is not there, and fail once for each
place where they fail; a null field of a rule is the node itself, which only tests of nodes can have; a text that is no number fails at_least and at_most; rules that repeat count once.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import blueprints
from .shared import shuffled, written

RULES = "code string, who string, field string, test string, value string, severity string, guard_field string, guard_test string, guard_value string"
FIELD_TESTS = ("required", "forbidden", "equals", "one_of", "matches", "not_matches", "at_least", "at_most", "type")
NODE_TESTS = ("needs_node", "needs_before", "needs_after", "alone")
#: Rules that may be sent to every executor, and whose keys are known before the documents are read.
MOST_SENT = 20_000


def names_of(places: DataFrame) -> Column:
    """The names by which rules can be for a node."""
    token = F.coalesce("module_token", F.lit(""))
    return F.array_distinct(F.array(F.lit("any"), F.concat(F.lit("kind:"), "kind"), F.concat(F.lit("app:"), F.substring_index(token, ":", 1)), F.concat(F.lit("module:"), token)))


def tables(docs: DataFrame, fields: Iterable[str] | None) -> tuple[DataFrame, DataFrame]:
    """(nodes with intervals, leaves of nodes with field, their path with * for places) of documents; with fields, only leaves at and below them are read."""
    wanted = None if fields is None else {tuple(f.split(".")) for f in fields}
    ways = None if wanted is None else {w[0] for w in wanted}

    def keep(inside: list[str], kind: str, text: str | None) -> bool:
        if wanted is None:
            return True
        if inside[0] not in ways:
            return False
        shape = tuple("*" if p.isdigit() else p for p in inside)
        return shape in wanted

    rows = written(blueprints.flat(docs, {"places": (blueprints.PLACES, blueprints._place_rows), "leaves": blueprints.local_rows(keep)}), "rulebook")
    leaves = blueprints.part(rows, "leaves", blueprints.LOCAL).where("node_path IS NOT NULL")
    return blueprints.part(rows, "places", blueprints.PLACES), leaves.withColumn("field", F.regexp_replace("local", r"(?<=^|\.)\d+(?=\.|$)", "*"))


def told(kind: Column, value: Column) -> Column:
    """Whether a value says something."""
    return F.when(kind == "string", F.trim(F.regexp_replace(value, r"\s+", " ")) != "").when(kind == "boolean", value == "true").when(kind == "null", F.lit(False)).when(kind == "number", F.lit(True)).otherwise(value != "0")


def passes(test: Column, wanted: Column, kind: Column, value: Column) -> Column:
    """Whether a value that is there passes a test of a field."""
    number, bound = F.trim(value).try_cast("double"), F.trim(wanted).try_cast("double")
    counts = kind.isin("number", "string")
    return (
        F.when(test == "required", told(kind, value))
        .when(test == "forbidden", ~told(kind, value))
        .when(test == "equals", F.coalesce(value, F.lit("")) == wanted)
        .when(test == "one_of", F.array_contains(F.split(wanted, r"\|"), F.coalesce(value, F.lit(""))))
        .when(test == "matches", F.coalesce((kind == "string") & F.regexp_like(value, wanted), F.lit(False)))
        .when(test == "not_matches", ~F.coalesce((kind == "string") & F.regexp_like(value, wanted), F.lit(False)))
        .when(test == "at_least", F.coalesce(counts & (number >= bound), F.lit(False)))
        .when(test == "at_most", F.coalesce(counts & (number <= bound), F.lit(False)))
        .when(test == "type", F.array_contains(F.split(wanted, r"\|"), kind))
    )


def _rule_ids(rules: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in RULES.split(", ")]
    return rules.select(*names).distinct().withColumn("rule", F.sha2(F.to_json(F.struct(*[F.coalesce(n, F.lit("\0")).alias(n) for n in names])), 256))


def judge(docs: DataFrame, rules: DataFrame) -> DataFrame:
    """bp_id, node_path, path, code, severity of what documents (bp_id, raw) do against the rules (see RULES)."""
    rules = written(_rule_ids(rules), "rules")
    few = rules.count() <= MOST_SENT
    fields = None
    if few:
        named = rules.select(F.explode(F.array("field", "guard_field")).alias("f")).where("f IS NOT NULL").distinct().collect()  # of MOST_SENT rules at most
        fields = [r.f for r in named]
    places, leaves = tables(docs, fields)
    sent = F.broadcast if few else lambda df: df
    nodes = places.withColumn("names", names_of(places)).select("bp_id", "node_path", "enter", "reach", "on_path", "names", F.explode("names").alias("who"))
    met = nodes.join(sent(rules), "who")
    at = ["bp_id", "node_path"]
    values = leaves.select(*at, "field", "path", "json_type", F.col("value").alias("is"))
    guards = met.where("guard_field IS NOT NULL")
    shown = values.withColumnsRenamed({"field": "guard_field"})
    kept = guards.select(*at, "rule", "guard_field", "guard_test", "guard_value").join(shuffled(shown), [*at, "guard_field"]).where(passes(F.col("guard_test"), F.col("guard_value"), F.col("json_type"), F.col("is"))).select(*at, "rule").distinct()
    applied = met.where("guard_field IS NULL").unionByName(guards.join(shuffled(kept), [*at, "rule"], "left_semi"))
    asked = applied.where(F.col("test").isin(*FIELD_TESTS))
    tested = asked.join(shuffled(values), [*at, "field"], "left").withColumn("fine", F.coalesce(passes(F.col("test"), F.col("value"), F.col("json_type"), F.col("is")), F.lit(False)))
    found = tested.where("path IS NOT NULL AND NOT fine AND test <> 'required'").select(*at, "path", "code", "severity")
    lacking = tested.where("test = 'required'").groupBy(*at, "rule", "field", "code", "severity").agg(F.max("fine").alias("fine")).where("NOT fine")
    found = found.unionByName(lacking.select(*at, F.concat("node_path", F.lit("."), "field").alias("path"), "code", "severity"))
    # Tests of other nodes: the least and the last number of each name answer all but the question of what has run before.
    other = places.select("bp_id", "enter", "reach", "on_path", F.explode(names_of(places)).alias("value"))
    ends = other.groupBy("bp_id", "value").agg(F.max("enter").alias("last"), F.count("*").alias("n"))
    far = applied.where(F.col("test").isin("needs_node", "needs_after", "alone")).join(shuffled(ends), ["bp_id", "value"], "left")
    bad = F.when(F.col("test") == "needs_node", F.col("n").isNull()).when(F.col("test") == "needs_after", F.coalesce(F.col("last") <= F.col("enter"), F.lit(True))).otherwise(F.col("n") > F.array_contains("names", F.col("value")).cast("int"))
    found = found.unionByName(far.where(F.coalesce(bad, F.lit(False))).select(*at, F.col("node_path").alias("path"), "code", "severity"))
    before = applied.where("test = 'needs_before'").withColumnRenamed("enter", "own").withColumnRenamed("on_path", "runs").drop("reach")
    ready = before.join(shuffled(other.where("on_path")), ["bp_id", "value"]).where("runs AND enter < own AND own <= reach").select(*at, "rule").distinct()
    late = before.join(shuffled(ready), [*at, "rule"], "left_anti").select(*at, F.col("node_path").alias("path"), "code", "severity")
    return found.unionByName(late)
