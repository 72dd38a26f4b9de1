"""Catalog and document search: tokens, query terms, scores, ranks, truncation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Words that carry no meaning in a query.
STOP_WORDS = ("a", "an", "and", "for", "in", "make", "module", "of", "or", "the", "to", "with")
# Points of a term's first match, and of a low-signal term's.
TERM_POINTS = (("exact", 30, 8), ("token", 20, 5), ("field", 12, 3), ("contains", 6, 1))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def query_terms(query: Column, most: int = 8) -> Column:
    """The first distinct terms of two or more characters that are not stop words; the whole query if there are none."""
    words = F.regexp_extract_all(F.lower(query), F.lit("[a-z0-9_:.+-]+"), F.lit(0))
    kept = F.slice(F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS))), 1, most)
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(F.lower(F.trim(query))))


def matches_any(text: Column, terms: Sequence[str]) -> Column:
    low, out = F.lower(text), F.lit(False)
    for t in terms:
        out = out | F.contains(low, F.lit(t.lower()))
    return F.coalesce(out, F.lit(False))


def term_score(term: str, name: Column, name_tokens: Column, field_tokens: Column, low_signal: bool = False) -> Column:
    """Points of the first kind of match that holds: the whole name, one of its tokens, a field's token, a part of the name."""
    points = {kind: (low if low_signal else high) for kind, high, low in TERM_POINTS}
    return (
        F.when(F.lower(name) == term, points["exact"])
        .when(F.array_contains(name_tokens, term), points["token"])
        .when(F.array_contains(field_tokens, term), points["field"])
        .when(F.contains(F.lower(name), F.lit(term)), points["contains"])
        .otherwise(0)
    )


def score(rows: DataFrame, terms: Sequence[str], name: str, fields: Sequence[str], low_signal: Sequence[str] = ()) -> DataFrame:
    """rows with a positive score over all terms."""
    prepared = rows.withColumn("_names", tokens(F.col(name))).withColumn("_fields", F.flatten(F.array(*[tokens(F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields])))
    total = sum((term_score(t, F.col(name), F.col("_names"), F.col("_fields"), t in low_signal) for t in terms), F.lit(0))
    return prepared.withColumn("score", total).where("score > 0").drop("_names", "_fields")


def rank(rows: DataFrame, order: Sequence[Column], limit: int, diversity: str | None = None, most_each: int = 3) -> DataFrame:
    """The first rows by order, with place; with a diversity column, at most so many of each of its values."""
    if diversity:
        own = Window.partitionBy(diversity).orderBy(*order)
        rows = rows.withColumn("_own", F.row_number().over(own)).where(F.col("_own") <= most_each).drop("_own")
    # Spark keeps only the first rows of each task before it numbers them.
    best = rows.orderBy(*order).limit(limit)
    return best.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def top_term_hits(rows: DataFrame, text: Column, terms: Sequence[str]) -> DataFrame:
    """Rows that hold the largest number of terms that any row holds (at least one)."""
    hits = sum((F.contains(F.lower(text), F.lit(t)).cast("int") for t in terms), F.lit(0))
    counted = rows.withColumn("hits", hits).where("hits > 0")
    most = counted.agg(F.max("hits").alias("_most"))
    return counted.join(F.broadcast(most), F.col("hits") == F.col("_most")).drop("_most")


def truncation(found: Column, limit: int) -> Column:
    return F.when(found > limit, F.concat(F.lit("limit "), F.lit(str(limit)))).otherwise(F.lit("none"))


# Points of a graph candidate's matches, bonuses, penalties and caps.
GRAPH_POINTS = {"endpoint_terms": 12, "edge_terms": 5, "workflow_terms": 4, "field_tokens": 2}
GRAPH_BONUS = {"app": 125, "bridge": 95, "control": 90, "utility": 80}
GRAPH_PENALTY = {"wrong_app": 120, "no_app": 85, "utility": 75, "endpoint_only": 55, "kind_only": 30, "field_only": 70}
NO_APP_CAP, NO_APP_CONTROL_CAP, FIELD_ONLY_CAP = 70, 145, 20


def graph_score(
    endpoint_terms: Column, edge_terms: Column, workflow_terms: Column, field_tokens: Column, controls: Column, utilities: Column,
    intended_apps: Column, matched_apps: Column, bound_apps: Column, asks_control: Column, is_utility: Column, endpoint_only: Column, kind_only: Column,
) -> Column:
    """The rank score of a graph candidate from its signals: numbers of matches, of apps that the query names, that match and that the candidate is bound to, and flags.

    A query that names apps which the candidate does not match holds it to a cap and lowers it; field tokens alone keep it under a low one.
    """
    field_only = (field_tokens > 0) & (matched_apps == 0) & (controls == 0) & (workflow_terms == 0) & (endpoint_terms == 0) & (edge_terms == 0)
    utility_only = (utilities > 0) & (intended_apps == 0) & ~asks_control
    points = sum((m * GRAPH_POINTS[n] for n, m in (("endpoint_terms", endpoint_terms), ("edge_terms", edge_terms), ("workflow_terms", workflow_terms), ("field_tokens", field_tokens))), F.lit(0))
    points = points + matched_apps * GRAPH_BONUS["app"] + F.when(matched_apps >= 2, GRAPH_BONUS["bridge"]).otherwise(0) + controls * GRAPH_BONUS["control"] + F.when(utility_only, utilities * GRAPH_BONUS["utility"]).otherwise(0)
    missed = (intended_apps > 0) & (matched_apps == 0)
    cap = F.when(controls > 0, NO_APP_CONTROL_CAP).otherwise(NO_APP_CAP)
    lowered = F.least(points, cap) - F.when(bound_apps > 0, GRAPH_PENALTY["wrong_app"]).otherwise(GRAPH_PENALTY["no_app"])
    points = F.when(missed, lowered).otherwise(points)
    named = intended_apps > 0
    points = points - F.when(named & is_utility, GRAPH_PENALTY["utility"]).otherwise(0) - F.when(named & endpoint_only, GRAPH_PENALTY["endpoint_only"]).otherwise(0) - F.when(kind_only, GRAPH_PENALTY["kind_only"]).otherwise(0)
    return F.when(field_only & ~utility_only, F.least(points - GRAPH_PENALTY["field_only"], F.lit(FIELD_ONLY_CAP))).otherwise(points)


def version_key(version: Column) -> Column:
    """Sort key: the current label first, then numbers from the newest down, then the rest."""
    parts = F.transform(F.split(version, r"\."), lambda p: -F.expr("0L") - p.try_cast("long"))
    return F.when(version.isin("current", "latest"), F.array(F.lit(-1).cast("long"))).when(version.rlike(r"^\d+(\.\d+)*$"), F.concat(F.array(F.lit(0).cast("long")), parts)).otherwise(F.array(F.lit(1).cast("long")))
