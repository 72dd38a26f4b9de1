"""Evidence in a node's data: values under keys of a certain name, rolled up to the nodes that hold them.

Keys are compared by letters and digits alone, case aside. A value is evidence if it says something: true, a number other than zero, text that is no word for no.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import blueprints

# Texts that are no evidence.
NO_WORDS = ("", "0", "false", "no", "none", "off")


@lru_cache(maxsize=16_384)
def plain(text: str) -> str:
    """Letters and digits alone, case aside. Keys repeat from document to document."""
    return "".join(c for c in text.casefold() if c.isalnum())


def plain_text(text: Column) -> Column:
    """plain() of a column."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def plain_keys(local: Column) -> Column:
    """The keys of a path, plain."""
    return F.transform(blueprints.path_keys(local), lambda p: plain_text(p))


def under(keys: Column, names: Iterable[str]) -> Column:
    """Whether one of a path's plain keys is among the names."""
    return F.arrays_overlap(keys, F.array(*[F.lit(n) for n in sorted(names)]))


def says_something(json_type: Column, value: Column) -> Column:
    number = value.try_cast("double")
    return (
        F.when(json_type == "boolean", value == "true")
        .when(json_type == "number", number != 0)
        .when(json_type == "string", ~plain_text(value).isin(*NO_WORDS))
        .otherwise(F.lit(False))
    )


def positive_int(json_type: Column, value: Column) -> Column:
    """The whole number above zero that a value is, or says; else null."""
    whole = F.when(json_type.isin("number", "string") & F.trim(value).rlike(r"^\d+$"), F.trim(value).try_cast("long"))
    return F.when(whole > 0, whole)


def rolled_up(places: DataFrame, facts: DataFrame, names: Iterable[str]) -> DataFrame:
    """Per node, the greatest value of each of the facts' columns (bp_id, enter, and the names) over the node and all nodes inside it, by their intervals.

    places: bp_id, enter, leave. A node without facts inside it has nulls.
    """
    names = list(names)
    held = facts.groupBy("bp_id", F.col("enter").alias("_at")).agg(*[F.max(n).alias(n) for n in names])
    inside = places.select("bp_id", "enter", "leave").join(held, "bp_id", "left").where("_at IS NULL OR (enter <= _at AND _at <= leave)")
    return places.select("bp_id", "enter").join(inside.groupBy("bp_id", "enter").agg(*[F.max(n).alias(n) for n in names]), ["bp_id", "enter"], "left")
