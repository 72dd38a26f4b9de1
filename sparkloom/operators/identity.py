"""Identities of modules and places: roles, separator-insensitive keys, aliases, keyed joins instead of prefix ranges, and path scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words of a module's token that tell its role, by precedence, and the ends of tokens that answer a webhook.
ROLE_WORDS = (("trigger", ("watch", "webhook", "trigger")), ("write", ("create", "update", "append", "upsert", "add", "send", "respond")), ("read", ("search", "list", "get", "watch")))
RESPONSE_ENDS = ("webhookrespond", "webhookresponse", "webhooksrespond", "webhooksresponse")
# Keys under which expressions may stand, and containers of nodes further down.
EXPRESSION_KEYS = ("mapper", "parameters", "filter", "conditions", "condition", "rules", "expression", "formula")
CHILD_CONTAINERS = ("routes", "branches", "tools")
ERROR_CONTAINERS = ("onerror", "on_error")


def semantic_key(text: Column) -> Column:
    """Letters and digits in lower case: a key that does not depend on separators."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def module_role(token: Column) -> Column:
    """trigger, write, read or action; an answer to a webhook writes, whatever it is named after."""
    low, key = F.lower(token), semantic_key(token)

    def any_of(tests: Sequence[Column]) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t
        return out

    role = F.when(any_of([F.endswith(key, F.lit(e)) for e in RESPONSE_ENDS]), "write")
    for name, words in ROLE_WORDS:
        role = role.when(any_of([F.contains(low, F.lit(w)) for w in words]), name)
    return role.otherwise("action")


#: Beginnings of older tokens that newer ones leave out.
LEGACY_PREFIXES = ("action", "search", "trigger")


def match_keys(token: Column, legacy: Sequence[str] = LEGACY_PREFIXES) -> Column:
    """The keys under which a token is found: its own, and the one without a legacy prefix."""
    key = semantic_key(token)
    short = key
    for prefix in reversed(legacy):
        short = F.when(F.startswith(key, F.lit(prefix)) & (F.length(key) > len(prefix)), F.substring(key, len(prefix) + 1, 1 << 20)).otherwise(short)
    return F.when(key == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.array(key, short)))


def matched(rows: DataFrame, modules: DataFrame, token: str, module_token: str, legacy: Sequence[str] = LEGACY_PREFIXES) -> DataFrame:
    """Pairs of rows and modules that share a match key: keys of both sides are exploded and joined, and pairs kept once."""
    a = rows.withColumn("_key", F.explode(match_keys(F.col(token), legacy)))
    b = modules.withColumn("_key", F.explode(match_keys(F.col(module_token), legacy)))
    return a.join(b, "_key").drop("_key").distinct()


def alias_text(text: Column) -> Column:
    """Words of letters and digits, in lower case, one space between them."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0)), " ")


def alias_rows(modules: DataFrame, app: str, module: str, names: Sequence[str], kind: str) -> DataFrame:
    """alias and module_id, each once: each name of a module, the name after its app, and the first name after app and kind."""
    raw = [F.col(module), *map(F.col, names), *[F.concat_ws(":", app, n) for n in names], F.concat_ws(":", app, kind, names[0])]
    each = modules.select(F.col(module).alias("module_id"), F.explode(F.array_distinct(F.array(*[alias_text(x.cast("string")) for x in raw]))).alias("alias")).where("alias <> ''")
    return each.select("alias", "module_id").distinct()


def alias_index(modules: DataFrame, app: str, module: str, names: Sequence[str], kind: str) -> DataFrame:
    """alias, modules (how many), first_module and last_module: no list of all modules of an alias is gathered; alias_rows() has them as rows."""
    return alias_rows(modules, app, module, names, kind).groupBy("alias").agg(F.count("*").alias("modules"), F.min("module_id").alias("first_module"), F.max("module_id").alias("last_module"))


def by_source(units: DataFrame, records: DataFrame, reference: str, app: str, version: str, prefix: str) -> DataFrame:
    """Units with the record that their reference (prefix app__version, or that and #part) names: an equal key, no range of prefixes."""
    key = F.concat(F.lit(prefix), F.col(app), F.lit("__"), F.col(version))
    return units.withColumn("_key", F.substring_index(F.col(reference), "#", 1)).join(records.withColumn("_key", key), "_key", "left").drop("_key")


def stale_children(children: DataFrame, fields: DataFrame, modules: DataFrame, targets: DataFrame, seen: DataFrame, key: str, field: str, module: str, target: Sequence[str]) -> DataFrame:
    """Keys of children (of fields of modules) whose module is among the targets and which were not seen there again."""
    held = children.select(key, field).join(fields.select(field, module), field).join(modules.select(module, *target), module)
    return held.join(targets.select(*target).distinct(), list(target), "left_semi").select(key).distinct().join(seen.select(key), key, "left_anti")


def expressions_allowed(path: Column) -> Column:
    """Whether a path inside a node (its parts after dots) belongs to mapped data: under a key for expressions, not in metadata, not in a node further down."""
    parts = F.filter(F.split(path, r"\."), lambda p: ~p.rlike(r"^\d+$"))
    inside = F.arrays_overlap(parts, F.array(*map(F.lit, EXPRESSION_KEYS)))
    flow_after = F.lit(False)
    for name in CHILD_CONTAINERS:
        at = F.array_position(parts, name)
        flow_after = flow_after | ((at > 0) & F.array_contains(F.slice(parts, at.cast("int") + 1, F.size(parts)), "flow"))
    below = F.arrays_overlap(parts, F.array(*map(F.lit, ERROR_CONTAINERS))) | flow_after
    return inside & ~F.array_contains(parts, "metadata") & ~below
