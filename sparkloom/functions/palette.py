"""The expression palette: name -> function of Columns. Positions count from 0, as workflow expressions do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + F.coalesce(x.cast("double"), F.lit(0.0)))


def _median(a: Column) -> Column:
    s = F.array_sort(a)
    n = F.size(s)
    low, high = F.element_at(s, F.floor((n + 1) / 2).cast("int")), F.element_at(s, F.floor((n + 2) / 2).cast("int"))
    return F.when(n > 0, (low + high) / 2)


def _spread(a: Column, sample: bool) -> Column:
    n, mean = F.size(a), _total(a) / F.size(a)
    squares = F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean))
    return F.when(n > (1 if sample else 0), F.sqrt(squares / (n - 1 if sample else n)))


# Format letters of workflow dates and the engine's.
DATE_TOKENS = (("YYYY", "yyyy"), ("YY", "yy"), ("DD", "dd"), ("ddd", "EEE"), ("A", "a"))


def date_pattern(pattern: str) -> str:
    for a, b in DATE_TOKENS:
        pattern = pattern.replace(a, b)
    return pattern


def _add(unit: str) -> Callable[[Column, Column], Column]:
    return lambda t, n: F.timestamp_add(unit, n.cast("int"), t)


def _set(part: str) -> Callable[[Column, Column], Column]:
    def run(t: Column, n: Column) -> Column:
        parts = {p: f(t) for p, f in (("year", F.year), ("month", F.month), ("day", F.day), ("hour", F.hour), ("minute", F.minute), ("second", F.second))}
        parts[part] = n.cast("int")
        return F.make_timestamp_ntz(*[parts[p] for p in ("year", "month", "day", "hour", "minute", "second")])

    return run


PALETTE: dict[str, Callable[..., Column]] = {
    # general and control
    "if": lambda c, a, b: F.when(c, a).otherwise(b),
    "ifempty": lambda a, b: F.coalesce(F.nullif(a, F.lit("")), b),
    "empty": lambda a: a.isNull() | (a == ""),
    "switch": lambda a, *rest: F.coalesce(*[F.when(a == k, v) for k, v in zip(rest[::2], rest[1::2])], *([rest[-1]] if len(rest) % 2 else [])),
    "get": lambda a, k: F.try_element_at(a, k + 1),
    "getJson": lambda a, path: F.get_json_object(a, path),
    "pick": lambda m, *keys: F.map_filter(m, lambda k, _: k.isin(*keys)),
    "omit": lambda m, *keys: F.map_filter(m, lambda k, _: ~k.isin(*keys)),
    "contains": lambda a, b: F.contains(a, b),
    # numbers
    "average": lambda a: F.when(F.size(a) > 0, _total(a) / F.size(a)),
    "sum": _total,
    "median": _median,
    "stdevS": lambda a: _spread(a, True),
    "stdevP": lambda a: _spread(a, False),
    "max": F.array_max,
    "min": F.array_min,
    "ceil": F.ceil,
    "floor": F.floor,
    "trunc": lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)),
    "abs": F.abs,
    "round": lambda x, n=0: F.round(x, n),
    "mod": lambda a, b: a % b,
    "parseNumber": lambda a, decimal=".": F.regexp_replace(F.replace(a, F.lit("," if decimal == "." else "."), F.lit("")), decimal.replace(".", r"\."), ".").try_cast("double"),
    "toNumber": lambda a: a.try_cast("double"),
    "formatNumber": lambda x, n: F.format_number(x, n),
    # text
    "length": F.length,
    "lower": F.lower,
    "upper": F.upper,
    "trim": F.trim,
    "capitalize": lambda a: F.concat(F.upper(F.substring(a, 1, 1)), F.expr("''"), F.substr(a, F.lit(2))),
    "startcase": F.initcap,
    "ascii": lambda a: F.regexp_replace(a, r"[^\x00-\x7F]", ""),
    "replace": lambda a, b, c: F.replace(a, b, c),
    "replaceEmojiCharacters": lambda a, b: F.regexp_replace(a, F.lit(r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]"), b),
    "substring": lambda a, start, end: F.substr(a, start + 1, end - start),
    "indexOf": lambda a, b: F.instr(a, b) - 1,
    "toString": lambda a: a.cast("string"),
    "toBinary": lambda a: a.cast("binary"),
    "encodeURL": F.url_encode,
    "decodeURL": F.url_decode,
    "escapeHTML": lambda a: F.replace(F.replace(F.replace(F.replace(a, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")),
    "escapeJSON": lambda a: F.regexp_replace(F.to_json(F.struct(a.alias("v"))), r'^\{"v":"(.*)"\}$', "$1"),
    "escapeMarkdown": lambda a: F.regexp_replace(a, r"([\\`*_{}\[\]()#+.!|-])", r"\\$1"),
    "stripHTML": lambda a: F.regexp_replace(a, "<[^>]*>", ""),
    "split": lambda a, d: F.split(a, F.concat(F.lit(r"\Q"), d, F.lit(r"\E"))),
    "match": lambda a, p: F.regexp_extract(a, p, 0),
    "regex": lambda a, p, group=0: F.regexp_extract(a, p, group),
    "md5": F.md5,
    "sha1": F.sha1,
    "sha256": lambda a: F.sha2(a, 256),
    "sha512": lambda a: F.sha2(a, 512),
    "base64": lambda a: F.base64(a.cast("binary")),
    "parseJSON": F.try_parse_json,
    # dates
    "formatDate": lambda t, p: F.date_format(t, date_pattern(p)),
    "parseDate": lambda a, p: F.try_to_timestamp(a, F.lit(date_pattern(p))),
    "addSeconds": _add("SECOND"),
    "addMinutes": _add("MINUTE"),
    "addHours": _add("HOUR"),
    "addDays": _add("DAY"),
    "addMonths": _add("MONTH"),
    "addYears": _add("YEAR"),
    "setSecond": _set("second"),
    "setMinute": _set("minute"),
    "setHour": _set("hour"),
    "setDate": _set("day"),
    "setMonth": _set("month"),
    "setYear": _set("year"),
    "setDay": lambda t, n: F.timestamp_add("DAY", (n - F.dayofweek(t)).cast("int"), t),
    # arrays
    "join": F.array_join,
    "size": F.size,
    "keys": F.map_keys,
    "slice": lambda a, start, end: F.slice(a, start + 1, end - start),
    "merge": F.concat,
    "add": lambda a, x: F.array_append(a, x),
    "remove": F.array_remove,
    "arrayContains": F.array_contains,
    "arrayIntersect": F.array_intersect,
    "arrayDiff": F.array_except,
    "map": lambda a, f: F.transform(a, f),
    "shuffle": F.shuffle,
    "sort": F.array_sort,
    "reverse": F.reverse,
    "first": lambda a: F.try_element_at(a, F.lit(1)),
    "last": lambda a: F.try_element_at(a, F.lit(-1)),
    "flatten": F.flatten,
    "distinct": F.array_distinct,
    "deduplicate": F.array_distinct,
    "toCollection": F.map_from_entries,
    "toArray": F.map_entries,
}

#: Number of arguments that a checked function takes: (least, most; None for any number).
ARITY: dict[str, tuple[int, int | None]] = {
    "trim": (1, 1), "get": (2, 2), "map": (2, None), "match": (2, 2), "regex": (2, 3), "replace": (3, 3), "split": (2, 2), "join": (2, 2), "lower": (1, 1), "upper": (1, 1),
    "length": (1, 1), "toNumber": (1, 1), "parseNumber": (1, 1), "round": (1, 2), "ceil": (1, 1), "floor": (1, 1), "sum": (1, 1), "average": (1, 1), "formatDate": (2, 3),
    "parseDate": (2, 3), "addDays": (2, 2), "parseJSON": (1, 1), "if": (3, 3), "ifempty": (2, 2), "empty": (1, 1), "contains": (2, 2),
}


def call(name: str, *args) -> Column:
    """The palette's function of this name; raises on an unknown name or a wrong number of arguments."""
    if name not in PALETTE:
        raise ValueError(f"unknown function {name!r}")
    least, most = ARITY.get(name, (0, None))
    if len(args) < least or (most is not None and len(args) > most):
        raise ValueError(f"{name} takes {least} to {most or 'any number of'} arguments, not {len(args)}")
    return PALETTE[name](*args)


def call_problem(name: Column, count: Column) -> Column:
    """unknown_function, arity (a wrong number of arguments), or null."""
    least, most = (F.try_element_at(F.create_map(*[F.lit(x) for k, ends in ARITY.items() if ends[end] is not None for x in (k, ends[end])]), name) for end in (0, 1))
    return F.when(~name.isin(*PALETTE), "unknown_function").when((count < least) | (count > most), "arity")


def arity_problems(calls, names: str = "name", count: str = "n_args"):
    """Rows of calls whose function is unknown (unknown_function) or has a wrong number of arguments (arity)."""
    return calls.withColumn("problem", call_problem(F.col(names), F.col(count))).where("problem IS NOT NULL")
