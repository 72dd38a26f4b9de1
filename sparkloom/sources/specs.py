"""Module specifications (JSON, one for an app's version) as flat catalog tables: modules, fields, constraints, and what is wrong with them.

Each specification is walked once; its modules are kept once each, the first of a name, and the others are reported. The tables are parts of
one table of rows, so that a catalog is compiled in one pass over the specifications.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS = "what string, app_slug string, app_version string, id string, parent_id string, kind string, name string, label string, path string, required boolean, value string, code string"
# Collections of modules in a specification and the kind of what they hold.
COLLECTIONS = (
    ("actions", "action"), ("searches", "search"), ("triggers", "trigger"), ("routers", "router"), ("convergers", "router"), ("transformers", "transformer"), ("feeders", "transformer"), ("aggregators", "aggregator"),
    ("directives", "action"), ("starters", "trigger"), ("returners", "action"), ("agents", "agent"), ("customModules", "custom"), ("modules", "unknown"),
)
# Collections of fields in a module and what they are for, collections of fields in a field, and keys of a field that constrain it.
DIRECTIONS = (("parameters", "parameter"), ("expect", "expect"), ("interface", "interface"))
NESTED = ("fields", "schema", "spec")
CONSTRAINTS = ("advanced", "default", "editable", "forceReload", "grouped", "help", "labels", "mappable", "max", "maxItems", "maxLength", "min", "minItems", "minLength", "multiple", "options", "placeholder", "scope", "semantic")
VALIDATED = ("max", "min", "pattern")
_CONSTRAINING = frozenset(CONSTRAINTS)
_encoded = json.JSONEncoder(sort_keys=True).encode  # made once: json.dumps makes an encoder a value


@lru_cache(maxsize=16_384)
def _part(text: str) -> str:
    """One part of an id: safe in a URL. Names of modules and fields repeat from version to version."""
    return quote(text.strip(), safe="-._~")


def _text(v) -> str | None:
    return v.strip() if isinstance(v, str) and v.strip() else None


class _Spec:
    """Rows of one specification."""

    def __init__(self, app: str, version: str):
        self.app, self.version, self.rows = app, version, []

    def add(self, what: str, id_: str | None, parent: str | None, kind: str | None = None, name: str | None = None, label: str | None = None, path: str | None = None, required: bool | None = None, value: str | None = None, code: str | None = None) -> None:
        self.rows.append((what, self.app, self.version, id_, parent, kind, name, label, path, required, value, code))

    def problem(self, code: str, module: str | None, path: str) -> None:
        self.add("problem", None, module, path=path, code=f"raw_spec.{code}")

    def modules(self, root: dict) -> None:
        seen: set[str] = set()
        own = f"module:{_part(self.app)}:{_part(self.version)}"
        for key, kind in COLLECTIONS:
            held = root.get(key)
            if held is None:
                continue
            if not isinstance(held, list):
                self.problem("module_collection_shape_invalid", None, key)
                continue
            for k, module in enumerate(held):
                name = _text(module.get("name")) if isinstance(module, dict) else None
                if name is None:
                    self.problem("module_name_missing", None, f"{key}.{k}")
                    continue
                id_ = f"{own}:{kind}:{_part(name)}"
                if id_ in seen:
                    self.problem("module_duplicate", id_, f"{key}.{k}")
                    continue
                seen.add(id_)
                self.add("module", id_, None, kind=kind, name=name, label=_text(module.get("label")) or name)
                for collection, direction in DIRECTIONS:
                    self.fields(module.get(collection), collection, id_, direction)
        if not seen:
            self.problem("module_collection_empty", None, "")

    def fields(self, held, at: str, module: str, direction: str, above: tuple[str, ...] = (), code: str = "field") -> None:
        if held is None:
            return
        if not isinstance(held, list):
            self.problem(f"{code}_collection_shape_invalid", module, at)
            return
        for k, field in enumerate(held):
            here = f"{at}.{k}"
            if not isinstance(field, dict):
                self.problem(f"{code}_item_shape_invalid", module, here)
                continue
            name = _text(field.get("name"))
            if name is None:
                self.problem("field_name_missing", module, here)
                continue
            path = (*above, name)
            id_ = f"field:{module}:{direction}:{'.'.join(map(_part, path))}"
            self.add("field", id_, module, kind=direction, name=name, label=_text(field.get("label")) or name, path=".".join(path), required=field.get("required") is True, value=_text(field.get("type")))
            rules = [] if _CONSTRAINING.isdisjoint(field) else [(c, field[c]) for c in CONSTRAINTS if c in field]
            if isinstance(checks := field.get("validate"), dict):
                rules += [(c, checks[c]) for c in VALIDATED if c in checks and c not in field]
            for key, value in rules:
                self.add("constraint", f"constraint:{id_}:{_part(key)}", id_, name=key, value=_encoded(value))
            for nested in NESTED:
                if nested in field:
                    self.fields(field[nested], f"{here}.{nested}", module, direction, path, "nested_field")


def compile_specs(specs: DataFrame) -> DataFrame:
    """Rows of all specifications (app_slug, app_version, raw: JSON with an object app); one that does not parse gives a problem (raw_spec.invalid_json)."""
    kinds = [pa.bool_() if c.split()[1] == "boolean" else pa.string() for c in ROWS.split(", ")]
    names = [c.split()[0] for c in ROWS.split(", ")]

    def rows(app: str | None, version: str | None, text: str | None) -> list[tuple]:
        spec = _Spec(app or "", version or "")
        try:
            root = json.loads(text or "")
        except (ValueError, RecursionError):
            root = None
        if isinstance(root, dict) and isinstance(root.get("app"), dict):
            spec.modules(root["app"])
        else:
            spec.problem("invalid_json" if root is None else "app_missing", None, "")
        return spec.rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(lo, 256) for lo in range(0, batch.num_rows, 256)):
                out = [row for cells in zip(*(c.to_pylist() for c in part.columns)) for row in rows(*cells)]
                cells = list(zip(*out)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names)

    return specs.select(*[F.col(c).cast("string").alias(c) for c in ("app_slug", "app_version", "raw")]).mapInArrow(run, ROWS)


def part(rows: DataFrame, what: str) -> DataFrame:
    """module, field, constraint or problem rows of compile_specs()."""
    return rows.where(F.col("what") == what).drop("what")


def fingerprints(rows: DataFrame) -> DataFrame:
    """app_slug, app_version and a hash over all rows of each version but its problems, whatever their order."""
    # Problems are left out by the hash, not by a filter: Spark would push it below the parsing of a snapshot's lines and parse them twice.
    one = F.when(F.col("what") != "problem", F.sha2(F.to_json(F.struct(*[c for c in rows.columns if c != "code"]), {"ignoreNullFields": "false"}), 256))
    held = rows.select("app_slug", "app_version", one.alias("_one"))
    n = F.count("_one")
    return held.groupBy("app_slug", "app_version").agg(F.sha2(F.concat_ws(",", n.cast("string"), *[s.cast("string") for s in hash_sums(F.col("_one"))]), 256).alias("fingerprint"), n.alias("rows")).where("rows > 0")


def hash_sums(one: Column) -> list[Column]:
    """Sums of the four 60-bit parts of rows' hashes (hex): no list of the rows, and no order of them. Each part is added up as two longs of 30 bits, exact for 2^33 rows; decimals for every row cost several times that."""
    parts = [F.conv(F.substring(one, 1 + 15 * k, 15), 16, 10).cast("long") for k in range(4)]
    wide = lambda n: n.cast("decimal(20,0)")
    return [wide(F.sum(F.shiftright(p, 30))) * F.lit(1 << 30).cast("decimal(10,0)") + wide(F.sum(p.bitwiseAND(F.lit((1 << 30) - 1)))) for p in parts]


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row, as a snapshot is stored; from_json() reads it."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("json"))


def from_json(texts: DataFrame) -> DataFrame:
    return texts.select(F.from_json("json", ROWS).alias("r")).select("r.*")
