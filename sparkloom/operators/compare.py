"""Documents against reference versions of themselves, in one pass a pair: semantic and layout findings, drift and removed nodes.

The two versions' texts are joined by document, equal texts are dropped, and each pair is walked once, both trees together, by the task that holds it; only
findings leave it. Paths are those of sources.blueprints (a key's own dots are escaped), so a key that holds a dot is one key.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.blueprints import CONTAINERS, _load, _renamed, _type, key_part, walk

FOUND = "bp_id string, what string, path string, code string"
WHAT = ("semantic", "layout", "drift", "removed")


def _kind(v: object) -> str:
    """The type of a value; whole numbers apart from others."""
    kind = _type(v)
    return "integer" if kind == "number" and isinstance(v, int) else "float" if kind == "number" else kind


def _same(a: object, b: object) -> bool:
    return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)


def semantic(a: object, b: object) -> Iterator[tuple[str, str]]:
    """(path, code) where two trees differ, layout aside. Below a change of type, or what one side lacks, nothing more is told; of arrays their common places and length."""
    stack = [("", a, b)]
    while stack:
        path, x, y = stack.pop()
        at = f"{path}." if path else ""
        if _kind(x) != _kind(y):
            yield path, "semantic.type"
        elif isinstance(x, dict):
            for k in [k for k in (*x, *(k for k in y if k not in x)) if k != "designer"]:
                if k not in y:
                    yield at + key_part(k), "semantic.missing"
                elif k not in x:
                    yield at + key_part(k), "semantic.added"
                else:
                    stack.append((at + key_part(k), x[k], y[k]))
        elif isinstance(x, list):
            if len(x) != len(y):
                yield path, "semantic.length"
            stack += [(f"{at}{k}", v, w) for k, (v, w) in enumerate(zip(x, y))]
        elif x != y:
            yield path, "semantic.value"


def layout(a: object, b: object) -> Iterator[tuple[str, str]]:
    """(path, "layout.changed") of each designer value that differs, in objects that both sides have."""
    stack = [("", a, b)]
    while stack:
        path, x, y = stack.pop()
        at = f"{path}." if path else ""
        if isinstance(x, dict) and isinstance(y, dict):
            if ("designer" in x or "designer" in y) and not ("designer" in x and "designer" in y and _same(x["designer"], y["designer"])):
                yield f"{at}designer", "layout.changed"
            stack += [(at + key_part(k), x[k], y[k]) for k in x if k in y and k != "designer"]
        elif isinstance(x, list) and isinstance(y, list):
            stack += [(f"{at}{k}", v, w) for k, (v, w) in enumerate(zip(x, y))]


def drift(a: object, b: object) -> Iterator[tuple[str, str]]:
    """(path, added, removed, type or value) of each change, layout among them; below a change of kind nothing more is told."""
    stack = [("", a, b)]
    while stack:
        path, x, y = stack.pop()
        at = f"{path}." if path else ""
        if _type(x) != _type(y):
            yield path, "type"
        elif isinstance(x, (dict, list)):
            left, right = (dict(enumerate(v)) if isinstance(v, list) else v for v in (x, y))
            for k in [*left, *(k for k in right if k not in left)]:
                inner = at + (str(k) if isinstance(x, list) else key_part(k))
                if k not in right:
                    yield inner, "removed"
                elif k not in left:
                    yield inner, "added"
                else:
                    stack.append((inner, left[k], right[k]))
        elif json.dumps(x) != json.dumps(y):
            yield path, "value"


def removed(a: dict, b: dict) -> Iterator[tuple[str, str]]:
    """(id, "node.removed") of nodes that the second tree no longer has."""
    held = {str(node["id"]) for node, *_ in walk(b) if node.get("id") is not None}
    gone = {str(node["id"]): None for node, *_ in walk(a) if node.get("id") is not None and str(node["id"]) not in held}
    return ((k, "node.removed") for k in gone)


# Fields that change with every save, a path below which nothing counts, and a flag that counts only when it is set.
VOLATILE = frozenset(("lastmodified", "last_modified", "lastrun", "last_run", "modifiedat", "modified_at", "revision", "timestamp", "updatedat", "updated_at"))
VOLATILE_BELOW = (".metadata.designer.messages",)
UNSET_FLAGS = frozenset(("$.metadata.instant",))


def lasting(v: object, path: str = "$") -> object:
    """A value without its volatile fields."""
    if isinstance(v, list):
        return [lasting(x, f"{path}[{k}]") for k, x in enumerate(v)]
    if not isinstance(v, dict):
        return v
    out = {}
    for k, x in v.items():
        at = f"{path}.{k}".lower()
        if k.lower() not in VOLATILE and not (x is False and at in UNSET_FLAGS) and not any(f in at for f in VOLATILE_BELOW):
            out[k] = lasting(x, f"{path}.{k}")
    return out


_SOURCE = re.compile(r"(?<![\w.])\d+(?=\.[A-Za-z_`\[])")


def _signature(node: dict) -> str:
    """What a node is, wherever it stands: its content without id, place on the canvas, child flows, and the numbers of the nodes that it refers to."""
    own = {k: v for k, v in node.items() if k not in ("id", *CONTAINERS)}
    if isinstance(own.get("metadata"), dict):
        own["metadata"] = {k: v for k, v in own["metadata"].items() if k != "designer"}
    return _SOURCE.sub("#", json.dumps(own, sort_keys=True))


def moved_nodes(a: dict, b: dict) -> dict[str, str]:
    """Paths of nodes of a, and where they stand in b: nodes that are not at their place any more, matched in order with equal ones at places where a has another."""
    x, y = ({path: _signature(node) for node, path, *_ in walk(root)} for root in (a, b))
    free: dict[str, list[str]] = {}
    for path, own in y.items():
        if x.get(path) != own:
            free.setdefault(own, []).append(path)
    for places in free.values():
        places.reverse()
    return {path: free[own].pop() for path, own in x.items() if y.get(path) != own and free.get(own)}


def relabelled(root: dict, labels: dict[str, int]) -> dict:
    """root with the ids of its nodes, and the references to them, replaced by labels (by path). Nodes that share an id keep their references to the first of them."""
    names: dict[str, str] = {}
    for node, path, *_ in walk(root):
        if node.get("id") is not None:
            names.setdefault(str(node["id"]), str(labels[path]))
    out = _renamed(root, names)
    for node, path, *_ in walk(out):
        node["id"] = labels[path]
    return out


def canonical(a: dict, b: dict) -> Iterator[tuple[str, str]]:
    """canonical_lasting() of two documents, volatile fields left out."""
    return canonical_lasting(lasting(a), lasting(b))


def canonical_lasting(a: dict, b: dict) -> Iterator[tuple[str, str]]:
    """semantic() of two documents whose ids are taken for places: ids relabelled by place, and nodes that moved told as such (path in a, "node.moved") and as nothing else."""
    moves = moved_nodes(a, b)
    back = {new: old for old, new in moves.items()}
    first = {path: k for k, (_, path, *_) in enumerate(walk(a), 1)}
    second: dict[str, int] = {}
    for k, (_, path, *_) in enumerate(walk(b), len(first) + 1):
        second[path] = first[back[path]] if path in back else first[path] if path in first and path not in moves else k
    heads = tuple(f"{p}." for p in (*moves, *back))
    for path, code in semantic(relabelled(a, first), relabelled(b, second)):
        if f"{path}." not in heads and not path.startswith(heads):
            yield path, code
    for path in moves:
        yield path, "node.moved"


_FINDERS = {"canonical": canonical, "semantic": semantic, "layout": layout, "drift": drift, "removed": removed}


def compare(reference: DataFrame, generated: DataFrame, what: Sequence[str] = WHAT) -> DataFrame:
    """bp_id, what, path, code for documents (bp_id, raw) of both sides; ones that do not parse, or that one side lacks, give no rows. path is the id for removed nodes."""
    sides = [rows.select(F.col("bp_id").cast("string").alias("bp_id"), F.col("raw").cast("string").alias(name)) for rows, name in ((reference, "a"), (generated, "b"))]
    return compared(sides[0].join(sides[1], "bp_id"), what)


def compared(pairs: DataFrame, what: Sequence[str] = WHAT) -> DataFrame:
    """compare() of texts that stand side by side already: bp_id, a (reference), b (generated)."""
    wanted = list(what)
    both = pairs.select(*[F.col(c).cast("string").alias(c) for c in ("bp_id", "a", "b")]).where("a <> b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bp_id, a, b in zip(*(batch.column(c).to_pylist() for c in ("bp_id", "a", "b"))):
                x, y = _load(a)[0], _load(b)[0]
                if x is not None and y is not None:
                    rows += [(bp_id, name, path, code) for name in wanted for path, code in _FINDERS[name](x, y)]
            cells = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], ["bp_id", "what", "path", "code"])

    return both.mapInArrow(run, FOUND)


def three_way(generated: DataFrame, exported: DataFrame, known_good: DataFrame) -> DataFrame:
    """comparison, bp_id, path, code: canonical findings of generated documents against exported and known good ones, and of these two."""
    # All versions of a document meet once, and each is parsed once for the comparisons that it is in.
    sides = [rows.select(F.col("bp_id").cast("string").alias("bp_id"), F.lit(k).alias("side"), F.col("raw").cast("string").alias("raw")) for k, rows in enumerate((generated, exported, known_good))]
    met = sides[0].unionByName(sides[1]).unionByName(sides[2]).where("bp_id IS NOT NULL AND raw IS NOT NULL")
    held = met.groupBy("bp_id").agg(F.collect_list(F.struct("side", "raw")).alias("versions"))
    pairs = (("generated_vs_exported", 0, 1), ("generated_vs_known_good", 0, 2), ("exported_vs_known_good", 1, 2))
    names = ["comparison", "bp_id", "path", "code"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for bp_id, versions in zip(*(batch.column(c).to_pylist() for c in ("bp_id", "versions"))):
                read: dict[str, dict | None] = {}
                for text in {v["raw"] for v in versions}:
                    root = _load(text)[0]
                    read[text] = None if root is None else lasting(root)
                of = [[v["raw"] for v in versions if v["side"] == k] for k in range(3)]
                for name, left, right in pairs:
                    for a in of[left]:
                        for b in of[right]:
                            if a != b and read[a] is not None and read[b] is not None:
                                rows += [(name, bp_id, path, code) for path, code in canonical_lasting(read[a], read[b])]
            cells = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cells], names)

    return held.mapInArrow(run, ", ".join(f"{n} string" for n in names))


def grouped(findings: DataFrame) -> DataFrame:
    """comparison, code, documents, findings, first_path: what the documents' findings have in common; places of lists are told apart no more."""
    shape = F.regexp_replace("path", r"(?<=^|\.)\d+(?=\.|$)", "*")
    return findings.groupBy("comparison", "code", shape.alias("shape")).agg(F.countDistinct("bp_id").alias("documents"), F.count("*").alias("findings"))


def accepted(path, code):
    """Whether a change of drift() is accepted: a changed coordinate of a designer is, nothing else."""
    return path.rlike(r"(^|\.)metadata\.designer\.[xy]$") & code.isin("value", "type")
