"""Templates {{...}} in text as rows: the template's body, and the functions that it calls with their numbers of arguments.

Quoted text may hold braces and separators; a template that is never closed, or closed without being opened, is told as unbalanced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

TEMPLATES = "bp_id string, node_path string, path string, body string, problem string"
CALLS = "bp_id string, node_path string, path string, name string, n_args int"
_PART = re.compile(r"""(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<open>\{\{)|(?P<close>\}\})""", re.S)
_TOKEN = re.compile(r"""(?P<quoted>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)\s*\(|(?P<sign>[()\[\],;])|\s+|(?P<rest>[^\s"'()\[\],;]+|.)""", re.S)


def templates_of(text: str) -> tuple[list[str], bool]:
    """(bodies of the templates, whether braces are unbalanced). Quotes count inside templates only."""
    bodies, at = [], 0
    while True:
        start, close = text.find("{{", at), text.find("}}", at)
        if start < 0:
            return bodies, close >= 0
        if 0 <= close < start:
            return bodies, True
        end = next((m for m in _PART.finditer(text, start + 2) if m["close"] or m["open"]), None)
        if end is None or end["open"]:
            return bodies, True
        bodies.append(text[start + 2 : end.start()])
        at = end.end()


def calls_of(body: str) -> list[tuple[str, int]]:
    """(function, number of arguments) of every call in a template's body, outer calls first; brackets that do not match give no more calls."""
    found: list[list] = []
    stack: list[list] = []  # [index of the call or None, separators, whether anything stands in it]
    for m in _TOKEN.finditer(body):
        if m["name"] or m["sign"] in ("(", "["):
            for held in stack[-1:]:
                held[2] = True
            found += [[m["name"], 0]] if m["name"] else []
            stack.append([len(found) - 1 if m["name"] else None, 0, False])
        elif m["sign"] in (")", "]"):
            if not stack:
                break
            call, separators, full = stack.pop()
            if call is not None:
                found[call][1] = separators + 1 if full or separators else 0
        elif m["sign"]:
            for held in stack[-1:]:
                held[1] += held[0] is not None
        elif m["quoted"] or m["rest"]:
            for held in stack[-1:]:
                held[2] = True
    open_ = {s[0] for s in stack}
    return [(name, n) for k, (name, n) in enumerate(found) if k not in open_]


def judged(text: str) -> Iterator[tuple[str | None, str | None]]:
    """(body, problem or None) of each template of a text; see templates()."""
    bodies, broken = templates_of(text)
    for body in bodies:
        yield body, None if body.strip() else "mapping.expression_empty"
    if broken:
        yield None, "mapping.expression_unbalanced"


def _rows(leaves: DataFrame, schema: str, rows_of) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    kinds = [pa.int32() if c.split()[1] == "int" else pa.string() for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[tuple]] = {}  # equal texts of a batch are read once
        for batch in batches:
            known.clear()
            rows = []
            for b, n, p, v in zip(*(c.to_pylist() for c in batch.columns)):
                if v not in known:
                    known[v] = list(rows_of(v))
                rows += [(b, n, p, *row) for row in known[v]]
            cells = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names)

    text = leaves.where("json_type = 'string' AND node_path IS NOT NULL AND (contains(value, '{{') OR contains(value, '}}'))")
    return text.select("bp_id", "node_path", "path", "value").mapInArrow(run, schema)


def templates(leaves: DataFrame) -> DataFrame:
    """Each template of the nodes' texts: body, and problem (mapping.expression_empty, or null); a text with unbalanced braces gives one row with mapping.expression_unbalanced."""
    return _rows(leaves, TEMPLATES, judged)


def calls(leaves: DataFrame) -> DataFrame:
    """Each function call in the nodes' templates: name and number of arguments."""
    return _rows(leaves, CALLS, lambda text: (c for body in templates_of(text)[0] for c in calls_of(body)))
