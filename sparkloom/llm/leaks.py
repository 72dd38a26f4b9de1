"""Secrets in texts by assignment-aware lexing (operator 12).

Fixed patterns give the base findings (assignments to telling names, access key ids, long hexadecimal runs). The method adds literals: a text is cut into
tokens (names, strings, operators), line by line,, and the tokens are parsed as the assignments of source code and configuration: ``name = "x"``, ``name: x``,
``"name": "x"``, ``name: type = "x"``, ``conf["name"] = "x"``, ``name => "x"``, ``export NAME=x``, ``set("name", "x")``, ``<name>x</name>`` and attributes.
Each gives a target name and an expression: strings and names joined by + or . or side by side. Constants are
propagated: a name stands for the literals last assigned to it (or, if it is only assigned later, for those), and ``${name}`` inside a string for its value. A
value is scored by the words of its target's name and by its form; if it scores at least ``least``, every literal that it is made of is a finding.

Texts are dealt to tasks as they lie; one document is one row of work, and time is linear in its length: closing quotes are found in one pass, names wait
for one assignment each, and a value takes part in others with at most ``MOST_PARTS`` literals and ``MOST_CHARS`` characters (a longer one is no secret).

Defined results: a null text is an empty one and has no findings; repeated rows are searched each; an empty table gives no rows; other columns are
ignored. Places are code points, ends exclusive.
"""

from __future__ import annotations

import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, tidy, with_columns

KINDS = ("assign", "access", "hex", "literal")
# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST_ASSIGN, LEAST_ACCESS = 8, 16

#: A value of more literals or more characters is not scored.
MOST_PARTS, MOST_CHARS = 64, 16_384

# What a word of the target's name, or a run of words, says.
NAME_POINTS = {
    "password": 4, "passwd": 4, "passphrase": 4, "pwd": 4, "pass": 2, "secret": 4, "token": 3, "credential": 4, "credentials": 4, "bearer": 3, "apikey": 4,
    "authorization": 3, "auth": 2, "cookie": 1, "session": 1, "salt": 2, "signature": 2, "key": 1, "pin": 2, "private": 2,
    "file": -3, "path": -3, "url": -2, "uri": -2, "label": -4, "hint": -4, "policy": -4, "length": -4, "pattern": -4, "regex": -4, "placeholder": -5, "field": -3, "column": -3,
    "title": -4, "message": -4, "error": -4, "help": -4, "count": -4, "limit": -4, "type": -3, "name": -2, "expiry": -4, "expires": -4, "ttl": -4, "min": -3, "max": -3,
}
KEY_BEFORE = {"api", "access", "private", "secret", "signing", "encryption", "master", "client", "auth", "account", "storage", "ssh", "shared", "service"}
MARKS = re.compile(r"^(?:gh[pousr]_|sk_live_|sk-|xox[abprs]-|glpat-|eyJ|AKIA|AIza|-----BEGIN)")
PLACEHOLDER = re.compile(r"example|change.?me|your|dummy|sample|placeholder|insert|replace|todo|redacted|xxxx|\*\*\*\*|\.\.\.\.|^(?:null|none|true|false|undefined|nil|test|password|secret|token)$|^[<{\[].*[>}\]]$|^%.*%$", re.IGNORECASE)
WORD_CUT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
#: A text in which no name that has points stands before an operator, a quote or a bracket has no value to score. Names are scored by their last NAME_CHARS characters.
NAME_CHARS = 128
TELLING = re.compile(r"(?:pass|pwd|secret|token|credential|bearer|key|auth|cookie|session|salt|signature|pin|private)[\w.$-]{0,%d}(?:[\"'`\])>]|\s*[:=+])" % NAME_CHARS, re.IGNORECASE)

LINE = re.compile(r"[^\n]+")
CUE = re.compile(r"[=:]|\(\s*[\"'`]")
QUOTE = re.compile(r"\\.|[\"'`\n]", re.DOTALL)
TOKEN = re.compile(
    r"""(?P<name>[A-Za-z_$@][\w$]*(?:[.-][\w$]+)*)"""
    r"""|(?P<op>:=|=>|->|[=!<>]=|\+=|::|[=:+,;()\[\]{}<>/?|&~])"""
    r"""|(?P<quote>["'`])"""
    r"""|(?P<word>[^\s\w"'`=:+,;()\[\]{}<>/?|&~]?[\w%!#^*.@\\-]+|\S)"""
)
BARE = re.compile(r"[^\s,;#&\"'`<>(){}\[\]][^\s,;&\"'`<>(){}\[\]]*")
WITHIN = re.compile(r"\$\{(\w+)\}|\{(\w+)\}|\$(\w+)")
ELEMENT = re.compile(r"<([A-Za-z_][\w.-]*)>([^<>\n]+)</([A-Za-z_][\w.-]*)>")


class Literal(NamedTuple):
    start: int
    end: int


class Value(NamedTuple):
    """What an expression comes to: its text, and the literals that it is made of."""

    text: str
    parts: tuple[Literal, ...]

    def __add__(self, other: Value) -> Value:
        parts = tuple(dict.fromkeys(self.parts + other.parts))
        # A value beyond the bounds stays beyond them: it is as long as they are, whatever is added.
        return Value((self.text + other.text)[: MOST_CHARS + 1], parts[: MOST_PARTS + 1])

    @property
    def bounded(self) -> bool:
        return len(self.text) <= MOST_CHARS and len(self.parts) <= MOST_PARTS


class Reference(NamedTuple):
    """A name, and what an unquoted word of configuration says itself where nothing defines it."""

    name: str
    instead: Value | None = None


class Pair(NamedTuple):
    """An assignment: the target's name, and literals and names in the order in which they are joined."""

    target: str
    expression: list[Value | Reference]


class Token(NamedTuple):
    kind: str  # name, op, string, word
    text: str
    start: int
    end: int


def closing_quotes(text: str) -> dict[int, int]:
    """For each quote that opens a string, the next one of its kind on its line that no backslash stands before. An apostrophe inside a word opens nothing."""
    found: dict[int, int] = {}
    last: dict[str, int] = {}
    for m in QUOTE.finditer(text):
        c, at = m[0], m.start()
        if c == "\n":
            last.clear()
        elif len(c) == 1:
            opened = last.pop(c, None)
            if opened is not None:
                found[opened] = at
            if c != "'" or not at or not text[at - 1].isalnum() or text[at - 1] in "rbfuRBFU":
                last[c] = at
    return found


def tokens(text: str, at: int, stop: int, closing: dict[int, int]) -> Iterator[Token]:
    """The tokens from at on; the line ends at stop."""
    while (m := TOKEN.search(text, at, stop)) is not None:
        kind, start, at = m.lastgroup, m.start(), m.end()
        if kind != "quote":
            yield Token(kind, m[0], start, at)
        elif (end := closing.get(start)) is not None:
            yield Token("string", text[start + 1 : end], start + 1, end)
            at = end + 1
        else:
            yield Token("word", m[0], start, at)


def literal(token: Token) -> list[Value | Reference]:
    """A string as the parts that it is joined of: its own text, and the names that it quotes."""
    if "$" not in token.text and "{" not in token.text:
        return [Value(token.text, (Literal(token.start, token.end),))]
    out: list[Value | Reference] = []
    at = 0
    for m in WITHIN.finditer(token.text):
        if m.start() > at:
            out.append(Value(token.text[at : m.start()], (Literal(token.start + at, token.start + m.start()),)))
        out.append(Reference(m[1] or m[2] or m[3]))
        at = m.end()
    if at < len(token.text):
        out.append(Value(token.text[at:], (Literal(token.start + at, token.end),)))
    return out


ASSIGNS = {"=", ":", ":=", "=>", "+="}


def operand(row: list[Token], k: int, text: str, op: Token) -> tuple[list[Value | Reference], int]:
    """The expression from row[k] on, right of op, and the place after it."""
    out: list[Value | Reference] = []
    while k < len(row):
        t = row[k]
        if t.kind == "string":
            out += literal(t)
            k += 1
        elif t.kind == "name" and t.text in ("r", "b", "f", "u", "rb", "br") and k + 1 < len(row) and row[k + 1].kind == "string" and row[k + 1].start == t.end + 1:
            k += 1
            continue
        elif not out or (row[k - 1].kind == "op" and row[k - 1].text in ("+", "&")):
            if op.text == ":" and text.startswith("//", t.start):
                return out, k  # an address
            if op.text != "=>" and not out and t.kind in ("name", "word", "op"):
                # An unquoted value of configuration; one that is a plain name may also be a constant's.
                m = BARE.match(text, t.start)
                if m is None:
                    return out, k
                end = m.end()
                after = k + 1
                while after < len(row) and row[after].start < end:
                    after += 1
                if t.kind == "name" and t.end == end and not (end < len(text) and text[end] == "("):
                    own = "." not in t.text and any(map(str.isdigit, t.text))
                    out.append(Reference(t.text, Value(t.text, (Literal(t.start, t.end),)) if own else None))
                elif t.kind == "name" and end < len(text) and text[end] == "(":
                    return out, after  # a call: its value is not known
                else:
                    out.append(Value(m[0], (Literal(m.start(), end),)))
                k = after
            elif t.kind == "name":
                out.append(Reference(t.text))
                k += 1
            else:
                return out, k
        else:
            return out, k
        if k < len(row) and row[k].kind == "op" and row[k].text in ("+", "&"):
            k += 1
        elif k < len(row) and row[k].kind == "string" and out:
            continue  # side by side
        else:
            return out, k
    return out, k


def pairs(text: str) -> Iterator[Pair]:
    """The assignments of a text, in order."""
    closing = closing_quotes(text)
    held: Token | None = None  # a key at the end of a line, whose value may open the next
    for m in LINE.finditer(text):
        if held is None and CUE.search(text, m.start(), m.end()) is None:
            continue
        row = list(tokens(text, m.start(), m.end(), closing))
        if not row:
            continue
        if held is not None and row[0].kind == "string":
            yield Pair(held.text, literal(row[0]))
        ends = len(row) > 1 and row[-1].kind == "op" and row[-1].text in (":", "=") and row[-2].kind in ("name", "string")
        held = row[-2] if ends else None
        yield from row_pairs(row, text)


def row_pairs(row: list[Token], text: str) -> Iterator[Pair]:
    """The assignments of one line."""
    k = 0
    named: Token | None = None  # the value of a name or key attribute, which a value attribute follows
    while k < len(row):
        t = row[k]
        if t.kind == "op" and t.text in ASSIGNS and k:
            target = row[k - 1]
            after, typed = k + 1, None
            if target.kind == "op" and target.text == "]" and k > 2 and row[k - 2].kind in ("string", "name"):
                target = row[k - 2]
            if target.kind not in ("name", "string"):
                k += 1
                continue
            if t.text == ":" and after + 1 < len(row) and row[after].kind == "name":
                # A declared type between the name and its value.
                depth, j = 0, after + 1
                while j < len(row) and j < after + 12 and (depth or row[j].text in ("[", "<", "|", "?") or (row[j].kind == "name" and row[j - 1].text == "|")):
                    depth += row[j].text in ("[", "<")
                    depth -= row[j].text in ("]", ">")
                    j += 1
                if j < len(row) and row[j].kind == "op" and row[j].text == "=":
                    t, after, typed = row[j], j + 1, row[after]
            expression, end = operand(row, after, text, t)
            if expression:
                if t.text == "+=":
                    expression.insert(0, Reference(target.text))
                lowered = target.text.lower()
                if lowered in ("name", "key", "id") and len(expression) == 1 and isinstance(expression[0], Value):
                    named = Token("string", expression[0].text, 0, 0)
                elif lowered in ("value", "content", "val") and named is not None:
                    yield Pair(named.text, expression)
                    named = None
                yield Pair(target.text, expression)
                if typed is not None:
                    yield Pair(typed.text, expression)  # or a name after a colon of prose
            k = max(end, after)
        elif t.kind == "string" and k > 1 and row[k - 1].text == "(" and row[k - 2].kind == "name" and k + 2 < len(row) and row[k + 1].text == "," and row[k + 2].kind == "string":
            yield Pair(t.text, literal(row[k + 2]))
            k += 3
        else:
            k += 1


def name_points(name: str) -> int:
    words = [w.lower() for w in WORD_CUT.findall(name[-NAME_CHARS:])]
    points = sum(NAME_POINTS.get(w, 0) for w in words)
    return points + 3 * sum(b == "key" and a in KEY_BEFORE for a, b in zip(words, words[1:]))


def value_points(value: str) -> int:
    """How much the form of a value speaks for a secret."""
    if len(value) < 6 or not value.isprintable() and "BEGIN" not in value:
        return -9
    points = (len(value) >= 8) + (len(value) >= 16) - 4 * bool(PLACEHOLDER.search(value))
    if MARKS.match(value):
        points += 3
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9 ]"))
    points += (kinds >= 2) + (kinds >= 3)
    held = Counter(value)
    bits = -sum(n / len(value) * math.log2(n / len(value)) for n in held.values())
    points += (bits >= 3) + (bits >= 3.5) - 6 * (len(held) < 4)
    points -= 3 * (" " in value.strip()) + 3 * (kinds == 1 and value.isalpha())
    if "://" in value and not re.search(r"://[^/\s:@]+:[^/\s:@]+@", value):
        points -= 4
    return points


def score(name: str, value: str) -> int:
    """Points of a value of this name; 0 if the name says nothing."""
    points = name_points(name)
    return points + value_points(value) if points > 0 else 0


def resolved(assignments: list[Pair]) -> Iterator[tuple[str, Value]]:
    """Each assignment with the value that it comes to, constants put in. A name that nothing defines stands for its own text if it may be unquoted, else for nothing."""
    known: dict[str, Value] = {}
    waiting: dict[str, list[int]] = {}
    missing: dict[int, set[str]] = {}
    later: deque[str] = deque()

    def value_of(pair: Pair) -> Value:
        out = Value("", ())
        for e in pair.expression:
            out += e if isinstance(e, Value) else known.get(e.name) or e.instead or Value("", ())
            if not out.bounded:
                break
        return out

    def define(name: str, value: Value) -> None:
        for n in {name, name.rsplit(".", 1)[-1]}:
            if n in waiting:
                later.append(n)
            known[n] = value

    for k, pair in enumerate(assignments):
        lacks = {e.name for e in pair.expression if isinstance(e, Reference) and e.name not in known}
        if lacks:
            missing[k] = lacks
            for name in lacks:
                waiting.setdefault(name, []).append(k)
        else:
            value = value_of(pair)
            define(pair.target, value)
            yield pair.target, value
    # Names used before they are assigned: a waiting assignment is done when the last name that it waits for is known.
    while later:
        name = later.popleft()
        for k in waiting.pop(name, ()):
            missing[k].discard(name)
            if not missing[k]:
                del missing[k]
                value = value_of(assignments[k])
                if assignments[k].target not in known:
                    define(assignments[k].target, value)
                yield assignments[k].target, value
    for k in missing:
        yield assignments[k].target, value_of(assignments[k])


def find_literals(text: str, least: int) -> list[tuple[int, int, str, int]]:
    """(start, end, name, score) of each literal of a value that scores at least ``least``; a literal counts for the best of its names."""
    best: dict[Literal, tuple[int, str]] = {}

    def note(name: str, value: Value) -> None:
        if value.parts and value.bounded and (points := score(name, value.text)) >= least:
            for part in value.parts:
                if part.end > part.start:
                    best[part] = max(best.get(part, (0, "")), (points, name))

    if TELLING.search(text):
        for name, value in resolved(list(pairs(text))):
            note(name, value)
    if "</" in text:
        for m in ELEMENT.finditer(text):
            if m[1] == m[3]:
                note(m[1], Value(m[2], (Literal(m.start(2), m.end(2)),)))
    return [(p.start, p.end, name, points) for p, (points, name) in sorted(best.items())]


def find(text: str, least: int) -> list[tuple[str, int, int, str | None, int | None]]:
    """(kind, start, end, name, score) of every finding, by start and then kind."""
    out: list[tuple[str, int, int, str | None, int | None]] = []
    if "=" in text or ":" in text:
        out += [("assign", m.start(), m.end(), m[1], None) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [("access", m.start(), m.end(), None, None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [("hex", m.start(), m.end(), None, None) for m in HEX.finditer(text)]
    out += [("literal", start, end, name, points) for start, end, name, points in find_literals(text, least)]
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0]), f[2]))


FINDING = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("name", pa.string()), ("score", pa.int32())])


def find_secrets(docs: DataFrame, least: int = 7) -> DataFrame:
    """doc_id and findings (kind, start, end, name, score; by start, then kind) of every row of docs (doc_id, text)."""
    docs = with_columns(docs, "doc_id", "text")
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [FINDING.field(k).name for k in range(FINDING.num_fields)]
        for batch in batches:
            rows = [[dict(zip(names, f)) for f in find(t, least)] if t else [] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, pa.list_(FINDING))], ["doc_id", "findings"])

    return docs.mapInArrow(tidy(run), f"doc_id {kind}, findings array<struct<kind:string,start:bigint,end:bigint,name:string,score:int>>")


def report_secrets(docs: DataFrame, least: int = 7) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_literal, names: the findings of every document in short form."""
    found = find_secrets(docs, least)

    def told(findings):
        return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"].cast("string"), f["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")

    base = F.filter("findings", lambda f: f["kind"] != "literal")
    names = F.array_join(F.array_distinct(F.transform(F.filter("findings", lambda f: f["kind"] == "literal"), lambda f: f["name"])), ",")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("findings")).alias("spans"),
        count("literal").alias("n_literal"),
        names.alias("names"),
    )
