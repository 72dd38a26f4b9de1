"""Chat formatting: roles of transcript lines by a hidden Markov model, then canonical turns (operator 6).

A transcript is text whose lines may open with a speaker's marker in any of many styles, or with none. States are a role
and whether a line begins a turn or goes on in one. A line shows the kind of its marker and the first or second unknown
speaker's name, whether a blank line stands before it, whether it ends with a question mark or a colon, its length, and whether it is the
first. The probabilities are counts over all labelled lines (added up in Spark; a table of states by features comes to the
driver), the roles are the Viterbi path, and turns are written as ``<|role|>``, the text without its marker, ``<|end|>``.

A transcript longer than ``segment_turns`` turn numbers is cut there, and a segment of more than ``segment_rows`` rows (many rows of one turn number) or ``segment_chars`` characters is dealt
to parts by a hash of its rows; each is parsed by itself, and only the first segment has the model's start probabilities.

Every labelled line trains. The transcripts that format_conversations() parses are made here, in the eight styles of STYLES, of which one is held out
of training in tests; roles of other transcripts are as right as their lines look like these.

Defined results: null or empty text gives no turn and the empty chat; turns without conv_id or turn number are left out of transcripts;
rows equal in conv_id, turn, role and text are one turn; other rows of one turn number follow one another by role and text; an unknown or
null role trains nothing; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import sendable, small_batches, with_columns

ROLES = ("system", "user", "assistant")
BEGIN, INSIDE = 0, 1
STATES = 2 * len(ROLES)  # 2 * role + (BEGIN or INSIDE)
# Names that speakers' markers use.
NAMES = {
    "system": "system instruction instructions context setup rules".split(),
    "user": "user human customer client prompter question q me you visitor".split(),
    "assistant": "assistant ai bot answer a model agent chatbot helper support".split(),
}
_KIND = {name: k + 1 for k, role in enumerate(ROLES) for name in NAMES[role]}
_NONE, _FIRST, _SECOND, _LATER = 0, 4, 5, 6
_MARKER = re.compile(r"^\s*(?:<\|\s*(\w{1,16})\s*\|>|\[(\w{1,16})\]|\*\*(\w{1,16})\s*:?\*\*\s*:?|#{1,4}\s*(\w{1,16})\s*:?\s*$|(\w{1,16})\s*[:>](?=\s|$))[ \t]*")
#: Values that each feature can take: marker, blank line before, ending, length, first line.
WIDTHS = (7, 2, 3, 4, 2)
#: Turn styles that to_transcripts writes, by role.
STYLES = (
    ("System: ", "User: ", "Assistant: "), ("Instructions: ", "Human: ", "AI: "), ("Context: ", "Q: ", "A: "), ("### System\n", "### User\n", "### Assistant\n"),
    ("<|system|>\n", "<|user|>\n", "<|assistant|>\n"), ("**System**: ", "**Customer**: ", "**Agent**: "), ("[system] ", "[user] ", "[assistant] "), ("Rules: ", "Anna: ", "Berta: "),
)


def line_features(text: str) -> tuple[list[str], list[int], np.ndarray]:
    """(non-blank lines, lengths of their markers, a row of features for each)."""
    lines, cut, rows, names, blank = [], [], [], {}, True
    for line in text.split("\n"):
        if not line.strip():
            blank = True
            continue
        kind, width = _NONE, 0
        if m := _MARKER.match(line):
            name = next(g for g in m.groups() if g).lower()
            kind, width = _KIND.get(name, 0), m.end()
            if not kind:
                kind = min(_FIRST + names.setdefault(name, len(names)), _LATER)
        body = line[width:].rstrip()
        end = 1 if body.endswith("?") else 2 if body.endswith(":") else 0
        size = 0 if len(body) < 20 else 1 if len(body) < 80 else 2 if len(body) < 300 else 3
        rows.append((kind, int(blank), end, size, int(not lines)))
        lines.append(line)
        cut.append(width)
        blank = False
    return lines, cut, np.array(rows, np.int64).reshape(-1, len(WIDTHS))


@dataclass
class Hmm:
    """Log probabilities: of first states, of moves between states, and for each feature of its values in each state."""

    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]

    @classmethod
    def from_counts(cls, counts: np.ndarray) -> Hmm:
        """counts: (kind, a, b, n) rows; kind 0 start b, 1 move a to b, 2 + f value b of feature f in state a."""
        start, move = np.full(STATES, 0.1), np.full((STATES, STATES), 0.1)
        emit = [np.full((STATES, w), 0.1) for w in WIDTHS]
        start[1::2] = 1e-6  # a text does not open inside a turn
        for a in range(STATES):
            for b in range(STATES):
                if b % 2 == INSIDE and a // 2 != b // 2:
                    move[a, b] = 1e-9
        for kind, a, b, n in counts:
            if kind == 0:
                start[b] += n
            elif kind == 1:
                move[a, b] += n
            else:
                emit[kind - 2][a, b] += n
        norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        return cls(norm(start), norm(move), [norm(e) for e in emit])

    def scores(self, rows: np.ndarray) -> np.ndarray:
        return sum(e[:, rows[:, f]].T for f, e in enumerate(self.emit))

    def viterbi(self, rows: np.ndarray, opens: bool = True) -> np.ndarray:
        """The likeliest states; opens: the rows are the beginning of a transcript."""
        if not len(rows):
            return np.zeros(0, np.int64)
        emit = self.scores(rows)
        best, back = (self.start if opens else np.zeros(STATES)) + emit[0], np.zeros((len(rows), STATES), np.int64)
        for t in range(1, len(rows)):
            reach = best[:, None] + self.move
            back[t] = reach.argmax(axis=0)
            best = reach.max(axis=0) + emit[t]
        path = np.empty(len(rows), np.int64)
        path[-1] = best.argmax()
        for t in range(len(rows) - 1, 0, -1):
            path[t - 1] = back[t, path[t]]
        return path


def parse(text: str | None, model: Hmm, opens: bool = True) -> list[tuple[str, str]]:
    """(role, text) of each turn of a transcript."""
    lines, cut, rows = line_features(text or "")
    turns: list[tuple[str, list[str]]] = []
    for line, width, state in zip(lines, cut, model.viterbi(rows, opens)):
        if state % 2 == BEGIN or not turns:
            turns.append((ROLES[state // 2], [line[width:].strip()]))
        else:
            turns[-1][1].append(line.strip())
    return [(role, "\n".join(x for x in held if x)) for role, held in turns]


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in turns)


def to_transcripts(conversations: DataFrame, segment_turns: int = 512, bare: int = 8, segment_rows: int = 4096, segment_chars: int = 1 << 22, styles: tuple[tuple[str, str, str], ...] = STYLES) -> DataFrame:
    """conv_id, segment, part, transcript, roles, pieces (what each turn is in the transcript): turns in order, in a style chosen by conv_id.

    One marker in ``bare`` is left out, and a blank line stands in its place. part is 0 but in segments of more than segment_rows rows or segment_chars characters (a longer text is a part of its own, or shares one).
    """
    given = with_columns(conversations, "conv_id", "turn", "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    segment = F.floor(F.col("turn") / segment_turns).cast("long").alias("segment")
    size = F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars")
    sizes = given.select("conv_id", segment, size).groupBy("conv_id", "segment").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
    large = sizes.where((F.col("n") > segment_rows) | (F.col("chars") > segment_chars))
    parts = sendable(large.select("conv_id", "segment", F.greatest(F.ceil(F.col("n") / segment_rows), F.ceil(F.col("chars") / segment_chars)).alias("parts")))
    rows = given.distinct()
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(styles)))
    k = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    marker = F.element_at(F.element_at(F.array(*[F.array(*map(F.lit, s)) for s in styles]), (style + 1).cast("int")), k)
    drop = (F.pmod(F.xxhash64("conv_id", "turn"), F.lit(bare)) == 0) & (F.col("turn") > 0)
    line = F.when(drop, F.concat(F.lit("\n"), F.coalesce("text", F.lit("")))).otherwise(F.concat(marker, F.coalesce("text", F.lit(""))))
    rows = rows.select("conv_id", segment, F.struct("turn", "role", "text", line.alias("line")).alias("t")).join(parts, ["conv_id", "segment"], "left")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("t"), "parts")).cast("int")
    held = rows.groupBy("conv_id", "segment", part.alias("part")).agg(F.sort_array(F.collect_list("t")).alias("t"))  # about segment_rows rows at most
    return held.select("conv_id", "segment", "part", F.array_join("t.line", "\n").alias("transcript"), F.col("t.role").alias("roles"), F.col("t.line").alias("pieces"))


def train(transcripts: DataFrame) -> Hmm:
    """Counts over all labelled lines of to_transcripts()' rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            for segment, text, roles, pieces in zip(*(batch.column(c).to_pylist() for c in ("segment", "transcript", "roles", "pieces"))):
                full: list[int | None] = []  # a state for each line that is not blank, None where the role is unknown
                for role, piece in zip(roles, pieces):
                    n = sum(1 for x in piece.split("\n") if x.strip())
                    full += [None] * n if role not in ROLES else [2 * ROLES.index(role) + (INSIDE if i else BEGIN) for i in range(n)]
                rows = line_features(text)[2]
                for t, s in enumerate(full):
                    if s is None:
                        continue
                    keys = [(2 + f, s, int(v)) for f, v in enumerate(rows[t])]
                    if t == 0 and segment == 0:
                        keys.append((0, 0, s))
                    elif t and full[t - 1] is not None:
                        keys.append((1, full[t - 1], s))
                    for key in keys:
                        sums[key] = sums.get(key, 0) + 1
        k = list(sums)
        yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in k], pa.int32()) for i in range(3)), pa.array([sums[x] for x in k], pa.int64())], ["kind", "a", "b", "n"])

    counts = transcripts.mapInArrow(run, "kind int, a int, b int, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n")).collect()
    return Hmm.from_counts(np.array([tuple(r) for r in counts], np.int64).reshape(-1, 4))


def format_chats(transcripts: DataFrame, model: Hmm) -> DataFrame:
    """conv_id, segment, n_turns, roles_found, chat of every transcript (conv_id, segment, transcript), and its other columns."""
    names, kinds = transcripts.columns, dict(transcripts.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            turns = [parse(t, model, s == 0) for t, s in zip(batch.column("transcript").to_pylist(), batch.column("segment").to_pylist())]
            new = [pa.array([len(x) for x in turns], pa.int32()), pa.array([[r for r, _ in x] for x in turns], pa.list_(pa.string())), pa.array([render(x) for x in turns], pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new], [*names, "n_turns", "roles_found", "chat"])

    return transcripts.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", n_turns int, roles_found array<string>, chat string")


def held_out():
    """Column: conversations that the model of format_conversations does not learn from (one in five)."""
    return F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5 == 0


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, segment, part, held_out, n_turns, roles_right, roles_found, chat: transcripts made of the turns, parsed again."""
    small_batches(conversations.sparkSession)
    transcripts = to_transcripts(conversations)
    model = train(transcripts.where(~held_out()))
    out = format_chats(transcripts, model)
    return out.select("conv_id", "segment", "part", held_out().alias("held_out"), "n_turns", (F.col("roles") == F.col("roles_found")).alias("roles_right"), F.array_join("roles_found", " ").alias("roles_found"), "chat")
