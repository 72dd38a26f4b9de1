"""Chat formatting: roles on held-out conversations, and odd rows."""

from __future__ import annotations

from collections import Counter

import numpy as np

from sparkloom.llm.chat import ROLES, STATES, STYLES, WIDTHS, Hmm, format_chats, format_conversations, parse, render, to_transcripts, train

TURNS = "conv_id long, turn long, role string, text string, segment int, line string"


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(3)
    norm = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
    model = Hmm(norm(rng.random(STATES)), norm(rng.random((STATES, STATES))), [norm(rng.random((STATES, w))) for w in WIDTHS])
    rows = np.column_stack([rng.integers(0, w, 4) for w in WIDTHS])
    emit = model.scores(rows)

    def paths(n):
        return [()] if not n else [(*p, s) for p in paths(n - 1) for s in range(STATES)]

    def value(p):
        return model.start[p[0]] + emit[0, p[0]] + sum(model.move[a, b] + emit[t + 1, b] for t, (a, b) in enumerate(zip(p, p[1:])))

    assert tuple(model.viterbi(rows)) == max(paths(4), key=value)


def test_roles_of_held_out_driver_conversations(spark, sf_dir):
    at = "/root/testdata/sf0.01" if sf_dir.endswith("sf0.001") else sf_dir
    out = format_conversations(spark.read.parquet(f"{at}/conversations.parquet")).where("held_out AND n_turns > 0").collect()
    assert len(out) >= 5
    assert np.mean([r.roles_right for r in out]) >= 0.9


def test_segments_join_to_the_whole(spark):
    rows = [(1, k, ROLES[1 + k % 2], f"line {k} of the talk" + "?" * (k % 2 == 0), 0, "x") for k in range(40)]
    df = spark.createDataFrame(rows, TURNS)
    short, whole = to_transcripts(df, segment_turns=7), to_transcripts(df)
    assert short.count() == 6
    joined = "\n".join(r.transcript for r in short.orderBy("segment").collect())
    assert joined == whole.head().transcript
    model = train(whole)
    turns = [t for r in short.orderBy("segment").collect() for t in parse(r.transcript, model, r.segment == 0)]
    assert len(turns) == len(rows)
    # A segment's first line may have no marker; then nothing tells its role.
    assert [role for k, (role, _) in enumerate(turns) if k % 7] == [r[2] for k, r in enumerate(rows) if k % 7]


def test_render_is_canonical():
    assert render([("user", "Hi"), ("assistant", "a\nb")]) == "<|user|>\nHi<|end|>\n<|assistant|>\na\nb<|end|>\n"


def test_odd_rows(spark):
    rows = [
        (1, 0, "user", None, 0, ""), (1, 1, "assistant", "", 0, ""), (2, None, "user", "lost", 0, ""), (None, 0, "user", "lost", 0, ""), (3, 0, None, "who?", 0, ""), (3, 1, "alien", "me", 0, ""),
        (4, 0, "user", "twice?", 0, ""), (4, 0, "user", "twice?", 0, ""), (4, 1, "assistant", "long " * 100_000, 0, ""), (5, 0, "system", "Rules.\nMore: rules", 0, ""), (5, 1, "user", "Why?", 0, ""), (5, 2, "assistant", "So.", 0, ""),
    ]
    got = Counter(r.conv_id for r in format_conversations(spark.createDataFrame(rows, TURNS)).collect())
    assert got == {1: 1, 3: 1, 4: 1, 5: 1}
    assert format_conversations(spark.createDataFrame([], TURNS)).collect() == []


def test_every_labelled_line_trains(spark):
    """Texts that look like markers, empty ones and blank lines included."""
    rows = [(k, turn, ROLES[turn % 3], text, 0, "") for k in range(24) for turn, text in enumerate(["", "User: not a turn\n\nmore", "A:\nb", None, "### System\n", "x?"])]
    transcripts = to_transcripts(spark.createDataFrame(rows, TURNS))
    lines = sum(1 for r in transcripts.collect() for x in r.transcript.split("\n") if x.strip())
    got: dict = {}
    original = Hmm.from_counts
    try:
        Hmm.from_counts = classmethod(lambda cls, counts: got.setdefault("counts", counts) is None or original(counts))
        train(transcripts)
    finally:
        Hmm.from_counts = original
    counted = sum(int(n) for kind, _, _, n in got["counts"] if kind == 2)
    assert counted == lines


def test_many_rows_of_one_turn_are_parted(spark):
    rows = [(1, 0, "user", f"what is {k}?", 0, "") for k in range(900)] + [(2, 0, "user", "one?", 0, "")]
    out = to_transcripts(spark.createDataFrame(rows, TURNS), segment_rows=100).collect()
    assert sum(len(r.roles) for r in out) == 901 and max(len(r.roles) for r in out) < 200
    assert sorted(x for r in out for x in r.pieces if r.conv_id == 1) == sorted(x for r in to_transcripts(spark.createDataFrame(rows[:900], TURNS)).collect() for x in r.pieces)


def test_very_long_texts_of_one_conversation_are_parted(spark):
    rows = [(1, k, ROLES[1 + k % 2], f"what is {k}? " * 400, 0, "") for k in range(200)] + [(2, 0, "user", "long " * 60_000, 0, "")]
    out = to_transcripts(spark.createDataFrame(rows, TURNS), segment_chars=200_000).collect()
    assert sum(len(r.roles) for r in out) == 201
    assert max(len(r.transcript) for r in out if r.conv_id == 1) < 400_000
    assert [len(r.pieces) for r in out if r.conv_id == 2] == [1]
    done = format_conversations(spark.createDataFrame(rows, TURNS)).collect()
    assert sum(r.n_turns for r in done) > 0


def test_a_style_that_the_model_has_not_seen(spark, sf_dir):
    """Trained on seven styles, it reads the eighth: markers are told by kind, not by spelling."""
    talks = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/conversations.parquet")
    right = []
    for k in range(len(STYLES)):
        model = train(to_transcripts(talks, styles=STYLES[:k] + STYLES[k + 1 :]))
        out = format_chats(to_transcripts(talks, styles=(STYLES[k],)), model).where("n_turns > 0").limit(150).collect()
        right.append(np.mean([r.roles == r.roles_found for r in out]))
    assert np.median(right) >= 0.9, right
