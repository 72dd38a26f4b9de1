"""The fold of a log against a plain loop, from any cut, and with an entity that holds most of it."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from sparkloom.operators.mutation import PROPOSALS, fold, states_of

LOG = "entity long, seq long, event string, note string"
EVENTS = ["propose", "approve", "reject", "apply", "vanish", None]


def log(spark, rows):
    return spark.createDataFrame(rows, LOG)


def looped(rows, states=None):
    states, out = dict(states or {}), []
    for entity, seq, event, note in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        now = states.get(entity, "none")
        new = PROPOSALS.moves.get((now, event))
        why = None if new else PROPOSALS.reasons.get((now, event), "unknown_event")
        out.append((entity, seq, event, note, now, new or now, new is not None, why))
        states[entity] = new or now
    return Counter(out), states


def made(n: int, entities: int, seed: int, hot: float = 0.3):
    rng = random.Random(seed)
    pick = lambda: 0 if rng.random() < hot else rng.choice([None, *range(1, entities)])
    return [(pick(), k, rng.choice(EVENTS), f"n{k}") for k in range(n)]


@pytest.mark.parametrize("hot", [0.0, 0.3, 0.97])
def test_folds_equal_a_loop(spark, hot):
    rows = made(3000, 40, 1, hot)
    want, states = looped(rows)
    out = fold(log(spark, rows))
    assert Counter(map(tuple, out.collect())) == want
    assert {r.entity: r.state for r in states_of(out).collect()} == states


@pytest.mark.parametrize("cut", [0, 1, 700, 1500])
def test_any_cut_of_the_log_gives_the_same_states(spark, cut):
    rows = made(1500, 12, 2)
    _, states = looped(rows)
    if not cut:
        first = spark.createDataFrame([], "entity long, state string")
    else:
        first = states_of(fold(log(spark, rows[:cut]))).select("entity", "state")
    out = states_of(fold(log(spark, rows[cut:]), start=first), first)
    assert {r.entity: r.state for r in out.collect()} == states


def test_an_empty_log(spark):
    assert fold(log(spark, [])).collect() == []
