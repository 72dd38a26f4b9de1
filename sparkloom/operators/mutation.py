"""Catalog changes as a fold of an ordered log of events per entity, with preconditions: what each event did, why it was refused, and the states at the end.

A machine has few states, so an event is a map of states, and maps compose: the log is dealt by ranges of (entity, order), each range composes the maps of its entities' runs, the runs of an entity
are chained (one row a range), and then every range applies its events from the states that it starts in. An entity that holds most of the log is spread over as many ranges as it needs, and
the log may be cut anywhere: the states of the first part are the start of the second.

Defined results: an event that the machine does not know is refused (unknown_event) and changes nothing; a null entity is an entity of its own; events of equal order follow one another by kind
and a hash of the row; an empty log leaves the states as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, written


@dataclass(frozen=True)
class Machine:
    """States (the first is that of an entity without events), and what events do: (state, event) to the next state; what is missing is refused with a reason."""

    states: tuple[str, ...]
    moves: dict[tuple[str, str], str]
    reasons: dict[tuple[str, str], str]

    @property
    def events(self) -> list[str]:
        return sorted({e for _, e in (*self.moves, *self.reasons)})

    def table(self) -> np.ndarray:
        """Next state by event and state; the last row is for unknown events."""
        own = np.tile(np.arange(len(self.states)), (len(self.events) + 1, 1))
        for (state, event), new in self.moves.items():
            own[self.events.index(event), self.states.index(state)] = self.states.index(new)
        return own

    def allowed(self) -> np.ndarray:
        own = np.zeros((len(self.events) + 1, len(self.states)), bool)
        for state, event in self.moves:
            own[self.events.index(event), self.states.index(state)] = True
        return own


_SOME = ("proposed", "approved", "rejected", "applied")
#: Proposals of edges: a proposal may be made anew at any time; reviews need one; only an approved one is applied.
PROPOSALS = Machine(
    ("none", *_SOME),
    {("none", "propose"): "proposed", **{(s, "propose"): "proposed" for s in _SOME}, **{(s, "approve"): "approved" for s in _SOME}, **{(s, "reject"): "rejected" for s in _SOME}, ("approved", "apply"): "applied"},
    {**{("none", e): "unknown_proposal" for e in ("approve", "reject", "apply")}, **{(s, "apply"): "proposal_not_approved" for s in ("proposed", "rejected", "applied")}},
)


def _runs(keys: pa.ChunkedArray) -> np.ndarray:
    """Where a new entity begins in a sorted column."""
    codes = keys.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])) if len(codes) else np.zeros(0, int)


def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches of one range after another; a range may lie in several."""
    for batch in batches:
        if batch.num_rows:
            yield pa.Table.from_batches([batch])


def fold(log: DataFrame, machine: Machine = PROPOSALS, start: DataFrame | None = None) -> DataFrame:
    """log (entity, seq, event and other columns) with before, after (states), accepted and reason. start: entity and state of what has been before."""
    names, kinds = log.columns, dict(log.dtypes)
    order = ["entity", "seq", "event", "_place"]
    rows = log.withColumn("_place", F.xxhash64(*names)).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = written(rows.withColumn("_part", F.shiftright("_at", 33).cast("int")).drop("_place"), "log")
    table, allowed, events, states = machine.table(), machine.allowed(), machine.events, list(machine.states)
    ranges = rows.repartition("_part").sortWithinPartitions("_part", "_at")

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # (part, entity), the map so far
        out: list[tuple] = []
        for t in _tables(batches):
            code = np.array([events.index(e) if e in events else len(events) for e in t.column("event").to_pylist()])
            part = t.column("_part").to_numpy()
            begins = np.union1d(_runs(t.column("entity")), np.flatnonzero(np.diff(part, prepend=part[0] - 1)))
            for lo, hi in zip(begins, [*begins[1:], len(code)]):
                key = (int(part[lo]), t.column("entity")[lo].as_py())
                if held is None or held[0] != key:
                    if held is not None:
                        out.append(held)
                    held = (key, np.arange(len(states)))
                now = held[1]
                for c in code[lo:hi]:
                    now = table[c][now]
                held = (key, now)
        if held is not None:
            out.append(held)
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in out], pa.int32()), pa.array([k[1] for k, _ in out], entity_type), pa.array([m.tolist() for _, m in out], pa.list_(pa.int32()))], ["_part", "entity", "map"])

    entity_type = pa.int64() if kinds["entity"] in ("bigint", "int") else pa.string()
    maps = written(ranges.select("_part", "_at", "entity", "event").mapInArrow(compose, f"_part int, entity {'bigint' if entity_type == pa.int64() else 'string'}, map array<int>"), "log-maps")
    first = maps if start is None else maps.join(start.select(F.col("entity").cast(maps.schema["entity"].dataType), F.col("state").alias("_state")), "entity", "left")
    begun = first.withColumn("_from", F.lit(0) if start is None else F.coalesce(F.array_position(F.array(*map(F.lit, states)), F.col("_state")).cast("int") - 1, F.lit(0)))

    def chain(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("_part")  # one row for each range that the entity lies in
        now, found = int(group["_from"].iloc[0]), []
        for m in group["map"]:
            found.append(now)
            now = int(m[now])
        return pd.DataFrame({"_part": group["_part"].to_numpy(), "entity": group["entity"].to_numpy(), "_begin": found})

    key_kind = maps.schema["entity"].dataType.simpleString()
    marked = begun.withColumn("_n", F.count("*").over(Window.partitionBy("entity")))
    alone = marked.where("_n = 1").select("_part", "entity", F.col("_from").alias("_begin"))
    several = marked.where("_n > 1").select("_part", "entity", "map", "_from").groupBy("entity").applyInPandas(chain, f"_part int, entity {key_kind}, _begin int")
    begins = written(alone.unionByName(several), "log-begins")
    left, right = rows.alias("r"), begins.alias("b")
    met = left.join(right, (F.col("r._part") == F.col("b._part")) & F.col("r.entity").cast(key_kind).eqNullSafe(F.col("b.entity"))).select("r.*", "b._begin")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        now = 0
        for t in _tables(batches):
            code = np.array([events.index(e) if e in events else len(events) for e in t.column("event").to_pylist()])
            part, begin = t.column("_part").to_numpy(), t.column("_begin").to_numpy()
            starts = np.union1d(_runs(t.column("entity")), np.flatnonzero(np.diff(part, prepend=part[0] - 1)))
            before = np.empty(len(code), np.int64)
            for lo, hi in zip(starts, [*starts[1:], len(code)]):
                key = (int(part[lo]), t.column("entity")[lo].as_py())
                if key != last:
                    last, now = key, int(begin[lo])
                for k in range(lo, hi):
                    before[k] = now
                    now = table[code[k], now]
            after, fine = table[code, before], allowed[code, before]
            why = [None if ok else machine.reasons.get((states[s], events[c]), "refused") if c < len(events) else "unknown_event" for ok, s, c in zip(fine, before, code)]
            text = lambda x: pa.array([states[s] for s in x], pa.string())
            yield pa.RecordBatch.from_arrays([*[t.column(n).combine_chunks() for n in names], text(before), text(after), pa.array(fine), pa.array(why, pa.string())], [*names, "before", "after", "accepted", "reason"])

    schema = ", ".join(f"`{n}` {kinds[n]}" for n in names) + ", before string, after string, accepted boolean, reason string"
    out = written(met.repartition("_part").sortWithinPartitions("_part", "_at").mapInArrow(apply, schema), "log-folded")
    dropped(rows, maps, begins)
    return out


def states_of(folded: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """entity, state, accepted and refused (numbers of events) after a folded log; entities without events keep the state that they had."""
    last = folded.groupBy("entity").agg(F.max_by("after", F.struct("seq", "event", F.xxhash64(*[c for c in folded.columns if c not in ("before", "after", "accepted", "reason")]))).alias("state"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))
    if start is None:
        return last
    kept = start.alias("s").join(last.alias("l"), F.col("s.entity").eqNullSafe(F.col("l.entity")), "left_anti").select("entity", "state", F.lit(0).cast("long").alias("accepted"), F.lit(0).cast("long").alias("refused"))
    return last.unionByName(kept)
