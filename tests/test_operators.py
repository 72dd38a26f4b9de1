"""Operators with small tables: temporal facts, graphs, queues, palette, rules, sources."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions.palette import PALETTE, arity_problems, call
from sparkloom.operators import aggregates, graph, queue, rules, search, temporal
from sparkloom.operators.shared import checkpointed
from sparkloom.plans import estimate
from sparkloom.sources import tables


def test_point_in_time_is_half_open(spark):
    facts = spark.createDataFrame([("a", "v1", "2026-05-20T00:00", "2026-05-21T00:00"), ("a", "v2", "2026-05-21T00:00", None)], "k string, fp string, valid_from string, valid_to string")
    at = lambda t: [r.fp for r in temporal.as_of(facts, F.lit(t)).collect()]
    assert (at("2026-05-20T12:00"), at("2026-05-21T00:00"), at("2026-05-19T00:00")) == (["v1"], ["v2"], [])


def test_merge_closes_opens_and_keeps(spark):
    facts = spark.createDataFrame([("same", "1", "t0", None), ("new", "1", "t0", None), ("gone", "1", "t0", None), ("new", "0", "s", "t0")], "k string, fingerprint string, valid_from string, valid_to string")
    incoming = spark.createDataFrame([("same", "1", "t1"), ("new", "2", "t1"), ("first", "9", "t1")], "k string, fingerprint string, valid_from string")
    got = sorted((r.k, r.fingerprint, r.valid_from, r.valid_to, r.action) for r in temporal.merge(facts, incoming, ["k"]).collect())
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted([("first", "9", "t1", None, "inserted"), ("gone", "1", "t0", None, "kept"), ("new", "0", "s", "t0", "kept"), ("new", "1", "t0", "t1", "closed"), ("new", "2", "t1", None, "inserted"), ("same", "1", "t0", None, "kept")], key=key)


def test_progress_of_three_units(spark):
    units = spark.createDataFrame([("r", True, 60), ("r", False, 30), ("r", False, 10)], "run string, done boolean, weight int")
    (r,) = aggregates.progress(units, ["run"], F.col("done"), F.col("weight")).collect()
    assert (r.total_units, r.completed_units, r.completed_weight, r.total_weight) == (3, 1, 60, 100)
    assert (r.count_ratio, r.weighted_ratio) == (pytest.approx(1 / 3), 0.6)


def test_edges_keep_the_largest_confidence_and_sticky_ambiguity(spark):
    edges = spark.createDataFrame([("k", 1, 2, 82, False), ("k", 1, 2, 94, False), ("k", 1, 3, 45, False), ("k", 1, 4, 88, True)], "kind string, source int, target int, confidence int, ambiguous boolean")
    got = {r.target: (r.confidence, r.status) for r in graph.merge_edges(edges).collect()}
    assert got == {2: (94, "promoted_candidate"), 3: (45, "low_confidence"), 4: (88, "ambiguous")}


def test_greedy_dedup_never_joins_two_canonicals(spark):
    rows = [("op", "n1", "a", ["x"]), ("op", "n2", "b", ["y"]), ("op", "n3", "c", ["x", "y"]), ("op", "n4", "d", []), ("doc", "n5", "a", ["x"]), ("op", "n6", "e", None)]
    nodes = spark.createDataFrame(rows, "kind string, node_id string, label string, aliases array<string>")
    checkpointed(spark)
    got = {r.node_id: r.canonical_id for r in graph.greedy_dedup(nodes).collect()}
    assert got == {"n1": "n1", "n2": "n2", "n3": "n1", "n4": "n4", "n5": "n5", "n6": "n6"}


def test_greedy_dedup_equals_the_loop_in_no_task(spark):
    """Random rows, one alias that a third of them hold, and a chain of 60; no group of them goes through Python."""
    rng = random.Random(3)
    ids = rng.sample(range(100, 1000), 260)
    rows = [(rng.choice(["op", "doc"]), f"n{i}", rng.choice(["a", "b", "c", None, f"l{i}"]), rng.choices([f"x{k}" for k in range(150)], k=rng.randrange(4)) + ["common"] * (k % 3 == 0)) for k, i in enumerate(ids[:200])]
    rows += [("chain", f"n{i}", f"{k:03}", [f"c{k}", f"c{k + 1}"]) for k, i in enumerate(ids[200:])]
    want = []
    for kind in ("op", "doc", "chain"):
        owner: dict[str, str] = {}
        for _, node, _, names in sorted((r for r in rows if r[0] == kind), key=lambda r: (r[2] is None, r[2] or "", r[1])):
            canonical = min((owner[a] for a in names if a in owner), default=node)
            for a in names:
                owner.setdefault(a, canonical)
            want.append((kind, node, canonical))
    out = graph.greedy_dedup(spark.createDataFrame(rows, "kind string, node_id string, label string, aliases array<string>"))
    assert "Pandas" not in out._jdf.queryExecution().toString()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    assert graph.greedy_dedup(spark.createDataFrame([], "kind string, node_id string, label string, aliases array<string>")).collect() == []


def test_cycles(spark):
    checkpointed(spark)
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (6, 1)], "source int, target int")
    assert sorted(r.node for r in graph.on_cycles(edges).collect()) == [1, 2, 3]
    assert graph.on_cycles(edges.where("source > 3")).collect() == []


def test_cycles_tell_when_rounds_run_out(spark):
    checkpointed(spark)
    chain = spark.createDataFrame([(k, k + 1) for k in range(10)], "source int, target int")
    assert graph.on_cycles(chain, most_rounds=6).collect() == []
    with pytest.raises(RuntimeError, match="rounds"):
        graph.on_cycles(chain, most_rounds=3)


def test_long_alias_chains_are_one_group(spark):
    checkpointed(spark)
    rows = [("op", f"n{k:02}", [f"a{k}", f"a{k + 1}"]) for k in range(40)] + [("doc", "n01", ["a1", "a1", None]), ("op", "x", None), ("op", "y", [None]), ("op", "n39", ["z"]), ("op", "z", ["z"])]
    got = sorted((r.kind, r.node_id, r.group) for r in graph.alias_groups(spark.createDataFrame(rows, "kind string, node_id string, aliases array<string>"), most_rounds=8).collect())
    assert got == sorted([("op", f"n{k:02}", "n00") for k in range(40)] + [("doc", "n01", "n01"), ("op", "x", "x"), ("op", "y", "y"), ("op", "n39", "n00"), ("op", "z", "n00")])


def test_save_is_all_or_nothing(spark):
    units = spark.createDataFrame([(1, "leased", "w"), (2, "leased", "w"), (3, "queued", None)], "unit_id int, status string, lease_owner string")
    outputs = lambda *ids: spark.createDataFrame([(i,) for i in ids], "unit_id int")
    status = lambda df: [r.status for r in df.orderBy("unit_id").collect()]
    assert status(queue.save_batch(units, outputs(1, 2), "w")) == ["completed", "completed", "queued"]
    assert status(queue.save_batch(units, outputs(1), "w")) == ["leased", "leased", "queued"]
    assert status(queue.save_batch(units, outputs(1, 2, 3), "w")) == ["leased", "leased", "queued"]


def test_query_terms(spark):
    row = spark.createDataFrame([("Send the email to a Google-Sheets row",), ("of the",)], "q string").select(search.query_terms(F.col("q")).alias("t")).collect()
    assert [r.t for r in row] == [["send", "email", "google-sheets", "row"], ["of the"]]


def test_version_order(spark):
    rows = spark.createDataFrame([("1.2",), ("latest",), ("10.0",), ("beta",), ("1.10",)], "v string")
    assert [r.v for r in rows.orderBy(search.version_key(F.col("v")), "v").collect()] == ["latest", "10.0", "1.10", "1.2", "beta"]


def value(spark, column):
    return spark.range(1).select(column.alias("v")).head().v


@pytest.mark.parametrize(
    ("name", "args", "want"),
    [
        ("capitalize", ("hello there",), "Hello there"), ("startcase", ("hello THERE",), "Hello There"), ("substring", ("abcdef", 1, 3), "bc"), ("indexOf", ("abc", "c"), 2), ("indexOf", ("abc", "z"), -1),
        ("ifempty", ("", "x"), "x"), ("empty", ("",), True), ("trim", ("  a ",), "a"), ("replace", ("a.b.c", ".", "-"), "a-b-c"), ("split", ("a.b", "."), ["a", "b"]), ("md5", ("abc",), "900150983cd24fb0d6963f7d28e17f72"),
        ("escapeHTML", ('<a href="x">&',), "&lt;a href=&quot;x&quot;&gt;&amp;"), ("stripHTML", ("<p>a<b>c</b></p>",), "ac"), ("encodeURL", ("a b&c",), "a+b%26c"), ("decodeURL", ("a+b%26c",), "a b&c"), ("base64", ("abc",), "YWJj"),
        ("ascii", ("naïve",), "nave"), ("trunc", (-2.5,), -2), ("mod", (7, 3), 1), ("toNumber", ("x",), None), ("escapeMarkdown", ("*a*",), r"\*a\*"), ("escapeJSON", ('a"b\n',), r"a\"b\n"), ("switch", ("b", "a", 1, "b", 2, 9), 2), ("switch", ("z", "a", 1, 9), 9),
    ],
)
def test_palette(spark, name, args, want):
    assert value(spark, call(name, *map(F.lit, args))) == want


def test_palette_numbers_and_arrays(spark):
    a = F.array(*map(F.lit, (4, 1, 3, 2)))
    got = {n: value(spark, call(n, a)) for n in ("sum", "average", "median", "max", "min", "first", "last", "size", "stdevS", "stdevP")}
    assert got == {"sum": 10.0, "average": 2.5, "median": 2.5, "max": 4, "min": 1, "first": 4, "last": 2, "size": 4, "stdevS": pytest.approx(1.2909944), "stdevP": pytest.approx(1.1180340)}
    assert value(spark, call("slice", a, F.lit(1), F.lit(3))) == [1, 3]
    assert value(spark, call("median", F.array().cast("array<int>"))) is None
    assert value(spark, call("first", F.array().cast("array<int>"))) is None


def test_palette_dates(spark):
    t = F.lit("2024-02-29 10:20:30").cast("timestamp_ntz")
    shown = lambda c: value(spark, call("formatDate", c, "YYYY-MM-DD HH:mm:ss"))
    assert shown(call("addYears", t, F.lit(1))) == "2025-02-28 10:20:30"
    assert shown(call("addMinutes", t, F.lit(45))) == "2024-02-29 11:05:30"
    assert shown(call("setMonth", t, F.lit(1))) == "2024-01-29 10:20:30"
    assert value(spark, call("parseDate", F.lit("05.03.2024"), "DD.MM.YYYY")) == dt.datetime(2024, 3, 5)


def test_wrong_calls(spark):
    with pytest.raises(ValueError, match="unknown function"):
        call("nothing")
    with pytest.raises(ValueError, match="arguments"):
        call("lower", F.lit("a"), F.lit("b"))
    calls = spark.createDataFrame([("lower", 1), ("lower", 2), ("if", 3), ("nope", 1), ("map", 7), ("md5", 1)], "name string, n_args int")
    assert sorted((r.name, r.problem) for r in arity_problems(calls).collect()) == [("lower", "arity"), ("nope", "unknown_function")]
    assert set(PALETTE) > {"if", "ifempty", "parseJSON", "toCollection"}


def test_findings_codes_and_ids(spark):
    rows = spark.createDataFrame([(1, "mail me@example.com or 123-45-6789"), (2, None), (3, ""), (4, "nothing")], "id int, text string")
    found = rules.with_finding_id(rules.findings(rows, ["id"], "text", rules.DATA_EXPOSURE), ["id"]).collect()
    assert sorted((r.id, r.code) for r in found) == [(1, "PII_EMAIL"), (1, "PII_SSN")]
    assert len({r.finding_id for r in found}) == 2


def test_manifest_verify_dump_and_carry_over(spark):
    files = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "é")], "path string, body string")
    listed = tables.manifest(files, "path", "body")
    assert {r.path: r.size_bytes for r in listed.collect()} == {"a": 1, "b": 1, "c": 2}
    now = spark.createDataFrame([("a", "x"), ("b", "changed"), ("d", "new")], "path string, body string")
    assert {r.path: r.problem for r in tables.verify(now, listed, "path", "body").collect()} == {"b": "changed", "c": "missing", "d": "unlisted"}
    dump = [r.statement for r in tables.dump(spark.createDataFrame([(2, "it's"), (1, None)], "n int, t string"), "t").collect()]
    assert dump == ["INSERT INTO t VALUES ('1', NULL);", "INSERT INTO t VALUES ('2', 'it''s');"]
    both = tables.carry_over(spark.createDataFrame([(1, "a")], "k int, v string"), spark.createDataFrame([(2, True)], "k int, gone boolean"))
    assert sorted(map(tuple, both.collect())) == [(1, "a"), (2, None)]


def test_cadence(spark):
    got = {t: value(spark, estimate.cadence_minutes(F.lit(t))) for t in ("30 minutes", " 2 Hours ", "1.5 day", "x", "0 minutes", "1 week")}
    assert got == {"30 minutes": 30.0, " 2 Hours ": 120.0, "1.5 day": 2160.0, "x": None, "0 minutes": None, "1 week": 10080.0}
    assert [value(spark, estimate.truthy(F.lit(x))) for x in ("TRUE", " yes", "0", "")] == [True, True, False, False]
    assert [value(spark, estimate.positive_number(F.lit(x))) for x in ("2.5", "-1", "inf", "x")] == [2.5, None, None, None]


def test_responding_to_empty_tables(spark):
    empty = spark.createDataFrame([], "kind string, source string, target string, confidence int, ambiguous boolean")
    assert graph.merge_edges(empty).collect() == []
    assert graph.expand(empty, ["a"]).collect() == []
    checkpointed(spark)
    assert queue.priority_order(spark.createDataFrame([], "unit_id int, p int"), [F.asc("p")]).collect() == []


def test_progress_of_runs_without_units(spark):
    units = spark.createDataFrame([("r", True, 60), ("r", None, 40)], "run string, done boolean, weight int")
    runs = spark.createDataFrame([("r",), ("empty",)], "run string")
    got = {r.run: r for r in aggregates.progress(units, ["run"], F.col("done"), F.col("weight"), runs).collect()}
    assert (got["r"].completed_units, got["r"].incomplete_units, got["r"].coverage_status) == (1, 0, "complete")
    assert (got["empty"].total_units, got["empty"].count_ratio, got["empty"].coverage_status) == (0, 0.0, "complete")


def test_arbitration_by_confidence_then_recency_then_id(spark):
    rows = [("a", "x", "e1", 5, "2024-01"), ("a", "y", "e2", 9, "2023-01"), ("a", "y", "e0", 5, "2024-01"), ("b", "x", "e3", 5, "2024-01"), ("b", "y", "e4", 5, "2024-02"), ("c", "x", "e6", 5, "2024-01"), ("c", "y", "e5", 5, "2024-01"), ("d", "x", "e7", 1, "2024-01")]
    claims = spark.createDataFrame(rows, "k string, v string, evidence_id string, confidence int, observed_at string")
    got = {(r.k, r.winning_id, r.losing_id, r.status, r.reason.split(" ")[0]) for r in temporal.arbitrate(claims, "k", "v").collect()}
    assert got == {("a", "e2", "e1", "resolved", "higher"), ("b", "e4", "e3", "resolved", "newer"), ("c", "e5", "e6", "needs_review", "equal")}


def test_severity_is_tuned_by_confidence(spark):
    rows = spark.createDataFrame([("x", "P0", "low"), ("x", "P0", "high"), ("zero_trace_violation", "P0", "low"), ("x", "P2", "low")], "c string, s string, e string")
    assert [r.t for r in rows.select(estimate.tuned_severity(F.col("c"), F.col("s"), F.col("e")).alias("t")).collect()] == ["P1", "P0", "P0", "P2"]


def test_filter_operators_are_one_list(spark):
    """Every comparison that the shape rules accept has a meaning."""
    from sparkloom.operators import shapes

    for name in shapes.FILTER_OPERATORS:
        assert value(spark, rules.filter_condition(f" {name.upper()}", F.lit("2"), F.lit("2"))) in (True, False)
    assert value(spark, rules.filter_condition("number:less", F.lit("9"), F.lit("10"))) is True
    with pytest.raises(ValueError):
        rules.filter_condition("like", F.lit("a"), F.lit("b"))
