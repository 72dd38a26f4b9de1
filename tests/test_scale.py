"""What keeps work from growing faster than the tables: small files dealt over cores, and joins by document that never go through the driver."""

from __future__ import annotations

import json

from sparkloom.operators import importability, rulebook
from sparkloom.plans import checks, handover
from sparkloom.sources.tables import dealt


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def docs(spark):
    return spark.createDataFrame([(str(k), json.dumps(case)) for k, (case, _) in enumerate(handover.CASES)], "bp_id string, raw string")


def test_importability_joins_by_document_are_no_broadcasts(spark):
    text = plan(importability.report(docs(spark)))
    assert "SortMergeJoin" in text and "Broadcast" not in text


def test_rules_are_sent_but_nothing_of_the_documents(spark):
    rules = spark.createDataFrame(list(handover.RULE_ROWS), rulebook.RULES)
    text = plan(rulebook.judge(docs(spark), rules))
    sent = [line for line in text.splitlines() if "BroadcastExchange" in line]
    joined = [line for line in text.splitlines() if "BroadcastHashJoin" in line]
    assert sent and all("[who#" in line for line in joined)


def test_documents_of_parts_are_dealt_over_cores(spark, sf_dir):
    cores = spark.sparkContext.defaultParallelism
    for made in (handover.case_documents(spark, sf_dir, handover.CASES), checks._specs(spark, sf_dir)):
        assert made.rdd.getNumPartitions() >= cores


def test_dealt_keeps_rows(spark):
    rows = spark.range(1000).coalesce(1)
    out = dealt(rows, "id")
    assert sorted(r.id for r in out.collect()) == list(range(1000)) and out.rdd.getNumPartitions() == 3 * spark.sparkContext.defaultParallelism


def parses(df) -> int:
    """How often documents' texts go through Python."""
    return plan(df).count("MapInArrow")


def test_fields_pairs_and_unknown_fields_are_told_while_walking(spark):
    from sparkloom.operators import graph, rules
    from sparkloom.sources import blueprints as b

    odd = ({"flow": [{"id": 1, "module": "a:B", "x.y": 1, "mapper": {"qty": ""}, "odd": {"id": 2, "odd": 3}}, {"id": 2, "module": "a:B", "mapper": {"deep": {"qty": 0}}, "onerror": [{"id": 3, "module": "a:B", "qty": "1", "": None}]}, "text"]}, ())
    rows = docs(spark).unionByName(spark.createDataFrame([("odd", json.dumps(odd[0])), ("bad", "{"), ("empty", '{"flow":[]}')], "bp_id string, raw string"))
    same = lambda x, y: sorted(map(tuple, x.collect()), key=str) == sorted(map(tuple, y.collect()), key=str)
    assert same(b.fields_unknown(rows), b.unknown_fields(b.leaves(rows)))
    assert same(b.pairs_available(rows), graph.available_by_reach(b.places(rows)).groupBy("bp_id").count())
    required = [("a:B", "qty"), ("a:B", "id"), ("datastore:AddRecord", "nothing"), ("a:B", "qty")]
    frame = spark.createDataFrame(sorted(set(required)), "module_token string, field string")
    assert same(b.fields_missing(rows, required), rules.required_missing(b.nodes(rows), frame, b.leaves(rows)))
    assert b.nodes(rows, only=("bp_id", "kind")).columns == ["bp_id", "kind"] and same(b.nodes(rows, only=("bp_id", "kind")), b.nodes(rows).select("bp_id", "kind"))
    keyed = b.leaves(rows, keys=("qty", "id", "module"))
    assert same(keyed, b.leaves(rows).where("key IN ('qty', 'id', 'module')"))
    assert same(b.leaves(rows, marks=("{{",)), b.leaves(rows).where("json_type = 'string' AND contains(value, '{{')"))


def test_numbers_that_are_not_finite_are_told_as_before():
    from sparkloom.sources.blueprints import _load

    for text, problem in (
        ('{"a":1e999}', "number_not_finite"), ('{"a":-1E+400}', "number_not_finite"), ('{"a":NaN}', "number_not_finite"), ('{"a":1e999', "invalid_json"), ('[1e999]', "root_not_object"), ('{"a":1e999,"a":1}', None),
        ('{"a":"1e999"}', None), ('{"a":1e-999}', None), ("﻿{}", "invalid_json"), ('{"a":' + "9" * 400 + "}", None), ('{"a":' + "9" * 400 + ".5}", "number_not_finite"), ('{"a":Infinity,"a":1}', "number_not_finite"), (None, "empty"),
    ):
        assert _load(text)[1] == problem, text


def test_documents_are_parsed_once(spark, sf_dir):
    from sparkloom.plans import flows, identity  # noqa: F401  register their queries
    from sparkloom.plans.queries import QUERIES

    for name in ("flow_required", "flow_unknown_fields", "flow_available", "golden_findings", "golden_removed", "runtime_drift", "diff_findings"):
        text = plan(QUERIES[name](spark, sf_dir))
        assert text.count("MapInArrow") == 1, name
        assert text.count("Join") == (1 if name != "diff_findings" else 0), name


def test_rewritten_documents_are_neither_shuffled_nor_written(spark, sf_dir):
    from sparkloom.plans import identity

    found = identity.rewritten_ids(spark, sf_dir)
    text = plan(found)
    assert text.count("MapInArrow") == 1 and text.count("Join") == 1  # the join of orders and lines
    assert "rewritten-" not in " ".join(found.inputFiles()) and "Exchange" not in text.split("MapInArrow")[0]


def test_shape_findings_are_told_in_the_task_that_walks(spark, sf_dir):
    from sparkloom.plans import flows

    found = flows.flow_findings(spark, sf_dir)
    text = plan(found)
    assert text.count("MapInArrow") == 1 and text.count("Join") == 1  # the join of orders and lines
    assert "shapes-" not in " ".join(found.inputFiles()) and "Exchange" not in text.split("MapInArrow")[0]
    # Lambdas keep Spark from making code for the rules.
    assert not [line for line in text.splitlines() if "Generate" in line and "lambda" in line]


def test_volumes_of_several_modes_parse_once(spark, sf_dir):
    import re

    files = handover.operation_volumes(spark, sf_dir).inputFiles()
    assert len(set(re.findall(r"volume-[0-9a-f]+", " ".join(files)))) == 1


def test_assembly_reads_its_plan_once(spark, sf_dir):
    import re

    files = " ".join(handover.assembled_documents(spark, sf_dir).inputFiles())
    assert "assembly-plan-" in files
    assert len(set(re.findall(r"assembly-level-[0-9a-f]+", files))) == 2  # the two levels below the main flow, which is not written again
