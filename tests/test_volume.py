"""Operation volumes of single documents, wrong requests, and odd tables."""

from __future__ import annotations

import json

import pytest

from sparkloom.operators import volume
from sparkloom.plans.handover import VOLUME_CASES, VOLUME_MODES


def docs(spark, *roots):
    return spark.createDataFrame([(f"d{k}", r if isinstance(r, str) else json.dumps(r)) for k, r in enumerate(roots)], "bp_id string, raw string")


@pytest.mark.parametrize("m", range(len(VOLUME_MODES)))
def test_every_case_by_itself(spark, m):
    mode, profile, module = VOLUME_MODES[m]
    got = {r.bp_id: (r.runs, r.minimum_per_run, r.overhead_per_run, tuple(w.removeprefix("estimate.") for w in r.warnings)) for r in volume.estimate(docs(spark, *[c for c, _ in VOLUME_CASES]), 24, mode, profile, module).collect()}
    for k, (case, found) in enumerate(VOLUME_CASES):
        assert got[f"d{k}"] == found[m], case


def test_once_and_longer_spans(spark):
    one = docs(spark, {"flow": [{"id": 1, "module": "a:B"}], "metadata": {"trigger": {"interval": "2 days"}}})
    assert [(r.runs, r.operations, r.precision) for r in volume.estimate(one, 240).collect()] == [(5, 5, "exact_static_model")]
    assert [(r.runs, r.warnings) for r in volume.estimate(one, 240, "run_once").collect()] == [(1, [])]
    assert [(r.runs, r.minimum_per_run, r.gaps) for r in volume.estimate(one, 240, "module_only").collect()] == [(1, 1, ["estimate.module_only_target_missing"])]


@pytest.mark.parametrize("wrong", [{"hours": 0}, {"hours": True}, {"hours": 1.5}, {"mode": "sometimes"}, {"profile": "hope"}])
def test_wrong_requests_raise(spark, wrong):
    with pytest.raises(ValueError):
        volume.estimate(docs(spark, "{"), **wrong)


def test_documents_that_do_not_parse_have_no_row(spark):
    assert volume.estimate(docs(spark, "{", "")).collect() == []
    assert volume.estimate(docs(spark, "{").limit(0)).collect() == []
