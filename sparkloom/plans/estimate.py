"""Cadence arithmetic, gates and policies as Columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Minutes of the units that cadence text may name.
UNIT_MINUTES = (("second", 1 / 60), ("minute", 1.0), ("hour", 60.0), ("day", 1440.0), ("week", 10080.0))


def cadence_minutes(text: Column) -> Column:
    """Minutes of text such as "30 minutes"; null if it is none."""
    clean = F.lower(F.trim(text))
    number = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)\s*([a-z]+?)s?$", 1).try_cast("double")
    unit = F.regexp_extract(clean, r"^(\d+(?:\.\d+)?)\s*([a-z]+?)s?$", 2)
    out = F.when(unit == UNIT_MINUTES[0][0], number * UNIT_MINUTES[0][1])
    for name, minutes in UNIT_MINUTES[1:]:
        out = out.when(unit == name, number * minutes)
    return F.when(out > 0, out)


def runs(hours: Column, minutes: Column) -> Column:
    """Runs in a span: one without a cadence, else at least one."""
    return F.when(minutes.isNull() | (minutes <= 0), 1).otherwise(F.greatest(F.lit(1), F.ceil(hours * 60 / minutes))).cast("long")


def operations(nodes: DataFrame, cadence: DataFrame, hours: float = 24) -> DataFrame:
    """Per document: runs, operations of a run (routers cost none, disabled nodes are skipped) and their product."""
    each = nodes.groupBy("bp_id").agg(F.sum(F.when((F.col("kind") != "router") & ~F.col("disabled"), 1).otherwise(0)).alias("per_run"))
    joined = each.join(cadence, "bp_id", "left").withColumn("runs", runs(F.lit(float(hours)), cadence_minutes(F.col("interval"))))
    return joined.select("bp_id", "runs", "per_run", (F.col("runs") * F.col("per_run")).alias("operations"))


def truthy(flag: Column, json_type: Column | None = None) -> Column:
    """Whether a flag's text sets it. With the value's JSON type: numbers, arrays and objects set nothing."""
    said = F.coalesce(F.lower(F.trim(flag.cast("string"))).isin("true", "1", "yes"), F.lit(False))
    return said if json_type is None else said & json_type.isin("boolean", "string")


def unset(flag: Column, json_type: Column | None = None) -> Column:
    """Whether a flag is there and its text says that it is not set."""
    said = F.coalesce(F.lower(F.trim(flag.cast("string"))).isin("false", "0", "no"), F.lit(False))
    return said if json_type is None else said & json_type.isin("boolean", "string")


def positive_number(text: Column) -> Column:
    """The number if it is finite and positive, else null."""
    x = text.cast("string").try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x)


def refund_decision(gross_cents: Column, delivered: Column, review_started: Column, fault: Column, duplicate: Column, recorded: Column) -> Column:
    """(eligible, refund_cents, access_revoked, reason). A recorded refund or chargeback only revokes access; a fault or a duplicate charge is paid back whole."""

    def decision(eligible: bool, cents: Column, revoked: bool, reason: str) -> Column:
        return F.struct(F.lit(eligible).alias("eligible"), cents.cast("long").alias("refund_cents"), F.lit(revoked).alias("access_revoked"), F.lit(reason).alias("reason"))

    return (
        F.when(recorded, decision(True, F.lit(0), True, "provider_refund_or_chargeback_recorded"))
        .when(duplicate | fault, decision(True, gross_cents, True, "duplicate_charge_or_fault"))
        .when(delivered | review_started, decision(False, F.lit(0), False, "delivery_or_customer_review_started"))
        .otherwise(decision(False, F.lit(0), False, "no_refund_trigger"))
    )


def referral_reward(gross_cents: Column, deductions: Sequence[Column], cancelling: Sequence[Column], ready: Column, reduced: Column, launch_window: Column, monthly_cents: Column) -> Column:
    """(earned, cancelled, net_cents, percent, initial_cents, recurring_cents) of a referral.

    cancelling amounts (refunds, chargebacks, fraud, reversals) cancel it and lower the net like the other deductions; the first three months' net pays a quarter.
    """
    taken = reduce(lambda a, b: a + b, [*deductions, *cancelling])
    cancelled = reduce(lambda a, b: a | b, [c > 0 for c in cancelling])
    net = F.greatest(F.lit(0), gross_cents - taken).cast("long")
    percent = F.when(reduced, 25).when(launch_window, 90).otherwise(50)
    earned = ~cancelled & ready & (net > 0)
    months = F.aggregate(F.slice(monthly_cents, 1, 3), F.lit(0).cast("long"), lambda a, b: a + b)

    def paid(cents: Column) -> Column:
        return F.when(earned, F.floor(cents / 100)).otherwise(0).cast("long")

    return F.struct(
        earned.alias("earned"), cancelled.alias("cancelled"), net.alias("net_cents"), percent.alias("percent"), paid(net * percent).alias("initial_cents"), paid(months * 25).alias("recurring_cents")
    )


def change_order(additional_scenario: Column, new_tool: Column, major: Column, same_purpose: Column, inside_family: Column, subscribed: Column, included: Column, paid_extras: Column) -> Column:
    """The order or entitlement that a requested change falls under. major: the architecture is replaced, or a provider's approval is at risk."""
    return (
        F.when(additional_scenario, "requires_additional_scenario_order")
        .when(new_tool, "requires_custom_tool_order")
        .when(major | ~same_purpose | ~inside_family, "requires_major_change_order")
        .when(~subscribed, "requires_extra_standard_change_order")
        .when(included, "included_standard_change")
        .when(paid_extras > 0, "paid_extra_standard_change")
        .otherwise("requires_extra_standard_change_order")
    )


def parity_confidence(families: Column, pairs: Column, has_spec: Column, dry_runs: Column, damp_tests: Column, shapes: Column, builtin: Column, app_specific: Column) -> Column:
    """low, medium, high or corpus_confirmed from the breadth of evidence for a rule."""
    confirmed = (families >= 3) & (pairs >= 3) & (dry_runs >= 2) & (shapes >= 2) & ((damp_tests > 0) | ~app_specific)
    high = (families >= 2) & (dry_runs >= 1) & ((pairs >= 1) | builtin)
    return F.when(has_spec & confirmed, "corpus_confirmed").when(has_spec & high, "high").when(has_spec & (families >= 1), "medium").otherwise("low")


def tuned_severity(category: Column, severity: Column, confidence: Column) -> Column:
    """P0 becomes P1 without high confidence, but for categories that gate whatever their evidence."""
    gated = category.isin("semantic_lineage_breakage", "zero_trace_violation")
    return F.when(~gated & (severity == "P0") & ~confidence.isin("high", "corpus_confirmed"), "P1").otherwise(severity)
