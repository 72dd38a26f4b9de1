"""Grouped summaries: progress, top counts, nearest-rank percentiles, fingerprints, gaps, bands, degrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def guarded_ratio(part: Column, whole: Column) -> Column:
    """part / whole as a double; 0 where whole is 0 or null."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def progress(units: DataFrame, run: Sequence[str], done: Column, weight: Column, runs: DataFrame | None = None) -> DataFrame:
    """Per run, of runs those without units included: total, completed and incomplete units, their weights, both ratios, and coverage_status. A null done counts as neither."""
    counted = units.groupBy(*run).agg(
        F.count("*").alias("total_units"), F.sum(F.when(done, 1).otherwise(0)).alias("completed_units"), F.sum(weight).alias("total_weight"), F.sum(F.when(done, weight).otherwise(F.lit(0))).alias("completed_weight"),
        F.sum(F.when(~done, 1).otherwise(0)).alias("incomplete_units"),
    )
    names = ["total_units", "completed_units", "total_weight", "completed_weight", "incomplete_units"]
    sums = counted if runs is None else runs.select(*run).distinct().join(counted, list(run), "left").select(*run, *[F.coalesce(c, F.lit(0)).alias(c) for c in names])
    return (
        sums.withColumn("count_ratio", guarded_ratio(F.col("completed_units"), F.col("total_units")))
        .withColumn("weighted_ratio", guarded_ratio(F.col("completed_weight"), F.col("total_weight")))
        .withColumn("coverage_status", F.when(F.col("incomplete_units") == 0, "complete").otherwise("incomplete_non_blocking"))
    )


def top_counts(rows: DataFrame, value: str, limit: int | None = None) -> DataFrame:
    counted = rows.groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(value))
    return counted.limit(limit) if limit else counted


def nearest_rank(rows: DataFrame, by: Sequence[str], value: str, ranks: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(p * n). They need no window: percentile_disc is the same value."""
    picks = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY `{value}`)").alias(name) for name, p in ranks.items()]
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), *picks)


def fingerprint(rows: DataFrame, table: str, key: str) -> DataFrame:
    """One row: count, least and largest key, and a hash of the three."""
    facts = rows.agg(F.count("*").alias("rows"), F.min(F.col(key)).cast("string").alias("low"), F.max(F.col(key)).cast("string").alias("high"))
    return facts.select(F.lit(table).alias("table_name"), "rows", "low", "high", F.sha2(F.concat_ws("|", F.lit(table), F.col("rows").cast("string"), "low", "high"), 256).alias("fingerprint"))


def gaps(expected: DataFrame, observed: DataFrame, key: str, want: str, have: str) -> DataFrame:
    """Expected values (arrays) that are not observed, per key; keys without any observation have them all."""
    return expected.join(observed, key, "left").withColumn("missing", F.array_sort(F.array_except(F.col(want), F.coalesce(F.col(have), F.array().cast("array<string>"))))).where(F.size("missing") > 0)


def bands(rows: DataFrame, band: Column, weight: Column, open_: Column, order: Column) -> DataFrame:
    return rows.groupBy(band.alias("band")).agg(F.count("*").alias("units"), F.sum(weight).alias("weight"), F.sum(F.when(open_, 1).otherwise(0)).alias("open_units"), F.min(order).alias("first_order"))


def max_degree(edges: DataFrame, source: str, target: str) -> DataFrame:
    ends = edges.select(F.col(source).alias("node")).unionByName(edges.select(F.col(target).alias("node")))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "node").limit(1)


def duplicates(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def lineage(rows: DataFrame, key: str, parts: Sequence[str]) -> DataFrame:
    """Per key, its distinct contributors in order, as one string."""
    one = F.concat_ws(":", *[F.col(p).cast("string") for p in parts])
    return rows.groupBy(key).agg(F.count("*").alias("facts"), F.array_join(F.array_sort(F.collect_set(one)), ",").alias("contributors"))


def repeated(rows: DataFrame, keys: Sequence[str], least: int) -> DataFrame:
    """Patterns seen at least so often."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def budgeted_prefix(rows: DataFrame, by: Sequence[str], order: Sequence[Column], size: str, budget: int) -> DataFrame:
    """The first rows of each group whose sizes together stay within the budget; the first row always stays."""
    ahead = Window.partitionBy(*by).orderBy(*order)
    upto = F.sum(size).over(ahead.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("place", F.row_number().over(ahead)).withColumn("running", upto).where((F.col("running") <= budget) | (F.col("place") == 1))


def severity_summary(findings: DataFrame, by: Sequence[str], severities: Sequence[str]) -> DataFrame:
    """Findings by severity, and whether the gate is passed: it is if no finding is an error."""
    counts = [F.sum(F.when(F.col("severity") == s, 1).otherwise(0)).alias(s) for s in severities]
    out = findings.groupBy(*by).agg(F.count("*").alias("findings"), *counts)
    return out.withColumn("passed", F.col("error") == 0)
