"""Work queues as pure functions from tables to tables: lease, reclaim, repair, save."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def priority_order(units: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Units with their place 1..n by order: a range sort, then places from the counts of the sorted parts."""
    spark = units.sparkSession
    held = units.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()).checkpoint()
    sizes = sorted((r._part, r.n, r.low) for r in held.groupBy("_part").agg(F.count("*").alias("n"), F.min("_seq").alias("low")).collect())  # one row a part
    bases, before = [], 0
    for part, n, low in sizes:
        bases.append((part, before - low))
        before += n
    table = F.broadcast(spark.createDataFrame(bases or [(0, 0)], "_part int, _shift long"))
    return held.join(table, "_part").withColumn("place", F.col("_seq") + F.col("_shift") + 1).drop("_part", "_seq", "_shift")


def lease(units: DataFrame, order: Sequence[Column], batch: int, worker: str, until: Column) -> DataFrame:
    """The first queued units become leased; the others stay as they are. units: unit_id, status, lease_owner, lease_expires_at."""
    first = units.where("status = 'queued'").orderBy(*order).limit(batch).select("unit_id", F.lit(True).alias("_pick"))
    joined = units.join(F.broadcast(first), "unit_id", "left")
    pick = F.col("_pick").isNotNull()
    return (
        joined.withColumn("status", F.when(pick, "leased").otherwise(F.col("status")))
        .withColumn("lease_owner", F.when(pick, worker).otherwise(F.col("lease_owner")))
        .withColumn("lease_expires_at", F.when(pick, until).otherwise(F.col("lease_expires_at")))
        .drop("_pick")
    )


def reclaim(units: DataFrame, now: Column) -> DataFrame:
    """Leases that have expired are queued again."""
    late = (F.col("status") == "leased") & (F.col("lease_expires_at") < now)
    return (
        units.withColumn("_late", F.coalesce(late, F.lit(False)))
        .withColumn("status", F.when(F.col("_late"), "queued").otherwise(F.col("status")))
        .withColumn("lease_owner", F.when(~F.col("_late"), F.col("lease_owner")))
        .withColumn("lease_expires_at", F.when(~F.col("_late"), F.col("lease_expires_at")))
        .drop("_late")
    )


def stranded(units: DataFrame, outputs: DataFrame) -> DataFrame:
    """Units that count as completed but have no output."""
    return units.where("status = 'completed'").join(outputs.select("unit_id").distinct(), "unit_id", "left_anti")


def save_batch(units: DataFrame, outputs: DataFrame, worker: str) -> DataFrame:
    """All or nothing: the worker's leased units are completed if the outputs are exactly theirs, else nothing changes."""
    own = units.where((F.col("status") == "leased") & (F.col("lease_owner") == worker)).select("unit_id")
    given = outputs.select("unit_id").distinct()
    odd = own.join(given, "unit_id", "left_anti").unionByName(given.join(own, "unit_id", "left_anti"))
    whole = odd.agg((F.count("*") == 0).alias("_whole"))
    done = (F.col("status") == "leased") & (F.col("lease_owner") == worker) & F.col("_whole")
    return units.join(F.broadcast(whole), F.lit(True)).withColumn("status", F.when(done, "completed").otherwise(F.col("status"))).drop("_whole")
