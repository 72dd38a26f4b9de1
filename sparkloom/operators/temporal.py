"""Facts with validity: a row holds from valid_from up to, not including, valid_to; the current row has a null valid_to."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def intervals(events: DataFrame, keys: Sequence[str], at: str, tie: str) -> DataFrame:
    """Events as validity intervals: each holds until the key's next one."""
    ahead = Window.partitionBy(*keys).orderBy(at, tie)
    return events.withColumn("valid_from", F.col(at)).withColumn("valid_to", F.lead(at).over(ahead))


def current(facts: DataFrame) -> DataFrame:
    return facts.where("valid_to IS NULL")


def as_of(facts: DataFrame, when: Column) -> DataFrame:
    """Facts that hold at a point in time."""
    return facts.where((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))


def merge(facts: DataFrame, incoming: DataFrame, keys: Sequence[str], fingerprint: str = "fingerprint") -> DataFrame:
    """Temporal upsert: an unchanged fingerprint changes nothing, another one closes the current row and opens a new one.

    incoming has the keys, the fingerprint and valid_from. The result has the columns of facts and an ``action``: kept, closed, inserted.
    """
    keys = list(keys)
    new = incoming.select(*keys, F.col(fingerprint).alias("_fp"), F.col("valid_from").alias("_from"))
    held = facts.join(new, keys, "left")
    closes = F.col("valid_to").isNull() & F.col("_fp").isNotNull() & (F.col("_fp") != F.col(fingerprint))
    old = held.select(
        *keys, fingerprint, "valid_from", F.when(closes, F.col("_from")).otherwise(F.col("valid_to")).alias("valid_to"), F.when(closes, "closed").otherwise("kept").alias("action")
    )
    now = current(facts).select(*keys, F.col(fingerprint).alias("_old"))
    fresh = incoming.join(now, keys, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col(fingerprint)))
    return old.unionByName(fresh.select(*keys, fingerprint, "valid_from", F.lit(None).cast(facts.schema["valid_to"].dataType).alias("valid_to"), F.lit("inserted").alias("action")))


def close_omitted(facts: DataFrame, present: DataFrame, keys: Sequence[str], scope: Column, when: Column) -> DataFrame:
    """Current rows in scope whose key is no longer present are closed at ``when``."""
    seen = present.select(*keys).distinct().withColumn("_seen", F.lit(True))
    gone = F.col("valid_to").isNull() & scope & F.col("_seen").isNull()
    return facts.join(seen, list(keys), "left").withColumn("valid_to", F.when(gone, when).otherwise(F.col("valid_to"))).drop("_seen")


def stale_by_hash(units: DataFrame, sources: DataFrame, key: str, own_hash: str, source_hash: str) -> DataFrame:
    """Units whose recorded hash is not the source's present one, or whose source is gone."""
    now = sources.select(key, F.col(source_hash).alias("_now"))
    return units.join(now, key, "left").where(~F.col(own_hash).eqNullSafe(F.col("_now"))).drop("_now")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Upsert by key: the last row of each key wins."""
    best = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")


def arbitrate(claims: DataFrame, key: str, value: str) -> DataFrame:
    """Conflicts of claims (key, value, evidence_id, confidence, observed_at): the winner against each piece of evidence for another value.

    The winner has the highest confidence, then the newest observation, then the least evidence_id: partial maxima, no window over a key's claims. Columns:
    key, winning_id, losing_id, conflict_id (a hash of the three), status and reason.
    """
    facts = F.struct("confidence", "observed_at", F.col("evidence_id").alias("id"), F.col(value).alias("value"))
    top = claims.groupBy(key).agg(F.max(F.struct("confidence", "observed_at")).alias("top"))
    best = claims.join(top, key).where(F.struct("confidence", "observed_at").eqNullSafe(F.col("top")))
    winner = best.groupBy(key).agg(F.min(F.struct("evidence_id", F.col(value).alias("value"))).alias("won"), F.first("top").alias("top"))
    losing = claims.withColumn("own", facts).join(winner, key).where(F.col("own.value") != F.col("won.value"))
    surer, newer = F.col("top.confidence") > F.col("own.confidence"), F.col("top.observed_at") > F.col("own.observed_at")
    return losing.select(
        key,
        F.col("won.evidence_id").alias("winning_id"),
        F.col("own.id").alias("losing_id"),
        F.concat(F.lit("claim-conflict:"), F.substring(F.sha2(F.concat_ws("|", F.col(key).cast("string"), F.col("won.evidence_id").cast("string"), F.col("own.id").cast("string")), 256), 1, 16)).alias("conflict_id"),
        F.when(surer | newer, "resolved").otherwise("needs_review").alias("status"),
        F.when(surer, "higher source confidence").when(newer, "newer evidence observed_at").otherwise("equal confidence and recency; stable evidence_id tiebreaker").alias("reason"),
    )
