"""A stream of changes kept as facts with validity: each micro-batch closes and opens rows of a store of Parquet folders.

Closed rows never change again, so they are only added (``closed/batch=N``); the current row of every key is written anew with each batch
(``current/batch=N``, the one before stays until the next). A batch that runs twice writes the same folders again, so a restart loses and doubles
nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import temporal


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _batches(spark: SparkSession, folder: str) -> list[int]:
    if not _exists(spark, folder):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    found = [f.getPath() for f in files if _exists(spark, f"{f.getPath()}/_SUCCESS")]
    return sorted(int(x.getName().removeprefix("batch=")) for x in found if x.getName().startswith("batch="))


def merge_batch(changes: DataFrame, batch: int, store: str, keys: Sequence[str], order: Sequence[Column]) -> None:
    """Merges changes (keys, fingerprint, valid_from and others) into the store. Of several changes of a key in a batch, the last by order counts."""
    spark = changes.sparkSession
    new = temporal.latest(changes, keys, order).select(*keys, "fingerprint", "valid_from")
    before = [b for b in _batches(spark, f"{store}/current") if b < batch]
    kind = new.schema["valid_from"].dataType
    schema = StructType([*new.schema.fields, *StructType.fromDDL(f"valid_to {kind.simpleString()}").fields])
    held = spark.read.schema(schema).parquet(f"{store}/current/batch={before[-1]}") if before else spark.createDataFrame([], schema)
    merged = temporal.merge(held, new, keys)
    columns = [*keys, "fingerprint", "valid_from", "valid_to"]
    merged.where("action = 'closed'").select(columns).write.mode("overwrite").parquet(f"{store}/closed/batch={batch}")
    merged.where("action <> 'closed'").select(columns).write.mode("overwrite").parquet(f"{store}/current/batch={batch}")


def keep_facts(changes: DataFrame, store: str, checkpoint: str, keys: Sequence[str], order: Sequence[Column], **trigger) -> StreamingQuery:
    """Starts the stream; trigger as for DataStreamWriter.trigger (availableNow=True: what is there, then stop)."""
    writer = changes.writeStream.foreachBatch(lambda df, n: merge_batch(df, n, store, keys, order)).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def facts(spark: SparkSession, store: str) -> DataFrame:
    """All facts: the closed ones and the current ones."""
    last = _batches(spark, f"{store}/current")[-1]
    current = spark.read.parquet(f"{store}/current/batch={last}")
    closed = [f"{store}/closed/batch={b}" for b in _batches(spark, f"{store}/closed") if b <= last]
    return spark.read.schema(current.schema).parquet(*closed).unionByName(current)


def windowed_counts(events: DataFrame, at: str, by: str, width: str, late: str) -> DataFrame:
    """Events by window and value; events later than ``late`` behind the newest are left out."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
