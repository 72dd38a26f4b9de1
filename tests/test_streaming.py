"""Facts kept from a stream, against the same merge in one go."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparkloom.streaming.facts import facts, keep_facts, merge_batch, windowed_counts

CHANGES = "k string, fingerprint string, valid_from string"


def order():
    return [F.desc("valid_from"), F.desc("fingerprint")]


def test_stream_keeps_history(spark, tmp_path):
    batches = [[("a", "1", "t1"), ("b", "1", "t1")], [("a", "1", "t2"), ("b", "2", "t2"), ("b", "0", "t1")], [("b", "1", "t3"), ("c", "9", "t3")]]
    for rows in batches:
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(CHANGES).parquet(f"{tmp_path}/in")
        keep_facts(stream, f"{tmp_path}/store", f"{tmp_path}/checkpoint", ["k"], order(), availableNow=True).awaitTermination()
    got = sorted((r.k, r.fingerprint, r.valid_from, r.valid_to or "") for r in facts(spark, f"{tmp_path}/store").collect())
    assert got == [("a", "1", "t1", ""), ("b", "1", "t1", "t2"), ("b", "1", "t3", ""), ("b", "2", "t2", "t3"), ("c", "9", "t3", "")]


def test_a_batch_twice_is_a_batch_once(spark, tmp_path):
    store = f"{tmp_path}/store"
    merge_batch(spark.createDataFrame([("a", "1", "t1")], CHANGES), 0, store, ["k"], order())
    for _ in range(2):
        merge_batch(spark.createDataFrame([("a", "2", "t2")], CHANGES), 1, store, ["k"], order())
    assert sorted((r.fingerprint, r.valid_to or "") for r in facts(spark, store).collect()) == [("1", "t2"), ("2", "")]


def test_windows_leave_late_events_out(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 10, m)
    for rows in [[(at(1), "x"), (at(2), "x"), (at(31), "y")], [(at(3), "x"), (at(59), "y")], [(at(4), "x")]]:
        spark.createDataFrame(rows, "ts timestamp, kind string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema("ts timestamp, kind string").parquet(f"{tmp_path}/in")
        counted = windowed_counts(stream, "ts", "kind", "10 minutes", "20 minutes")
        counted.writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/c").foreachBatch(lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/out")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.start.minute, r.kind, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got[0] == (0, "x", 2) and (0, "x", 3) not in got
