"""Checkpoints and tables written between steps: in the folder that spark.checkpoint.dir names; where it is unset, a local session (tests) gets a temporary one and a cluster an error."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpointed(spark: SparkSession) -> SparkSession:
    """The session, with a checkpoint folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named or "file://" + tempfile.mkdtemp(prefix="sparkloom-"))
    return spark


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once below the checkpoint folder and read again from there; what nobody deletes before goes when the driver ends."""
    spark = checkpointed(df.sparkSession)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{tag}-{uuid.uuid4().hex}"
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    at, system = _file_system(spark, path)
    system.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def shuffled(rows: DataFrame) -> DataFrame:
    """rows for a join by document that is never a broadcast: Spark judges a side by its compressed size, and repetitive rows are many times that where the driver holds them."""
    return rows.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later result reads."""
    for df in tables:
        at, system = _file_system(df.sparkSession, df._sparkloom_path)
        system.delete(at, True)
