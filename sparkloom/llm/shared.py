"""Tables written to the shared folder, and helpers that several operators use.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``, which every executor and
the driver can reach; a lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of rows that go to a Python worker at once, and of a row group of the tables written between steps.
BATCH_BYTES = 4 << 20
GROUP_BYTES = 16 << 20


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_BYTES: a batch is held by a task and by its worker, twice on both sides while it is made."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int((spark.conf.get(key) or "0").rstrip("b"))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets a temporary one; a cluster has to name one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        at = getattr(spark.sparkContext, "_sparkloom_shared", None)
        if at is None:
            if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
            at = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
            spark.sparkContext.setCheckpointDir(at)
            spark.sparkContext._sparkloom_shared = at
    return at.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/sparkloom/{tag}-{uuid.uuid4().hex}"


def mounted_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder that plain file calls reach on every machine.

    Memory mapping needs a mounted folder: ``file:`` or no scheme.
    """
    url = urlparse(shared_path(spark, tag))
    if url.scheme not in ("", "file"):
        raise ValueError(f"memory-mapped model files need a mounted shared folder in spark.checkpoint.dir, not {url.scheme}:")
    return url.path


def written(df: DataFrame, tag: str) -> DataFrame:
    """df, written once to the shared folder and read again from there; what nobody deletes before goes when the driver ends."""
    spark = df.sparkSession
    small_batches(spark)
    path = shared_path(spark, tag)
    df.write.option("parquet.block.size", GROUP_BYTES).parquet(path)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkloom_path = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables made by written() that no later result reads."""
    for df in tables:
        delete(df.sparkSession, df._sparkloom_path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], tokenizes: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's function that gives freed memory back to the system at its end: Python workers live on, and the next task may run in another one.

    A worker that ran a tokenizer before drops it when it takes up other work.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = sys.modules.get(f"{__package__}.tokens")
        if loaded and not tokenizes:
            loaded.forget()
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return whole


#: Rows of ids and numbers that may be sent to every executor: about 30 MB as a hash table.
MOST_BROADCAST = 500_000


def sendable(df: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """A narrow table, marked to be broadcast if it has at most ``most`` rows; a larger one is left to a shuffle join."""
    return F.broadcast(df) if df.count() <= most else df


def as_rows(df: DataFrame) -> DataFrame:
    """All columns as the one column ``row``, so that their names cannot clash with an operator's own; "row.*" gives them back."""
    return df.select(F.struct(*[df[f"`{c}`"] for c in df.columns]).alias("row"))


def with_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns, whatever their names, cannot clash."""
    return df.select(*[df[f"`{n}`"] for n in names])
