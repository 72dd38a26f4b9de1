"""Catalog snapshots as files: the rows of compiled specifications as canonical JSON lines, with a manifest that is written last.

A snapshot is a folder. ``rows`` holds one JSON object a line, in files by application, in the order of what they are; ``manifest`` holds, for each application and version,
the number of its rows and their fingerprint, and ``COMPLETE`` the hash over the whole manifest. Spark's own commit makes each table whole or absent, and a snapshot without
``COMPLETE`` is none: a task that breaks leaves no snapshot, whatever files lie there. Reading holds the rows against the manifest.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shared import checkpointed, written
from . import specs

MANIFEST = "app_slug string, app_version string, rows long, fingerprint string"


def fresh(spark: SparkSession) -> str:
    """A folder for a snapshot below the shared folder; it goes when the driver ends."""
    base = checkpointed(spark).sparkContext._jsc.sc().getCheckpointDir().get()
    path = f"{base}/snapshot-{uuid.uuid4().hex}"
    at, system = _file(spark, path)
    system.deleteOnExit(at)
    return path


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _total(spark: SparkSession, manifest: DataFrame) -> str:
    """A hash over the manifest, whatever the order of its rows: the sums of the parts of each row's hash."""
    one = F.sha2(F.to_json(F.struct("app_slug", "app_version", "rows", "fingerprint"), {"ignoreNullFields": "false"}), 256)
    sums = manifest.agg(F.count("*").alias("n"), *[s.alias(f"s{k}") for k, s in enumerate(specs.hash_sums(one))]).head()
    return hashlib.sha256(",".join(map(str, sums)).encode()).hexdigest()


def write(rows: DataFrame, path: str) -> str:
    """Writes rows of specs.compile_specs() as a snapshot and returns its path; an old snapshot there is an error.

    The manifest is made of the rows themselves, so that reading tells whether the files hold them. rows are read three times: a table is better than what makes it.
    """
    spark = rows.sparkSession
    names = [c.split()[0] for c in specs.ROWS.split(", ")]
    order = ["app_slug", "app_version", "what", "id", "path", "name"]
    line = F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")
    placed = rows.repartitionByRange(*order, F.xxhash64(*names)).sortWithinPartitions(*order, F.xxhash64(*names))
    placed.select(line).write.mode("error").text(f"{path}/rows")
    specs.fingerprints(rows.select(*names)).select("app_slug", "app_version", "rows", "fingerprint").write.mode("error").json(f"{path}/manifest")
    at, system = _file(spark, f"{path}/COMPLETE")
    out = system.create(at, False)
    out.write(bytearray(_total(spark, manifest(spark, path)).encode()))
    out.close()
    return path


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return specs.from_json(spark.read.text(f"{path}/rows").withColumnRenamed("value", "json"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """app_slug, app_version, rows, fingerprint of what was to be written."""
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def problems(spark: SparkSession, path: str, there: DataFrame | None = None) -> DataFrame:
    """app_slug, app_version, problem: versions that the manifest and the rows do not agree on (row_missing, row_unlisted, row_changed), or one row (incomplete, manifest_changed) for the whole.

    there: specs.fingerprints() of the snapshot's lines, if they are known already.
    """
    kinds = "app_slug string, app_version string, problem string"
    at, system = _file(spark, f"{path}/COMPLETE")
    if not system.exists(at):
        return spark.createDataFrame([(None, None, "incomplete")], kinds)
    listed = manifest(spark, path)
    if spark.read.text(f"{path}/COMPLETE").head().value != _total(spark, listed):
        return spark.createDataFrame([(None, None, "manifest_changed")], kinds)
    there = specs.fingerprints(_lines(spark, path)) if there is None else there
    both = listed.join(there.select("app_slug", "app_version", F.col("fingerprint").alias("now")), ["app_slug", "app_version"], "full_outer")
    problem = F.when(F.col("now").isNull(), "row_missing").when(F.col("fingerprint").isNull(), "row_unlisted").when(F.col("now") != F.col("fingerprint"), "row_changed")
    return both.select("app_slug", "app_version", problem.alias("problem")).where("problem IS NOT NULL")


def _held(spark: SparkSession, path: str, there: DataFrame | None = None) -> None:
    found = problems(spark, path, there).limit(3).collect()
    if found:
        raise ValueError(f"the snapshot {path} is not as it was written: {[tuple(r) for r in found]}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a snapshot; one that is not whole, or was changed, raises."""
    _held(spark, path)
    return _lines(spark, path)


def fingerprints(spark: SparkSession, path: str) -> DataFrame:
    """specs.fingerprints() of a snapshot's rows, from one reading of them that is held against the manifest; one that is not whole, or was changed, raises."""
    there = written(specs.fingerprints(_lines(spark, path)), "snapshot-read")
    _held(spark, path, there)
    return there
