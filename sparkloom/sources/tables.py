"""Parquet tables of a folder, and JSON columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table; only the named columns are read."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over all cores: a file of few bytes is one task's, however many rows it has and whatever each costs later."""
    return rows.repartition(3 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def json_pairs(rows: DataFrame, ids: Sequence[str], column: str) -> DataFrame:
    """ids, key and value (as text) of each entry of flat JSON objects; other text gives no rows."""
    entries = F.from_json(column, "map<string,string>")
    return rows.select(*ids, F.explode(entries).alias("key", "value"))


def manifest(files: DataFrame, path: str, payload: str) -> DataFrame:
    """path, sha256 and size of each payload."""
    return files.select(F.col(path).alias("path"), F.sha2(payload, 256).alias("sha256"), F.octet_length(payload).cast("long").alias("size_bytes"))


def verify(files: DataFrame, listed: DataFrame, path: str, payload: str) -> DataFrame:
    """Paths that are missing from files, not listed, or of another hash than listed."""
    now = manifest(files, path, payload).select("path", F.col("sha256").alias("now"))
    both = listed.select("path", F.col("sha256").alias("was")).join(now, "path", "full_outer")
    problem = F.when(F.col("now").isNull(), "missing").when(F.col("was").isNull(), "unlisted").when(F.col("was") != F.col("now"), "changed")
    return both.select("path", problem.alias("problem")).where("problem IS NOT NULL")


def dump(rows: DataFrame, name: str) -> DataFrame:
    """INSERT statements of a table, as text rows in the order of all columns; values are quoted as SQL text."""
    quoted = [F.when(F.col(c).isNull(), "NULL").otherwise(F.concat(F.lit("'"), F.replace(F.col(c).cast("string"), F.lit("'"), F.lit("''")), F.lit("'"))) for c in rows.columns]
    return rows.orderBy(*rows.columns).select(F.concat(F.lit(f"INSERT INTO {name} VALUES ("), F.concat_ws(", ", *quoted), F.lit(");")).alias("statement"))


def carry_over(new: DataFrame, old: DataFrame) -> DataFrame:
    """Old rows put to new ones by shared column names; others become null."""
    return new.unionByName(old.select(*[c for c in old.columns if c in new.columns]), allowMissingColumns=True)
