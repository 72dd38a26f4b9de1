"""Catalog operators on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import catalog


@pytest.mark.parametrize(
    ("url", "host", "kind"),
    [
        ("https://Example.com/a", "example.com", "name"), ("http://user:pw@10.0.0.1:80/x", "10.0.0.1", "private_ip"), ("http://0x7f.1/", "0x7f.1", "loopback"), ("http://2130706433/", "2130706433", "loopback"), ("http://017700000001", "017700000001", "loopback"),
        ("http://[::1]/", "[::1]", "loopback"), ("http://169.254.169.254/meta", "169.254.169.254", "link_local"), ("http://8.8.8.8?x", "8.8.8.8", "public_ip"), ("http://localhost#a", "localhost", "loopback"), ("http://1.2.3.4.5/", "1.2.3.4.5", "name"),
        ("mailto:x", None, None), (None, None, None), ("", None, None),
    ],
)
def test_hosts(spark, url, host, kind):
    row = spark.createDataFrame([(url,)], "url string").select(catalog.host(F.col("url")).alias("h")).withColumn("k", catalog.host_kind("h")).head()
    assert (row.h, row.k) == (host, kind)


def test_nesting_depth(spark):
    rows = spark.createDataFrame([("",), ("{}",), ("a{b{c}d{e{f}}}",), ("}}{",), (None,)], "t string")
    assert [r.d for r in rows.select(catalog.nesting_depth(F.col("t")).alias("d")).collect()] == [0, 1, 3, 0, None]


def test_integrity_of_null_and_missing(spark):
    a = spark.createDataFrame([(1, 5), (1, 6), (None, None)], "id int, up int")
    b = spark.createDataFrame([(5,)], "key int")
    got = sorted((r.table_name, r.problem, r.id or "") for r in catalog.integrity({"a": (a, "id"), "b": (b, "key")}, [("a", "up", "b")]).collect())
    assert got == [("a", "duplicate_id", "1"), ("a", "no_b", "6"), ("a", "null_id", "")]


def test_first_failed_test_names_the_problem(spark):
    rows = spark.createDataFrame([(1, None), (-1, "x"), (-1, None), (None, None)], "a int, b string")
    got = [r.problem for r in catalog.split_valid(rows, {"negative": F.col("a") < 0, "no_b": F.col("b").isNull()}).collect()]
    assert got == ["no_b", "negative", "negative", "no_b"]


def test_sections_keep_totals(spark):
    rows = spark.createDataFrame([(k, f"l{k}", k % 3) for k in range(10)], "id long, label string, score int")
    got = catalog.sections({"a": rows, "b": rows.where("id < 0")}, 2).collect()
    assert [(r.section, r.id, r.place, r.total) for r in got] == [("a", 2, 1, 10), ("a", 5, 2, 10)]
