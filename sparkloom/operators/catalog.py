"""Catalog operators: sections of a search, integrity, status, audits, imports, hosts, placeholders, hints."""

from __future__ import annotations

import ipaddress
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def latest_child(parents: DataFrame, children: DataFrame, key: str, order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """Each parent with the columns of its first child by order; nulls where it has none."""
    best = children.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_k = 1").select(key, *columns)
    return parents.join(best, key, "left")


def sections(parts: dict[str, DataFrame], limit: int) -> DataFrame:
    """One result of several searches (id, label, score): the first of each by score and id, with its section's name, place and total."""
    out = []
    for name, rows in parts.items():
        order = [F.desc("score"), F.asc("id")]
        total = rows.agg(F.count("*").alias("total"))
        top = rows.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # at most limit rows
        out.append(top.join(F.broadcast(total)).select(F.lit(name).alias("section"), "id", "label", "score", "place", "total"))
    return reduce(DataFrame.unionByName, out)


def integrity(tables: dict[str, tuple[DataFrame, str]], links: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Problems of a catalog: ids that are not unique or null (tables: name to rows and id column), and links (child table, column, parent table) to parents that are not there."""
    parts = []
    for name, (rows, key) in tables.items():
        again = rows.groupBy(key).agg(F.count("*").alias("n")).where(f"n > 1 OR `{key}` IS NULL")
        parts.append(again.select(F.lit(name).alias("table_name"), F.when(F.col(key).isNull(), "null_id").otherwise("duplicate_id").alias("problem"), F.col(key).cast("string").alias("id")))
    for child, column, parent in links:
        rows, (above, key) = tables[child][0], tables[parent]
        lost = rows.where(F.col(column).isNotNull()).join(above.select(F.col(key).alias(column)).distinct(), column, "left_anti")
        parts.append(lost.select(F.lit(child).alias("table_name"), F.lit(f"no_{parent}").alias("problem"), F.col(column).cast("string").alias("id")).distinct())
    return reduce(DataFrame.unionByName, parts)


def projection_status(source: DataFrame, projected: DataFrame, key: str, fingerprint: str) -> DataFrame:
    """How many keys a projection lacks, has too many, has with another fingerprint, and has right."""
    a, b = source.select(key, F.col(fingerprint).alias("_a"), F.lit(1).alias("_x")), projected.select(key, F.col(fingerprint).alias("_b"), F.lit(1).alias("_y"))
    state = F.when(F.col("_y").isNull(), "missing").when(F.col("_x").isNull(), "extra").when(F.col("_a").eqNullSafe(F.col("_b")), "fresh").otherwise("stale")
    return a.join(b, key, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def split_valid(rows: DataFrame, problems: dict[str, Column]) -> DataFrame:
    """rows with problem: the name of the first test that holds, null for rows to import. A null test does not hold."""
    problem = F.coalesce(*[F.when(test, F.lit(name)) for name, test in problems.items()])
    return rows.withColumn("problem", problem)


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port and brackets; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", 1)), F.lit(""))


def _address(text: str) -> ipaddress.IPv4Address | ipaddress.IPv6Address | None:
    """The address that a host stands for, in the usual forms or as whole, octal or hexadecimal numbers."""
    try:
        return ipaddress.ip_address(text.strip("[]"))
    except ValueError:
        pass
    try:
        parts = [int(p, 16) if p.lower().startswith("0x") else int(p, 8) if len(p) > 1 and p.startswith("0") else int(p) for p in text.split(".")]
    except ValueError:
        return None
    if not 1 <= len(parts) <= 4 or any(not 0 <= p < 256 for p in parts[:-1]) or not 0 <= parts[-1] < 256 ** (5 - len(parts)):
        return None
    return ipaddress.IPv4Address(sum(p << (24 - 8 * k) for k, p in enumerate(parts[:-1])) + parts[-1])


@F.pandas_udf(StringType())
def host_kind(hosts: pd.Series) -> pd.Series:
    """name, public_ip, private_ip, loopback, link_local or reserved_ip; null for no host."""

    def kind(h: str | None) -> str | None:
        if not h:
            return None
        at = _address(h)
        if at is None:
            return "loopback" if h == "localhost" or h.endswith(".localhost") else "name"
        return "loopback" if at.is_loopback else "link_local" if at.is_link_local else "private_ip" if at.is_private and not at.is_reserved else "public_ip" if at.is_global else "reserved_ip"

    seen = {h: kind(h) for h in hosts.unique()}
    return hosts.map(seen).astype(object).where(hosts.notna(), None)


def nesting_depth(text: Column, opens: str = "{", closes: str = "}") -> Column:
    """The deepest nesting of one kind of brackets, by running sums over the brackets alone; brackets in quotes are not left out."""
    only = F.regexp_replace(text, f"[^\\{opens}\\{closes}]", "")
    signs = F.split(only, "")
    walked = F.aggregate(signs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), lambda s, c: F.struct((s["now"] + F.when(c == opens, 1).when(c == closes, -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c == opens, 1).otherwise(0)).alias("most")))
    return walked["most"]


def mark_placeholders(text: Column, patterns: dict[str, str]) -> Column:
    """Text with every match of a pattern replaced by <name>; patterns apply in order, so that an earlier one keeps its matches."""
    for name, pattern in patterns.items():
        text = F.regexp_replace(text, pattern, f"<{name}>")
    return text


def repair_candidates(findings: DataFrame, ids: Sequence[str], fixes: dict[str, tuple[str, int]], limit: int) -> DataFrame:
    """For each document (ids), the first fixes by rank: findings' codes looked up in fixes (code to fix and rank), each fix once with the number of findings that it answers."""
    known = F.create_map(*[F.lit(x) for code, (fix, rank) in fixes.items() for x in (code, f"{rank:04d}:{fix}")])
    found = findings.withColumn("_f", F.get(F.map_values(F.map_filter(known, lambda k, _: k == F.col("code"))), 0)).where("_f IS NOT NULL")
    each = found.groupBy(*ids, "_f").agg(F.count("*").alias("findings"))
    best = Window.partitionBy(*ids).orderBy("_f")
    return each.withColumn("place", F.row_number().over(best)).where(F.col("place") <= limit).select(*ids, F.substring("_f", 6, 1000).alias("fix"), "findings", "place")


def backlog(events: DataFrame, key: str, kind: str, order: Sequence[Column], closing: Sequence[str]) -> DataFrame:
    """The state of each entry after its last event: closed by one of the closing kinds, else open; with its number of events."""
    last = Window.partitionBy(key).orderBy(*order)
    counted = events.withColumn("_k", F.row_number().over(last)).withColumn("events", F.count("*").over(Window.partitionBy(key)))
    return counted.where("_k = 1").select(key, F.col(kind).alias("last"), F.when(F.col(kind).isin(*closing), "closed").otherwise("open").alias("state"), "events")
