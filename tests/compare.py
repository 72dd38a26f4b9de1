"""Holds a query's rows against SQL's: same columns, kinds of types, and the same rows in any order."""

from __future__ import annotations

import math
from collections import Counter

# Type names of both engines that hold the same values.
KINDS = {
    "tinyint": "int", "smallint": "int", "int": "int", "integer": "int", "bigint": "int", "hugeint": "int", "long": "int", "uinteger": "int", "ubigint": "int",
    "float": "float", "double": "float", "string": "text", "varchar": "text", "boolean": "bool", "date": "date", "timestamp": "time", "timestamp_ntz": "time",
}


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_value, v))
    return v


def spark_rows(df) -> tuple[dict[str, str], Counter]:
    names = sorted(df.columns)
    kinds = {n: KINDS.get(k, k) for n, k in df.dtypes}
    return kinds, Counter(tuple(_value(r[n]) for n in names) for r in df.collect())


def sql_rows(con, sql: str) -> tuple[dict[str, str], Counter]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    kinds = {d[0]: KINDS.get(str(d[1]).lower(), str(d[1]).lower()) for d in got.description}
    order = sorted(range(len(names)), key=lambda k: names[k])
    return kinds, Counter(tuple(_value(r[k]) for k in order) for r in got.fetchall())


def assert_same(df, con, sql: str) -> None:
    kinds, rows = spark_rows(df)
    other_kinds, other = sql_rows(con, sql)
    assert kinds == other_kinds
    assert rows == other, (list((rows - other).items())[:3], list((other - rows).items())[:3])
