"""Catalog operators over the driver tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, rules, search
from ..sources import tables
from ..sources.tables import table
from .queries import STAMP, query, stamp


@query(f"SELECT o_orderkey, l_partkey, {STAMP.format('l_shipdate')} AS shipped FROM orders LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey, l_suppkey) AS k FROM lineitem) ON l_orderkey = o_orderkey AND k = 1")
def latest_child(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_shipdate"]).withColumnRenamed("l_orderkey", "o_orderkey")
    out = catalog.latest_child(table(spark, d, "orders", ["o_orderkey"]), lines, "o_orderkey", [F.desc("l_shipdate"), F.asc("l_partkey"), F.asc("l_suppkey")], ["l_partkey", "l_shipdate"])
    return out.select("o_orderkey", "l_partkey", stamp("l_shipdate").alias("shipped"))


_SECTIONS = {"part": ("part", "p_partkey", "p_name"), "type": ("part", "p_partkey", "p_type"), "nation": ("nation", "n_nationkey", "n_name"), "supplier": ("supplier", "s_suppkey", "s_name")}
_TERMS = ("e", "steel", "green")
_HITS = " + ".join(f"contains(lower(label), '{t}')::INT" for t in _TERMS)


@query(" UNION ALL ".join(f"SELECT '{s}' AS section, id, label, score, row_number() OVER (ORDER BY score DESC, id) AS place, total FROM (SELECT *, count(*) OVER () AS total FROM (SELECT CAST({k} AS BIGINT) AS id, {c} AS label, {_HITS.replace('label', c)} AS score FROM {t}) WHERE score > 0) QUALIFY row_number() OVER (ORDER BY score DESC, id) <= 8" for s, (t, k, c) in _SECTIONS.items()))
def section_search(spark: SparkSession, d: str) -> DataFrame:
    parts = {}
    for name, (t, key, label) in _SECTIONS.items():
        hits = sum((F.contains(F.lower(label), F.lit(x)).cast("int") for x in _TERMS), F.lit(0))
        parts[name] = table(spark, d, t, [key, label]).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"), hits.alias("score")).where("score > 0")
    return catalog.sections(parts, 8)


@query("""
SELECT 'lineitem' AS table_name, 'duplicate_id' AS problem, CAST(l_orderkey AS VARCHAR) AS id FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1
UNION ALL SELECT DISTINCT 'lineitem', 'no_orders', CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')""")
def catalog_integrity(spark: SparkSession, d: str) -> DataFrame:
    found = {"lineitem": (table(spark, d, "lineitem", ["l_orderkey"]), "l_orderkey"), "orders": (table(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).where("o_orderstatus <> 'P'"), "o_orderkey")}
    return catalog.integrity(found, [("lineitem", "l_orderkey", "orders")])


@query("""
SELECT CASE WHEN b.k IS NULL THEN 'missing' WHEN a.k IS NULL THEN 'extra' WHEN a.f IS NOT DISTINCT FROM b.f THEN 'fresh' ELSE 'stale' END AS state, count(*) AS n
FROM (SELECT p_partkey AS k, p_brand AS f FROM part) a FULL JOIN (SELECT k, min(f) AS f FROM (SELECT p_partkey + 7 * (p_size // 45) AS k, CASE WHEN p_size > 40 THEN 'old' ELSE p_brand END AS f FROM part) GROUP BY 1) b ON a.k = b.k GROUP BY 1""")
def projection_status(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", ["p_partkey", "p_brand", "p_size"])
    now = part.select("p_partkey", F.col("p_brand").alias("f"))
    key = (F.col("p_partkey") + 7 * F.floor(F.col("p_size") / 45)).alias("p_partkey")
    held = part.select(key, F.when(F.col("p_size") > 40, "old").otherwise(F.col("p_brand")).alias("f")).groupBy("p_partkey").agg(F.min("f").alias("f"))
    return catalog.projection_status(now, held, "p_partkey", "f")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'in_debt' WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'unknown_segment' END AS problem FROM customer")
def legacy_import(spark: SparkSession, d: str) -> DataFrame:
    """Rows to import have a null problem; the others go to quarantine under the first test that they fail."""
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    return catalog.split_valid(c, {"in_debt": F.col("c_acctbal") < 0, "unknown_segment": ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")}).select("c_custkey", "problem")


#: Hosts in the forms that an address may take, and their kinds.
HOSTS = (
    ("example.org", "name"), ("LOCALHOST", "loopback"), ("a.localhost", "loopback"), ("127.0.0.1", "loopback"), ("2130706433", "loopback"), ("0x7f.1", "loopback"), ("0177.0.0.1", "loopback"), ("10.1.2.3", "private_ip"), ("192.168.0.9", "private_ip"),
    ("169.254.169.254", "link_local"), ("[::1]", "loopback"), ("[fe80::1]", "link_local"), ("8.8.8.8", "public_ip"), ("134744072", "public_ip"), ("240.0.0.1", "reserved_ip"), ("1.2.3.4.5", "name"), ("300.1.1.1", "name"),
)


@query(f"""SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS host, 'name' AS kind FROM pages
UNION ALL SELECT page_id, h, kind FROM pages JOIN (VALUES {', '.join(f"({k}, '{h.lower()}', '{kind}')" for k, (h, kind) in enumerate(HOSTS))}) v(k, h, kind) ON k = page_id % {len(HOSTS)}""")
def page_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of the pages' addresses, and of links in other forms, one a page."""
    pages = table(spark, d, "pages", ["page_id", "url"])
    other = F.element_at(F.array(*[F.lit(h) for h, _ in HOSTS]), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    links = pages.select("page_id", F.concat(F.lit("http://me:x@"), other, F.lit(":8080/a?b#c")).alias("url"))
    at = pages.unionByName(links).select("page_id", catalog.host(F.col("url")).alias("host"))
    return at.withColumn("kind", catalog.host_kind("host"))


@query("SELECT event_id, CAST(1 + event_id % 5 AS INTEGER) AS depth FROM events WHERE props LIKE '{%'")
def json_depth(spark: SparkSession, d: str) -> DataFrame:
    """Each event's object, put into up to four others, with another one beside it."""
    events, k = table(spark, d, "events", ["event_id", "props"]).where("startswith(props, '{')"), (F.col("event_id") % 5).cast("int")
    nested = F.concat(F.lit("[{},"), F.repeat(F.lit('{"a":'), k), F.col("props"), F.repeat(F.lit("}"), k), F.lit(",{}]"))
    return events.select("event_id", catalog.nesting_depth(nested).alias("depth"))


@query("SELECT event_id, regexp_replace(regexp_replace(props, '[0-9]+', '<number>', 'g'), '\"[a-z]+\"', '<name>', 'g') AS marked FROM events")
def placeholder_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", ["event_id", "props"]).select("event_id", catalog.mark_placeholders(F.col("props"), {"number": "[0-9]+", "name": '"[a-z]+"'}).alias("marked"))


_FIXES = {"PII_EMAIL": ("redact", 2), "PII_PHONE": ("redact", 2), "PII_SSN": ("remove", 1), "PII_CARD": ("remove", 1), "SECRET_ASSIGNMENT": ("rotate", 3)}
_FIX_RULES = rules.DATA_EXPOSURE + rules.SECRETS


@query(f"""
WITH f AS ({" UNION ALL ".join(f"SELECT doc_id, '{_FIXES[r.code][1]:04d}:{_FIXES[r.code][0]}' AS fx FROM documents WHERE regexp_matches(text, '{r.pattern}')" for r in _FIX_RULES if r.code in _FIXES)}), g AS (SELECT doc_id, fx, count(*) AS findings FROM f GROUP BY 1, 2)
SELECT doc_id, substr(fx, 6) AS fix, findings, row_number() OVER (PARTITION BY doc_id ORDER BY fx) AS place FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY fx) <= 2""")
def repair_candidates(spark: SparkSession, d: str) -> DataFrame:
    found = rules.findings(table(spark, d, "documents", ["doc_id", "text"]), ["doc_id"], "text", _FIX_RULES)
    return catalog.repair_candidates(found, ["doc_id"], _FIXES, 2)


@query("SELECT user_id, event_type AS last, CASE WHEN event_type IN ('purchase', 'logout') THEN 'closed' ELSE 'open' END AS state, n AS events FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE k = 1")
def backlog_state(spark: SparkSession, d: str) -> DataFrame:
    return catalog.backlog(table(spark, d, "events", ["event_id", "ts", "user_id", "event_type"]), "user_id", "event_type", [F.desc("ts"), F.desc("event_id")], ["purchase", "logout"])


@query("SELECT 'INSERT INTO region VALUES (''' || r_regionkey || ''', ''' || replace(r_name, '''', '''''') || ''');' AS statement FROM region")
def table_dump(spark: SparkSession, d: str) -> DataFrame:
    return tables.dump(table(spark, d, "region", ["r_regionkey", "r_name"]), "region")


@query("""
SELECT coalesce(a.p_partkey, b.p_partkey) AS path, CASE WHEN b.p_partkey IS NULL THEN 'missing' WHEN a.p_partkey IS NULL THEN 'unlisted' ELSE 'changed' END AS problem
FROM part a FULL JOIN (SELECT p_partkey + 10000000 * (p_size // 48) AS p_partkey, CASE WHEN p_size = 1 THEN 'x' ELSE p_name END AS p_name FROM part) b ON a.p_partkey = b.p_partkey WHERE a.p_name IS DISTINCT FROM b.p_name""")
def manifest_problems(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_size"])
    listed = tables.manifest(part, "p_partkey", "p_name")
    # Renamed parts are missing under one key and unlisted under another.
    now = part.withColumn("p_partkey", F.col("p_partkey") + 10_000_000 * F.floor(F.col("p_size") / 48)).withColumn("p_name", F.when(F.col("p_size") == 1, "x").otherwise(F.col("p_name")))
    return tables.verify(now, listed, "p_partkey", "p_name")


@query("SELECT n_nationkey AS k, n_name AS label, n_regionkey AS up FROM nation UNION ALL SELECT r_regionkey, r_name, NULL FROM region")
def state_carry_over(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "nation", ["n_nationkey", "n_name", "n_regionkey"]).toDF("k", "label", "up")
    return tables.carry_over(new, table(spark, d, "region", ["r_regionkey", "r_name"]).toDF("k", "label").withColumn("gone", F.lit(1)))


@query("SELECT lang, count(*) AS n FROM documents WHERE list_has_any(regexp_extract_all(lower(text), '[a-zäöüßéèêçáíóúñ]+'), ['der', 'und', 'die', 'que', 'les', 'los']) GROUP BY 1")
def marker_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents with words that mark a language."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-zäöüßéèêçáíóúñ]+"), F.lit(0))
    marks = F.array(*map(F.lit, ("der", "und", "die", "que", "les", "los")))
    return table(spark, d, "documents", ["text", "lang"]).where(F.arrays_overlap(words, marks)).groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'old w') OR contains(lower(p_name), '%') OR contains(lower(p_type), 'romo') OR contains(lower(p_type), '_')")
def substring_match(spark: SparkSession, d: str) -> DataFrame:
    """Any term in any column; signs of patterns stand for themselves."""
    return table(spark, d, "part", ["p_partkey", "p_name", "p_type"]).where(search.matches_any(F.col("p_name"), ["OLD w", "%"]) | search.matches_any(F.col("p_type"), ["romo", "_"])).select("p_partkey")


@query("""
SELECT o_orderpriority AS family, count(*) AS units, list_aggregate(list_sort(list(DISTINCT o_orderstatus)), 'string_agg', ',') AS kinds, CASE WHEN count(*) < 100 THEN 'too_few' WHEN sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) * 20 > count(*) THEN 'review' ELSE 'pass' END AS gate FROM orders GROUP BY 1""")
def quality_audit(spark: SparkSession, d: str) -> DataFrame:
    """A sample gate by family: enough units, and at most one in twenty in doubt."""
    sums = table(spark, d, "orders", ["o_orderpriority", "o_orderstatus"]).groupBy(F.col("o_orderpriority").alias("family")).agg(F.count("*").alias("units"), F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ",").alias("kinds"), F.sum((F.col("o_orderstatus") == "P").cast("int")).alias("_p"))
    return sums.select("family", "units", "kinds", F.when(F.col("units") < 100, "too_few").when(F.col("_p") * 20 > F.col("units"), "review").otherwise("pass").alias("gate"))
