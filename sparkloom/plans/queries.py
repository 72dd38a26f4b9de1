"""The library's operators over the driver tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.palette import call
from ..operators import aggregates, diff, graph, queue, rules, search, temporal
from ..sources.tables import json_pairs, table
from . import estimate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def stamp(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


STAMP = "strftime({}, '%Y-%m-%d %H:%M:%S')"


# --- temporal facts -----------------------------------------------------------------------------------------------


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return temporal.intervals(table(spark, d, "events", ["event_id", "ts", "user_id", "event_type", "props"]), ["user_id", "event_type"], "ts", "event_id")


FACTS = "(SELECT event_id, user_id, event_type, props, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events)"


@query(f"SELECT event_id, user_id, event_type, {STAMP.format('valid_from')} AS valid_from FROM {FACTS} WHERE valid_to IS NULL")
def current_rows(spark: SparkSession, d: str) -> DataFrame:
    return temporal.current(_facts(spark, d)).select("event_id", "user_id", "event_type", stamp("valid_from").alias("valid_from"))


@query(f"SELECT event_id, user_id, event_type FROM {FACTS} WHERE valid_from <= TIMESTAMP '2024-01-10 00:00:00' AND (valid_to IS NULL OR valid_to > TIMESTAMP '2024-01-10 00:00:00')")
def as_of(spark: SparkSession, d: str) -> DataFrame:
    when = F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")
    return temporal.as_of(_facts(spark, d), when).select("event_id", "user_id", "event_type")


SPLIT = "1995-06-01"


@query(f"""
WITH base AS (SELECT o_custkey AS k, o_orderstatus AS fingerprint, o_orderdate AS valid_from, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate < TIMESTAMP '{SPLIT}'),
facts AS (SELECT k, fingerprint, valid_from FROM base WHERE n = 1),
inc AS (SELECT k, fingerprint, valid_from FROM (SELECT o_custkey AS k, o_orderstatus AS fingerprint, o_orderdate AS valid_from, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '{SPLIT}') WHERE n = 1)
SELECT f.k AS cust, f.fingerprint, {STAMP.format('f.valid_from')} AS valid_from, CASE WHEN i.k IS NOT NULL AND i.fingerprint <> f.fingerprint THEN {STAMP.format('i.valid_from')} END AS valid_to, CASE WHEN i.k IS NOT NULL AND i.fingerprint <> f.fingerprint THEN 'closed' ELSE 'kept' END AS action FROM facts f LEFT JOIN inc i ON i.k = f.k
UNION ALL
SELECT i.k, i.fingerprint, {STAMP.format('i.valid_from')}, NULL, 'inserted' FROM inc i LEFT JOIN facts f ON i.k = f.k WHERE f.k IS NULL OR f.fingerprint <> i.fingerprint""")
def scd2_merge(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate"])
    rows = orders.select(F.col("o_custkey").alias("cust"), F.col("o_orderstatus").alias("fingerprint"), F.col("o_orderdate").alias("valid_from"), "o_orderkey")
    newest = [F.desc("valid_from"), F.desc("o_orderkey")]
    split = F.lit(SPLIT).cast("timestamp_ntz")
    facts = temporal.latest(rows.where(F.col("valid_from") < split), ["cust"], newest).withColumn("valid_to", F.lit(None).cast("timestamp_ntz"))
    incoming = temporal.latest(rows.where(F.col("valid_from") >= split), ["cust"], newest)
    out = temporal.merge(facts.select("cust", "fingerprint", "valid_from", "valid_to"), incoming.select("cust", "fingerprint", "valid_from"), ["cust"])
    return out.select("cust", "fingerprint", stamp("valid_from").alias("valid_from"), stamp("valid_to").alias("valid_to"), "action")


@query("SELECT p.p_partkey AS part, CASE WHEN p.p_size >= 10 AND q.k IS NULL THEN '2024-06-01' END AS valid_to FROM part p LEFT JOIN (SELECT DISTINCT p_partkey AS k FROM part WHERE p_retailprice < 1400) q ON q.k = p.p_partkey")
def close_omitted(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part", ["p_partkey", "p_size", "p_retailprice"])
    facts = parts.select(F.col("p_partkey").alias("part"), "p_size", F.lit(None).cast("string").alias("valid_to"))
    present = parts.where("p_retailprice < 1400").select(F.col("p_partkey").alias("part"))
    return temporal.close_omitted(facts, present, ["part"], F.col("p_size") >= 10, F.lit("2024-06-01")).select("part", "valid_to")


@query("SELECT l.doc_id, CAST(l.quality AS INTEGER) AS own FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id WHERE d.doc_id IS NULL OR (d.n_chars % 2) IS DISTINCT FROM l.quality")
def stale_by_hash(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "labels", ["doc_id", "quality"]).select("doc_id", F.col("quality").cast("int").alias("own"))
    sources = table(spark, d, "documents", ["doc_id", "n_chars"]).select("doc_id", (F.col("n_chars") % 2).cast("int").alias("now"))
    return temporal.stale_by_hash(units, sources, "doc_id", "own", "now")


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def upsert_latest(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events", ["event_id", "ts", "user_id", "event_type"])
    return temporal.latest(rows, ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_type", "event_id")


@query("""
WITH c AS (SELECT o_custkey AS subject, o_orderpriority AS value, o_orderkey AS id, CAST(floor(o_totalprice / 90000) AS BIGINT) AS sure, date_trunc('month', o_orderdate) AS seen FROM orders),
w AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY subject ORDER BY sure DESC, seen DESC, id) = 1)
SELECT c.subject, w.id AS winning_id, c.id AS losing_id, 'claim-conflict:' || substr(sha256(c.subject || '|' || w.id || '|' || c.id), 1, 16) AS conflict_id, CASE WHEN w.sure > c.sure OR w.seen > c.seen THEN 'resolved' ELSE 'needs_review' END AS status,
CASE WHEN w.sure > c.sure THEN 'higher source confidence' WHEN w.seen > c.seen THEN 'newer evidence observed_at' ELSE 'equal confidence and recency; stable evidence_id tiebreaker' END AS reason
FROM c JOIN w ON w.subject = c.subject WHERE c.value <> w.value""")
def claim_arbitration(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderpriority", "o_totalprice", "o_orderdate"])
    claims = orders.select(
        F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("value"), F.col("o_orderkey").alias("evidence_id"),
        F.floor(F.col("o_totalprice") / 90000).alias("confidence"), F.date_trunc("month", "o_orderdate").alias("observed_at"),
    )
    return temporal.arbitrate(claims, "subject", "value")


# --- aggregates ---------------------------------------------------------------------------------------------------


@query("""
SELECT c_custkey AS run, count(o_orderkey) AS total_units, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS completed_units, count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) AS incomplete_units,
CAST(coalesce(sum(CAST(floor(o_totalprice) AS BIGINT)), 0) AS BIGINT) AS total_weight, CAST(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) END), 0) AS BIGINT) AS completed_weight,
CASE WHEN count(o_orderkey) = 0 THEN 0.0 ELSE round(CAST(count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS DOUBLE) / count(o_orderkey), 6) END AS count_ratio,
coalesce(round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) ELSE 0 END) AS DOUBLE) / nullif(sum(CAST(floor(o_totalprice) AS BIGINT)), 0), 6), 0.0) AS weighted_ratio,
CASE WHEN count(CASE WHEN o_orderstatus <> 'F' THEN 1 END) = 0 THEN 'complete' ELSE 'incomplete_non_blocking' END AS coverage_status
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""")
def run_progress(spark: SparkSession, d: str) -> DataFrame:
    units = table(spark, d, "orders", ["o_custkey", "o_orderstatus", "o_totalprice"]).withColumnRenamed("o_custkey", "run")
    runs = table(spark, d, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("run"))
    out = aggregates.progress(units, ["run"], F.col("o_orderstatus") == "F", F.floor("o_totalprice"), runs)
    return out.withColumn("count_ratio", F.round("count_ratio", 6)).withColumn("weighted_ratio", F.round("weighted_ratio", 6))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_counts(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.top_counts(table(spark, d, "events", ["event_type"]), "event_type", 5)


@query("SELECT event_type, count(value) AS n, min(value) AS low, max(value) AS high, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_summary(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.nearest_rank(table(spark, d, "events", ["event_type", "value"]), ["event_type"], "value", {"p50": 0.5, "p95": 0.95})


KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id"}


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, CAST(min({k}) AS VARCHAR) AS low, CAST(max({k}) AS VARCHAR) AS high, sha256('{t}|' || count(*) || '|' || min({k}) || '|' || max({k})) AS fingerprint FROM {t}" for t, k in KEYS.items()))
def table_fingerprint(spark: SparkSession, d: str) -> DataFrame:
    return rules.report([aggregates.fingerprint(table(spark, d, t, [k]), t, k) for t, k in KEYS.items()])


@query("""
WITH want AS (SELECT n_nationkey AS nation, ['small', 'large', 'debt'] AS kinds FROM nation), have AS (SELECT s_nationkey AS nation, list(DISTINCT CASE WHEN s_acctbal < 0 THEN 'debt' WHEN s_acctbal < 5000 THEN 'small' ELSE 'large' END) AS kinds FROM supplier GROUP BY 1)
SELECT nation, array_to_string(m, ',') AS missing FROM (SELECT w.nation, list_sort([k FOR k IN w.kinds IF h.kinds IS NULL OR NOT list_contains(h.kinds, k)]) AS m FROM want w LEFT JOIN have h USING (nation)) WHERE len(m) > 0""")
def coverage_gaps(spark: SparkSession, d: str) -> DataFrame:
    want = table(spark, d, "nation", ["n_nationkey"]).select(F.col("n_nationkey").alias("nation"), F.array(*map(F.lit, ("small", "large", "debt"))).alias("want"))
    kind = F.when(F.col("s_acctbal") < 0, "debt").when(F.col("s_acctbal") < 5000, "small").otherwise("large")
    have = table(spark, d, "supplier", ["s_nationkey", "s_acctbal"]).groupBy(F.col("s_nationkey").alias("nation")).agg(F.collect_set(kind).alias("have"))
    return aggregates.gaps(want, have, "nation", "want", "have").select("nation", F.array_join("missing", ",").alias("missing"))


@query("SELECT o_orderpriority AS band, count(*) AS units, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS weight, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_units, min(o_orderkey) AS first_order FROM orders GROUP BY 1")
def band_rollup(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders", ["o_orderkey", "o_orderpriority", "o_totalprice", "o_orderstatus"])
    return aggregates.bands(orders, F.col("o_orderpriority"), F.round(F.col("o_totalprice") * 100).cast("long"), F.col("o_orderstatus") == "O", F.col("o_orderkey"))


@query("SELECT node, count(*) AS degree FROM (SELECT 'p' || l_partkey AS node FROM lineitem UNION ALL SELECT 's' || l_suppkey FROM lineitem) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
def max_degree(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "lineitem", ["l_partkey", "l_suppkey"]).select(F.concat(F.lit("p"), "l_partkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"))
    return aggregates.max_degree(edges, "source", "target")


@query("SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.duplicates(table(spark, d, "lineitem", ["l_orderkey", "l_partkey"]), ["l_orderkey", "l_partkey"])


@query("SELECT l_orderkey, count(*) AS facts, string_agg(DISTINCT l_returnflag || ':' || l_linestatus, ',' ORDER BY l_returnflag || ':' || l_linestatus) AS contributors FROM lineitem GROUP BY 1")
def lineage_report(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.lineage(table(spark, d, "lineitem", ["l_orderkey", "l_returnflag", "l_linestatus"]), "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 3")
def repeated_patterns(spark: SparkSession, d: str) -> DataFrame:
    return aggregates.repeated(table(spark, d, "events", ["user_id", "event_type"]), ["user_id", "event_type"], 3)


@query("""
SELECT source, doc_id, n_chars, place, CAST(running AS BIGINT) AS running FROM (SELECT source, doc_id, n_chars, row_number() OVER w AS place, sum(n_chars) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents WINDOW w AS (PARTITION BY source ORDER BY n_chars DESC, doc_id))
WHERE running <= 50000 OR place = 1""")
def priority_budget(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["source", "doc_id", "n_chars"])
    return aggregates.budgeted_prefix(docs, ["source"], [F.desc("n_chars"), F.asc("doc_id")], "n_chars", 50_000)


# --- differences --------------------------------------------------------------------------------------------------


@query("""
WITH a AS (SELECT c_custkey, c_mktsegment AS seg, CAST(floor(c_acctbal / 1000) AS BIGINT) AS bal FROM customer), b AS (SELECT CASE WHEN c_acctbal < 0 THEN -c_custkey ELSE c_custkey END AS c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'MOVED' ELSE c_mktsegment END AS seg, CAST(floor(c_acctbal / 1000) AS BIGINT) + (c_custkey % 5 = 0)::INT AS bal FROM customer),
j AS (SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN a.c_custkey IS NULL THEN 'added' WHEN b.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS change, concat_ws(',', CASE WHEN a.bal IS DISTINCT FROM b.bal THEN 'bal' END, CASE WHEN a.seg IS DISTINCT FROM b.seg THEN 'seg' END) AS f FROM a FULL JOIN b ON a.c_custkey = b.c_custkey)
SELECT c_custkey, change, CASE WHEN change = 'changed' THEN f ELSE '' END AS changed_fields FROM j WHERE change <> 'changed' OR f <> ''""")
def entity_drift(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", ["c_custkey", "c_mktsegment", "c_acctbal"]).withColumn("bal", F.floor(F.col("c_acctbal") / 1000).cast("long"))
    k = F.col("c_custkey")
    old = c.select("c_custkey", "bal", F.col("c_mktsegment").alias("seg"))
    # Customers in debt were given new keys.
    new = c.select(F.when(F.col("c_acctbal") < 0, -k).otherwise(k).alias("c_custkey"), (F.col("bal") + (k % 5 == 0).cast("int")).alias("bal"), F.when(k % 7 == 0, "MOVED").otherwise(F.col("c_mktsegment")).alias("seg"))
    return diff.drift(old, new, "c_custkey", ["bal", "seg"])


@query("""
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS v, lead(json_extract_string(props, '$.k')) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS w, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events)
SELECT event_id, 'k' AS path, 'value' AS change, v AS old_value, w AS new_value FROM e WHERE nxt IS NOT NULL AND v IS NOT NULL AND w IS NOT NULL AND v <> w""")
def json_delta(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events", ["event_id", "user_id", "ts", "props"])
    ahead = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = events.withColumn("next", F.lead("props").over(ahead)).where("next IS NOT NULL")

    def leaves(column: str) -> DataFrame:
        return json_pairs(pairs, ["event_id"], column).select("event_id", F.col("key").alias("path"), F.lit("scalar").alias("json_type"), "value")

    return diff.leaf_delta(leaves("props"), leaves("next"), ["event_id"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    customers = table(spark, d, "customer", ["c_custkey", "c_mktsegment"]).where("c_mktsegment <> 'BUILDING'")
    return diff.dangling(table(spark, d, "orders", ["o_orderkey", "o_custkey"]), customers, "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("""
WITH p AS (SELECT l_orderkey AS k, list(DISTINCT l_returnflag) AS have FROM lineitem GROUP BY 1)
SELECT o_orderkey AS k, m AS missing FROM (SELECT o_orderkey, unnest(CASE WHEN p.have IS NULL THEN ['<unknown>'] ELSE [x FOR x IN ['A', 'N'] IF NOT list_contains(p.have, x)] END) AS m FROM orders LEFT JOIN p ON p.k = o_orderkey WHERE o_orderstatus = 'F')""")
def revalidate_targets(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "orders", ["o_orderkey", "o_orderstatus"]).where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.array(F.lit("A"), F.lit("N")).alias("need"))
    known = table(spark, d, "lineitem", ["l_orderkey", "l_returnflag"]).groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_set("l_returnflag").alias("have"))
    return diff.revalidate(targets, known, "k", "need", "have")


#: End of a changed path, JSON of the old and the new value, and the class of the change.
CHANGES = (
    (".metadata.designer.x", "1", "2", "designer-layout"), (".mapper", None, '{"Designer":1}', "designer-layout"), (".routes[0].label", '"a"', '"b"', "route/filter"), (".filter.name", '"{{1.a}}"', None, "route/filter"),
    (".version", "1", "2", "module-version"), (".app_version_note", '"1"', '"2"', "module-version"), (".mapper.url", '"{{1.url}}"', '"x"', "placeholder"), (".mapper.to", "1", "2", "connection"), (".module", '"a:b"', '"c:d"', "connection"),
)
#: The same for paths outside the flow.
ROOT_CHANGES = (("$.metadata", "1", "2", "metadata"), ("$.metadata.version_note", "1", "2", "metadata"), ("$.metadata.notes.a", "1", "2", "designer-layout"), ("$.schedule.kind", "1", "2", "semantic"), ("$.parameters.x", None, "3", "semantic"), ("$.other", "[1]", "[2]", "unknown"))
_CHANGES = [("$.flow[{}]" + e, a, b, c) for e, a, b, c in CHANGES] + list(ROOT_CHANGES)


def _sql_text(x: str | None) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'"


@query(f"""
WITH c(n, path, before, after, change_class) AS (VALUES {", ".join(f"({n}, {_sql_text(p)}, {_sql_text(a)}, {_sql_text(b)}, '{c}')" for n, (p, a, b, c) in enumerate(_CHANGES))})
SELECT p_partkey, replace(path, '{{}}', CAST(p_partkey AS VARCHAR)) AS path, change_class FROM part JOIN c ON n = p_partkey % {len(_CHANGES)}""")
def classified_changes(spark: SparkSession, d: str) -> DataFrame:
    n = (F.col("p_partkey") % len(_CHANGES) + 1).cast("int")
    path, before, after = (F.element_at(F.array(*[F.lit(c[k]) for c in _CHANGES]), n) for k in range(3))
    part = table(spark, d, "part", ["p_partkey"]).withColumn("path", F.replace(path, F.lit("{}"), F.col("p_partkey").cast("string")))
    return part.select("p_partkey", "path", diff.classify(F.col("path"), before, after).alias("change_class"))


# --- graphs -------------------------------------------------------------------------------------------------------


@query("SELECT p_brand AS kind, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g')) AS key, min(p_partkey) AS node_id, max(p_retailprice) AS confidence, count(*) AS sources FROM part GROUP BY 1, 2")
def graph_dedup(spark: SparkSession, d: str) -> DataFrame:
    return graph.dedup_nodes(table(spark, d, "part", ["p_brand", "p_type", "p_partkey", "p_retailprice"]), "p_brand", "p_type", "p_partkey", "p_retailprice")


@query("""
SELECT kind, source, target, confidence, evidence, CASE WHEN amb = 1 THEN 'ambiguous' WHEN confidence < 70 THEN 'low_confidence' ELSE 'promoted_candidate' END AS status FROM (SELECT l_returnflag AS kind, l_suppkey AS source, l_partkey AS target, max(l_quantity * 2) AS confidence, count(*) AS evidence, max(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS amb FROM lineitem GROUP BY 1, 2, 3)""")
def edge_merge(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", ["l_returnflag", "l_suppkey", "l_partkey", "l_quantity", "l_tax"])
    return graph.merge_edges(lines.select(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), (F.col("l_quantity") * 2).alias("confidence"), (F.col("l_tax") > 0.07).alias("ambiguous")))


def _places(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    region, nation, supplier = table(spark, d, "region"), table(spark, d, "nation"), table(spark, d, "supplier", ["s_suppkey", "s_name", "s_nationkey"])
    nodes = (
        region.select(F.lit("region").alias("kind"), F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_name").alias("label"))
        .unionByName(nation.select(F.lit("nation").alias("kind"), F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("label")))
        .unionByName(supplier.select(F.lit("supplier").alias("kind"), F.concat(F.lit("s"), "s_suppkey").alias("node"), F.col("s_name").alias("label")))
    )
    edges = nation.select(F.lit("in_region").alias("kind"), F.concat(F.lit("n"), "n_nationkey").alias("source"), F.concat(F.lit("r"), "n_regionkey").alias("target")).unionByName(
        supplier.select(F.lit("in_nation").alias("kind"), F.concat(F.lit("s"), "s_suppkey").alias("source"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    )
    return nodes, edges


EDGES = "(SELECT 'in_region' AS kind, 'n' || n_nationkey AS source, 'r' || n_regionkey AS target FROM nation UNION ALL SELECT 'in_nation', 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"
NODES = "(SELECT 'region' AS kind, 'r' || r_regionkey AS node, r_name AS label FROM region UNION ALL SELECT 'nation', 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 'supplier', 's' || s_suppkey, s_name FROM supplier)"


@query(f"SELECT kind, source AS node, target AS other, 'out' AS direction FROM {EDGES} WHERE source IN ('n3', 'n7') UNION ALL SELECT kind, target, source, 'in' FROM {EDGES} WHERE target IN ('n3', 'n7')")
def node_expansion(spark: SparkSession, d: str) -> DataFrame:
    return graph.expand(_places(spark, d)[1], ["n3", "n7"])


@query(f"SELECT e.kind, e.source, e.target, a.label AS source_label, b.label AS target_label FROM {EDGES} e LEFT JOIN {NODES} a ON a.node = e.source LEFT JOIN {NODES} b ON b.node = e.target")
def edge_endpoints(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _places(spark, d)
    return graph.with_endpoints(edges, nodes, "node", "label").select("kind", "source", "target", "source_label", "target_label")


@query(f"SELECT 'node' AS what, kind, count(*) AS n FROM {NODES} GROUP BY 2 UNION ALL SELECT 'edge', kind, count(*) FROM {EDGES} GROUP BY 2")
def graph_overview(spark: SparkSession, d: str) -> DataFrame:
    return graph.overview(*_places(spark, d))


@query("""
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS s, l_suppkey AS t FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT s AS x FROM e INTERSECT SELECT t FROM e), i AS (SELECT e.* FROM e JOIN n ON n.x = e.s JOIN n m ON m.x = e.t),
fw AS (SELECT s AS root, t AS x FROM i UNION SELECT fw.root, i.t FROM fw JOIN i ON i.s = fw.x), cyc AS (SELECT DISTINCT root AS c FROM fw WHERE root = x)
SELECT c AS node FROM cyc UNION SELECT a.x FROM fw a JOIN cyc ON a.root = cyc.c JOIN fw b ON b.root = a.x JOIN cyc c2 ON c2.c = b.x""")
def cycle_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Keys of returned lines, as a graph from part to supplier key: nodes on cycles, or on a way from one to another. No node outside both ends can be one."""
    from ..operators.shared import checkpointed

    checkpointed(spark)
    lines = table(spark, d, "lineitem", ["l_partkey", "l_suppkey", "l_returnflag"]).where("l_returnflag = 'R'")
    return graph.on_cycles(lines.select(F.col("l_partkey").alias("source"), F.col("l_suppkey").alias("target")))


@query("""
WITH p AS (SELECT conv_id, role, min(turn) AS pos FROM conversations GROUP BY 1, 2), g AS (SELECT conv_id % 20 AS grp, conv_id, role, pos FROM p),
h AS (SELECT grp, role, count(DISTINCT conv_id) AS paths FROM g GROUP BY 1, 2), q AS (SELECT a.grp, a.role, b.role AS earlier, count(DISTINCT a.conv_id) AS n FROM g a JOIN g b ON a.conv_id = b.conv_id AND b.pos < a.pos GROUP BY 1, 2, 3)
SELECT q.grp, q.role AS node_id, q.earlier FROM q JOIN h ON h.grp = q.grp AND h.role = q.role WHERE q.n = h.paths""")
def path_availability(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "conversations", ["conv_id", "turn", "role"]).groupBy("conv_id", "role").agg(F.min("turn").alias("pos"))
    paths = steps.select((F.col("conv_id") % 20).alias("grp"), F.col("conv_id").alias("path_id"), "pos", F.col("role").alias("node_id"))
    return graph.available_before(paths, ["grp"])


BOXES = "(SELECT s_nationkey AS g, s_suppkey AS node, CAST((s_suppkey * 37) % 400 AS DOUBLE) AS x, CAST((s_suppkey * 91) % 300 AS DOUBLE) AS y FROM supplier)"


@query(f"SELECT a.g, a.node AS a, b.node AS b FROM {BOXES} a JOIN {BOXES} b ON a.g = b.g AND a.node < b.node AND abs(a.x - b.x) < 120 AND abs(a.y - b.y) < 80")
def layout_overlaps(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier", ["s_nationkey", "s_suppkey"])
    boxes = s.select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("node"), ((F.col("s_suppkey") * 37) % 400).cast("double").alias("x"), ((F.col("s_suppkey") * 91) % 300).cast("double").alias("y"))
    return graph.overlaps(boxes, ["g"], 120.0, 80.0)


@query("SELECT n_regionkey AS g, n_nationkey AS node, (n_nationkey % 3) * 300 AS x, CAST((row_number() OVER (PARTITION BY n_regionkey, n_nationkey % 3 ORDER BY n_nationkey) - 1) * 150 AS INTEGER) AS y FROM nation")
def layout_plan(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", ["n_regionkey", "n_nationkey"]).select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("node"), (F.col("n_nationkey") % 3).alias("depth"))
    return graph.layout(n, ["g"]).select("g", "node", "x", "y")


# --- rules --------------------------------------------------------------------------------------------------------


def _rules_sql(rows: str, ids: str, text: str, found: tuple[rules.Rule, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {ids}, '{r.code}' AS code, '{r.severity}' AS severity FROM {rows} WHERE regexp_matches({text}, '{r.pattern.replace(chr(39), chr(39) * 2)}')" for r in found)


#: Invented strings that the text rules look for, and some that they must let pass; one stands at the end of each document's text.
SAMPLES = (
    "AKIA" + "ABCD" * 4, "AKIA too short", "Authorization: Bearer " + "abcd." * 4, "-----BEGIN RSA " + "PRIVATE KEY-----", "ghp_" + "a1B2" * 5, "Password = hunter22", "secret: no", "; DROP TABLE x", "Union All Select 1", "select * from t", "DELETE FROM t;", "delete from t where a",
    "update {{1.a}}", "the MD5 of it", "md52", "in ECB mode", "TODO: more", "todo", "a Passwort", "__schema { types }", "mutation AddItem {", "mutation of it", "call +49 170 555-1234", "4111-1111-1111-1111", "123-45-6789", "nothing",
)
_ENDED = f"(SELECT doc_id, text || ' ' || s AS text FROM documents JOIN (VALUES {', '.join(f'({k}, {s!r})' for k, s in enumerate(SAMPLES))}) v(k, s) ON k = doc_id % {len(SAMPLES)})"


def _document_findings(found: tuple[rules.Rule, ...]):
    def run(spark: SparkSession, d: str) -> DataFrame:
        end = F.element_at(F.array(*map(F.lit, SAMPLES)), (F.col("doc_id") % len(SAMPLES) + 1).cast("int"))
        docs = table(spark, d, "documents", ["doc_id", "text"]).withColumn("text", F.concat("text", F.lit(" "), end))
        return rules.findings(docs, ["doc_id"], "text", found)

    return run


for _name, _family in (("pii_findings", rules.DATA_EXPOSURE), ("secret_findings", rules.SECRETS), ("sql_findings", rules.SQL), ("crypto_findings", rules.CRYPTO), ("note_findings", rules.NOTES), ("graphql_findings", rules.GRAPHQL)):
    QUERIES[_name] = _document_findings(_family)
    ORACLE_SQL[_name] = _rules_sql(_ENDED, "doc_id", "text", _family)


@query(_rules_sql("pages", "page_id", "url", rules.URLS + rules.REDIRECT))
def url_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.findings(table(spark, d, "pages", ["page_id", "url"]), ["page_id"], "url", rules.URLS + rules.REDIRECT)


@query(_rules_sql("pages", "page_id", "html", rules.CONTENT))
def html_findings(spark: SparkSession, d: str) -> DataFrame:
    return rules.findings(table(spark, d, "pages", ["page_id", "html"]), ["page_id"], "html", rules.CONTENT)


ALL_DOC_RULES = rules.DATA_EXPOSURE + rules.SECRETS + rules.SQL


@query(f"""
WITH f AS ({_rules_sql("documents", "source", "text", ALL_DOC_RULES)}), s AS (SELECT source, count(*) AS findings, CAST(sum(CASE WHEN severity = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error, CAST(sum(CASE WHEN severity = 'warning' THEN 1 ELSE 0 END) AS BIGINT) AS warning, CAST(sum(CASE WHEN severity = 'info' THEN 1 ELSE 0 END) AS BIGINT) AS info FROM f GROUP BY 1)
SELECT *, error = 0 AS passed FROM s""")
def phase_gates(spark: SparkSession, d: str) -> DataFrame:
    found = rules.findings(table(spark, d, "documents", ["source", "text"]), ["source"], "text", ALL_DOC_RULES)
    return aggregates.severity_summary(found, ["source"], ["error", "warning", "info"])


@query("""
SELECT 'allowed' AS audit, event_type AS value, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY 2
UNION ALL SELECT 'pattern', o_orderpriority, count(*) FROM orders WHERE NOT regexp_full_match(o_orderpriority, '[12]-[A-Z]+') GROUP BY 2
UNION ALL SELECT 'json_key', k, count(*) FROM (SELECT unnest(json_keys(props)) AS k FROM events) WHERE k NOT IN ('allowed') GROUP BY 2
UNION ALL SELECT 'json_array', v, count(*) FROM (SELECT unnest(CASE CAST(event_id % 5 AS INTEGER) WHEN 0 THEN [event_type] WHEN 1 THEN ['<non_array_json>'] WHEN 2 THEN ['<invalid_json>'] WHEN 3 THEN ['<non_text_value>', '<non_text_value>', 'click'] ELSE [] END) AS v FROM events) WHERE v <> 'click' GROUP BY 2""")
def value_violations(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events", ["event_id", "event_type", "props"])
    texts = (F.concat(F.lit('["click", "'), "event_type", F.lit('"]')), F.lit('{"a": 1}'), F.lit("not json"), F.lit('[1, " ", "click"]'), F.lit(None).cast("string"))
    arrays = events.select(F.element_at(F.array(*texts), (F.col("event_id") % len(texts) + 1).cast("int")).alias("items"))
    parts = {
        "allowed": rules.allowed_violations(events, "event_type", ["click", "view"]),
        "pattern": rules.pattern_violations(table(spark, d, "orders", ["o_orderpriority"]), "o_orderpriority", "[12]-[A-Z]+"),
        "json_key": rules.json_key_violations(events, "props", ["allowed"]),
        "json_array": rules.json_array_violations(arrays, "items", ["click"]),
    }
    return rules.report([v.select(F.lit(k).alias("audit"), "value", "n") for k, v in parts.items()])


@query("""
WITH t AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS token FROM part), m AS (SELECT lower(split_part(p_type, ' ', 1)) AS token, count(*) AS n FROM (SELECT DISTINCT p_type FROM part) GROUP BY 1)
SELECT t.token, CASE WHEN m.n IS NULL THEN 'unknown' WHEN m.n = 1 THEN 'known' ELSE 'ambiguous' END AS status FROM t LEFT JOIN m ON m.token = t.token
UNION ALL SELECT lower(split_part(p_type, ' ', 1)) || '!' AS token, 'unknown' FROM (SELECT DISTINCT split_part(p_type, ' ', 1) AS p_type FROM part)""")
def token_resolution(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", ["p_name", "p_type"])
    first = F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))
    tokens = part.select(F.explode(F.split("p_name", " ")).alias("token")).unionByName(part.select(F.concat(first, F.lit("!")).alias("token"))).distinct()
    return rules.resolve(tokens, part.select("p_type").distinct().select(first.alias("key")), "token", "key").select("token", "status")


@query("SELECT DISTINCT d.doc_id, d.lang FROM documents d JOIN labels l ON l.doc_id = d.doc_id WHERE l.toxic = 1 AND l.quality = 1")
def semi_search(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").where("toxic = 1 AND quality = 1").select("doc_id")
    return table(spark, d, "documents", ["doc_id", "lang"]).join(labels, "doc_id", "left_semi").distinct()


_REDACT_SQL = "text"
for _r in (*rules.DATA_EXPOSURE, *rules.SECRETS):
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_r.pattern}', '<{_r.code.lower()}>', 'g')"


@query(f"SELECT doc_id, sha256({_REDACT_SQL}) AS redacted FROM documents")
def redaction(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", ["doc_id", "text"]).select("doc_id", F.sha2(rules.redact(F.col("text")), 256).alias("redacted"))


@query("""
SELECT 'contains (case insensitive)' AS operator, count(*) AS n FROM part WHERE contains(lower(p_name), 'green') UNION ALL SELECT 'not equal to', count(*) FROM part WHERE p_brand <> 'Brand#13' UNION ALL SELECT 'text:equal:ci', count(*) FROM part WHERE lower(p_brand) = 'brand#13'
UNION ALL SELECT 'number:greaterorequal', count(*) FROM part WHERE p_size >= 25 UNION ALL SELECT 'lt', count(*) FROM part WHERE p_size < 9 UNION ALL SELECT 'exists', count(*) FROM part WHERE p_type IS NOT NULL""")
def route_filters(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part")
    asked = (("Contains (case insensitive) ", "p_name", "GREEN"), ("not equal to", "p_brand", "Brand#13"), ("text:equal:ci", "p_brand", "BRAND#13"), ("number:greaterorequal", "p_size", "25"), ("lt", "p_size", "9"), ("exists", "p_type", None))
    tests = {o.strip().lower(): rules.filter_condition(o, F.col(a), None if b is None else F.lit(b)) for o, a, b in asked}
    sums = part.agg(*[F.sum(c.cast("int")).cast("long").alias(k) for k, c in tests.items()])
    return sums.unpivot([], list(tests), "operator", "n")


# --- search -------------------------------------------------------------------------------------------------------

TERMS = ("and", "the", "idiot")


def _score_sql(name: str, fields: list[str], terms: tuple[str, ...]) -> str:
    both = " || ' ' || ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields)
    t = [f"CASE WHEN lower({name}) = '{x}' THEN 30 WHEN list_contains(regexp_extract_all(lower({name}), '[a-z0-9]+'), '{x}') THEN 20 WHEN list_contains(regexp_extract_all(lower({both}), '[a-z0-9]+'), '{x}') THEN 12 WHEN contains(lower({name}), '{x}') THEN 6 ELSE 0 END" for x in terms]
    return " + ".join(t)


@query(f"SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (SELECT doc_id, {_score_sql('text', ['lang', 'source'], ('idiot', 'clown', 'en'))} AS score FROM documents) WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20")
def doc_search(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", ["doc_id", "text", "lang", "source"])
    return search.rank(search.score(docs, ["idiot", "clown", "en"], "text", ["lang", "source"]).select("doc_id", "score"), [F.desc("score"), F.asc("doc_id")], 20).withColumn("place", F.col("place").cast("long"))


@query(f"""
SELECT p_partkey, score FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_partkey) AS own FROM (SELECT p_partkey, p_brand, {_score_sql('p_name', ['p_type', 'p_brand'], ('green', 'steel', 'brand'))} AS score FROM part) WHERE score > 0) WHERE own <= 3 ORDER BY score DESC, p_partkey LIMIT 24""")
def module_search(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    found = search.score(part, ["green", "steel", "brand"], "p_name", ["p_type", "p_brand"])
    return search.rank(found, [F.desc("score"), F.asc("p_partkey")], 24, diversity="p_brand").select("p_partkey", "score")


@query("SELECT p_partkey, hits FROM (SELECT p_partkey, contains(lower(p_name), 'green')::INT + contains(lower(p_name), 'steel')::INT + contains(lower(p_name), 'small')::INT AS hits FROM part) WHERE hits > 0 AND hits = (SELECT max(contains(lower(p_name), 'green')::INT + contains(lower(p_name), 'steel')::INT + contains(lower(p_name), 'small')::INT) FROM part)")
def text_search(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", ["p_partkey", "p_name"])
    return search.top_term_hits(part, F.col("p_name"), ["green", "steel", "small"]).select("p_partkey", "hits")


@query("""
WITH w AS (SELECT p_partkey, [x FOR x IN regexp_extract_all(lower(p_name || ' for the ' || p_type), '[a-z0-9_:.+-]+') IF length(x) >= 2 AND x NOT IN ('a', 'an', 'and', 'for', 'in', 'make', 'module', 'of', 'or', 'the', 'to', 'with')] AS t FROM part),
u AS (SELECT p_partkey, [x FOR x, i IN t IF list_position(t, x) = i] AS t FROM w) SELECT p_partkey, array_to_string(t[1:4], ' ') AS terms FROM u""")
def query_terms(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part", ["p_partkey", "p_name", "p_type"])
    return part.select("p_partkey", F.array_join(search.query_terms(F.concat_ws(" for the ", "p_name", "p_type"), 4), " ").alias("terms"))


@query("SELECT event_type, count(*) AS found, CASE WHEN count(*) > 1500 THEN 'limit 1500' ELSE 'none' END AS truncated FROM events GROUP BY 1")
def truncation_report(spark: SparkSession, d: str) -> DataFrame:
    counted = table(spark, d, "events", ["event_type"]).groupBy("event_type").agg(F.count("*").alias("found"))
    return counted.withColumn("truncated", search.truncation(F.col("found"), 1500))


#: Signals of a graph candidate (in graph_score's order) and its score.
CANDIDATES = (
    ((2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0), 29), ((1, 0, 1, 1, 0, 0, 1, 1, 1, 0, 0, 0, 0), 143), ((0, 0, 0, 0, 0, 0, 3, 2, 2, 0, 0, 0, 0), 345), ((9, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0), -15), ((9, 0, 0, 0, 0, 0, 1, 0, 2, 0, 1, 1, 0), -180),
    ((0, 0, 0, 0, 2, 0, 1, 0, 0, 1, 0, 0, 0), 60), ((0, 0, 0, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0), -64), ((0, 0, 0, 3, 0, 2, 0, 0, 0, 0, 0, 0, 0), 166), ((0, 0, 0, 3, 0, 2, 0, 0, 0, 1, 0, 0, 0), -64), ((0, 2, 0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 1), -20),
)


@query(f"SELECT p_partkey, relevance FROM part JOIN (VALUES {', '.join(f'({k}, {score})' for k, (_, score) in enumerate(CANDIDATES))}) v(k, relevance) ON k = p_partkey % {len(CANDIDATES)}")
def graph_relevance(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("p_partkey") % len(CANDIDATES) + 1).cast("int")
    signal = [F.element_at(F.array(*[F.lit(c[n]) for c, _ in CANDIDATES]), k) for n in range(13)]
    return table(spark, d, "part", ["p_partkey"]).select("p_partkey", search.graph_score(*signal[:9], *[s == 1 for s in signal[9:]]).cast("int").alias("relevance"))


# --- queues and estimates -----------------------------------------------------------------------------------------


def _units(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority", "o_custkey"])
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "leased").otherwise("completed")
    leased = F.col("o_orderstatus") == "F"
    return o.select(F.col("o_orderkey").alias("unit_id"), status.alias("status"), F.col("o_orderpriority").alias("priority"), F.when(leased, F.concat(F.lit("w"), F.col("o_custkey") % 3)).alias("lease_owner"), F.when(leased, F.col("o_custkey") % 100).alias("lease_expires_at"))


UNITS = "(SELECT o_orderkey AS unit_id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'leased' ELSE 'completed' END AS status, o_orderpriority AS priority, CASE WHEN o_orderstatus = 'F' THEN 'w' || (o_custkey % 3) END AS lease_owner, CASE WHEN o_orderstatus = 'F' THEN o_custkey % 100 END AS lease_expires_at FROM orders)"


@query(f"SELECT u.unit_id, CASE WHEN p.unit_id IS NOT NULL THEN 'leased' ELSE u.status END AS status, CASE WHEN p.unit_id IS NOT NULL THEN 'w9' ELSE u.lease_owner END AS lease_owner FROM {UNITS} u LEFT JOIN (SELECT unit_id FROM {UNITS} WHERE status = 'queued' ORDER BY priority, unit_id LIMIT 50) p ON p.unit_id = u.unit_id")
def lease_next(spark: SparkSession, d: str) -> DataFrame:
    return queue.lease(_units(spark, d), [F.asc("priority"), F.asc("unit_id")], 50, "w9", F.lit(500).cast("long")).select("unit_id", "status", "lease_owner")


@query(f"SELECT unit_id, CASE WHEN status = 'leased' AND lease_expires_at < 40 THEN 'queued' ELSE status END AS status, CASE WHEN NOT (status = 'leased' AND lease_expires_at < 40) THEN lease_owner END AS lease_owner FROM {UNITS}")
def reclaim_expired(spark: SparkSession, d: str) -> DataFrame:
    return queue.reclaim(_units(spark, d), F.lit(40)).select("unit_id", "status", "lease_owner")


@query(f"SELECT unit_id FROM {UNITS} WHERE status = 'completed' AND unit_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def repair_stranded(spark: SparkSession, d: str) -> DataFrame:
    outputs = table(spark, d, "lineitem", ["l_orderkey", "l_returnflag"]).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("unit_id"))
    return queue.stranded(_units(spark, d), outputs).select("unit_id")


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN status = 'leased' AND lease_owner = 'w1' THEN 'completed' ELSE status END AS status FROM {UNITS}) GROUP BY 1")
def save_batch(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    outputs = units.where("status = 'leased' AND lease_owner = 'w1'").select("unit_id")
    return queue.save_batch(units, outputs, "w1").groupBy("status").agg(F.count("*").alias("n"))


@query(f"SELECT unit_id, row_number() OVER (ORDER BY priority, unit_id DESC) AS place FROM {UNITS}")
def priority_order(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.shared import checkpointed

    checkpointed(spark)
    return queue.priority_order(_units(spark, d).select("unit_id", "priority"), [F.asc("priority"), F.desc("unit_id")]).select("unit_id", "place")


@query("""
SELECT o_orderkey, CASE CAST(o_custkey % 4 AS INTEGER) WHEN 0 THEN 48 WHEN 1 THEN 12 WHEN 2 THEN 1 ELSE 1 END AS runs, (CASE CAST(o_custkey % 4 AS INTEGER) WHEN 0 THEN 48 WHEN 1 THEN 12 WHEN 2 THEN 1 ELSE 1 END) * n AS operations FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def op_estimate(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("30 minutes", "2 hours", "3 days", "at noon"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    n = table(spark, d, "lineitem", ["l_orderkey"]).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    rows = table(spark, d, "orders", ["o_orderkey", "o_custkey"]).join(n, "o_orderkey")
    return rows.withColumn("runs", estimate.runs(F.lit(24.0), estimate.cadence_minutes(text))).select("o_orderkey", F.col("runs").cast("int").alias("runs"), (F.col("runs") * F.col("n")).alias("operations"))


@query("""
WITH o AS (SELECT o_orderkey AS k, CAST(floor(o_totalprice * 100) AS BIGINT) AS gross, o_orderstatus AS st, CAST(o_custkey AS BIGINT) AS c FROM orders)
SELECT k, CASE WHEN c % 5 = 0 THEN 0 WHEN c % 7 = 0 OR c % 11 = 0 THEN gross ELSE 0 END AS refund_cents,
CASE WHEN c % 5 = 0 THEN 'provider_refund_or_chargeback_recorded' WHEN c % 7 = 0 OR c % 11 = 0 THEN 'duplicate_charge_or_fault' WHEN st <> 'O' OR c % 3 = 0 THEN 'delivery_or_customer_review_started' ELSE 'no_refund_trigger' END AS refund_reason,
CASE WHEN c % 4 = 0 OR c % 13 = 0 OR gross - 1000 - c * 10 <= 0 THEN 0 ELSE (gross - 1000 - c * 10) * CASE WHEN c % 6 = 0 THEN 25 WHEN st = 'F' THEN 90 ELSE 50 END // 100 END AS initial_cents,
CASE WHEN c % 4 = 0 OR c % 13 = 0 OR gross - 1000 - c * 10 <= 0 THEN 0 ELSE (c + c + 1 + c + 2) * 25 // 100 END AS recurring_cents,
CASE WHEN c % 17 = 0 THEN 'requires_additional_scenario_order' WHEN c % 13 = 0 THEN 'requires_custom_tool_order' WHEN c % 11 = 0 OR c % 7 = 0 OR c % 5 = 0 THEN 'requires_major_change_order' WHEN c % 3 = 0 THEN 'requires_extra_standard_change_order'
WHEN c % 2 = 0 THEN 'included_standard_change' WHEN c % 19 > 9 THEN 'paid_extra_standard_change' ELSE 'requires_extra_standard_change_order' END AS change_order,
CASE WHEN c % 2 = 0 AND c % 5 >= 3 AND c % 9 >= 3 AND c % 3 >= 2 AND c % 7 >= 2 AND (c % 6 > 0 OR st <> 'F') THEN 'corpus_confirmed' WHEN c % 2 = 0 AND c % 5 >= 2 AND c % 3 >= 1 AND (c % 9 >= 1 OR st = 'O') THEN 'high' WHEN c % 2 = 0 AND c % 5 >= 1 THEN 'medium' ELSE 'low' END AS confidence
FROM o""")
def policy_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Decisions over facts made of each order's numbers."""
    orders = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"])
    o = orders.select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_totalprice") * 100).alias("gross"), F.col("o_orderstatus").alias("st"), F.col("o_custkey").cast("long").alias("c"))
    c, st = F.col("c"), F.col("st")
    refund = estimate.refund_decision(F.col("gross"), st != "O", c % 3 == 0, c % 7 == 0, c % 11 == 0, c % 5 == 0)
    cancelling = [F.when(c % 4 == 0, 500).otherwise(0)]
    reward = estimate.referral_reward(F.col("gross"), [F.lit(1000), c * 10], cancelling, c % 13 != 0, c % 6 == 0, st == "F", F.array(c, c + 1, c + 2, c + 99))
    order = estimate.change_order(c % 17 == 0, c % 13 == 0, c % 11 == 0, c % 7 != 0, c % 5 != 0, c % 3 != 0, c % 2 == 0, F.greatest(F.lit(0), c % 19 - 9))
    sure = estimate.parity_confidence(c % 5, c % 9, c % 2 == 0, c % 3, c % 6, c % 7, st == "O", st == "F")
    return o.select("k", refund["refund_cents"].alias("refund_cents"), refund["reason"].alias("refund_reason"), reward["initial_cents"].alias("initial_cents"), reward["recurring_cents"].alias("recurring_cents"), order.alias("change_order"), sure.alias("confidence"))


# --- expression palette and dataflow modules ----------------------------------------------------------------------


@query("""
SELECT p_partkey, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS capitalized, substr(p_name, 3, 4) AS middle, instr(p_name, 'e') - 1 AS at, md5(p_name) AS m, sha256(p_type) AS s, base64(encode(p_brand)) AS b,
array_to_string(list_reverse(string_split(p_name, ' ')), '-') AS turned, replace(replace(p_type, '&', '&amp;'), '<', '&lt;') AS escaped, coalesce(nullif(p_brand, ''), 'none') AS brand, regexp_extract(p_type, '[A-Z]+$', 0) AS word FROM part""")
def palette_text(spark: SparkSession, d: str) -> DataFrame:
    n, t, b = F.col("p_name"), F.col("p_type"), F.col("p_brand")
    return table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand"]).select(
        "p_partkey", call("capitalize", n).alias("capitalized"), call("substring", n, F.lit(2), F.lit(6)).alias("middle"), call("indexOf", n, F.lit("e")).cast("long").alias("at"), call("md5", n).alias("m"), call("sha256", t).alias("s"),
        call("base64", b).alias("b"), call("join", call("reverse", call("split", n, F.lit(" "))), "-").alias("turned"), call("escapeHTML", t).alias("escaped"), call("ifempty", b, F.lit("none")).alias("brand"), call("match", t, "[A-Z]+$").alias("word"),
    )


@query("""
WITH q AS (SELECT l_orderkey, list(CAST(l_quantity AS DOUBLE) ORDER BY l_linenumber, l_quantity) AS a FROM lineitem GROUP BY 1)
SELECT l_orderkey, list_sum(a) AS total, round(list_avg(a), 6) AS average, list_median(a) AS middle, list_max(a) AS high, list_min(a) AS low, round(coalesce(list_stddev_pop(a), 0), 6) AS spread, a[1] AS first, a[len(a)] AS last, CAST(len(list_distinct(a)) AS BIGINT) AS kinds FROM q""")
def palette_numbers(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_quantity"])
    a = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("double").alias("q")))), lambda s: s["q"])
    rows = lines.groupBy("l_orderkey").agg(a.alias("a"))
    c = F.col("a")
    return rows.select(
        "l_orderkey", call("sum", c).alias("total"), F.round(call("average", c), 6).alias("average"), call("median", c).alias("middle"), call("max", c).alias("high"), call("min", c).alias("low"),
        F.round(call("stdevP", c), 6).alias("spread"), call("first", c).alias("first"), call("last", c).alias("last"), F.size(call("distinct", c)).cast("long").alias("kinds"),
    )


@query("SELECT o_orderkey, strftime(o_orderdate + INTERVAL 10 DAY, '%d.%m.%Y') AS later, strftime(o_orderdate + INTERVAL 2 MONTH, '%Y-%m-%d') AS months, strftime(make_timestamp(year(o_orderdate), month(o_orderdate), 1, 0, 0, 0), '%Y-%m-%d') AS first_day FROM orders")
def palette_dates(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("o_orderdate")
    first = call("setDate", t, F.lit(1))
    return table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).select(
        "o_orderkey", call("formatDate", call("addDays", t, F.lit(10)), "DD.MM.YYYY").alias("later"), call("formatDate", call("addMonths", t, F.lit(2)), "YYYY-MM-DD").alias("months"), call("formatDate", first, "YYYY-MM-DD").alias("first_day")
    )


@query("SELECT o_orderkey, string_agg(CAST(l_partkey AS VARCHAR), '|' ORDER BY l_linenumber, l_partkey) AS parts, count(*) AS bundles FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def aggregator_modules(spark: SparkSession, d: str) -> DataFrame:
    """An array aggregator followed by a text aggregator."""
    bundles = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"]).join(table(spark, d, "orders", ["o_orderkey"]), F.col("l_orderkey") == F.col("o_orderkey"))
    held = bundles.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("a"))
    return held.select("o_orderkey", F.array_join(F.transform("a", lambda s: s["l_partkey"].cast("string")), "|").alias("parts"), F.size("a").cast("long").alias("bundles"))


@query("SELECT n_nationkey, i AS bundle, i * 2 + n_nationkey AS value FROM nation, range(0, 3) t(i)")
def repeater_module(spark: SparkSession, d: str) -> DataFrame:
    """A repeater followed by a variable."""
    repeated = table(spark, d, "nation", ["n_nationkey"]).withColumn("bundle", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")))
    return repeated.withColumn("value", F.col("bundle") * 2 + F.col("n_nationkey"))


@query("SELECT event_id, key, value FROM (SELECT event_id, unnest(json_keys(props)) AS key, props FROM events), LATERAL (SELECT json_extract_string(props, '$.' || key) AS value)")
def iterator_module(spark: SparkSession, d: str) -> DataFrame:
    """An iterator over parsed JSON."""
    return json_pairs(table(spark, d, "events", ["event_id", "props"]), ["event_id"], "props")


@query("SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS size_bytes FROM documents")
def payload_manifest(spark: SparkSession, d: str) -> DataFrame:
    from ..sources.tables import manifest

    return manifest(table(spark, d, "documents", ["doc_id", "text"]), "doc_id", "text").withColumnRenamed("path", "doc_id")


@query("SELECT lang, count(*) AS units, CAST(sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS labelled, round(sum(CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS coverage FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY 1")
def label_coverage(spark: SparkSession, d: str) -> DataFrame:
    labelled = table(spark, d, "labels", ["doc_id"]).distinct().withColumn("has", F.lit(1))
    docs = table(spark, d, "documents", ["doc_id", "lang"]).join(labelled, "doc_id", "left")
    sums = docs.groupBy("lang").agg(F.count("*").alias("units"), F.sum(F.coalesce("has", F.lit(0))).cast("long").alias("labelled"))
    return sums.withColumn("coverage", F.round(aggregates.guarded_ratio(F.col("labelled"), F.col("units")), 6))


@query("SELECT DISTINCT ref FROM (SELECT unnest(regexp_extract_all(html, 'https?://[a-z0-9.-]+|href=\"/[A-Za-z]+')) AS ref FROM pages)")
def reference_extraction(spark: SparkSession, d: str) -> DataFrame:
    """Distinct references in any text."""
    return table(spark, d, "pages", ["html"]).select(F.explode(F.regexp_extract_all("html", F.lit('https?://[a-z0-9.-]+|href="/[A-Za-z]+'), F.lit(0))).alias("ref")).distinct()
