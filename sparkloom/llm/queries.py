"""The queries opN_<name> and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .chat import format_conversations
from .coder import round_trip
from .html import extract_pages
from .leaks import report_secrets
from .merkle import verify_manifest
from .minhash import near_duplicates
from .mixing import mix_sources
from .ngram import score_documents
from .packing import pack_documents
from .parsing import compare_with_next
from .pivots import near_vectors
from .quantize import hard_negatives
from .toxicity import category_labels, score_toxicity


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op5_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_read(spark, sf_dir, "documents"))


def op6_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_conversations(_read(spark, sf_dir, "conversations"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op1_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(_read(spark, sf_dir, "documents"), category_labels(_read(spark, sf_dir, "labels")))


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_read(spark, sf_dir, "documents"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(_read(spark, sf_dir, "embeddings"))


def op10_ngram_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_read(spark, sf_dir, "documents"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_next(_read(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors."""
    return hard_negatives(_read(spark, sf_dir, "embeddings"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in all documents: base patterns and literals assigned to telling names."""
    return report_secrets(_read(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of all documents; every second one is tampered with before it is verified."""
    return verify_manifest(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_toxicity": op3_toxicity,
    "op4_fingerprints": op4_fingerprints,
    "op5_coded_ids": op5_coded_ids,
    "op6_chats": op6_chats,
    "op7_mix_sources": op7_mix_sources,
    "op8_pack": op8_pack,
    "op9_near_vectors": op9_near_vectors,
    "op10_ngram_scores": op10_ngram_scores,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_secrets": op12_secrets,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: The smallest item that links reach, from {links} (a, b) and {items} (k): every item carries its own and its neighbours' names until none is new.
_REACHED = "r AS (SELECT k AS x, k AS root FROM {items} UNION SELECT e.y, r.root FROM r JOIN (SELECT a AS x, b AS y FROM {links} UNION ALL SELECT b, a FROM {links}) e ON e.x = r.x), c AS (SELECT x AS k, min(root) AS root FROM r GROUP BY 1)"

#: The preimage of a document's leaf.
_LEAF = "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

ORACLE_SQL: dict[str, str] = {
    "op2_near_duplicates": f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT doc_id AS k, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i : i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS g FROM w),
x AS (SELECT k, len(g) AS n, unnest(g) AS g FROM s), p AS (SELECT a.k AS a, b.k AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS common FROM x a JOIN x b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * common >= 75 * (n - common)), {_REACHED.format(links="l", items="s")}
SELECT s.k AS doc_id, CAST(len(g) AS BIGINT) AS n_shingles, root AS component_id, s.k = root AS kept FROM s JOIN c ON c.k = s.k""",
    "op9_near_vectors": f"""
WITH RECURSIVE v AS (SELECT vec_id AS k, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
g AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len([y FOR y IN e IF y IS NULL OR NOT isfinite(y)]) = 0 AND len([y FOR y IN e IF y <> 0]) > 0),
l AS (SELECT a.k AS a, b.k AS b FROM g a JOIN g b ON a.label = b.label AND len(a.e) = len(b.e) AND a.k < b.k WHERE list_cosine_similarity(a.e, b.e) >= 0.98), {_REACHED.format(links="l", items="v")},
n AS (SELECT k, count(*) AS n FROM (SELECT a AS k FROM l UNION ALL SELECT b FROM l) GROUP BY 1)
SELECT v.k AS vec_id, coalesce(n.n, 0) AS n_links, root AS component_id, v.k = root AS kept FROM v JOIN c ON c.k = v.k LEFT JOIN n ON n.k = v.k""",
    "op11_hard_negatives": """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * CAST(y AS DOUBLE)) FOR y IN embedding] AS e
  FROM embeddings WHERE label IS NOT NULL AND len(embedding) > 0 AND len([y FOR y IN embedding IF y IS NULL OR NOT isfinite(y)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.r AS a, b.r, b.vec_id, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score, a.label = b.label AS same FROM v a JOIN v b ON len(a.e) = len(b.e) AND a.r <> b.r WHERE a.vec_id % 100 = 0),
p AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id, r) AS place FROM s WHERE same QUALIFY place <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.place ORDER BY s.score DESC, s.vec_id, s.r) AS INTEGER) AS rank, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score QUALIFY rank <= 5""",
    # b and m: the checksum of doc_id bit by bit, t and c: the levels of sources and of their roots, q: siblings of each document and level, z: the fold.
    "op13_merkle_manifest": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS k, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g, * FROM documents),
b AS (SELECT k, CAST(doc_id AS VARCHAR) AS s, 0 AS i, 4294967295 AS c FROM d WHERE doc_id IS NOT NULL
  UNION ALL SELECT k, s, i + 1, xor(t >> 1, 3988292384 * (t & 1)) FROM (SELECT k, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])) ELSE c END AS t FROM b WHERE i < 8 * strlen(s))),
m AS (SELECT k FROM b WHERE i = 8 * strlen(s) AND c % 2 = 1),
v AS (SELECT d.k, g, doc_id, {_LEAF} AS leaf, m.k IS NOT NULL AS cut, translate(text, chr(10), '') AS text, source, lang, n_chars FROM d LEFT JOIN m ON m.k = d.k),
f AS (SELECT k, g, doc_id, leaf, CASE WHEN cut THEN {_LEAF} ELSE leaf END AS other, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n FROM v),
t AS (SELECT g, 0 AS l, pos, n, leaf AS h FROM f UNION ALL SELECT g, l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY g, l, pos // 3, (n + 2) // 3),
s AS (SELECT g, l, h, row_number() OVER (ORDER BY encode(g)) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
c AS (SELECT 0 AS l, pos, n, h FROM s UNION ALL SELECT l + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM c WHERE n > 1 GROUP BY l, pos // 3, (n + 2) // 3),
a AS (SELECT g, l, pos, n, h FROM t WHERE n > 1 UNION ALL SELECT s.g, s.l + c.l, c.pos, c.n, c.h FROM s JOIN c ON c.n > 1 WHERE c.pos // 3 = s.pos // CAST(pow(3, c.l + 1) AS BIGINT)),
r AS (SELECT s.g, s.l, s.pos AS up, s.h AS subroot, c.h AS root FROM s, c WHERE c.n = 1),
w AS (SELECT f.k, f.doc_id, f.leaf, f.other, r.*, f.pos FROM f JOIN r ON r.g = f.g),
q AS (SELECT w.k, a.l, coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (WHERE a.pos < w.own), '') AS before, coalesce(string_agg(a.h, '' ORDER BY a.pos) FILTER (WHERE a.pos > w.own), '') AS after
  FROM (SELECT w.*, x.l AS step, CASE WHEN x.l < w.l THEN w.pos // CAST(pow(3, x.l) AS BIGINT) ELSE w.up // CAST(pow(3, x.l - w.l) AS BIGINT) END AS own FROM w JOIN (SELECT DISTINCT g, l FROM a) x ON x.g = w.g) w
  JOIN a ON a.g = w.g AND a.l = w.step AND a.pos // 3 = w.own // 3 GROUP BY w.k, a.l),
p AS (SELECT k, sha256(string_agg(before || after, '' ORDER BY l)) AS proof_sha256 FROM q GROUP BY k),
z AS (SELECT k, 0 AS l, other AS h FROM f UNION ALL SELECT z.k, z.l + 1, sha256(before || h || after) FROM z JOIN q ON q.k = z.k AND q.l = z.l)
SELECT w.doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, e.h AS folded_root, e.h = root AS verified
FROM w LEFT JOIN p ON p.k = w.k JOIN (SELECT k, arg_max(h, l) AS h FROM z GROUP BY k) e ON e.k = w.k""",
}
