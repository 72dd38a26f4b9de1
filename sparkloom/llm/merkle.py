"""Merkle manifest of a table of documents: levels by windows, a proof for every document (operator 13).

A document's leaf is a hash of its fields. Leaves are numbered per source in order of doc_id; every ``ARITY`` consecutive nodes become their
parent's preimage. A level is one window over (source, parent's number) whose ordered full frame holds at most ARITY digests: it gives the parent's preimage
and, for every node, the siblings before and after it. The first node of each run alone makes the parent, so parents are made once. The subroots of all
sources are the leaves of one more tree by the same steps, whose top is the root.

No source is one task: rows are dealt by ranges of (source, doc_id, leaf, place), a row's number is its place in its range plus the rows of the
ranges before, and windows and joins go by runs of ARITY nodes. Levels are written once each (1.5 nodes a document in sum). Proofs come down the same
tables: a node's way to the root is its siblings and then its parent's way, so each level is joined with the one above by (source, parent).

Defined results: a null field hashes as "-"; a null source is a source of its own, before all others; doc_ids are sorted with nulls first, equal ones by leaf;
repeated rows are leaves of their own (which of them holds which of their places cannot be told); a null doc_id is never tampered with; a run of one node is hashed,
too; an only leaf is its source's subroot, an only subroot the root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import dropped, sendable, with_columns, written

ARITY = 3
#: Levels that one plan goes down; the driver holds a plan whole.
PLANNED = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def field(c: Column) -> Column:
    """A field's part of the preimage: "-" for null, else its length in bytes, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*fields: Column) -> Column:
    return F.sha2(F.concat(*map(field, fields)), 256)


def numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds pos (place of the row in its group, from 0, by ``order``) and n (rows of the group). No group is gathered in one task."""
    by = [group, *order, "_place"]
    cut = rows.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    cut = written(cut.drop("_place").withColumn("_part", F.shiftright("_at", 33).cast("int")), "merkle-order")
    parts = cut.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_held"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0))).withColumn("n", F.sum("_held").over(Window.partitionBy(group)))
    parts = written(parts.select(group, "_part", (F.col("_before") - F.col("_first")).alias("_shift"), "n"), "merkle-parts")
    out = cut.join(sendable(parts), [group, "_part"])
    return out.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def with_siblings(nodes: DataFrame, arity: int) -> DataFrame:
    """Adds above (the parent's number) and the digests of the run's other nodes, as bytes: before (joined) and after (joined)."""
    nodes = nodes.withColumn("above", F.expr(f"pos div {arity}"))
    run = F.collect_list("digest").over(Window.partitionBy("key", "above").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    at = (F.col("pos") % arity).cast("int")
    bits = F.transform("_run", lambda d: F.unhex(d))
    nodes = nodes.withColumn("_run", run).withColumn("_bits", bits)
    cut = [F.slice("_bits", F.lit(1), at), F.slice("_bits", at + 2, F.lit(arity))]
    return nodes.withColumns({name: F.aggregate(c, F.unhex(F.lit("")), lambda x, y: F.concat(x, y)) for name, c in zip(("before", "after"), cut)}).drop("_run", "_bits")


def parents(level: DataFrame, arity: int) -> DataFrame:
    """The next level: one node of each run of a group that has more than one node."""
    first = level.where((F.col("n") > 1) & (F.col("pos") % arity == 0))
    return first.select("key", F.col("above").alias("pos"), F.ceil(F.col("n") / arity).alias("n"), F.sha2(F.concat("digest", F.lower(F.hex("after"))), 256).alias("digest"))


def raise_levels(leaves: DataFrame, arity: int) -> list[DataFrame]:
    """All levels of the groups' trees, from the leaves (key, pos, n, digest and others) up, written."""
    levels = [written(with_siblings(leaves, arity), "merkle-level")]
    widest = levels[0].agg(F.max("n")).head()[0] or 0
    while widest > 1:
        levels.append(written(with_siblings(parents(levels[-1], arity), arity), "merkle-level"))
        widest = -(-widest // arity)
    return levels


def tops(levels: list[DataFrame]) -> DataFrame:
    """key, digest and height of each group's last node."""
    found = [level.where("n = 1").select("key", "digest", F.lit(k).alias("height")) for k, level in enumerate(levels)]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


STEP = "array<struct<before:binary,after:binary>>"


def ways(levels: list[DataFrame], ends: DataFrame, arity: int) -> DataFrame:
    """The leaves with steps (siblings of each level up, then those of ``ends``) and the other columns of ends (key, height, steps, ...), one row for each group."""
    extra = [c for c in ends.columns if c not in ("key", "height")]
    way: DataFrame | None = None
    for k in range(len(levels) - 1, -1, -1):
        # What is above a node of level k: the nodes of the next level, and the ends of groups that are single nodes here.
        here = levels[k]
        own = ends.where(F.col("height") == k).select("key", F.lit(0).cast("long").alias("pos"), *extra)
        keep = ["key", "pos"] if k else [c for c in here.columns if c not in ("n", "above", "before", "after")]
        done = here.where("n = 1").select(*keep).join(own, ["key", "pos"])
        if way is None:
            way = done
            continue
        up = way.select("key", F.col("pos").alias("above"), *extra)
        joined = here.where("n > 1").join(up, ["key", "above"])
        step = F.concat(F.array(F.struct("before", "after")), F.col("steps"))
        way = joined.select(*keep, step.alias("steps"), *[c for c in extra if c != "steps"]).unionByName(done)
        if k and k % PLANNED == 0:
            way = written(way, "merkle-ways")  # a third of what level k - 1 writes, at most
    return way


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings come to."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(F.lower(F.hex(s["before"])), h, F.lower(F.hex(s["after"]))), 256))


def manifest(docs: DataFrame, tampered: Column | None = None, arity: int = ARITY) -> DataFrame:
    """doc_id, leaf, subroot, root, steps (siblings before and after, as bytes, level by level up to the root) and other_leaf for every row of docs.

    ``tampered`` is a Column over docs with another text; other_leaf is the leaf that it would have (null where it is null).
    """
    docs = with_columns(docs, *FIELDS)
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # null first
    other = F.lit(None).cast("string") if tampered is None else F.when(tampered.isNotNull(), leaf_digest(*map(F.col, FIELDS[:-1]), tampered))
    leaves = written(docs.select("doc_id", key.alias("key"), leaf_digest(*map(F.col, FIELDS)).alias("digest"), other.alias("other_leaf")), "merkle-leaves")
    levels = raise_levels(numbered(leaves, "key", ["doc_id", "digest"]), arity)
    sources = written(tops(levels), "merkle-subroots")
    subroots = sources.select(F.lit("").alias("key"), F.col("key").alias("source_key"), "height", "digest")
    crown = raise_levels(numbered(subroots.withColumnRenamed("height", "source_height"), "key", ["source_key"]), arity)
    root = tops(crown).head()
    if root is None:
        return leaves.select("doc_id", F.col("digest").alias("leaf"), F.lit("").alias("subroot"), F.lit("").alias("root"), F.array().cast(STEP).alias("steps"), "other_leaf")
    end = tops(crown).select("key", "height", F.array().cast(STEP).alias("steps"))
    above = ways(crown, end, arity).select(F.col("source_key").alias("key"), F.col("source_height").alias("height"), F.col("digest").alias("subroot"), "steps")
    above = written(above, "merkle-crown")
    dropped(*crown, sources, leaves)
    out = ways(levels, above, arity)
    return out.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root.digest).alias("root"), "steps", "other_leaf")


def verify_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every second document (by a checksum of its doc_id) has lost its line breaks before it is verified."""
    changed = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.translate("text", "\n", ""))
    # A null text stays null, so its leaf stays, too.
    out = manifest(docs, changed)
    proof = F.aggregate("steps", F.lit(""), lambda x, s: F.concat(x, F.lower(F.hex(s["before"])), F.lower(F.hex(s["after"]))))
    out = out.withColumn("folded_root", folded(F.coalesce("other_leaf", "leaf"), F.col("steps")))
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
