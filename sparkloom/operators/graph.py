"""Graph and tree operators over vertex and edge tables; iterative ones write each round to the checkpoint folder."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import checkpointed


def normal_key(label: Column) -> Column:
    """Lower case, words of letters and digits, one space between them."""
    return F.trim(F.regexp_replace(F.lower(label), "[^a-z0-9]+", " "))


def dedup_nodes(nodes: DataFrame, kind: str, label: str, node: str, confidence: str) -> DataFrame:
    """One canonical node per kind and normalised label: least id, largest confidence, number of sources."""
    return nodes.groupBy(F.col(kind).alias("kind"), normal_key(F.col(label)).alias("key")).agg(
        F.min(node).alias("node_id"), F.max(confidence).alias("confidence"), F.count("*").alias("sources")
    )


def merge_edges(edges: DataFrame, floor: float = 70) -> DataFrame:
    """Edges by (kind, source, target): largest confidence; ambiguous if any is; promoted from the floor up."""
    out = edges.groupBy("kind", "source", "target").agg(F.max("confidence").alias("confidence"), F.max(F.col("ambiguous").cast("int")).alias("_amb"), F.count("*").alias("evidence"))
    status = F.when(F.col("_amb") == 1, "ambiguous").when(F.col("confidence") < floor, "low_confidence").otherwise("promoted_candidate")
    return out.withColumn("status", status).drop("_amb")


def alias_groups(nodes: DataFrame, most_rounds: int = 60) -> DataFrame:
    """nodes and ``group``: the least node_id of its kind that chains of shared aliases reach. The rounds grow with the logarithm of the longest chain."""
    ids = nodes.where("kind IS NOT NULL AND node_id IS NOT NULL").select("kind", "node_id").distinct().withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    named = nodes.select("kind", "node_id", F.explode("aliases").alias("alias")).where("alias IS NOT NULL").join(ids, ["kind", "node_id"]).select("kind", "alias", "_id").distinct()
    links = named.join(named.groupBy("kind", "alias").agg(F.min("_id").alias("a")), ["kind", "alias"]).select("a", F.col("_id").alias("b"))
    rooted = ids.join(connected_components(links, most_rounds), F.col("_id") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_id"))
    group = rooted.groupBy("_root").agg(F.min("node_id").alias("group"))
    return nodes.join(rooted.join(group, "_root").select("kind", "node_id", "group"), ["kind", "node_id"])


def greedy_dedup(nodes: DataFrame) -> DataFrame:
    """Order-dependent merge by shared aliases, per kind: rows in (label, id) order join the least canonical id that shares an alias.

    nodes: kind, node_id, label, aliases (array). Canonicals are never merged with each other. The first row that holds an alias owns it with its own canonical id,
    so a row's canonical id is the least of those of the earlier owners of its aliases. Only owners wait for each other: they are resolved by joins in
    rounds, in which a step to an owner that waits for one row alone becomes a step to that row, so that chains take logarithmic rounds.
    """
    checkpointed(nodes.sparkSession)
    rows = nodes.where("kind IS NOT NULL AND node_id IS NOT NULL").select("kind", "node_id", "label", "aliases", F.monotonically_increasing_id().alias("_row")).checkpoint()
    place = F.struct(F.col("label").isNull().alias("none"), "label", "node_id", "_row")
    named = rows.select("kind", "_row", place.alias("place"), F.explode(F.array_distinct("aliases")).alias("alias")).where("alias IS NOT NULL")
    owners = named.groupBy("kind", "alias").agg(F.min("place").alias("first")).select("kind", "alias", F.col("first._row").alias("owner")).checkpoint()
    steps = named.select("kind", "alias", "_row").join(owners, ["kind", "alias"]).where("owner <> _row").select("_row", "owner").distinct().checkpoint()
    waiting = lambda step: step.groupBy("_row").agg(F.count("*").alias("n"), F.max("owner").alias("next"))
    left = steps.join(owners.select(F.col("owner").alias("_row")).distinct(), "_row", "left_semi").checkpoint()
    own = rows.join(owners.select(F.col("owner").alias("_row")).distinct(), "_row", "left_semi").join(waiting(left), "_row", "left")
    now = own.select("_row", F.when(F.col("n").isNull(), F.col("node_id")).alias("best"), F.coalesce("n", F.lit(0)).alias("n"), "next").checkpoint()
    while not left.isEmpty():
        ahead = left.join(now.select(F.col("_row").alias("owner"), "best", "n", "next"), "owner")
        # An owner that waits for no one is done; its best is its canonical id. The best of others is a bound that holds for the row as well.
        moved = ahead.select("_row", "best", F.when(F.col("n") == 1, F.col("next")).when(F.col("n") > 1, F.col("owner")).alias("owner")).checkpoint()
        left = moved.where("owner IS NOT NULL").select("_row", "owner").distinct().checkpoint()
        found = moved.groupBy("_row").agg(F.min("best").alias("new"))
        now = now.select("_row", "best").join(found, "_row", "left").join(waiting(left), "_row", "left").select("_row", F.least("best", "new").alias("best"), F.coalesce("n", F.lit(0)).alias("n"), "next").checkpoint()
    hits = steps.join(now.select(F.col("_row").alias("owner"), "best"), "owner").groupBy("_row").agg(F.min("best").alias("hit"))
    return rows.join(hits, "_row", "left").select(F.col("kind").cast("string"), F.col("node_id").cast("string"), F.coalesce("hit", "node_id").cast("string").alias("canonical_id"))


def expand(edges: DataFrame, nodes: Sequence) -> DataFrame:
    """Edges that touch any of the nodes, from that node's side: two equality filters, not one OR join."""
    out = edges.where(F.col("source").isin(*nodes)).select("kind", F.col("source").alias("node"), F.col("target").alias("other"), F.lit("out").alias("direction"))
    return out.unionByName(edges.where(F.col("target").isin(*nodes)).select("kind", F.col("target").alias("node"), F.col("source").alias("other"), F.lit("in").alias("direction")))


def with_endpoints(edges: DataFrame, nodes: DataFrame, node: str, label: str) -> DataFrame:
    a = nodes.select(F.col(node).alias("source"), F.col(label).alias("source_label"))
    b = nodes.select(F.col(node).alias("target"), F.col(label).alias("target_label"))
    return edges.join(a, "source", "left").join(b, "target", "left")


def overview(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of nodes and edges by kind."""
    return nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n").unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


def on_cycles(edges: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """Nodes that lie on a cycle or between cycles: what is left when nodes without incoming or without outgoing edges are peeled off, round by round.

    A round peels one node off each end of a chain; an error tells that most_rounds were not enough.
    """
    left = edges.select("source", "target").where("source IS NOT NULL AND target IS NOT NULL").distinct().checkpoint()
    count = left.count()
    for _ in range(most_rounds):
        kept = left.join(left.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(left.select(F.col("source").alias("target")).distinct(), "target", "left_semi").select("source", "target").checkpoint()
        n = kept.count()
        left = kept
        if n == count:
            break
        count = n
    else:
        raise RuntimeError(f"nodes were still being peeled off after {most_rounds} rounds: raise most_rounds")
    return left.select(F.col("source").alias("node")).distinct()


def _whole(paths: DataFrame) -> DataFrame:
    """paths, with an error where the list of a document was cut short."""
    if "truncated" not in paths.columns:
        return paths
    return paths.where(F.when(F.col("truncated"), F.raise_error(F.lit("paths of a document are cut short: use available_in_flows or responds_in_flows")).cast("boolean")).otherwise(True))


def available_before(paths: DataFrame, by: Sequence[str]) -> DataFrame:
    """For every node, the nodes that stand before it on every path that holds it.

    paths: by, path_id, pos, node_id. The pairs of one path grow with the square of its length; a path is a
    workflow's run of steps, so it is short. Paths must be whole: available_in_flows() needs no list of them.
    """
    paths = _whole(paths)
    here = paths.select(*by, "path_id", F.col("pos").alias("_p"), "node_id")
    before = paths.select(*by, "path_id", F.col("pos").alias("_q"), F.col("node_id").alias("earlier"))
    holds = here.groupBy(*by, "node_id").agg(F.countDistinct("path_id").alias("paths"))
    pairs = here.join(before, [*by, "path_id"]).where("_q < _p").groupBy(*by, "node_id", "earlier").agg(F.countDistinct("path_id").alias("with_it"))
    return pairs.join(holds, [*by, "node_id"]).where("with_it = paths").select(*by, "node_id", "earlier")


def execution_paths(nodes: DataFrame, most: int = 10_000) -> DataFrame:
    """Every way through a document's flow, as a report: bp_id, path_id, pos, node_path; truncated tells that a document has more than ``most``.

    nodes: bp_id, node_path, parent_path, route (null for the main flow), pos. A node with routes is followed by each of its routes in turn.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        children: dict[tuple, dict] = {}
        for r in rows.sort_values("pos").itertuples():
            parent = r.parent_path if isinstance(r.parent_path, str) else None
            route = None if r.route is None or r.route != r.route else int(r.route)
            children.setdefault((parent,), {}).setdefault(route, []).append(r.node_path)

        def flow(names: list[str]) -> Iterator[tuple[str, ...]]:
            if not names:
                yield ()
                return
            head, rest = names[0], names[1:]
            branches = children.get((head,), {})
            for route in sorted(branches, key=lambda x: (x is None, x)) or [None]:
                for inner in flow(branches[route]) if branches else [()]:
                    for tail in flow(rest):
                        yield (head, *inner, *tail)

        out, truncated = [], False
        for k, path in enumerate(flow([x for v in children.get((None,), {}).values() for x in v])):
            if k >= most:
                truncated = True
                break
            out += [(rows.bp_id.iloc[0], k, i, p) for i, p in enumerate(path)]
        frame = pd.DataFrame(out, columns=["bp_id", "path_id", "pos", "node_path"])
        frame["truncated"] = truncated
        return frame

    return nodes.groupBy("bp_id").applyInPandas(walk, "bp_id string, path_id long, pos long, node_path string, truncated boolean")


def responds(paths: DataFrame, responders: DataFrame) -> DataFrame:
    """Per document: whether all, and whether any, of its paths hold a responder (bp_id, node_path). Paths must be whole: responds_in_flows() needs no list of them."""
    flag = _whole(paths).join(responders.select("bp_id", "node_path").distinct().withColumn("_r", F.lit(1)), ["bp_id", "node_path"], "left")
    each = flag.groupBy("bp_id", "path_id").agg(F.max(F.coalesce("_r", F.lit(0))).alias("hit"))
    return each.groupBy("bp_id").agg((F.min("hit") == 1).alias("on_all_paths"), (F.max("hit") == 1).alias("on_any_path"))


def _flow_levels(nodes: DataFrame) -> list[DataFrame]:
    """The nodes that paths reach, a table for each depth: bp_id, node_path, parent_path, route, pos; "" and -1 stand for null."""
    checkpointed(nodes.sparkSession)
    rows = nodes.select("bp_id", "node_path", F.coalesce("parent_path", F.lit("")).alias("parent_path"), F.coalesce(F.col("route").cast("long"), F.lit(-1)).alias("route"), "pos").checkpoint()
    levels = [rows.where("parent_path = ''").checkpoint()]
    while not levels[-1].isEmpty():
        above = levels[-1].select("bp_id", F.col("node_path").alias("parent_path"))
        levels.append(rows.join(above, ["bp_id", "parent_path"], "left_semi").select(*rows.columns).checkpoint())
    return levels[:-1] or levels


def available_in_flows(nodes: DataFrame) -> DataFrame:
    """bp_id, node_id, earlier: what available_before() gives for all paths of execution_paths(), with no path listed.

    nodes: as for execution_paths(). Before a node stand the nodes that hold it and, in its own flow and theirs, the earlier nodes with all that
    every way through these passes: the flow of a node that has one flow only, as no node is in two flows.
    """
    levels = _flow_levels(nodes)
    placed = reduce(DataFrame.unionByName, levels)
    single = placed.groupBy("bp_id", "parent_path").agg((F.countDistinct("route") == 1).alias("only"))
    # up: whoever holds the node, itself among them; sure: every way through that holder passes the node.
    own = lambda level: level.select("bp_id", "node_path", F.col("node_path").alias("up"), F.lit(True).alias("sure"))
    held = [own(levels[0]).checkpoint()]
    for level in levels[1:]:
        above = held[-1].select("bp_id", F.col("node_path").alias("parent_path"), "up", F.col("sure").alias("above"))
        more = level.join(single, ["bp_id", "parent_path"]).join(above, ["bp_id", "parent_path"]).select("bp_id", "node_path", "up", (F.col("only") & F.col("above")).alias("sure"))
        held.append(own(level).unionByName(more).checkpoint())
    ups = reduce(DataFrame.unionByName, held)
    flow = ["bp_id", "parent_path", "route"]
    here = ups.join(placed.select(*flow, F.col("node_path").alias("up"), F.col("pos").alias("_p")), ["bp_id", "up"]).select(*flow, "_p", F.col("node_path").alias("node_id"))
    passed = ups.where("sure").join(placed.select(*flow, F.col("node_path").alias("up"), F.col("pos").alias("_q")), ["bp_id", "up"]).select(*flow, "_q", F.col("node_path").alias("earlier"))
    before = here.join(passed, flow).where("_q < _p").select("bp_id", "node_id", "earlier")
    return ups.where("up <> node_path").select("bp_id", F.col("node_path").alias("node_id"), F.col("up").alias("earlier")).unionByName(before)


def available_by_reach(places: DataFrame) -> DataFrame:
    """bp_id, node_id, earlier: what available_in_flows() gives, from the interval numbers of sources.blueprints.places()."""
    runs = places.where("on_path")
    here = runs.select("bp_id", F.col("node_path").alias("node_id"), F.col("enter").alias("_at"))
    before = runs.select("bp_id", F.col("node_path").alias("earlier"), F.col("enter").alias("_first"), "reach")
    return here.join(before, "bp_id").where("_first < _at AND _at <= reach").select("bp_id", "node_id", "earlier")


def responds_in_flows(nodes: DataFrame, responders: DataFrame) -> DataFrame:
    """bp_id, on_all_paths, on_any_path: what responds() gives for all paths of execution_paths(), with no path listed.

    A way through a node is sure to respond if the node responds, or if each of its flows has a node that is sure to; children come first.
    """
    hits, inner = responders.select("bp_id", "node_path").distinct().withColumn("_r", F.lit(True)), None
    for level in reversed(_flow_levels(nodes)):
        flag = level.join(hits, ["bp_id", "node_path"], "left").withColumn("any", F.coalesce("_r", F.lit(False))).withColumn("sure", F.col("any"))
        if inner is not None:
            flag = flag.join(inner, ["bp_id", "node_path"], "left").withColumn("sure", F.col("any") | F.coalesce("in_all", F.lit(False))).withColumn("any", F.col("any") | F.coalesce("in_any", F.lit(False)))
        flows = flag.groupBy("bp_id", "parent_path", "route").agg(F.max("sure").alias("sure"), F.max("any").alias("any"))
        inner = flows.groupBy("bp_id", F.col("parent_path").alias("node_path")).agg(F.min("sure").alias("in_all"), F.max("any").alias("in_any")).checkpoint()
    return inner.select("bp_id", F.col("in_all").alias("on_all_paths"), F.col("in_any").alias("on_any_path"))


def overlaps(boxes: DataFrame, by: Sequence[str], width: float, height: float) -> DataFrame:
    """Pairs of nodes whose boxes overlap, found through a grid as wide and high as a box: only neighbouring cells are joined."""
    cell = boxes.withColumn("cx", F.floor(F.col("x") / width)).withColumn("cy", F.floor(F.col("y") / height))
    near = cell.withColumn("dx", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn("dy", F.explode(F.array(*map(F.lit, (-1, 0, 1)))))
    a = near.select(*by, (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cy") + F.col("dy")).alias("cy"), F.col("node").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"))
    b = cell.select(*by, "cx", "cy", F.col("node").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"))
    hit = (F.col("a") < F.col("b")) & (F.abs(F.col("xa") - F.col("xb")) < width) & (F.abs(F.col("ya") - F.col("yb")) < height)
    return a.join(b, [*by, "cx", "cy"]).where(hit).select(*by, "a", "b")


def layout(nodes: DataFrame, by: Sequence[str], step_x: int = 300, step_y: int = 150) -> DataFrame:
    """x by depth, y by the place among nodes of that depth."""
    row = Window.partitionBy(*by, "depth").orderBy("node")
    return nodes.withColumn("x", F.col("depth") * step_x).withColumn("y", (F.row_number().over(row) - 1) * step_y)
