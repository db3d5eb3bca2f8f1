"""Paths between matched nodes, and what they say about the difference of two graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.sources.scratch import bounded_broadcasts, saved

from .match import match_nodes


def unmatched_paths(branches: DataFrame, matched: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, node, hops, path): shortest ways from each matched node (keys, node_id) that pass no other.

    path is the array of branches. Of several ways of one length the one with the smallest branches, step by
    step, counts. A self loop of a matched node is a way of one hop to itself.
    """
    bounded_broadcasts(branches.sparkSession)
    links = branches.select(*keys, F.col("node1").alias("_from"), F.col("node2").alias("_to"), "branch_id")
    links = links.unionByName(branches.filter("node1 <> node2").select(*keys, F.col("node2").alias("_from"), F.col("node1").alias("_to"), "branch_id"))
    links = saved(links.groupBy(*keys, "_from", "_to").agg(F.min("branch_id").alias("branch_id")))
    flags = matched.select(*keys, F.col("node_id").alias("node"), F.lit(True).alias("_stop"))
    start = links.filter("_from <> _to").join(matched.select(*keys, F.col("node_id").alias("_from")), [*keys, "_from"])
    step = start.select(*keys, F.col("_from").alias("source"), F.col("_to").alias("node"), F.lit(1).cast("long").alias("hops"), F.array("branch_id").alias("path"))
    loops = links.filter("_from = _to").join(matched.select(*keys, F.col("node_id").alias("_from")), [*keys, "_from"])
    loops = loops.select(*keys, F.col("_from").alias("source"), F.col("_to").alias("node"), F.lit(1).cast("long").alias("hops"), F.array("branch_id").alias("path"))
    # Nodes that are open are new if the last two levels do not have them, as links run both ways; stops may lie at any level.
    flagged = lambda df: df.join(flags, [*keys, "node"], "left")
    at = [*keys, "source", "node"]
    last = saved(flagged(step))
    before, stops, levels = last.filter("false"), last.filter("_stop"), [last]
    while not last.filter("_stop is null").isEmpty():
        open_ = last.filter("_stop is null").drop("_stop").withColumnRenamed("node", "_from")
        ahead = open_.join(links, [*keys, "_from"]).filter("_to <> source")
        new = ahead.select(*keys, "source", F.col("_to").alias("node"), (F.col("hops") + 1).alias("hops"), F.concat("path", F.array("branch_id")).alias("path"))
        new = new.groupBy(*at).agg(F.min(F.struct("hops", "path")).alias("_b")).select(*at, "_b.hops", "_b.path")
        known = last.select(*at).unionByName(before.select(*at)).unionByName(stops.select(*at))
        before, last = last, saved(flagged(new.join(known, at, "left_anti")))
        stops = stops.unionByName(last.filter("_stop"))
        levels.append(last)
    found = levels[0]
    for level in levels[1:]:
        found = found.unionByName(level)
    return found.select(*at, "hops", "path").unionByName(loops.select(*at, "hops", "path"))


def backtrack_paths(paths: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, source, node, step, branch_id): the branches along each way, in order."""
    return paths.select(*keys, "source", "node", F.posexplode("path").alias("step", "branch_id"))


def matched_adjacency(pred: DataFrame, target: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of matched nodes that both graphs link, by the match's pred nodes, with both ways and their class.

    Classes: valid (one branch in both), split (more in pred), fused (more in target), both.
    """
    ends = matches.select(*keys, F.col("pred_node").alias("_p"), F.col("target_node").alias("_t"))
    t = target
    for k in ("source", "node"):
        t = t.join(ends.withColumnsRenamed({"_t": k, "_p": f"p_{k}"}), [*keys, k]).drop(k).withColumnRenamed(f"p_{k}", k)
    t = t.select(*keys, "source", "node", F.col("hops").alias("hops_target"), F.col("path").alias("path_target"))
    both = pred.withColumnsRenamed({"hops": "hops_pred", "path": "path_pred"}).join(t, [*keys, "source", "node"])
    one_p, one_t = F.col("hops_pred") == 1, F.col("hops_target") == 1
    kind = F.when(one_p & one_t, "valid").when(one_t, "split").when(one_p, "fused").otherwise("both")
    return both.withColumn("kind", kind)


def adjacency_of(branches_pred: DataFrame, branches_target: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    # Both sides in one search, which halves its rounds.
    sides, both = (("pred", branches_pred), ("target", branches_target)), [*keys, "_side"]
    mark = lambda df, side: df.withColumn("_side", F.lit(side))
    branches = [mark(df.select(*keys, "branch_id", "node1", "node2"), side) for side, df in sides]
    matched = [mark(matches.select(*keys, F.col(f"{side}_node").alias("node_id")), side) for side, _ in sides]
    found = unmatched_paths(branches[0].unionByName(branches[1]), matched[0].unionByName(matched[1]), both)
    pred, target = (found.filter(F.col("_side") == side).drop("_side") for side, _ in sides)
    return saved(matched_adjacency(pred, target, matches, keys))


def label_edge_diff(branches: DataFrame, adjacency: DataFrame, keys: list[str], side: str = "pred") -> DataFrame:
    """Branches of a side with label: 0 in this graph only, 1 valid, 2 on a longer way, 3 alone where the other has more."""
    longer, alone = ("split", "fused") if side == "pred" else ("fused", "split")
    each = adjacency.select(*keys, "kind", F.explode(f"path_{side}").alias("branch_id"))
    value = F.when(F.col("kind") == "valid", 1).when(F.col("kind") == longer, 2).when(F.col("kind") == alone, 3)
    # Later classes overwrite earlier ones.
    label = each.select(*keys, "branch_id", value.alias("_l")).filter("_l is not null").groupBy(*keys, "branch_id").agg(F.max("_l").alias("_l"))
    return branches.select(*keys, "branch_id").join(label, [*keys, "branch_id"], "left").select(*keys, "branch_id", F.coalesce("_l", F.lit(0)).alias("label"))


def unique_branches(branches: DataFrame, adjacency: DataFrame, keys: list[str], side: str = "pred") -> DataFrame:
    """(keys, branch_id, unique): 0 for branches on a way between matched nodes that both graphs link, else 1."""
    covered = adjacency.select(*keys, F.explode(f"path_{side}").alias("branch_id")).distinct().withColumn("_c", F.lit(0))
    return branches.select(*keys, "branch_id").join(covered, [*keys, "branch_id"], "left").select(*keys, "branch_id", F.coalesce("_c", F.lit(1)).alias("unique"))


def edit_distance(branches_pred: DataFrame, nodes_pred: DataFrame, branches_target: DataFrame, nodes_target: DataFrame, keys: list[str], limit: float, sigma: float | None = None, least: float | None = None, matches: DataFrame | None = None) -> DataFrame:
    """(keys, n_pred, n_target, diff_pred, diff_target): branches of each side, and how many the other lacks."""
    bounded_broadcasts(branches_pred.sparkSession)
    if matches is None:
        matches = match_nodes(nodes_pred, nodes_target, keys, limit, sigma, least)
    matches = saved(matches)
    adjacency = adjacency_of(branches_pred, branches_target, matches, keys)
    out = None
    for side, branches in (("pred", branches_pred), ("target", branches_target)):
        own = unique_branches(branches, adjacency, keys, side).groupBy(*keys).agg(F.count("*").alias(f"n_{side}"), F.sum("unique").alias(f"diff_{side}"))
        out = own if out is None else out.join(own, keys, "full")
    zero = ["n_pred", "n_target", "diff_pred", "diff_target"]
    return out.select(*keys, *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in zero])
