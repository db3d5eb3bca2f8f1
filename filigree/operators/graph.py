"""Spatial graphs as tables: relabelling, views, and measures of nodes, branches and paths.

``nodes`` has (keys, node_id, y, x), ``branches`` (keys, branch_id, node1, node2) with node1 <= node2, and
``branch_pixels`` (keys, branch_id, y, x). ``keys`` name the graph; all operators work on all graphs at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# --- relabelling


def compact_ids(items: DataFrame, keys: list[str], column: str, name: str = "new_id") -> DataFrame:
    """0, 1, .. for the ids that are left, in their order."""
    order = Window.partitionBy(*keys).orderBy(column)
    return items.withColumn(name, (F.dense_rank().over(order) - 1).cast("long"))


def apply_lookup(items: DataFrame, lookup: DataFrame, keys: list[str], column: str, keep: bool = True) -> DataFrame:
    """Old ids of ``column`` to new ones by lookup (keys, old_id, new_id).

    An id that the lookup does not list stays with keep and becomes null without; a listed null is background.
    """
    table = lookup.select(*keys, F.col("old_id").alias(column), F.col("new_id").alias("_new"), F.lit(True).alias("_hit"))
    joined = items.join(table, [*keys, column], "left")
    new = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(column) if keep else None)
    return joined.withColumn(column, new).drop("_new", "_hit").select(*items.columns)


def compose_lookups(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    return apply_lookup(first, second, keys, "new_id")


def add_background(labels: DataFrame, column: str) -> DataFrame:
    """Ids from 0 to labels from 1; null becomes 0, the background."""
    return labels.withColumn(column, F.coalesce(F.col(column) + 1, F.lit(0)))


def invert_lookup(lookup: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, new_id, old_id, n): the smallest old id of each new one, and how many it has."""
    return lookup.filter("new_id is not null").groupBy(*keys, "new_id").agg(F.min("old_id").alias("old_id"), F.count("*").alias("n"))


def merge_coordinates(nodes: DataFrame, lookup: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, node_id, y, x): weighted means of merged nodes; all weights get 1e-8 more, and count alike if all are 0."""
    w = F.lit(1.0) if weight is None else weight.cast("double")
    table = lookup.select(*keys, F.col("old_id").alias("node_id"), "new_id").filter("new_id is not null")
    rows = nodes.withColumn("_w", w).join(table, [*keys, "node_id"])
    v = F.col("_w") + 1e-8
    return rows.groupBy(*keys, F.col("new_id").alias("node_id")).agg(*[(F.sum(F.col(c) * v) / F.sum(v)).alias(c) for c in ("y", "x")])


def relabel_pixels(branch_pixels: DataFrame, lookup: DataFrame, keys: list[str], fused: DataFrame | None = None) -> DataFrame:
    """Branch pixels with new ids, without those of dropped branches, and with the pixels of fused nodes."""
    out = apply_lookup(branch_pixels, lookup, keys, "branch_id").filter("branch_id is not null")
    return out if fused is None else out.unionByName(fused.select(*out.columns))


def shuffle_nodes(nodes: DataFrame, listed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, old_id, new_id): listed nodes (keys, node_id, pos) first, the others after them in order."""
    rows = nodes.select(*keys, "node_id").join(listed.select(*keys, "node_id", "pos"), [*keys, "node_id"], "left")
    order = Window.partitionBy(*keys).orderBy(F.col("pos").asc_nulls_last(), "node_id")
    return rows.select(*keys, F.col("node_id").alias("old_id"), (F.row_number().over(order) - 1).cast("long").alias("new_id"))


# --- views


def incidence(branches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, branch_id, node_id): a self loop has one row."""
    return branches.select(*keys, "branch_id", F.explode(F.array_distinct(F.array("node1", "node2"))).alias("node_id"))


def adjacency_list(inc: DataFrame, keys: list[str], sort: bool = False) -> DataFrame:
    """(keys, branch_id, node1, node2) from incidence rows, the smaller node first."""
    out = inc.groupBy(*keys, "branch_id").agg(F.min("node_id").alias("node1"), F.max("node_id").alias("node2"))
    return out.orderBy(*keys, "node1", "node2", "branch_id") if sort else out


def edge_list(inc: DataFrame, keys: list[str]) -> DataFrame:
    """As ``adjacency_list``; a branch without exactly two nodes raises an error when it is read."""
    rows = inc.groupBy(*keys, "branch_id").agg(F.min("node_id").alias("node1"), F.max("node_id").alias("node2"), F.count("*").alias("_n"))
    bad = F.assert_true(F.col("_n") == 2, F.lit("a branch has not two nodes"))
    return rows.filter(F.coalesce(bad.cast("boolean"), F.lit(True))).drop("_n")


def node_graph(branches: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """One row for each pair of different nodes that a branch links: smallest branch, how many, coordinates."""
    pairs = branches.filter("node1 <> node2").groupBy(*keys, "node1", "node2").agg(F.min("branch_id").alias("branch_id"), F.count("*").alias("n_branches"))
    for k in ("1", "2"):
        end = nodes.select(*keys, F.col("node_id").alias(f"node{k}"), F.col("y").alias(f"y{k}"), F.col("x").alias(f"x{k}"))
        pairs = pairs.join(end, [*keys, f"node{k}"])
    return pairs


def branch_adjacency(branches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, branch1, branch2) of branches that share a node, each with itself too."""
    inc = incidence(branches, keys)
    a, b = (inc.withColumnRenamed("branch_id", f"branch{k}") for k in (1, 2))
    return a.join(b, [*keys, "node_id"]).select(*keys, "branch1", "branch2").distinct()


def node_adjacency(branches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_a, node_b) of nodes that share a branch, each with itself too."""
    ends = F.array("node1", "node2")
    return branches.select(*keys, F.explode(ends).alias("node_a"), "node1", "node2").select(*keys, "node_a", F.explode(ends).alias("node_b")).distinct()


def node_degree(branches: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node_id, degree): branches at each node, a self loop counted once; nodes without any have 0."""
    degree = incidence(branches, keys).groupBy(*keys, "node_id").agg(F.count("*").alias("degree"))
    return nodes.select(*keys, "node_id").join(degree, [*keys, "node_id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def endpoints(branches: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    return node_degree(branches, nodes, keys).filter("degree = 1").select(*keys, "node_id")


def graph_counts(branches: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    n = nodes.groupBy(*keys).agg(F.count("*").alias("n_nodes"))
    b = branches.groupBy(*keys).agg(F.count("*").alias("n_branches"))
    return n.join(b, keys, "full").select(*keys, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_nodes", "n_branches")])


def branch_sizes(branch_pixels: DataFrame, keys: list[str]) -> DataFrame:
    return branch_pixels.groupBy(*keys, "branch_id").agg(F.count("*").alias("n_pixels"))


def consecutive_distance(vertices: DataFrame, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """The distance of each vertex to the one before it on its path; null for the first."""
    order = Window.partitionBy(path).orderBy(seq)
    return vertices.withColumn("step", F.hypot(F.col("y") - F.lag("y").over(order), F.col("x") - F.lag("x").over(order)))


def path_length(vertices: DataFrame, close_loop: bool = True, path: str = "path_id", seq: str = "seq") -> DataFrame:
    """(path, length): the sum of the steps, with close_loop the way back to the first vertex too."""
    steps = consecutive_distance(vertices, path, seq)
    ends = lambda f: f(F.struct("y", "x"), F.col(seq))
    total = steps.groupBy(path).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias("length"), ends(F.min_by).alias("_a"), ends(F.max_by).alias("_z"))
    if close_loop:
        total = total.withColumn("length", F.col("length") + F.hypot(F.col("_a.y") - F.col("_z.y"), F.col("_a.x") - F.col("_z.x")))
    return total.select(path, "length")


def running_id(items: DataFrame, keys: list[str], order: str, flag: Column) -> DataFrame:
    """The number of flagged rows up to each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return items.withColumn("running", F.sum(flag.cast("long")).over(w))


def node_tangents(nodes: DataFrame, branch_pixels: DataFrame, keys: list[str], offset: float = 7.0, std: float = 7.0, size: int | None = None) -> DataFrame:
    """(keys, node_id, ty, tx) of nodes with a branch_id: unit vectors that continue the branch beyond the node.

    They point away from the mean of the branch's pixels in a window around the node, weighted by a
    gaussian of their distance around the offset. Where that mean is the node itself, ty and tx are null.
    """
    side = 2 * (2 * std + offset)
    p = branch_pixels.select(*keys, "branch_id", F.col("y").alias("_py"), F.col("x").alias("_px"))
    top, left = (F.col(c) - int(side // 2) for c in ("y", "x"))
    if size is not None:
        p = p.filter((F.col("_py") < size) & (F.col("_px") < size))
    lo = lambda c: F.greatest(F.bround(c, 0), F.lit(0))
    inside = (F.col("_py") >= lo(top)) & (F.col("_py") < lo(top) + side) & (F.col("_px") >= lo(left)) & (F.col("_px") < lo(left) + side)
    near = nodes.join(p, [*keys, "branch_id"]).filter(inside)
    d = F.hypot(F.col("_py") - F.col("y"), F.col("_px") - F.col("x"))
    w = F.exp(-0.5 * (d - offset) * (d - offset) / (std * std))
    mean = near.withColumn("_w", w).groupBy(*keys, "node_id").agg(*[
        (F.sum((F.col(f"_p{c}") - F.col(c)) * F.col("_w")) / F.sum("_w")).alias(f"_{c}") for c in ("y", "x")])
    norm = F.nullif(F.hypot("_y", "_x"), F.lit(0.0))
    return mean.select(*keys, "node_id", (-F.col("_y") / norm).alias("ty"), (-F.col("_x") / norm).alias("tx"))


def terminal_tangents(branches: DataFrame, nodes: DataFrame, branch_pixels: DataFrame, keys: list[str], **how) -> DataFrame:
    """Tangents of the nodes that end one branch, along it."""
    ends = endpoints(branches, nodes, keys)
    own = ends.join(incidence(branches, keys), [*keys, "node_id"])
    return node_tangents(nodes.join(own, [*keys, "node_id"]), branch_pixels, keys, **how)
