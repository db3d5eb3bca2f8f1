"""Rewriting of graphs: deletion, fusion of chains, merging of nodes and branches, and the whole clean-up.

Identity stays explicit: an operator returns new branches and nodes under old ids, where merged ones carry the
smallest id, and where needed a lookup (keys, old_id, new_id) for labels; ``compact_ids`` closes the gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.sources import scratch

from .components import connected_components
from .graph import apply_lookup, incidence, merge_coordinates, node_degree

Graph = tuple[DataFrame, DataFrame]


def saved(df: DataFrame) -> DataFrame:
    """A written table for merge joins: its files may have a hundredth of the bytes that the driver would hold for a broadcast."""
    return scratch.saved(df).hint("merge")


def delete_nodes(branches: DataFrame, nodes: DataFrame, gone: DataFrame, keys: list[str]) -> Graph:
    """Without the nodes (keys, node_id) and all their branches."""
    out = nodes.join(gone, [*keys, "node_id"], "left_anti")
    for k in ("node1", "node2"):
        branches = branches.join(gone.withColumnRenamed("node_id", k), [*keys, k], "left_anti")
    return branches.select(*keys, "branch_id", "node1", "node2"), out


def _contract(branches: DataFrame, links: DataFrame, gone: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Joins branches linked (keys, b1, b2) into one under the smallest id, with the ends that are not gone.

    What keeps no end vanishes; one end twice is a self loop. Also returns the lookup of branch ids.
    """
    found = connected_components(links, "b1", "b2", keys).select(*keys, F.col("id").alias("branch_id"), F.col("component"))
    named = branches.join(found, [*keys, "branch_id"], "left").withColumn("new_id", F.coalesce("component", "branch_id"))
    named = saved(named.select(*keys, "branch_id", "new_id", "node1", "node2"))
    ends = named.select(*keys, "new_id", F.explode(F.array("node1", "node2")).alias("node_id")).join(gone, [*keys, "node_id"], "left_anti")
    whole = ends.groupBy(*keys, "new_id").agg(F.min("node_id").alias("node1"), F.max("node_id").alias("node2"))
    whole = whole.select(*keys, F.col("new_id").alias("branch_id"), "node1", "node2")
    kept = whole.select(*keys, F.col("branch_id").alias("new_id"), F.lit(True).alias("_kept"))
    lookup = named.join(kept, [*keys, "new_id"], "left").select(*keys, F.col("branch_id").alias("old_id"), F.when(F.col("_kept"), F.col("new_id")).alias("new_id"))
    return whole, lookup


def fuse_nodes(branches: DataFrame, nodes: DataFrame, fused: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes nodes (keys, node_id) with two branches and joins these, along chains; a ring of such nodes vanishes.

    Nodes with more branches stay. Returns branches, nodes and the lookup of branch ids.
    """
    inc = incidence(branches, keys).join(fused.select(*keys, "node_id"), [*keys, "node_id"], "left_semi")
    pairs = inc.groupBy(*keys, "node_id").agg(F.min("branch_id").alias("b1"), F.max("branch_id").alias("b2"), F.count("*").alias("_n"))
    pairs = saved(pairs.filter("_n = 2"))
    gone = pairs.select(*keys, "node_id")
    whole, lookup = _contract(branches, pairs.select(*keys, "b1", "b2"), gone, keys)
    return whole, nodes.join(gone, [*keys, "node_id"], "left_anti"), lookup


def fused_pixels(nodes: DataFrame, branches: DataFrame, fused: DataFrame, lookup: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, branch_id, y, x) of each fused node: the branch that it became a part of."""
    # Its branches that are left have one new id; others, as spurs that went before, are not listed.
    own = incidence(branches, keys).join(fused, [*keys, "node_id"], "left_semi").withColumnRenamed("branch_id", "old_id")
    new = own.join(lookup, [*keys, "old_id"]).filter("new_id is not null").groupBy(*keys, "node_id").agg(F.min("new_id").alias("new_id"))
    return new.join(nodes, [*keys, "node_id"]).select(*keys, F.col("new_id").alias("branch_id"), "y", "x")


def fuse_node_pairs(branches: DataFrame, nodes: DataFrame, pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes pairs of ends (keys, a, b) and makes their two branches one. Pairs with a node that is no end,
    or that occurs twice, are left out."""
    both = pairs.select(*keys, "a", "b")
    each = both.select(*keys, F.explode(F.array("a", "b")).alias("node_id")).groupBy(*keys, "node_id").count().filter("count = 1")
    ends = incidence(branches, keys).groupBy(*keys, "node_id").agg(F.min("branch_id").alias("_b"), F.count("*").alias("_n")).filter("_n = 1")
    ok = saved(ends.join(each, [*keys, "node_id"], "left_semi").select(*keys, "node_id", "_b"))
    for k, n in (("a", "b1"), ("b", "b2")):
        both = both.join(ok.withColumnsRenamed({"node_id": k, "_b": n}), [*keys, k])
    both = saved(both)
    gone = both.select(*keys, F.explode(F.array("a", "b")).alias("node_id"))
    whole, lookup = _contract(branches, both.select(*keys, "b1", "b2"), gone, keys)
    return whole, nodes.join(gone, [*keys, "node_id"], "left_anti"), lookup


def draw_segments(segments: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, y, x) of the cells of straight lines (y1, x1)-(y2, x2), ends rounded, one cell a step of the longer side.

    Segments are dealt out by a number of tasks, as the work grows with their cells and not with their bytes.
    """
    tasks = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = segments.repartition(tasks, *keep)
    r = {c: F.bround(c, 0).cast("long") for c in ("y1", "x1", "y2", "x2")}
    rows = segments.withColumns(r)
    dy, dx = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    n = F.greatest(F.abs(dy), F.abs(dx))
    each = rows.withColumn("_n", n).withColumn("_t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n"))))
    # The shorter side moves once the error passes half a step.
    side = lambda a, d: F.col(a) + F.when(F.col("_n") == 0, 0).otherwise(F.signum(d) * F.floor((2 * F.abs(d) * F.col("_t") + F.col("_n") - 1) / (2 * F.col("_n")))).cast("long")
    return each.select(*keep, side("y1", dy).alias("y"), side("x1", dx).alias("x"))


def bridge_nodes(branches: DataFrame, nodes: DataFrame, branch_pixels: DataFrame, pairs: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fuses pairs of ends, relabels the pixels, and draws straight links between the ends.

    Pixels are sent, named anew and told apart in blocks of 8 x 8, some six times fewer rows for a line; each is returned once.
    """
    from .graph import relabel_pixels
    from .tiles import cells_of, in_blocks, joined_blocks

    whole, left, lookup = fuse_node_pairs(branches, nodes, pairs, keys)
    lookup = saved(lookup)
    seg = pairs.select(*keys, "a", "b")
    for k, n in (("a", "1"), ("b", "2")):
        seg = seg.join(nodes.select(*keys, F.col("node_id").alias(k), F.col("y").alias(f"y{n}"), F.col("x").alias(f"x{n}")), [*keys, k])
    own = incidence(branches, keys).withColumnsRenamed({"node_id": "a", "branch_id": "old_id"})
    seg = seg.join(own, [*keys, "a"]).join(lookup, [*keys, "old_id"]).filter("new_id is not null").withColumnRenamed("new_id", "branch_id")
    drawn = draw_segments(seg, [*keys, "branch_id"])
    by = [*keys, "branch_id"]
    drawn = drawn.select(*by, *[F.col(c).cast("int").alias(c) for c in ("y", "x")])
    blocks = relabel_pixels(in_blocks(branch_pixels, by), lookup, keys, in_blocks(drawn, by))
    return whole, left, cells_of(joined_blocks(blocks, by), by)


def merge_parallel_branches(branches: DataFrame, keys: list[str], nodes: DataFrame | None = None, distance: float | None = None) -> tuple[DataFrame, DataFrame]:
    """One branch, the smallest, for each pair of nodes; with a distance, only of nodes that are at most so far apart."""
    rows = branches
    near = F.lit(True)
    if distance is not None:
        for k in ("1", "2"):
            rows = rows.join(nodes.select(*keys, F.col("node_id").alias(f"node{k}"), F.col("y").alias(f"_y{k}"), F.col("x").alias(f"_x{k}")), [*keys, f"node{k}"])
        near = F.hypot(F.col("_y1") - F.col("_y2"), F.col("_x1") - F.col("_x2")) <= distance
    from pyspark.sql import Window

    first = F.min("branch_id").over(Window.partitionBy(*keys, "node1", "node2"))
    named = rows.withColumn("new_id", F.when(near, first).otherwise(F.col("branch_id")))
    lookup = named.select(*keys, F.col("branch_id").alias("old_id"), "new_id")
    return named.filter("branch_id = new_id").select(*keys, "branch_id", "node1", "node2"), lookup


def near_join(nodes: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """(keys, a, b, distance) of pairs a < b within the distance, by cells of that size and their neighbours."""
    cell = lambda c: F.floor(F.col(c) / distance)
    own = nodes.select(*keys, F.col("node_id").alias("a"), F.col("y").alias("_y1"), F.col("x").alias("_x1"), cell("y").alias("_cy"), cell("x").alias("_cx"))
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    wide = nodes.select(*keys, F.col("node_id").alias("b"), F.col("y").alias("_y2"), F.col("x").alias("_x2"), F.explode(around).alias("o"))
    wide = wide.select(*keys, "b", "_y2", "_x2", (cell("_y2") + F.col("o.i")).alias("_cy"), (cell("_x2") + F.col("o.j")).alias("_cx"))
    d = F.hypot(F.col("_y1") - F.col("_y2"), F.col("_x1") - F.col("_x2"))
    return own.join(wide, [*keys, "_cy", "_cx"]).filter((F.col("a") < F.col("b")) & (d <= distance)).select(*keys, "a", "b", d.alias("distance"))


def merge_clusters(branches: DataFrame, nodes: DataFrame, clusters: DataFrame, keys: list[str], erase: bool = True, weight=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Merges the nodes of each cluster (keys, node_id, cluster_id) into its smallest node.

    Branches inside a cluster go; without erase their label becomes the smallest branch that enters it.
    Returns branches, nodes with merged coordinates, and the lookup of branch ids.
    """
    low = clusters.groupBy(*keys, "cluster_id").agg(F.min("node_id").alias("new_id"))
    member = saved(clusters.join(low, [*keys, "cluster_id"]).select(*keys, "node_id", "new_id"))
    rows = branches
    for k in ("1", "2"):
        rows = rows.join(member.select(*keys, F.col("node_id").alias(f"node{k}"), F.col("new_id").alias(f"_c{k}")), [*keys, f"node{k}"], "left")
    # A self loop has one node in the cluster only, and stays.
    inner = F.coalesce((F.col("_c1") == F.col("_c2")) & (F.col("node1") != F.col("node2")), F.lit(False))
    ends = [F.coalesce(f"_c{k}", f"node{k}") for k in (1, 2)]
    rows = saved(rows.select(*keys, "branch_id", F.least(*ends).alias("node1"), F.greatest(*ends).alias("node2"), inner.alias("_inner"), "_c1", "_c2"))
    kept = rows.filter("not _inner").select(*keys, "branch_id", "node1", "node2")
    new = F.when(F.col("_inner"), None).otherwise(F.col("branch_id"))
    if not erase:
        entering = rows.filter("not _inner").select(*keys, "branch_id", F.explode(F.array("_c1", "_c2")).alias("_c1")).filter("_c1 is not null")
        entering = entering.groupBy(*keys, "_c1").agg(F.min("branch_id").alias("_in"))
        rows = rows.join(entering, [*keys, "_c1"], "left")
        new = F.when(F.col("_inner"), F.col("_in")).otherwise(F.col("branch_id"))
    lookup = rows.select(*keys, F.col("branch_id").alias("old_id"), new.alias("new_id"))
    whole = nodes.select(*keys, F.col("node_id").alias("old_id")).join(member.withColumnRenamed("node_id", "old_id"), [*keys, "old_id"], "left")
    whole = whole.select(*keys, "old_id", F.coalesce("new_id", "old_id").alias("new_id"))
    return kept, merge_coordinates(nodes, whole, keys, weight), lookup


def merge_near_nodes(branches: DataFrame, nodes: DataFrame, keys: list[str], junction: float = 0, termination: float = 0, node: float = 0) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Merges clusters of junctions, then of ends, then of all nodes that are close; each on the result before.

    Means are of the junctions of a cluster, or of all its nodes if it has none. What is an end is told anew before each step.
    """
    lookups = []
    for which, distance in (("junction", junction), ("termination", termination), ("node", node)):
        if distance <= 0:
            continue
        end = node_degree(branches, nodes, keys).select(*keys, "node_id", (F.col("degree") == 1).alias("_end"))
        known = saved(nodes.join(end, [*keys, "node_id"]))
        picked = known if which == "node" else known.filter(F.col("_end") == (which == "termination"))
        pairs = near_join(picked, keys, distance)
        clusters = connected_components(pairs, "a", "b", keys).select(*keys, F.col("id").alias("node_id"), F.col("component").alias("cluster_id"))
        branches, nodes, lookup = merge_clusters(branches, known, clusters, keys, True, ~F.col("_end"))
        branches, nodes = saved(branches), saved(nodes)
        lookups.append(saved(lookup))
    return branches, nodes, lookups


def remove_spurs_by_distance(branches: DataFrame, nodes: DataFrame, keys: list[str], distance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes branches from a junction to an end that is nearer than the distance; fuses junctions left with two branches.

    Returns branches, nodes and the lookup of the ids of branches that were not removed.
    """
    degree = saved(node_degree(branches, nodes, keys).join(nodes, [*keys, "node_id"]))
    rows = branches
    for k in ("1", "2"):
        rows = rows.join(degree.select(*keys, F.col("node_id").alias(f"node{k}"), F.col("degree").alias(f"_d{k}"), F.col("y").alias(f"_y{k}"), F.col("x").alias(f"_x{k}")), [*keys, f"node{k}"])
    one = (F.col("_d1") == 1) != (F.col("_d2") == 1)
    short = F.hypot(F.col("_y1") - F.col("_y2"), F.col("_x1") - F.col("_x2")) < distance
    swap = F.col("_d1") == 1
    spurs = saved(rows.filter(one & short).select(*keys, F.when(swap, F.col("node1")).otherwise(F.col("node2")).alias("node_id"), F.when(swap, F.col("node2")).otherwise(F.col("node1")).alias("junction")))
    branches, nodes = delete_nodes(branches, nodes, spurs.select(*keys, "node_id"), keys)
    branches, nodes = saved(branches), saved(nodes)
    old = spurs.select(*keys, F.col("junction").alias("node_id")).distinct()
    two = node_degree(branches, nodes, keys).filter("degree = 2").join(old, [*keys, "node_id"], "left_semi")
    return fuse_nodes(branches, nodes, two.select(*keys, "node_id"), keys)


def small_cycles(branches: DataFrame, nodes: DataFrame, keys: list[str], distance: float) -> DataFrame:
    """(keys, cycle_nodes) of chordless cycles of three or four nodes whose nodes are all nearer than the distance.

    Nodes are ranked by their degree. A cycle is looked for from corners below its highest node, which have
    few neighbours where that one has many, so a hub's neighbours never meet each other: about the number of
    links to the power of 1.5 corners in all. Of four, the highest node and the one opposite are tested first.
    """
    pairs = branches.filter("node1 <> node2").select(*keys, F.least("node1", "node2").alias("p"), F.greatest("node1", "node2").alias("q")).distinct()
    pos = nodes.select(*keys, "node_id", "y", "x")

    def spanned(df: DataFrame, u: str, v: str) -> DataFrame:
        """The rows whose two nodes are nearer than the distance."""
        for k in (u, v):
            df = df.join(pos.withColumnsRenamed({"node_id": k, "y": f"_y{k}", "x": f"_x{k}"}), [*keys, k])
        near = F.hypot(F.col(f"_y{u}") - F.col(f"_y{v}"), F.col(f"_x{u}") - F.col(f"_x{v}")) < distance
        return df.filter(near).drop(f"_y{u}", f"_y{v}", f"_x{u}", f"_x{v}")

    # Only sides that are short enough can be in such a cycle, but any side is a chord.
    chords = saved(pairs)
    short = spanned(chords, "p", "q").select(*keys, "p", "q")
    both = saved(short.unionByName(short.select(*keys, F.col("q").alias("p"), F.col("p").alias("q"))))
    rank = both.groupBy(*keys, "p").agg(F.count("*").alias("n")).select(*keys, "p", F.struct("n", "p").alias("_r"))
    links = both.join(rank, [*keys, "p"]).join(rank.withColumnsRenamed({"p": "q", "_r": "_s"}), [*keys, "q"])
    links = saved(links.select(*keys, F.col("p").alias("u"), F.col("q").alias("v"), "_r", "_s"))
    up = links.filter("_r < _s").select(*keys, "u", "v", F.col("_s").alias("_v"))
    corner = up.join(links.select(*keys, "u", F.col("v").alias("w"), F.col("_s").alias("_w"), (F.col("_r") < F.col("_s")).alias("_up")), [*keys, "u"])
    corner = corner.filter("_w < _v").select(*keys, "u", "v", "w", F.least("v", "w").alias("p"), F.greatest("v", "w").alias("q"), "_up")
    # Three: both other nodes above u, and linked.
    three = corner.filter("_up").join(short, [*keys, "p", "q"], "left_semi")
    three = three.select(*keys, F.array_sort(F.array("u", "v", "w")).alias("cycle_nodes"))
    # Four: v is the highest, w opposite; any two u between the same v and w.
    open_ = saved(spanned(corner.join(chords, [*keys, "p", "q"], "left_anti").select(*keys, "u", "v", "w"), "v", "w"))
    four = open_.join(open_.withColumnRenamed("u", "o"), [*keys, "v", "w"]).filter("u < o").select(*keys, "u", "o", "v", "w")
    four = spanned(four.join(chords.withColumnsRenamed({"p": "u", "q": "o"}), [*keys, "u", "o"], "left_anti"), "u", "o")
    # The smallest node first, its two neighbours in order around the one opposite.
    p, q = F.least("v", "w"), F.greatest("v", "w")
    four = four.select(*keys, F.when(F.col("u") < p, F.array("u", p, "o", q)).otherwise(F.array(p, "u", q, "o")).alias("cycle_nodes"))
    return three.unionByName(four)


def collapse_small_cycles(branches: DataFrame, nodes: DataFrame, keys: list[str], distance: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Each union of overlapping small cycles becomes one node."""
    cycles = small_cycles(branches, nodes, keys, distance)
    first = cycles.select(*keys, F.element_at("cycle_nodes", 1).alias("a"), F.explode("cycle_nodes").alias("b"))
    clusters = connected_components(first, "a", "b", keys).select(*keys, F.col("id").alias("node_id"), F.col("component").alias("cluster_id"))
    return merge_clusters(branches, nodes, clusters, keys)


def simplify_degree2(branches: DataFrame, nodes: DataFrame, keys: list[str], predicate=None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fuses nodes with two branches that pass the predicate (a column over the nodes), then drops nodes without branches."""
    two = node_degree(branches, nodes, keys).filter("degree = 2").join(nodes, [*keys, "node_id"])
    two = two if predicate is None else two.filter(predicate)
    branches, nodes, lookup = fuse_nodes(branches, nodes, two.select(*keys, "node_id"), keys)
    branches = saved(branches)
    left = node_degree(branches, nodes, keys).filter("degree > 0").select(*keys, "node_id")
    return branches, nodes.join(left, [*keys, "node_id"], "left_semi"), lookup


def clean_graph(
    branches: DataFrame, nodes: DataFrame, keys: list[str], spurs: float = 0, junction: float = 0, termination: float = 0, node: float = 0, cycles: float = 0, simplify: str | None = "node", predicate=None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Spurs, near nodes, small cycles, parallel branches and chains, in this order; a distance of 0 skips a step.

    simplify: "branch", "node", "both" or None. Without "branch", parallel branches are merged only where the
    ends are within ``cycles``. Returns branches, nodes and the lookup (keys, old_id, new_id) of all given
    branches through all steps, null for those that were dropped.
    """
    return _cleaned(branches, nodes, keys, spurs, junction, termination, node, cycles, simplify, predicate)[:3]


def _cleaned(branches, nodes, keys, spurs=0, junction=0, termination=0, node=0, cycles=0, simplify="node", predicate=None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """``clean_graph``, and the pixels (keys, branch_id, y, x) of fused nodes under the ids at the end, each once; None if no step fuses."""
    first, steps, fused = branches, [], []

    def fuses(new: DataFrame, left: DataFrame, lookup: DataFrame) -> tuple[DataFrame, DataFrame]:
        steps.append(lookup)
        gone = nodes.select(*keys, "node_id").join(left, [*keys, "node_id"], "left_anti")
        fused.append((len(steps), fused_pixels(nodes, branches, gone, lookup, keys)))
        return new, left

    if spurs > 0:
        branches, nodes = fuses(*(saved(d) for d in remove_spurs_by_distance(branches, nodes, keys, spurs)))
    if max(junction, termination, node) > 0:
        branches, nodes, lookups = merge_near_nodes(branches, nodes, keys, junction, termination, node)
        steps += lookups
    if cycles > 0:
        branches, nodes, lookup = (saved(d) for d in collapse_small_cycles(branches, nodes, keys, cycles))
        steps.append(lookup)
    every = simplify in ("branch", "both")
    if cycles > 0 or every:
        branches, lookup = (saved(d) for d in merge_parallel_branches(branches, keys, nodes, None if every else cycles))
        steps.append(lookup)
    if simplify in ("node", "both"):
        branches, nodes = fuses(*simplify_degree2(branches, nodes, keys, predicate))
    return branches, nodes, follow_lookups(first, steps, keys), _last_fused(fused, steps, keys)


def _last_fused(fused: list[tuple[int, DataFrame]], steps: list[DataFrame], keys: list[str]) -> DataFrame | None:
    """The pixels of fused nodes through the lookups after their own; at one pixel the last step counts, of one step the smallest branch."""
    rows = None
    for n, found in fused:
        for lookup in steps[n:]:
            found = apply_lookup(found, lookup, keys, "branch_id", keep=False)
        found = found.filter("branch_id is not null").select(*keys, F.struct(F.lit(-n), "branch_id").alias("_b"), *[F.col(c).cast("int").alias(c) for c in ("y", "x")])
        rows = found if rows is None else rows.unionByName(found)
    return None if rows is None else rows.groupBy(*keys, "y", "x").agg(F.min("_b").alias("_b")).select(*keys, "_b.branch_id", "y", "x")


def follow_lookups(branches: DataFrame, lookups: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, old_id, new_id) of the branches through lookups one after the other; null once one drops or lacks an id."""
    out = branches.select(*keys, F.col("branch_id").alias("old_id"), F.col("branch_id").alias("new_id"))
    for lookup in lookups:
        step = lookup.select(*keys, F.col("old_id").alias("new_id"), F.col("new_id").alias("_next"))
        out = out.join(step, [*keys, "new_id"], "left").select(*keys, "old_id", F.col("_next").alias("new_id"))
    return out


def by_width(width: float) -> dict[str, float]:
    """The distances of ``clean_graph`` for the largest width of a line."""
    return dict(spurs=width, junction=width // 2 + 1, termination=0, node=width // 2, cycles=width)


def clean_graph_by_width(branches: DataFrame, nodes: DataFrame, keys: list[str], width: float, **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``clean_graph`` with distances from the largest width of a line."""
    return clean_graph(branches, nodes, keys, **by_width(width), **how)


def masks_to_graphs(pixels: DataFrame, width: float | None = None, spurs: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From masks to cleaned graphs, keyed by image_id: branches, nodes, and the branches' pixels under the cleaned ids.

    Where a node was fused, its pixel belongs to the branch that it became a part of, whatever was there before.
    """
    from .graph import relabel_pixels
    from .skeleton import CELL, parse_skeleton, skeleton_of_masks

    labels, branches, nodes = parse_skeleton(skeleton_of_masks(pixels, spurs))
    if width is None:
        return branches, nodes, labels
    branches, nodes, lookup, fused = _cleaned(branches.hint("merge"), nodes.hint("merge"), ["image_id"], **by_width(width))
    fused, lookup = saved(fused), saved(lookup)
    return branches, nodes, relabel_pixels(labels.join(fused, CELL, "left_anti"), lookup, ["image_id"], fused)
