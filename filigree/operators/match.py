"""Matching of the nodes of two graphs by distance.

``pred`` and ``target`` are nodes (keys, node_id, y, x) of the two sides; ties in distance go to the smallest
id. Candidates within a limit are found by cells of its size; without a limit all pairs of a graph count.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.sources.scratch import bounded_broadcasts, discard, saved

from .components import connected_components


def cross_distance(pred: DataFrame, target: DataFrame, keys: list[str], limit: float | None = None) -> DataFrame:
    """(keys, pred_node, target_node, distance) of all pairs of a graph, or of those within the limit."""
    a = pred.select(*keys, F.col("node_id").alias("pred_node"), F.col("y").alias("_y1"), F.col("x").alias("_x1"))
    b = target.select(*keys, F.col("node_id").alias("target_node"), F.col("y").alias("_y2"), F.col("x").alias("_x2"))
    on = list(keys)
    if limit is not None:
        cell = lambda c: F.floor(F.col(c) / limit)
        around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
        a = a.withColumns({"_cy": cell("_y1"), "_cx": cell("_x1")})
        b = b.withColumn("_o", F.explode(around)).withColumns({"_cy": cell("_y2") + F.col("_o.i"), "_cx": cell("_x2") + F.col("_o.j")})
        on += ["_cy", "_cx"]
    d = F.hypot(F.col("_y1") - F.col("_y2"), F.col("_x1") - F.col("_x2"))
    out = a.join(b, on).select(*keys, "pred_node", "target_node", d.alias("distance"))
    return out if limit is None else out.filter(F.col("distance") <= limit)


def distance_matrix(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, distance) of all pairs of points in a group, both ways and with themselves."""
    out = cross_distance(points, points, keys)
    return out.withColumnsRenamed({"pred_node": "a", "target_node": "b"})


def nearest_node(pairs: DataFrame, keys: list[str], side: str = "pred_node", other: str = "target_node") -> DataFrame:
    """The nearest node opposite of each node of a side."""
    best = pairs.groupBy(*keys, side).agg(F.min(F.struct("distance", other)).alias("_b"))
    return best.select(*keys, side, f"_b.{other}", "_b.distance")


def _known(nodes: DataFrame) -> DataFrame:
    """The nodes that have a place."""
    return nodes.filter((F.abs("y") < float("inf")) & (F.abs("x") < float("inf")))


def nearest(pred: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pred_node, target_node, distance): the nearest target of each pred, without a table of all pairs.

    Cells are as wide as a graph's targets lie apart on average. Each pred looks in the cells around its own;
    those that find a target within a cell's width are done, the others look again in cells four times as
    wide. Nodes without a finite place and graphs without targets give no row.
    """
    extent = lambda c: F.max(c) - F.min(c)
    n, h, w = F.count("*"), extent("y"), extent("x")
    spots = _known(target)
    spacing = spots.groupBy(*keys).agg(F.greatest(F.sqrt(h * w / n), F.greatest(h, w) / n).alias("_s")).withColumn("_s", F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0))
    place = lambda df, name, k: saved(df.join(spacing, keys).select(*keys, F.col("node_id").alias(name), F.col("y").alias(f"_y{k}"), F.col("x").alias(f"_x{k}"), "_s"))
    left, spots, out, reach = place(_known(pred), "pred_node", 1), place(spots, "target_node", 2), None, 1.0
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    while True:
        # A little wider than the reach, so that rounding puts no target within it two cells away.
        cell = lambda c: F.floor(F.col(c) / (F.col("_s") * (reach * (1 + 1e-9))))  # noqa: E731, B023
        a = left.withColumn("_o", F.explode(around)).withColumns({"_cy": cell("_y1") + F.col("_o.i"), "_cx": cell("_x1") + F.col("_o.j")})
        b = spots.withColumns({"_cy": cell("_y2"), "_cx": cell("_x2")}).drop("_s")
        d = F.hypot(F.col("_y1") - F.col("_y2"), F.col("_x1") - F.col("_x2"))
        pairs = a.join(b, [*keys, "_cy", "_cx"]).withColumn("distance", d).filter(F.col("distance") <= F.col("_s") * reach)
        found = saved(nearest_node(pairs, keys))
        out = found if out is None else out.unionByName(found)
        rest, before = saved(left.join(found, [*keys, "pred_node"], "left_anti")), left
        discard(before)
        if rest.isEmpty():
            return out
        left, reach = rest, reach * 4


def mutual_nearest(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs that are each other's nearest."""
    a = nearest_node(pairs, keys)
    b = nearest_node(pairs, keys, "target_node", "pred_node").drop("distance")
    return a.join(b, [*keys, "pred_node", "target_node"])


#: What the nodes beyond the reach of a density may add to it at most.
DENSITY_ERROR = 1e-9


def density_reach(most: int, sigma: float) -> float:
    """A radius beyond which ``most`` nodes add at most DENSITY_ERROR to a sum of exp(-d² / 2 sigma²)."""
    return sigma * math.sqrt(2 * math.log(max(most, 1) / DENSITY_ERROR))


def node_density(pred: DataFrame, target: DataFrame, keys: list[str], sigma: float) -> DataFrame:
    """(keys, node_id, density) of pred: means of how crowded its own and the other graph are there, each 0 to 1.

    Nodes are looked up by cells up to the radius beyond which all nodes of the largest graph together add
    less than DENSITY_ERROR, so a density is too small by at most that.
    """
    counts = pred.groupBy(*keys).count().unionByName(target.groupBy(*keys).count())
    reach = density_reach(counts.agg(F.max("count")).first()[0] or 1, sigma)

    def crowd(other: DataFrame) -> DataFrame:
        pairs = cross_distance(pred, other, keys, reach)
        weight = F.exp(-F.col("distance") * F.col("distance") / (2 * sigma * sigma))
        return pairs.groupBy(*keys, F.col("pred_node").alias("node_id")).agg(F.sum(weight).alias("_s"))

    clip = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    own = crowd(pred).select(*keys, "node_id", clip(F.col("_s") - 1).alias("_own"))
    cross = crowd(target).select(*keys, "node_id", clip(F.col("_s")).alias("_cross"))
    out = own.join(cross, [*keys, "node_id"], "left")
    return out.select(*keys, "node_id", ((F.col("_own") + F.coalesce("_cross", F.lit(0.0))) / 2).alias("density"))


def match_limits(pred: DataFrame, target: DataFrame, keys: list[str], limit: float, sigma: float, least: float | None = None) -> DataFrame:
    """(keys, node_id, max_distance) of pred: the limit times what the density of the nearest node opposite leaves."""
    least = max(limit / 20, 1) if least is None else least
    near = nearest(pred, target, keys)
    density = node_density(target, pred, keys, sigma).withColumnRenamed("node_id", "target_node")
    own = near.join(density, [*keys, "target_node"])
    value = F.least(F.greatest(limit * (1 - F.col("density")), F.lit(float(least))), F.lit(float(limit)))
    return own.select(*keys, F.col("pred_node").alias("node_id"), value.alias("max_distance"))


def match_weights(pred: DataFrame, target: DataFrame, keys: list[str], limit: float | None = None, sigma: float | None = None, least: float | None = None, gamma: float = 0) -> DataFrame:
    """(keys, pred_node, target_node, distance, weight, gain): what a pair adds over leaving both unmatched.

    A node may stay unmatched for half the weight of its limit (without a limit, for nothing).
    """
    pairs = cross_distance(pred, target, keys)
    if gamma > 0:
        weigh = lambda d: F.exp(-gamma * d / 1000)
    else:
        pairs = pairs.join(pairs.groupBy(*keys).agg(F.max("distance").alias("_max")), keys)
        weigh = lambda d: F.col("_max") - d
    pairs = pairs.withColumn("weight", weigh(F.col("distance")))
    if sigma is None:
        alone = F.lit(0.0) if limit is None else weigh(F.lit(float(limit)))
        return pairs.withColumn("gain", F.col("weight") - alone).select(*keys, "pred_node", "target_node", "distance", "weight", "gain")
    for side, a, b in (("pred_node", pred, target), ("target_node", target, pred)):
        own = match_limits(a, b, keys, limit, sigma, least).withColumnsRenamed({"node_id": side, "max_distance": f"_m{side}"})
        pairs = pairs.join(own, [*keys, side])
    both = (weigh(F.col("_mpred_node")) + weigh(F.col("_mtarget_node"))) / 2
    return pairs.withColumn("gain", F.col("weight") - both).select(*keys, "pred_node", "target_node", "distance", "weight", "gain")


def match_gains(pred: DataFrame, target: DataFrame, keys: list[str], limit: float | None = None, sigma: float | None = None, least: float | None = None, gamma: float = 0) -> DataFrame:
    """(keys, pred_node, target_node, distance, gain) of the pairs with a gain, which lie within the limit.

    The largest distance of a graph cancels out of gains, so only near pairs are looked at. With a sigma, the limits
    of the nodes are at most ``limit`` too.
    """
    if limit is None:
        return match_weights(pred, target, keys, limit, sigma, least, gamma).filter("gain > 0").drop("weight")
    weigh = (lambda d: F.exp(-gamma * d / 1000)) if gamma > 0 else (lambda d: -d)
    pairs, alone = cross_distance(pred, target, keys, limit), weigh(F.lit(float(limit)))
    if sigma is not None:
        for side, a, b in (("pred_node", pred, target), ("target_node", target, pred)):
            own = match_limits(a, b, keys, limit, sigma, least).withColumnsRenamed({"node_id": side, "max_distance": f"_m{side}"})
            pairs = pairs.join(own, [*keys, side])
        alone = (weigh(F.col("_mpred_node")) + weigh(F.col("_mtarget_node"))) / 2
    return pairs.withColumn("gain", weigh(F.col("distance")) - alone).filter("gain > 0").select(*keys, "pred_node", "target_node", "distance", "gain")


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """The pairs of largest total gain (potentials and augmenting paths); pairs without gain stay unmatched."""
    n, m = gain.shape
    if n > m:
        return [(i, j) for j, i in assign(gain.T)]
    cost = np.concatenate([-np.maximum(gain, 0), np.zeros((n, n))], axis=1)
    width = m + n
    u, v, owner = np.zeros(n + 1), np.zeros(width + 1), np.zeros(width + 1, int)
    for i in range(1, n + 1):
        owner[0], at = i, 0
        least, before, done = np.full(width + 1, np.inf), np.zeros(width + 1, int), np.zeros(width + 1, bool)
        while owner[at]:
            done[at] = True
            row = owner[at]
            slack = cost[row - 1] - u[row] - v[1:]
            better = ~done[1:] & (slack < least[1:])
            least[1:][better], before[1:][better] = slack[better], at
            to = int(np.where(done, np.inf, least).argmin())
            step = least[to]
            u[owner[done]] += step
            v[done] -= step
            least[~done] -= step
            at = to
        while at:
            owner[at] = owner[before[at]]
            at = before[at]
    return [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j] and gain[owner[j] - 1, j - 1] > 0]


#: Dense gain tables of up to so many cells are solved by augmenting paths, larger parts by an auction over their pairs.
DENSE = 40_000
#: Steps of the auction as shares of the largest gain: the first, the last, and the ratio of one to the next.
FIRST, LAST, RATIO = 0.25, 1e-12, 8


def assign_sparse(pairs: list[tuple[int, int, float]]) -> set[tuple[int, int]]:
    """The pairs (i, j, gain) of largest total gain, by an auction with epsilon scaling in memory that grows with the pairs.

    Nodes may stay unmatched: each is a bidder and an object, the two of a node may take each other for
    nothing, and for each pair the second node's bidder may take the first's object for nothing. So there is
    always an object for everyone, and the total is within LAST times the largest gain of the best for each node.
    """
    wants: dict[int, dict[int, float]] = {}
    for i, j, gain in pairs:
        for bidder, thing, worth in ((2 * i, 2 * j + 1, gain), (2 * j + 1, 2 * i, 0.0), (2 * i, 2 * i, 0.0), (2 * j + 1, 2 * j + 1, 0.0)):
            own = wants.setdefault(bidder, {})
            own[thing] = max(own.get(thing, 0.0), worth)
    most = max((gain for *_, gain in pairs), default=0.0)
    choices = {k: (list(own), list(own.values())) for k, own in wants.items()}
    price, step, owner = dict.fromkeys(wants, 0.0), most * FIRST, {}
    while most > 0:
        owner, waiting = {}, list(wants)
        while waiting:
            bidder = waiting.pop()
            best = second = float("-inf")
            for thing, gain in zip(*choices[bidder], strict=True):
                value = gain - price[thing]
                if value > best:
                    best, second, chosen = value, best, thing
                elif value > second:
                    second = value
            price[chosen] += best - second + step
            if (before := owner.get(chosen)) is not None:
                waiting.append(before)
            owner[chosen] = bidder
        if step <= most * LAST:
            break
        step = max(step / RATIO, most * LAST)
    return {(bidder // 2, thing // 2) for thing, bidder in owner.items() if thing % 2 and not bidder % 2}


def assign_component(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """The best assignment in each component (keys, component, pred_node, target_node, distance, gain).

    A pair that is alone in its component is its best assignment if it gains; only the others go to Python, a component
    as a row, so that many come in a batch.
    """
    schema = pairs.select(*keys, "pred_node", "target_node", "distance").schema
    columns = ["distance", "pred_node", "target_node", "gain"]
    sized = saved(pairs.withColumn("_pairs", F.count("*").over(Window.partitionBy(*keys, "component"))))
    alone = sized.filter("_pairs = 1 and gain > 0").select(*keys, "pred_node", "target_node", "distance")

    def solve(pred: np.ndarray, target: np.ndarray, gains: np.ndarray) -> list[bool]:
        """Which pairs are taken."""
        (a, i), (b, j) = (np.unique(side, return_inverse=True) for side in (pred, target))
        if len(a) * len(b) <= DENSE:
            gain = np.zeros((len(a), len(b)))
            gain[i, j] = gains
            chosen = set(assign(gain))
        else:
            chosen = assign_sparse(list(zip(i.tolist(), j.tolist(), gains.tolist(), strict=True)))
        return [(x, y) in chosen for x, y in zip(i.tolist(), j.tolist(), strict=True)]

    def run(batches):
        for batch in batches:
            lists = {c: batch.column(c) for c in columns}
            cuts = lists["gain"].offsets.to_numpy()
            pred, target, gains = (lists[c].values.to_numpy(zero_copy_only=False) for c in columns[1:])
            kept = [solve(pred[a:b], target[a:b], gains[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
            rows = pa.array(np.repeat(np.arange(len(kept)), [sum(k) for k in kept]))
            at = pa.array(cuts[0] + np.flatnonzero(np.concatenate(kept)) if kept else [], pa.int64())
            arrays = [batch.column(c).take(rows) for c in keys] + [lists[c].values.take(at) for c in ("pred_node", "target_node", "distance")]
            yield pa.RecordBatch.from_arrays(arrays, schema.names)

    # By a number of partitions, which are not merged for being small: the work is in the parts, not in their bytes.
    tasks = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    others = sized.filter("_pairs > 1").drop("_pairs").repartition(tasks, *keys, "component")
    parts = others.groupBy(*keys, "component").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("_p"))
    return alone.unionByName(parts.select(*keys, *[F.col(f"_p.{c}").alias(c) for c in columns]).mapInArrow(run, schema))


def gain_parts(gains: DataFrame, keys: list[str]) -> DataFrame:
    """``gains`` (each pair once) with the connected part of each pair, as ``component``.

    Pairs whose two nodes have no other are parts already; only the rest is looked at as a graph.
    """
    own = {side: F.count("*").over(Window.partitionBy(*keys, side)) for side in ("pred_node", "target_node")}
    shared = F.greatest(own["pred_node"], own["target_node"]) > 1
    gains = saved(gains.withColumn("_shared", shared))
    single = gains.filter(~F.col("_shared")).drop("_shared").withColumn("component", F.least(F.col("pred_node") * 2, F.col("target_node") * 2 + 1))
    gains = gains.filter("_shared").drop("_shared")
    edges = gains.select(*keys, (F.col("pred_node") * 2).alias("a"), (F.col("target_node") * 2 + 1).alias("b"))
    part = connected_components(edges, "a", "b", keys).filter("id % 2 = 0").select(*keys, (F.col("id") / 2).cast("long").alias("pred_node"), "component")
    return gains.join(part, [*keys, "pred_node"]).unionByName(single)


def match_nodes(pred: DataFrame, target: DataFrame, keys: list[str], limit: float, sigma: float | None = None, least: float | None = None, gamma: float = 0) -> DataFrame:
    """(keys, pred_node, target_node, distance) of the assignment with the largest total weight.

    Pairs without a gain never improve it, so it is solved in each connected part of the pairs with one.
    """
    bounded_broadcasts(pred.sparkSession)
    return assign_component(gain_parts(saved(match_gains(pred, target, keys, limit, sigma, least, gamma)), keys), keys)


def greedy_match(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Rounds of mutual best pairs by (gain, distance, ids) until no pair with a gain is left."""
    left, out = saved(pairs.filter("gain > 0")), None
    while not left.isEmpty():
        order = F.struct((-F.col("gain")).alias("g"), "distance", "pred_node", "target_node")
        a = left.groupBy(*keys, "pred_node").agg(F.min(order).alias("_b")).select(*keys, "pred_node", "_b.target_node")
        b = left.groupBy(*keys, "target_node").agg(F.min(order).alias("_b")).select(*keys, "target_node", "_b.pred_node")
        best = saved(left.join(a.join(b, [*keys, "pred_node", "target_node"]), [*keys, "pred_node", "target_node"]))
        out = best if out is None else out.unionByName(best)
        done, left = left, saved(left.join(best.select(*keys, "pred_node"), [*keys, "pred_node"], "left_anti").join(best.select(*keys, "target_node"), [*keys, "target_node"], "left_anti"))
        discard(done)
    rows = left if out is None else out
    return rows.select(*keys, "pred_node", "target_node", "distance")


def split_matched(nodes: DataFrame, matches: DataFrame, keys: list[str], side: str) -> tuple[DataFrame, DataFrame]:
    """The nodes of a side that are matched, and the others."""
    listed = matches.select(*keys, F.col(side).alias("node_id"))
    return nodes.join(listed, [*keys, "node_id"], "left_semi"), nodes.join(listed, [*keys, "node_id"], "left_anti")
