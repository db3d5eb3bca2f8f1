"""Skeletons: thinning, the kind of each pixel, spurs, and branches between nodes.

A skeleton pixel's kind is 1 endpoint, 2 branch, 3 or 4 junction of as many lines. All tables are keyed by
``image_id``; identity of pixels within an image is (y, x), and branch and node numbers follow the order
of their first pixel, row by row.
"""

from __future__ import annotations

from functools import cache, reduce
from operator import or_

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.sources.scratch import bounded_broadcasts, discard, saved

from .components import connected_components
from .raster import CELL, CLOCKWISE, KEY
from .tiles import SIZE, boxed, codes, first_of, labels, over_tiles

# 3 x 3 patterns row by row; 1 must be set, 0 must not, 2 may be either.
JUNCTION_3 = ["101 010 212", "101 212 010", "010 211 120", "210 011 102", "202 111 010", "120 012 101"]
JUNCTION_4 = ["101 010 101", "010 111 010", "222 211 211"]
ENDPOINT = ["212 010 000", "021 012 000"]
SOLO = ["000 010 000"]
HOLLOW = ["212 101 212"]


def rotated(pattern: str) -> list[str]:
    """The pattern and its three quarter turns."""
    out = [pattern.split()]
    for _ in range(3):
        out.append(["".join(row[2 - k] for row in out[-1]) for k in range(3)])
    return [" ".join(p) for p in out]


def masks(pattern: str) -> tuple[int, int]:
    """Which bits of a 3 x 3 code must be set, and which must not."""
    cells = pattern.replace(" ", "")
    return sum(1 << k for k in range(9) if cells[k] == "1"), sum(1 << k for k in range(9) if cells[k] == "0")


@cache
def pattern_masks() -> dict[str, list[tuple[int, int]]]:
    turn = lambda ps: [masks(q) for p in ps for q in rotated(p)]
    return {
        "junction3": turn(JUNCTION_3), "junction4": [masks(p) for p in JUNCTION_4],
        "endpoint": turn(ENDPOINT) + [masks(p) for p in SOLO], "hollow": [masks(p) for p in HOLLOW],
    }


def junction_patterns(spark) -> DataFrame:
    """(pattern_id, family, pos, neg) of all patterns: 24 of three lines, 3 of four, the hollow cross, 9 of ends."""
    rows = [(name, pos, neg) for name, ps in pattern_masks().items() for pos, neg in ps]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "pattern_id int, family string, pos int, neg int")


def _matches(code: int, family: str) -> bool:
    return any(code & pos == pos and not code & neg for pos, neg in pattern_masks()[family])


def _flags(df: DataFrame, *families: str) -> DataFrame:
    """Adds a boolean column for each family, looked up by code in a table of 512 rows."""
    rows = [(c, *(_matches(c, f) for f in families)) for c in range(512)]
    table = df.sparkSession.createDataFrame(rows, "code long, " + ", ".join(f"{f} boolean" for f in families))
    return df.join(F.broadcast(table), "code", "left")


@cache
def _table(family: str) -> np.ndarray:
    """Which of the 512 codes match a family."""
    return np.array([_matches(c, family) for c in range(512)])


def _levels(mask: np.ndarray, fix_hollow: bool) -> np.ndarray:
    """0 background, 1 branch, 2 and 3 junction; looks 1 cell around, or 3 with the repair.

    The repair fills a hollow cross's middle, lowers the 3 x 3 block around it, and classes the middle anew.
    """
    level = lambda code: np.select([_table("junction4")[code], _table("junction3")[code]], [3, 2], 1)
    code = codes(mask)
    v = np.where(mask, level(code), 0)
    if not fix_hollow or not (hollow := _table("hollow")[code]).any():
        return v
    v = np.where(hollow, 1, np.maximum(v - np.bitwise_count(codes(hollow)), 0))
    return np.where(hollow, level(codes(v > 0)), v)


def classify_pixels(pixels: DataFrame, fix_hollow: bool = True) -> DataFrame:
    """(image, y, x, kind) of the pixels of thin lines, by one pass over tiles."""

    def kinds(mask, _):
        v = _levels(mask, fix_hollow)
        y, x = np.nonzero(v)
        return y, x, (v + 1 - _table("endpoint")[codes(v > 0)])[y, x].astype(np.int32)

    reach = 3 if fix_hollow else 1
    return over_tiles(pixels, reach, boxed(kinds, reach), "kind int", outside=fix_hollow)


def fix_hollow_cross(pixels: DataFrame) -> DataFrame:
    """(image, y, x, v): 1 branch, 2 and 3 junction, after the repair."""

    def levels(mask, _):
        v = _levels(mask, True)
        y, x = np.nonzero(v)
        return y, x, v[y, x].astype(np.int32)

    return over_tiles(pixels, 3, boxed(levels, 3), "v int")


def _ended(kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """The cells of a kind over 0, with kind 1 for the ends that are found by pattern; looks 1 cell around."""
    set_ = kind > 0
    y, x = np.nonzero(set_)
    return y, x, np.where(_table("endpoint")[codes(set_)], 1, kind)[y, x].astype(np.int32)


def _endpoints(skeleton: DataFrame) -> DataFrame:
    """Ends found by pattern become kind 1."""
    return over_tiles(skeleton, 1, boxed(lambda _, kind: _ended(kind), 1), "kind int", "kind", outside=False)


def remove_1px_spurs(skeleton: DataFrame) -> DataFrame:
    """Drops ends that touch a junction and lowers the junctions around; then finds the ends anew."""

    def left(_, kind):
        spurs = (kind == 1) & (codes(kind >= 3) > 0)
        n = np.bitwise_count(codes(spurs))
        lowered = np.select([kind <= 1, (kind == 4) & (n == 1)], [0, 3], 2)
        return _ended(np.where((n == 1) | (n == 2), np.where(np.isnan(kind), 0, lowered), kind))

    return over_tiles(skeleton, 3, boxed(left, 3), "kind int", "kind", outside=False)


def remove_short_spurs(skeleton: DataFrame, length: int) -> DataFrame:
    """Drops branches with an end that have fewer branch pixels than ``length``, then single pixels."""
    skeleton = saved(skeleton)
    branches, ends, _ = parse_skeleton(skeleton, keep_open=True)
    tips = saved(ends.join(skeleton.filter("kind = 1").select(*CELL).hint("merge"), CELL, "left_semi").select(KEY, "branch_id", "y", "x"))
    short = branches.groupBy(KEY, "branch_id").count().filter(F.col("count") < length)
    short = saved(short.join(tips.hint("merge"), [KEY, "branch_id"], "left_semi").select(KEY, "branch_id"))
    gone = branches.unionByName(tips).join(short.hint("merge"), [KEY, "branch_id"], "left_semi").select(*CELL)
    left = skeleton.join(gone.hint("merge"), CELL, "left_anti")
    return remove_1px_spurs(_endpoints(saved(left)))


# --- thinning


@cache
def removable(first: bool) -> tuple[bool, ...]:
    """By the code of the eight neighbours, clockwise from the upper left: whether the pass removes the pixel."""

    def rule(code: int) -> bool:
        ring = [code >> k & 1 for k in range(8)]
        n, e, s, w = ring[1], ring[3], ring[5], ring[7]
        turns = sum(a == 0 and b == 1 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
        sides = (n * e * s, e * s * w) if first else (n * e * w, n * s * w)
        return 2 <= sum(ring) <= 6 and turns == 1 and not any(sides)

    return tuple(rule(c) for c in range(256))


#: Rounds that a tile runs by itself, which spoil twice as many cells at the edge of its halo.
ROUNDS = 8


def thinned(mask: np.ndarray, rounds: int) -> np.ndarray:
    """Up to so many rounds of two passes; what is beyond the array is background."""
    state = np.pad(mask, 1)
    rings = [divmod(b, 3) for b in CLOCKWISE]
    tables = [np.array(removable(first)) for first in (True, False)]
    h, w = mask.shape
    for _ in range(rounds):
        left = state.sum()
        for table in tables:
            code = sum(state[i : i + h, j : j + w].astype(np.uint8) << k for k, (i, j) in enumerate(rings))
            state[1:-1, 1:-1] &= ~table[code]
        if state.sum() == left:
            break
    return state[1:-1, 1:-1]


def thin(pixels: DataFrame) -> DataFrame:
    """(image, y, x) of lines one pixel wide, by two passes a round until a round removes nothing.

    By tiles: each runs ROUNDS rounds before tiles exchange their halos.
    """
    state, before = saved(pixels.select(*CELL).dropna(subset=["y", "x"]).distinct()), -1
    while (now := state.count()) != before:
        before, old = now, state
        state = saved(over_tiles(state, 2 * ROUNDS, boxed(lambda mask, _: np.nonzero(thinned(mask, ROUNDS)), 0), ""))
        discard(old)
    return state


# --- components and branches


def pixel_id(y: str = "y", x: str = "x"):
    return F.shiftleft(F.col(y).cast("long"), 31) + F.col(x).cast("long")


def components_pixels(pixels: DataFrame, connectivity: int = 2) -> DataFrame:
    """(image, y, x, component): numbered by their first pixel; connectivity 1 is by sides, 2 by corners too.

    Each tile finds its own components; only those that touch across an edge of tiles meet as a graph.
    """

    def local(mask, _, top, left):
        y, x, first = boxed(lambda m, _: (*np.nonzero(m), labels(m, connectivity)), 0)(mask, None)
        ids = ((y + top).astype(np.int64) << 31) + x + left
        return y, x, ids[first]

    own = saved(over_tiles(pixels, 0, local, "part long"))
    last = lambda c: F.pmod(F.col(c), F.lit(SIZE)).isin(0, SIZE - 1)
    edge = own.filter(last("y") | last("x"))
    ahead = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if connectivity == 2 else [])
    spots = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in ahead])
    moved = edge.select(KEY, F.col("part").alias("a"), "y", "x", F.explode(spots).alias("o"))
    moved = moved.select(KEY, "a", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    edges = moved.join(edge.withColumnRenamed("part", "b"), CELL).filter("a <> b").select(KEY, "a", "b").distinct()
    found = connected_components(edges, "a", "b", [KEY]).withColumnRenamed("id", "part")
    return own.join(found, [KEY, "part"], "left").select(*CELL, F.coalesce("component", "part").alias("component"))


def remove_small_components(pixels: DataFrame, least: int = 3) -> DataFrame:
    labelled = components_pixels(pixels)
    large = labelled.groupBy(KEY, "component").count().filter(F.col("count") >= least)
    return labelled.join(large, [KEY, "component"], "left_semi").select(*CELL)


def largest_component(pixels: DataFrame, connectivity: int = 1) -> DataFrame:
    """The pixels of each image's largest component; of equal ones, the first."""
    labelled = components_pixels(pixels, connectivity)
    sizes = labelled.groupBy(KEY, "component").count()
    best = sizes.groupBy(KEY).agg(F.max(F.struct("count", (-F.col("component")).alias("c"))).alias("b"))
    return labelled.join(best.select(KEY, (-F.col("b.c")).alias("component")), [KEY, "component"], "left_semi").select(*CELL)


def roi_mask(image: DataFrame, h: int, w: int, blur: int = 5, threshold: float = 5, channel: str = "r") -> DataFrame:
    """The region of interest of a dense image: blurred, over the threshold, the largest part by sides."""
    from .raster import median_blur

    return largest_component(median_blur(image, channel, blur, h, w).filter(F.col("v") > threshold).select(*CELL), 1)


#: (dy, dx) of the eight neighbours, clockwise from the upper left.
RING = [(-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1)]


def close_slots(slot: int) -> int:
    """Bit mask of the neighbour slots that touch a slot, itself included."""
    dy, dx = RING[slot]
    return sum(1 << k for k, (a, b) in enumerate(RING) if max(abs(a - dy), abs(b - dx)) <= 1)


def drop_close_neighbours(skeleton: DataFrame) -> DataFrame:
    """(image, y, x, hidden) of branch pixels: bit mask of neighbour slots next to a node among the neighbours."""
    nodes = skeleton.filter("kind != 2").select(*CELL)
    spots = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx"), F.lit(close_slots(k)).alias("m")) for k, (a, b) in enumerate(RING)])
    near = nodes.select(*CELL, F.explode(spots).alias("o")).select(KEY, (F.col("y") - F.col("o.dy")).alias("y"), (F.col("x") - F.col("o.dx")).alias("x"), "o.m")
    hidden = near.groupBy(*CELL).agg(F.bit_or("m").alias("hidden"))
    return skeleton.filter("kind = 2").select(*CELL).join(hidden, CELL, "left").withColumn("hidden", F.coalesce("hidden", F.lit(0)))


@cache
def _hidden() -> np.ndarray:
    """By the code of the nodes in a pixel's window: bit mask of its hidden neighbour slots."""
    bits = [3 * (dy + 1) + dx + 1 for dy, dx in RING]
    return np.array([reduce(or_, (close_slots(k) for k in range(8) if c >> bits[k] & 1), 0) for c in range(512)])


#: The neighbours before a pixel, row by row, to which it looks back: (slot, dy, dx).
BACK = [(k, dy, dx) for k, (dy, dx) in enumerate(RING) if (dy, dx) < (0, 0)]


def _runs(_, kind: np.ndarray) -> tuple[np.ndarray, ...]:
    """Branch pixels with their hidden slots, and for each the number of the first one of its run."""
    hidden = _hidden()[codes((kind != 2) & ~np.isnan(kind))]
    y, x = np.nonzero(kind == 2)
    number = np.full((kind.shape[0] + 2, kind.shape[1] + 2), -1)
    number[y + 1, x + 1] = np.arange(len(y))
    ends = []
    for k, dy, dx in BACK:
        b = number[y + 1 + dy, x + 1 + dx]
        linked = (b >= 0) & (hidden[y, x] >> k & 1 == 0)
        ends.append((np.flatnonzero(linked), b[linked]))
    return y, x, hidden[y, x].astype(np.int32), first_of(len(y), *(np.concatenate(e) for e in zip(*ends, strict=True)))


def label_branches(skeleton: DataFrame) -> DataFrame:
    """(image, branch_id, y, x) of branch pixels: runs that neither cross nor go around a node.

    Each tile finds its own runs; only those that touch across an edge of tiles meet as a graph.
    """
    bounded_broadcasts(skeleton.sparkSession)

    def local(mask, kind, top, left):
        inside = np.pad(np.ones((SIZE, SIZE), bool), 1)
        y, x, hidden, first = boxed(_runs, 0)(mask, np.where(inside | (kind != 2), kind, np.nan))
        ids = ((y + top).astype(np.int64) << 31) + x + left
        return y, x, hidden, ids[first]

    own = saved(over_tiles(skeleton.dropna(subset=[KEY]), 1, local, "hidden int, part long", "kind", outside=False))
    last = lambda c: F.pmod(F.col(c), F.lit(SIZE)).isin(0, SIZE - 1)
    edge = own.filter(last("y") | last("x"))
    spots = F.array(*[F.struct(F.lit(1 << k).alias("bit"), F.lit(a).alias("dy"), F.lit(b).alias("dx")) for k, a, b in BACK])
    seen = edge.select(KEY, "y", "x", "hidden", F.col("part").alias("a"), F.explode(spots).alias("o")).filter(F.col("hidden").bitwiseAND(F.col("o.bit")) == 0)
    seen = seen.select(KEY, "a", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    edges = seen.join(edge.select(*CELL, F.col("part").alias("b")).hint("merge"), CELL).filter("a <> b").select(KEY, "a", "b").distinct()
    found = connected_components(edges, "a", "b", [KEY]).withColumnRenamed("id", "part")
    parts = own.select(KEY, "part").distinct().join(found.hint("merge"), [KEY, "part"], "left")
    order = Window.partitionBy(KEY).orderBy(F.coalesce("component", "part"))
    parts = parts.select(KEY, "part", (F.dense_rank().over(order) - 1).cast("long").alias("branch_id"))
    return own.join(parts.hint("merge"), [KEY, "part"]).select(KEY, "branch_id", "y", "x")


def _numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """0, 1, .. within each image in the order of ``column``."""
    order = Window.partitionBy(KEY).orderBy(column)
    return df.dropna(subset=[KEY, column]).withColumn(name, (F.dense_rank().over(order) - 1).cast("long"))


def branch_ends(branches: DataFrame, nodes: DataFrame) -> DataFrame:
    """(image, branch_id, node_id, y, x) of each node next to a branch; y and x are the node's."""
    spots = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a, b in RING])
    # There are fewer nodes than pixels, so they look around.
    near = nodes.select(KEY, "node_id", F.col("y").alias("_y"), F.col("x").alias("_x"), F.explode(spots).alias("o"))
    near = near.select(KEY, "node_id", "_y", "_x", (F.col("_y") + F.col("o.dy")).alias("y"), (F.col("_x") + F.col("o.dx")).alias("x"))
    return branches.join(near.hint("merge"), CELL).select(KEY, "branch_id", "node_id", F.col("_y").alias("y"), F.col("_x").alias("x")).distinct()


def parse_skeleton(skeleton: DataFrame, keep_open: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Branch pixels, branches (image, branch_id, node1, node2) and nodes (image, node_id, y, x).

    Branches with fewer than two different end nodes are dropped and the others numbered on; of more than
    two, the smallest and largest count. With keep_open, all branches, and their ends in place of branches.
    """
    pixels = saved(label_branches(skeleton))
    spots = skeleton.filter("kind != 2").withColumn("id", pixel_id())
    nodes = saved(_numbered(spots, "id", "node_id").select(KEY, "node_id", "y", "x"))
    ends = saved(branch_ends(pixels, nodes))
    if keep_open:
        return pixels, ends, nodes
    pairs = ends.groupBy(KEY, "branch_id").agg(F.min("node_id").alias("node1"), F.max("node_id").alias("node2")).filter("node1 < node2")
    pairs = saved(_numbered(pairs.withColumnRenamed("branch_id", "_old"), "_old", "branch_id"))
    kept = pixels.withColumnRenamed("branch_id", "_old").join(pairs.select(KEY, "_old", "branch_id").hint("merge"), [KEY, "_old"])
    return kept.select(KEY, "branch_id", "y", "x"), pairs.select(KEY, "branch_id", "node1", "node2"), nodes.withColumns({k: F.col(k).cast("double") for k in ("y", "x")})


def skeleton_of_labels(branch_pixels: DataFrame) -> DataFrame:
    return branch_pixels.select(*CELL).distinct()


def skeleton_of_masks(pixels: DataFrame, spurs: int = 0) -> DataFrame:
    """From masks to typed skeletons: thin, drop small parts, class the pixels, remove spurs up to ``spurs``."""
    kinds = saved(classify_pixels(saved(remove_small_components(thin(pixels)))))
    if spurs > 0:
        kinds = remove_1px_spurs(kinds)
    return remove_short_spurs(kinds, spurs) if spurs >= 2 else kinds
