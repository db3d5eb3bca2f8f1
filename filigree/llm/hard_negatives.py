"""Hard negatives: for an anchor and each of its positives, the best rows of other labels in a window of scores.

A score is the inner product of two vectors of whole numbers. Rows stand in buckets of nearly equal length,
cut into blocks of a bounded number of rows. A block holds, for each coordinate, its rows' directions sorted
by it. Anchors meet blocks in groups of bounded size. An anchor that looks for scores of at least ``low`` in
a block needs a cosine of at least low / (its length * the block's longest); that confines each coordinate
of a direction to a range around the anchor's own. The ranges of the anchor's largest coordinates, its focus,
are cut out of the sorted lists and intersected, and what is left is verified exactly. Where no range of an
anchor spares half of a block, the whole block is verified. A first search in a bounded sample gives each
anchor the score that its best rows must reach, which loses nothing, as more rows only raise it.

Of rows that share a vec_id the one with the smallest label, then vector, stands. Rows with a null vec_id may
be positives and negatives (last among equal scores), never anchors. Rows with a null label, a null vector
or a null, NaN or infinite entry take no part. A shorter vector counts as filled up with zeros. Scaled
entries are held between -2**23 and 2**23, so that all of it fits a long for up to 1,024 entries. Other
columns are dropped; an empty table gives no rows, and so does an anchor without positives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .whitening import usable

LIMIT = 1 << 23
#: Rows of a block, anchors of a group, rows of the sample for the first search.
ROWS, ANCHORS, SAMPLE = 4096, 4096, 4096
#: Coordinates whose ranges are intersected.
FOCUS = 4
#: Buckets of lengths: so many for each doubling.
BUCKETS = 16
#: A table of blocks up to so many rows is broadcast.
FEW_BLOCKS = 500_000
#: Stands for a null vec_id, and for no bound.
NO_ID, ANY = (1 << 63) - 1, 1 << 62

FOUND = "anchor_id long, slot long, id long, score long"


def whole_rows(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, label, x, length): the rows that take part, x = floor(scale * entry)."""
    v = F.transform(usable(vector), lambda c: F.least(F.greatest(F.floor(c.cast("double") * scale), F.lit(-LIMIT)), F.lit(LIMIT)).cast("int"))
    kept = rows.select("vec_id", F.col("label").cast("long").alias("label"), v.alias("x")).filter(F.col("label").isNotNull() & F.col("x").isNotNull())
    named = kept.filter("vec_id is not null").groupBy(F.col("vec_id").alias("id")).agg(F.min(F.struct("label", "x")).alias("r")).select("id", "r.*")
    nameless = kept.filter("vec_id is null").select(F.lit(NO_ID).alias("id"), "label", "x")
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
    return named.unionByName(nameless).withColumn("length", F.sqrt(square))


def indexed(rows: DataFrame) -> DataFrame:
    """``rows`` with their bucket of lengths and block of at most about ROWS rows."""
    bucket = F.when(F.col("length") > 0, F.floor(F.log2("length") * BUCKETS)).otherwise(-1).cast("int")
    rows = saved(rows.withColumn("bucket", bucket))
    # The number of buckets is bounded by what LIMIT and the number of entries allow.
    parts = rows.groupBy("bucket").agg(F.ceil(F.count("*") / ROWS).alias("parts"))
    return rows.join(F.broadcast(parts), "bucket").withColumn("part", F.pmod(F.xxhash64("id", "x"), "parts")).drop("parts")


def search(blocks: DataFrame, anchors: DataFrame, best: int, same: bool) -> DataFrame:
    """The ``best`` rows by (score, id) in each slot of an anchor, as FOUND.

    ``anchors`` has id, label, x, length and slots, an array of (slot, low, high): bounds of scores, both
    included. With ``same``, rows of the anchor's label but itself count, else those of other labels.
    """
    groups = max(-(-anchors.count() // ANCHORS), 1)
    known = saved(blocks.groupBy("bucket", "part").agg(F.max("length").alias("longest")))
    many = known.count()
    known = F.broadcast(known) if many <= FEW_BLOCKS else known
    tasks = max(many * groups, 1)
    least = F.array_min(F.transform("slots", lambda s: s["low"]))
    asked = anchors.withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int"))
    asked = asked.join(known, least <= F.col("length") * F.col("longest") * (1 + 1e-9))
    dealt = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) if groups > 1 else blocks.withColumn("group", F.lit(0))
    keys = ["bucket", "part", "group"]

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        columns = ([], [], [], [])
        if rows.num_rows and anchors.num_rows:
            for found in _meet(rows, anchors, best, same):
                for column, values in zip(columns, found, strict=True):
                    column.append(values)
        arrays = [np.concatenate([np.zeros(0, np.int64), *c]) for c in columns]
        return pa.table(arrays, ["anchor_id", "slot", "id", "score"])

    found = dealt.repartition(tasks, *keys).groupBy(*keys).cogroup(asked.repartition(tasks, *keys).groupBy(*keys)).applyInArrow(meet, FOUND)
    order = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= best)


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    lists = column.combine_chunks()
    out = np.zeros((len(lists), width))
    out[np.arange(width) < np.diff(lists.offsets.to_numpy())[:, None]] = lists.flatten().to_numpy()
    return out


def feasible(unit: np.ndarray, cosine: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The range of each coordinate of directions whose cosine with the unit vectors is at least this much."""
    cosine = np.clip(cosine, -1, 1)[:, None]
    middle, width = unit * cosine, np.sqrt(np.maximum(1 - unit * unit, 0) * (1 - cosine * cosine))
    low = np.where(unit <= -cosine, -1.0, middle - width)
    high = np.where(unit >= cosine, 1.0, middle + width)
    return low - 1e-9, high + 1e-9


def _meet(rows: pa.Table, anchors: pa.Table, best: int, same: bool):
    """(anchor ids, slots, ids, scores) of each anchor's best rows in a block."""
    width = max(max((len(x) for t in (rows, anchors) for x in t["x"]), default=0), 1)
    x, q = _matrix(rows["x"], width), _matrix(anchors["x"], width)
    ids, labels, length = (rows[c].to_numpy() for c in ("id", "label", "length"))
    own, own_label, own_length = (anchors[c].to_numpy() for c in ("id", "label", "length"))
    slots = anchors["slots"].to_pylist()
    least = np.array([min(s["low"] for s in own_slots) for own_slots in slots], float)
    if length.max() * own_length.max() >= 1 << 53:  # doubles would round
        x, q = x.astype(np.int64), q.astype(np.int64)
    unit = x / np.where(length > 0, length, 1)[:, None]
    order = np.argsort(unit, axis=0)
    lists = np.take_along_axis(unit, order, 0)
    direction = q / np.where(own_length > 0, own_length, 1)[:, None]
    reach = own_length * length.max()
    cosine = np.where(reach > 0, least / np.where(reach > 0, reach, 1), 0)
    low, high = feasible(direction, cosine)
    focus = np.argsort(-np.abs(direction), axis=1)[:, :FOCUS]
    first, last = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(x))
    for c in np.unique(focus):
        at = np.nonzero(focus == c)
        first[at] = np.searchsorted(lists[:, c], low[at[0], c], "left")
        last[at] = np.searchsorted(lists[:, c], high[at[0], c], "right")
    sizes = last - first
    shortest = sizes.argmin(1)
    wide = (cosine <= 0) | (sizes.min(1) > len(x) // 2)

    def chosen(k: int, at: np.ndarray | None, scores: np.ndarray):
        among, names = (labels, ids) if at is None else (labels[at], ids[at])
        fits = (among == own_label[k]) & (names != own[k]) if same else among != own_label[k]
        fits = np.flatnonzero(fits & (scores >= least[k]))
        scores, names = scores[fits].astype(np.int64), names[fits]
        by = np.lexsort((names, -scores))
        scores, names = scores[by], names[by]
        for s in slots[k]:
            start = np.searchsorted(-scores, -s["high"], "left")
            end = min(np.searchsorted(-scores, -s["low"], "right"), start + best)
            if end > start:
                yield np.full(end - start, own[k]), np.full(end - start, s["slot"]), names[start:end], scores[start:end]

    for k in np.flatnonzero(~wide & (cosine <= 1 + 1e-9)):
        j = shortest[k]
        at = order[first[k, j] : last[k, j], focus[k, j]]
        for c in focus[k]:
            if c != focus[k, j]:
                at = at[(unit[at, c] >= low[k, c]) & (unit[at, c] <= high[k, c])]
        if len(at):
            yield from chosen(k, at, x[at] @ q[k])
    whole = np.flatnonzero(wide)
    for some in np.array_split(whole, -(-len(whole) // 64) or 1):
        scores = x @ q[some].T
        for k, column in zip(some, scores.T, strict=True):
            yield from chosen(k, None, column)


def _bounded(anchors: DataFrame, sample: DataFrame, best: int, same: bool) -> DataFrame:
    """``anchors`` with the lower bounds of their slots raised to what a sample of the rows already reaches."""
    reached = search(sample, anchors, best, same).groupBy("anchor_id", "slot").agg(F.count("*").alias("n"), F.min("score").alias("score"))
    reached = reached.filter(F.col("n") == best).groupBy(F.col("anchor_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("reached"))
    raised = F.transform("slots", lambda s: s.withField("low", F.greatest(s["low"], F.coalesce(F.get(F.map_values(F.map_filter("reached", lambda k, _: k == s["slot"])), F.lit(0)), s["low"]))))
    return saved(anchors.join(reached, "id", "left").withColumn("slots", raised).drop("reached"))


def mine(
    rows: DataFrame, is_anchor: Column, vector: str = "embedding", scale: int = 256, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` has vec_id, label and a vector; ``is_anchor`` is a condition on vec_id. An anchor's positives are
    its best rows of the same label; a negative scores from ``least`` to ``most`` percent of the positive.
    """
    index = saved(indexed(whole_rows(rows, vector, scale)))
    sample = saved(index.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).withColumns({"bucket": F.lit(-2), "part": F.lit(0).cast("long")}))
    anchors = index.withColumnRenamed("id", "vec_id").filter(is_anchor & (F.col("vec_id") != NO_ID)).withColumnRenamed("vec_id", "id").select("id", "label", "x", "length")
    slot = lambda name, low, high: F.struct(name.alias("slot"), low.cast("long").alias("low"), high.cast("long").alias("high"))
    open_slots = saved(anchors.withColumn("slots", F.array(slot(F.lit(0).cast("long"), F.lit(-ANY), F.lit(ANY)))))
    found = saved(search(index, _bounded(open_slots, sample, positives, True), positives, True))
    # A positive is named by its place, as several may have no id.
    window = slot(F.col("rank").cast("long"), F.expr(f"({least} * score + 99) div 100"), F.expr(f"({most} * score) div 100"))
    windows = found.filter("score >= 0").withColumn("s", window).filter("s.low <= s.high").groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list("s").alias("slots"))
    asking = saved(anchors.join(windows, "id"))
    near = search(index, _bounded(asking, sample, negatives, False), negatives, False)
    pairs = found.select("anchor_id", F.col("rank").cast("long").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("positive_score"))
    named = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return near.join(pairs, ["anchor_id", "slot"]).select(
        "anchor_id", named("positive").alias("positive_id"), "rank", named("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
