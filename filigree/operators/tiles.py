"""Square tiles of rasters, for work that looks at neighbouring pixels many times.

A tile holds the cells of one square of one image and a halo of its neighbours' cells, so a pixel is sent
once and its share of halos (a sixteenth more for a halo of 2 round a tile of 128), whatever the window or
the number of passes inside. A large image is many tiles, so no task holds an image.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = "image_id"
SIZE = 128
#: Cells that a task returns at a time.
CHUNK = 1 << 20

#: Gets a mask, the values (NaN where there is none; None if no value is asked for) and the coordinates of the first cell; gives (y, x, more columns ...) in the tile.
Make = Callable[[np.ndarray, np.ndarray, int, int], tuple[np.ndarray, ...]]


def tiled(cells: DataFrame, halo: int, columns: dict[str, Column], size: int = SIZE, outside: bool = True) -> DataFrame:
    """(image, ty, tx, at, ``columns``): a row for each tile that has cells in it or, with outside, its halo; ``at`` counts row by row."""
    side = size + 2 * halo
    reach = lambda c: F.sequence(F.floor((F.col(c) - halo) / size).cast("int"), F.floor((F.col(c) + halo) / size).cast("int"))
    own = cells.select(KEY, "y", "x", *[v.alias(f"_{k}") for k, v in columns.items()]).dropna(subset=["y", "x"]).withColumn("ty", F.explode(reach("y"))).withColumn("tx", F.explode(reach("x")))
    at = ((F.col("y") - F.col("ty") * size + halo) * side + F.col("x") - F.col("tx") * size + halo).cast("int")
    # By a number of partitions, which are not merged for being small: work on a tile grows with its window, not its bytes.
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = (F.floor(F.col("y") / size) == F.col("ty")) & (F.floor(F.col("x") / size) == F.col("tx"))
    cell = F.struct(at.alias("at"), *[F.col(f"_{k}").alias(k) for k in columns]) if columns else at
    listed = [F.collect_list(cell).alias("cells"), F.max(inside).alias("inside")]
    each = own.repartition(tasks, KEY, "ty", "tx").groupBy(KEY, "ty", "tx").agg(*listed)
    each = each if outside else each.filter("inside")
    return each.select(KEY, "ty", "tx", *([F.col(f"cells.{k}").alias(k) for k in ("at", *columns)] if columns else [F.col("cells").alias("at")]))


def over_cells(cells: DataFrame, halo: int, make: Callable, columns: str, given: dict[str, Column], size: int = SIZE, outside: bool = True) -> DataFrame:
    """(image, y, x, ``columns``): what ``make`` gives for the cells of each tile and its halo, without the halo's cells.

    ``make`` gets where the cells are, as Arrow arrays their ``given`` columns, and the tile's first line and column. A
    cell stands there as often as the table has it. Without outside, tiles that only have cells in their halo are left out.
    """
    side = size + 2 * halo
    tiles = tiled(cells, halo, given, size, outside)
    kind, listed = dict(tiles.dtypes)[KEY], ["ty", "tx", "at", *given]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, waiting = batch.column(KEY), [], 0

            def taken():
                tile = np.concatenate([np.full(len(p[0]), i) for i, p in parts])
                rest = [np.concatenate(c) for c in zip(*(p for _, p in parts), strict=True)]
                arrays = [ids.take(pa.array(tile)), *(pa.array(c, pa.float64() if c.dtype == object else None) for c in rest)]
                return pa.RecordBatch.from_arrays(arrays, names)

            for i, (ty, tx, at, *lists) in enumerate(zip(*(batch.column(c) for c in listed), strict=True)):
                top, left = ty.as_py() * size - halo, tx.as_py() * size - halo
                y, x, *more = make(at.values.to_numpy(), *(v.values for v in lists), top, left)
                own = (y >= halo) & (y < side - halo) & (x >= halo) & (x < side - halo)
                parts.append((i, [(y[own] + top).astype(np.int32), (x[own] + left).astype(np.int32), *(c[own] for c in more)]))
                waiting += len(parts[-1][1][0])
                if waiting >= CHUNK:
                    yield taken()
                    parts, waiting = [], 0
            if waiting:
                yield taken()

    names = [KEY, "y", "x", *(c.split()[0] for c in columns.split(",") if c.strip())]
    return tiles.mapInArrow(run, ", ".join([f"{KEY} {kind}", "y int", "x int", *filter(None, [columns])]))


def packed(rows: DataFrame, by: list[str], record: np.dtype) -> DataFrame:
    """(by, cells): the columns of ``record`` of rows with equal keys, as records in bytes, in the order of the columns.

    Rows are packed batch by batch where they are, so that a cell is sent as its record and not as a row; a key
    stands once for each batch that has it. Columns of ``record`` have no nulls, unless they are floats there.
    """
    rows = rows.select(*by, *record.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            data = np.empty(batch.num_rows, record)
            for c in record.names:
                data[c] = batch.column(c).to_numpy(zero_copy_only=False)
            keys = [batch.column(c).dictionary_encode("encode").indices.to_numpy() for c in by]
            order = np.lexsort([data[c] for c in reversed(record.names)] + keys[::-1])
            new = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
            cuts = np.r_[0, np.flatnonzero(new) + 1, batch.num_rows]
            buffers = [None, pa.py_buffer((cuts * record.itemsize).astype(np.int32)), pa.py_buffer(data[order].tobytes())]
            first = pa.array(order[cuts[:-1]])
            arrays = [*(batch.column(c).take(first) for c in by), pa.Array.from_buffers(pa.binary(), len(cuts) - 1, buffers)]
            yield pa.RecordBatch.from_arrays(arrays, [*by, "cells"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"{c} {kinds[c]}" for c in by), "cells binary"]))


def in_blocks(pixels: DataFrame, by: list[str]) -> DataFrame:
    """(by, ty, tx, bits): 8 x 8 cells in one number, bits row by row. A pixel with a null coordinate keeps both in ty and tx, with null bits."""
    y, x = F.col("y"), F.col("x")
    whole, seven = y.isNotNull() & x.isNotNull(), F.lit(7)
    at = F.shiftleft(y.bitwiseAND(seven), 3).bitwiseOR(x.bitwiseAND(seven)).cast("int")
    tile = [F.when(whole, F.shiftright(c, 3)).otherwise(c).alias(k) for c, k in ((y, "ty"), (x, "tx"))]
    return joined_blocks(pixels.select(*by, *tile, at.alias("_at")).withColumn("bits", F.expr("shiftleft(1L, _at)")), by)


def joined_blocks(blocks: DataFrame, by: list[str]) -> DataFrame:
    """One block for each place: a cell is set if any of them sets it."""
    return blocks.groupBy(*by, "ty", "tx").agg(F.bit_or("bits").alias("bits"))


def cells_of(blocks: DataFrame, by: list[str]) -> DataFrame:
    """(by, y, x): the cells of blocks, a row for each."""
    each = blocks.withColumn("_at", F.explode(F.array(*map(F.lit, range(64)))))
    each = each.filter(F.coalesce(F.expr("shiftright(bits, _at) & 1L") == 1, F.col("_at") == 0))
    cell = lambda t, k: F.when(F.col("bits").isNull(), F.col(t)).otherwise(F.shiftleft(F.col(t), 3).bitwiseOR(k))
    return each.select(*by, cell("ty", F.shiftright("_at", 3)).alias("y"), cell("tx", F.col("_at").bitwiseAND(F.lit(7))).alias("x"))


def over_tiles(cells: DataFrame, halo: int, make: Make, columns: str, value: str | None = None, size: int = SIZE, outside: bool = True) -> DataFrame:
    """(image, y, x, ``columns``): what ``make`` gives for each tile, without the halo's cells."""
    side = size + 2 * halo

    def dense(at, *rest):
        *v, top, left = rest
        mask, values = np.zeros(side * side, bool), None
        mask[at] = True
        if v:
            values = np.full(side * side, np.nan)
            values[at] = v[0].to_numpy(zero_copy_only=False)
            values = values.reshape(side, side)
        return make(mask.reshape(side, side), values, top, left)

    given = {} if value is None else {"v": F.col(value).cast("double")}
    return over_cells(cells, halo, dense, columns, given, size, outside)


def boxed(make: Callable[..., tuple[np.ndarray, ...]], reach: int) -> Make:
    """``make`` of mask and values on the smallest box around the set cells and ``reach`` more, as small images leave most of a tile empty."""

    def run(mask, values, *_):
        (y, x), (h, w) = (np.flatnonzero(mask.any(k)) for k in (1, 0)), mask.shape
        up, left = max(y[0] - reach, 0), max(x[0] - reach, 0)
        box = slice(up, min(y[-1] + reach + 1, h)), slice(left, min(x[-1] + reach + 1, w))
        v, u, *more = make(mask[box], None if values is None else values[box])
        return v + up, u + left, *more

    return run


def codes(mask: np.ndarray, h: int = 3, w: int = 3) -> np.ndarray:
    """The code of each cell's window: bits row by row, set where the mask is; beyond the array nothing is."""
    padded = np.pad(mask, ((h // 2, h - 1 - h // 2), (w // 2, w - 1 - w // 2))).astype(np.int16 if h * w < 16 else np.int64)
    out = np.zeros(mask.shape, padded.dtype)
    for k in range(h * w):
        out |= padded[k // w : k // w + mask.shape[0], k % w : k % w + mask.shape[1]] << k
    return out


def labels(mask: np.ndarray, connectivity: int) -> np.ndarray:
    """For each set cell in row order, the number (in that order) of the first set cell that it is connected with."""
    number = np.full(mask.shape, -1)
    number[mask] = np.arange(mask.sum())
    ends = []
    for a, b in [(number[:, :-1], number[:, 1:]), (number[:-1], number[1:])] + [(number[:-1, :-1], number[1:, 1:]), (number[:-1, 1:], number[1:, :-1])] * (connectivity == 2):
        both = (a >= 0) & (b >= 0)
        ends.append((a[both], b[both]))
    return first_of(mask.sum(), *(np.concatenate(e) for e in zip(*ends, strict=True)))


def first_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of ``n`` numbers, the smallest that it is connected with by the pairs (a, b)."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while not np.array_equal(root, up := root[root]):
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root
