"""Sparse rasters: images as tables of their set pixels, and what looks at neighbouring pixels.

A pixel table has its image's key, y and x; what is not there is background. Windows are coded as bit masks
in row-major order, so a 3 x 3 window has nine bits and its middle is bit 4. All operators work on all
images at once, keyed by ``image_id``; rows with a null coordinate match nothing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tiles import KEY, SIZE, boxed, codes, over_cells, over_tiles

CELL = [KEY, "y", "x"]


def read_images(spark, path: str, lines: int = 256) -> DataFrame:
    """(origin, y, x, b, g, r) of image files; missing channels repeat the first.

    A task holds one image's bytes, and writes its pixels by so many lines at a time. Files that are no images give nothing.
    ``sources.images`` stores images in strips, which many tasks write and read.
    """
    files = spark.read.format("image").load(path).select("image.*").filter("height > 0")

    def cells(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                data = np.frombuffer(row.data, np.uint8).reshape(row.height, row.width, row.nChannels)
                for top in range(0, row.height, lines):
                    part = data[top : top + lines].astype(np.int32)
                    y, x = np.indices(part.shape[:2], np.int32)
                    channels = {c: part[..., min(k, row.nChannels - 1)].ravel() for k, c in enumerate("bgr")}
                    yield pd.DataFrame({"origin": row.origin, "y": (y + top).ravel(), "x": x.ravel(), **channels})

    return files.mapInPandas(cells, "origin string, y int, x int, b int, g int, r int")


def binarize_image(image: DataFrame) -> DataFrame:
    """Set pixels: those whose mean channel is over one half."""
    return image.filter((F.col("b") + F.col("g") + F.col("r")) / 3.0 / 255 > 0.5).select(*CELL)


def scale_image(image: DataFrame) -> DataFrame:
    """(image, channel, y, x, v) with values from 0 to 1."""
    return image.select(*CELL, F.expr("stack(3, 0, b, 1, g, 2, r) as (channel, v)")).withColumn("v", F.col("v") / 255.0)


def raster_to_pixels(dense: DataFrame, value: str = "v") -> DataFrame:
    return dense.filter(F.col(value) != 0).select(*CELL)


def pixels_to_raster(pixels: DataFrame, images: DataFrame, h: int, w: int) -> DataFrame:
    """One row for every cell of every image, v 1 where set and 0 elsewhere."""
    cells = images.select(KEY).distinct().select(KEY, F.explode(F.sequence(F.lit(0), F.lit(h - 1))).alias("y"))
    cells = cells.select(KEY, "y", F.explode(F.sequence(F.lit(0), F.lit(w - 1))).alias("x"))
    return cells.join(pixels.select(*CELL).distinct().withColumn("v", F.lit(1)), CELL, "left").withColumn("v", F.coalesce("v", F.lit(0)))


def write_tables(tables: dict[str, DataFrame], root: str, by: str = KEY, buckets: int = 64) -> None:
    """Each table as Parquet, in a bounded number of folders by the hash of its key."""
    for name, df in tables.items():
        df.withColumn("bucket", F.pmod(F.xxhash64(by), F.lit(buckets))).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/{name}")


# --- projections and filters


def crop(pixels: DataFrame, shape: tuple[int, int], size: tuple[int, int], center: tuple = (0.5, 0.5)) -> DataFrame:
    """The window of ``size`` around ``center`` of a raster of ``shape``, in its own coordinates.

    A centre from -1 to 1 as a float is a share of the side; cells outside the raster are background.
    """
    spot = [round((c % 1) * s) if isinstance(c, float) and -1 <= c <= 1 else c for c, s in zip(center, shape, strict=True)]
    (y0, x0), (h, w) = (s - n // 2 for s, n in zip(spot, size, strict=True)), size
    inside = F.col("y").between(y0, y0 + h - 1) & F.col("x").between(x0, x0 + w - 1)
    return pixels.filter(inside).withColumns({"y": F.col("y") - y0, "x": F.col("x") - x0})


def clip_pair(a: DataFrame, b: DataFrame, shape_a: tuple[int, int], shape_b: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both rasters cut to their common size around their middles."""
    size = tuple(min(s) for s in zip(shape_a, shape_b, strict=True))
    return tuple(_centred(df, shape, size) for df, shape in ((a, shape_a), (b, shape_b)))


def pad_pair(a: DataFrame, b: DataFrame, shape_a: tuple[int, int], shape_b: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
    """Both rasters moved into the middle of the larger size."""
    size = tuple(max(s) for s in zip(shape_a, shape_b, strict=True))
    return tuple(_centred(df, shape, size) for df, shape in ((a, shape_a), (b, shape_b)))


def _centred(pixels: DataFrame, shape, size) -> DataFrame:
    (dy, dx), (h, w) = ((n - s) // 2 if n >= s else -((s - n) // 2) for s, n in zip(shape, size, strict=True)), size
    moved = pixels.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx})
    return moved.filter(F.col("y").between(0, h - 1) & F.col("x").between(0, w - 1))


def cat_crop(a: DataFrame, b: DataFrame, shape_a, shape_b, channels_a: int = 1) -> DataFrame:
    """Both cut to their common size; the second one's channels follow the first one's."""
    a, b = clip_pair(a, b, shape_a, shape_b)
    return a.unionByName(b.withColumn("channel", F.col("channel") + channels_a))


def select_by_mask(values: DataFrame, mask: DataFrame) -> DataFrame:
    """The rows whose pixel is set in the mask; also how a region of interest is applied."""
    return values.join(mask.select(*CELL), CELL, "left_semi")


def threshold_class(scores: DataFrame, score: str, limit: float = 0.5) -> DataFrame:
    return scores.filter(F.col(score) > limit)


def mask_pair(layers: DataFrame, roi: str = "roi") -> DataFrame:
    """All layers but the region of interest, inside it."""
    inside = layers.filter(F.col("layer") == roi).select(*CELL)
    return layers.filter(F.col("layer") != roi).join(inside, CELL, "left_semi")


def index_to_mask(items: DataFrame, index: DataFrame, keys: list[str], invert: bool = False) -> DataFrame:
    """All items with a flag: whether the index lists them."""
    hit = index.select(*keys).distinct().withColumn("_hit", F.lit(True))
    flag = F.col("_hit").isNull() if invert else F.col("_hit").isNotNull()
    return items.join(hit, keys, "left").withColumn("flag", flag).drop("_hit")


def validate_layers(layers: DataFrame, needed: tuple[str, ...] = ("pred", "target")) -> DataFrame:
    """(image, layer) of each layer that an image lacks while another image or layer has it."""
    images = layers.select(KEY).distinct()
    wanted = images.crossJoin(F.broadcast(layers.sparkSession.createDataFrame([(k,) for k in needed], "layer string")))
    return wanted.join(layers.select(KEY, "layer").distinct(), [KEY, "layer"], "left_anti")


# --- neighbourhoods


def offsets(h: int, w: int) -> list[tuple[int, int, int]]:
    """(bit, dy, dx) of each cell of a window around its middle."""
    return [(i * w + j, i - h // 2, j - w // 2) for i in range(h) for j in range(w)]


def window_code(pixels: DataFrame, h: int = 3, w: int = 3, background: bool = False) -> DataFrame:
    """(image, y, x, code) of each set pixel, with background also of the others that have a set pixel in their window.

    By tiles with a halo of half a window, so a pixel is sent once, not for each cell of the window. Repeated pixels count once.
    """

    def coded(mask, _):
        code = codes(mask, h, w)
        y, x = np.nonzero(code if background else mask)
        return y, x, code[y, x].astype(np.int64)

    return over_tiles(pixels, max(h, w) // 2, boxed(coded, max(h, w) // 2), "code long", outside=background)


def neighbour_code(pixels: DataFrame) -> DataFrame:
    """The 3 x 3 code without its middle, clockwise from the upper left: bits 0 to 7."""
    code = F.col("code")
    bits = [code.bitwiseAND(F.lit(1 << k)) != 0 for k in CLOCKWISE]
    return window_code(pixels).withColumn("code", sum((F.when(b, 1 << i).otherwise(0) for i, b in enumerate(bits)), F.lit(0)))


#: Bits of the 3 x 3 code clockwise from the upper left.
CLOCKWISE = (0, 1, 2, 5, 8, 7, 6, 3)


def extract_patches(pixels: DataFrame, centres: DataFrame, h: int = 3, w: int = 3) -> DataFrame:
    """(image, y, x, patch) for each centre: its window's cells in row-major order, 0 or 1.

    Pixels and centres meet in tiles, so neither is joined.
    """
    reach = max(h, w) // 2
    side = SIZE + 2 * reach
    mark = lambda df, v: df.select(*CELL, F.lit(v).alias("_centre"))

    def coded(at, centre, *_):
        centre, mask = centre.to_numpy(zero_copy_only=False), np.zeros(side * side, bool)
        mask[at[~centre]] = True
        at = at[centre]
        return at // side, at % side, codes(mask.reshape(side, side), h, w).ravel()[at].astype(np.int64)

    both = mark(pixels.dropna(subset=[KEY]), False).unionByName(mark(centres, True))
    found = over_cells(both, reach, coded, "code long", {"centre": F.col("_centre")}, outside=False)
    kind = dict(centres.dtypes)
    found = found.select(KEY, *[F.col(c).cast(kind[c]).alias(c) for c in ("y", "x")], "code")
    found = found.unionByName(centres.filter("y is null or x is null").select(*CELL, F.lit(0).cast("long").alias("code")))
    cell = lambda k: F.shiftright("code", k).bitwiseAND(F.lit(1)).cast("int")
    return found.select(*CELL, F.array(*[cell(k) for k in range(h * w)]).alias("patch"))


def extract_ring(pixels: DataFrame, centres: DataFrame, pattern: list[list[int]]) -> DataFrame:
    """(image, y, x, ring): only the cells of the window that the pattern sets."""
    h, w = len(pattern), len(pattern[0])
    keep = [k for k, _, _ in offsets(h, w) if pattern[k // w][k % w]]
    return extract_patches(pixels, centres, h, w).select(*CELL, F.array(*[F.get("patch", k) for k in keep]).alias("ring"))


def hit_or_miss(coded: DataFrame, patterns: DataFrame, how: str | None = "any") -> DataFrame:
    """Codes against patterns (pattern_id, pos, neg): which must be set and which not.

    how: "any" gives the coded rows that match one, "sum" how many each row matches, None every match.
    The pattern table is small by its nature: a window has few cells.
    """
    p = F.broadcast(patterns.select("pattern_id", F.col("pos").cast("long").alias("pos"), F.col("neg").cast("long").alias("neg")))
    match = (F.col("code").bitwiseAND(F.col("pos")) == F.col("pos")) & (F.col("code").bitwiseAND(F.col("neg")) == 0)
    if how == "any":
        return coded.join(p, match, "left_semi")
    if how == "sum":
        # The patterns as one row, so that codes are neither sent nor grouped.
        listed = F.broadcast(p.filter("pattern_id is not null").agg(F.collect_list(F.struct("pos", "neg")).alias("_p")))
        hit = lambda q: (F.col("code").bitwiseAND(q.pos) == q.pos) & (F.col("code").bitwiseAND(q.neg) == 0)
        return coded.crossJoin(listed).select(*coded.columns, F.size(F.filter("_p", hit)).cast("long").alias("n"))
    return coded.join(p, match).filter(F.col("pattern_id").isNotNull()).select(*coded.columns, "pattern_id")


def dilate(pixels: DataFrame, h: int = 3, w: int = 3) -> DataFrame:
    def grown(mask, _):
        out = np.zeros_like(mask)
        for y, x in np.argwhere(np.ones((h, w), bool)):
            out |= moved(mask, h // 2 - y, w // 2 - x)
        return np.nonzero(out)

    return over_tiles(pixels, max(h, w) // 2, boxed(grown, max(h, w) // 2), "")


def erode(pixels: DataFrame, h: int = 3, w: int = 3) -> DataFrame:
    def shrunk(mask, _):
        out = mask.copy()
        for y, x in np.argwhere(np.ones((h, w), bool)):
            out &= moved(mask, h // 2 - y, w // 2 - x)
        return np.nonzero(out)

    return over_tiles(pixels, max(h, w) // 2, boxed(shrunk, max(h, w) // 2), "", outside=False)


def moved(grid: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """The grid moved by (dy, dx); zero comes in, and what leaves the array is lost."""
    out, (h, w) = np.zeros_like(grid), grid.shape
    to = lambda d, n: slice(min(max(d, 0), n), max(min(n + d, n), 0))
    out[to(dy, h), to(dx, w)] = grid[to(-dy, h), to(-dx, w)]
    return out


def spread(values: DataFrame, kernel: DataFrame) -> DataFrame:
    """(image, o, y, x, v) of values (image, i, y, x, v): each spread by the kernels (o, i, dy, dx, w) of its channel.

    The kernels are read first, as they are small by their nature. By tiles whose halo is as wide as they reach, so a
    value is sent once and for the halo's share again, not for each of a kernel's cells. Repeated values add up;
    where nothing but nulls meets, the sum is null; cells that nothing reaches are absent.
    """
    rows = kernel.select("o", "i", "dy", "dx", "w").dropna(subset=["i", "dy", "dx"]).collect()
    kind = dict(kernel.dtypes)
    outs, ins = (list(dict.fromkeys(r[k] for r in rows)) for k in ("o", "i"))
    taps = {}  # of each channel: which output, how far, the weight and whether there is one
    for r in rows:
        taps.setdefault(ins.index(r["i"]), []).append((outs.index(r["o"]), int(r["dy"]), int(r["dx"]), r["w"] or 0.0, r["w"] is not None))
    taps = {i: [np.array(c) for c in zip(*own, strict=True)] for i, own in taps.items()}
    reach = max((int(np.abs(c).max()) for own in taps.values() for c in own[1:3]), default=0)
    side = SIZE + 2 * reach

    def run(at, channel, v, *_):
        channel, known, v = channel.to_numpy(), v.is_valid().to_numpy(zero_copy_only=False), v.to_numpy(zero_copy_only=False)
        v, y, x = np.where(known, v, 0.0), at // side + reach, at % side + reach
        # A box around all that is reached, with what lies beyond the tile's halo.
        up, left, h, w = y.min() - reach, x.min() - reach, np.ptp(y) + 1 + 2 * reach, np.ptp(x) + 1 + 2 * reach
        total, reached, met = (np.zeros(len(outs) * h * w) for _ in range(3))
        for i, own in taps.items():
            here = channel == i
            spot, plain = (y[here] - up) * w + x[here] - left, known[here].all() and own[4].all()
            step = max((1 << 20) // max(len(spot), 1), 1)
            for k in range(0, len(own[0]) if len(spot) else 0, step):
                o, dy, dx, weight, given = (c[k : k + step, None] for c in own)
                to = (o * (h * w) + dy * w + dx + spot).ravel()
                total += np.bincount(to, (weight * v[here]).ravel(), len(total))
                reached += np.bincount(to, minlength=len(total))
                if not plain:
                    met += np.bincount(to, (given & known[here]).ravel(), len(total))
            if plain:
                met = np.maximum(met, reached)
        found = np.flatnonzero(reached)
        sums = total[found]
        if not met[found].all():
            sums = np.where(met[found] > 0, sums, None).astype(object)
        o, y, x = np.unravel_index(found, (len(outs), h, w))
        return y + up - reach, x + left - reach, o.astype(np.int32), sums

    known = F.create_map(*[e for k, i in enumerate(ins) for e in (F.lit(i).cast(kind["i"]), F.lit(k))]) if ins else None
    own = values.withColumn("_i", F.lit(None).cast("int") if known is None else F.try_element_at(known, F.col("i").cast(kind["i"]))).filter("_i is not null")
    out = over_cells(own, reach, run, "k int, v double", {"i": F.col("_i"), "v": F.col("v").cast("double")})
    name = F.element_at(F.array(*[F.lit(o).cast(kind["o"]) for o in outs or [None]]), F.col("k") + 1)
    return out.select(KEY, name.alias("o"), "y", "x", "v")


def convolve(values: DataFrame, kernel: DataFrame, value: str = "v") -> DataFrame:
    """(image, y, x, v): each value spread by the kernel (dy, dx, w); cells that nothing reaches are absent.

    A kernel is small by its nature.
    """
    one = kernel.select(F.lit(0).alias("o"), F.lit(0).alias("i"), "dy", "dx", "w")
    out = spread(values.select(*CELL, F.col(value).alias("v"), F.lit(0).alias("i")), one)
    # Coordinates have the type of a sum of both.
    kind = dict(values.crossJoin(kernel).select((F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).dtypes)
    return out.select(KEY, *[F.col(c).cast(kind[c]).alias(c) for c in ("y", "x")], "v")


def median_blur(image: DataFrame, value: str, size: int, h: int, w: int) -> DataFrame:
    """(image, y, x, v): the median of the window around each cell of a dense image; borders are repeated.

    By tiles with a halo of half a window. Where cells are absent, medians are of those there.
    """
    r = size // 2

    def blur(mask, v, top, left):
        # A border cell stands for the cells beyond it, too.
        spot = lambda first, n, side: np.clip(np.clip(np.arange(first, first + side), 0, n - 1) - first, 0, side - 1)
        v = v[np.ix_(spot(top, h, len(v)), spot(left, w, len(v)))]
        # Only the windows that hold a cell and whose middle is in the image, as small images leave most of a tile empty.
        box = []
        for axis, (first, n) in enumerate(((top, h), (left, w))):
            held = np.flatnonzero(~np.isnan(v).all(1 - axis))
            low, high = (max(held[0] - 2 * r, -r - first, 0), min(held[-1] + 1, n - r - first, len(v) - 2 * r)) if len(held) else (0, 0)
            if low >= high:
                return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
            box.append(slice(low, high + 2 * r))
        v, (up, back) = v[tuple(box)], (b.start for b in box)
        windows = np.lib.stride_tricks.sliding_window_view(v, (size, size))
        windows = windows.reshape(*windows.shape[:2], -1)
        ranked, there = np.sort(windows, axis=2), size * size - np.isnan(windows).sum(2)  # NaN comes last
        middle = sum(np.take_along_axis(ranked, np.maximum(k, 0)[..., None], 2)[..., 0] for k in ((there - 1) // 2, there // 2)) / 2
        y, x = (c + r + a for c, a in zip(np.nonzero(there), (up, back), strict=True))
        known = (y + top >= 0) & (y + top < h) & (x + left >= 0) & (x + left < w)
        return y[known], x[known], middle[there > 0][known]

    return over_tiles(image.filter(F.col(value).isNotNull()), r, blur, "v double", value)


def avg_pyramid(dense: DataFrame, n: int, h: int, w: int, value: str = "v") -> DataFrame:
    """(level, image, y, x, v): n halvings by means of 2 x 2; an odd last row or column is dropped."""
    level = dense.select(*CELL, F.col(value).cast("double").alias("v"))
    out = level.withColumn("level", F.lit(0))
    for k in range(1, n + 1):
        h, w = h // 2, w // 2
        even = level.filter((F.col("y") < 2 * h) & (F.col("x") < 2 * w))
        level = even.groupBy(KEY, F.floor(F.col("y") / 2).alias("y"), F.floor(F.col("x") / 2).alias("x")).agg(F.avg("v").alias("v"))
        out = out.unionByName(level.withColumn("level", F.lit(k)))
    return out


def _to_ends(pixels: DataFrame, along: str, size: int, name: str) -> DataFrame:
    """The pixels with their run along an axis, name_run, and their distance to the nearest background cell at its ends, name."""
    line = [KEY, *(c for c in CELL if c not in (KEY, along))]
    ranked = pixels.withColumn(f"{name}_run", F.col(along) - F.dense_rank().over(Window.partitionBy(*line).orderBy(along)))
    run = Window.partitionBy(*line, f"{name}_run")
    first, last = F.min(along).over(run), F.max(along).over(run)
    # Beyond the image there is no background.
    ends = F.least(F.when(first > 0, F.col(along) - first + 1), F.when(last < size - 1, last - F.col(along) + 1))
    return ranked.withColumn(name, ends.cast("long"))


def lower_envelope(at: list[int], height: list[int], ask: list[int]) -> list[int]:
    """The least (q - at)² + height over all parabolas, for each q of ``ask``; ``at`` and ``ask`` rise.

    A stack of the parabolas that are lowest somewhere, each with where it begins to be so, in linear time.
    """
    stack, begins = [], []
    for q, f in zip(at, height, strict=True):
        start = float("-inf")
        while stack:
            p, g = stack[-1]
            start = (f + q * q - g - p * p) / (2 * (q - p))
            if start > begins[-1]:
                break
            stack.pop(), begins.pop()
            start = float("-inf")
        stack.append((q, f))
        begins.append(start)
    out, k, last = [], 0, len(stack) - 1
    for q in ask:
        while k < last and begins[k + 1] <= q:
            k += 1
        p, g = stack[k]
        out.append((q - p) * (q - p) + g)
    return out


def distance_transform(pixels: DataFrame, radius: int | None, h: int, w: int) -> DataFrame:
    """(image, y, x, distance) of each set pixel to the nearest background cell of its image; up to the radius, if one is given.

    Exact at any depth, in time that grows with the pixels: distances along rows first, then down each column
    the lower envelope of the parabolas that stand on its cells, at the height of their squared row distances,
    and on the background cells at its runs' ends. Null where the image has no background (within the radius).
    Repeated pixels count once; rows with a null coordinate are left out.
    """
    cells = _to_ends(pixels.select(*CELL).dropna(subset=["y", "x"]).distinct(), "x", w, "_row")
    columns = cells.groupBy(KEY, "x").agg(F.sort_array(F.collect_list(F.struct("y", "_row"))).alias("c"))
    columns = columns.select(KEY, "x", F.col("c.y").alias("y"), F.col("c._row").alias("far"))
    kind = dict(pixels.dtypes)

    def run(batches):
        for batch in batches:
            squares = []
            for y, far in zip(batch.column("y"), batch.column("far"), strict=True):
                y, far = y.as_py(), far.as_py()
                stand = {}
                for here, before, after in zip(y, [None, *y[:-1]], [*y[1:], None], strict=True):
                    if before != here - 1 and here > 0:
                        stand[here - 1] = 0
                    if after != here + 1 and here < h - 1:
                        stand[here + 1] = 0
                stand |= {q: f * f for q, f in zip(y, far, strict=True) if f is not None}
                at = sorted(stand)
                squares.append(lower_envelope(at, [stand[q] for q in at], y) if at else [None] * len(y))
            own = batch.column("y")
            of = pa.array(np.repeat(np.arange(len(own)), np.diff(own.offsets.to_numpy())))
            flat = pa.array([d for s in squares for d in s], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(KEY).take(of), own.flatten(), batch.column("x").take(of), flat], [*CELL, "d"])

    found = columns.mapInArrow(run, f"{KEY} {kind[KEY]}, y {kind['y']}, x {kind['x']}, d long")
    kept = F.col("d") if radius is None else F.when(F.col("d") <= radius * radius, F.col("d"))
    return found.select(*CELL, F.sqrt(kept).alias("distance"))


def inside(box: tuple[float, float, float, float]) -> Column:
    """Predicate: the cell is in the closed box (top, left, bottom, right); Parquet statistics can prune by it."""
    top, left, bottom, right = box
    return F.col("y").between(top, bottom) & F.col("x").between(left, right)
