"""Operators by tiles against whole arrays, over images of several tiles."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.operators import kernels, raster, skeleton
from filigree.operators.tiles import labels
from filigree.plans import catalog
from filigree.plans.registry import Tables

SMOKE = "/root/testdata/sf0.001"


def blobs(h, w, seed, share=0.5):
    """A mask of smooth random shapes."""
    v = np.random.default_rng(seed).random((h, w))
    for _ in range(3):
        v = sum(np.roll(v, (i, j), (0, 1)) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9
    return v > np.quantile(v, 1 - share)


def table(spark, masks, top=0, left=0):
    rows = [(k, int(y) + top, int(x) + left) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    random.Random(1).shuffle(rows)
    extra = [(k, None, 3) for k in masks] + [(None, None, None)] + rows[:5]
    return spark.createDataFrame([*rows, *extra], "image_id long, y int, x int").repartition(4)


def cells(df, *more):
    return sorted(tuple(r) for r in df.select("image_id", "y", "x", *more).collect())


def test_thin_over_tiles(spark):
    masks = {1: blobs(290, 300, 1), 2: np.ones((140, 260), bool), 3: blobs(20, 20, 2)}
    want = sorted((k, int(y), int(x)) for k, m in masks.items() for y, x in zip(*np.nonzero(skeleton.thinned(m, 10**6)), strict=True))
    assert cells(skeleton.thin(table(spark, masks))) == want


@pytest.mark.parametrize("connectivity", [1, 2])
def test_components_over_tiles(spark, connectivity):
    rng = np.random.default_rng(3)
    snake = np.zeros((280, 280), bool)
    snake[::4] = True
    snake[2::8, 0] = snake[1::8, 0] = snake[3::8, 0] = True
    snake[6::8, -1] = snake[5::8, -1] = snake[7::8, -1] = True
    masks = {1: rng.random((270, 300)) < 0.45, 2: snake, 3: np.zeros((1, 1), bool) | True}
    got = cells(skeleton.components_pixels(table(spark, masks), connectivity), "component")
    want = []
    for k, m in masks.items():
        own = {(int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True)}
        while own:
            first = min(own)
            own.discard(first)
            stack, found = [first], [first]
            while stack:
                y, x = stack.pop()
                for i, j in [(-1, 0), (1, 0), (0, -1), (0, 1)] + [(-1, -1), (-1, 1), (1, -1), (1, 1)] * (connectivity == 2):
                    if (y + i, x + j) in own:
                        own.discard((y + i, x + j))
                        stack.append((y + i, x + j))
                        found.append((y + i, x + j))
            want += [(k, y, x, (first[0] << 31) + first[1]) for y, x in found]
    assert sorted(set(got)) == sorted(want) and len(got) == len(want)


def test_components_left_of_the_origin(spark):
    m = blobs(60, 70, 5)
    moved = skeleton.components_pixels(table(spark, {1: m}, -30, -35)).groupBy("component").count().select("count")
    assert sorted(r[0] for r in moved.collect()) == sorted(np.unique(labels(m, 2), return_counts=True)[1].tolist())


def test_median_over_tiles(spark):
    h, w = 140, 150
    v = np.random.default_rng(4).integers(0, 50, (2, h, w))
    rows = [(k, y, x, int(v[k, y, x])) for k in range(2) for y in range(h) for x in range(w)]
    image = spark.createDataFrame(rows, "image_id long, y int, x int, r int")
    got = raster.median_blur(image, "r", 5, h, w).collect()
    want = np.array([np.median(np.lib.stride_tricks.sliding_window_view(np.pad(p, 2, "edge"), (5, 5)), axis=(2, 3)) for p in v])
    assert len(got) == len(rows) and all(r["v"] == want[r["image_id"], r["y"], r["x"]] for r in got)
    # Absent cells: the median of those there, at all cells that something reaches.
    few = raster.median_blur(image.filter("image_id = 0 and y = 1 and x in (1, 2)"), "r", 3, h, w)
    near = {(y, x): [v[0, 1, c] for c in (1, 2) if abs(x - c) <= 1] for y in range(3) for x in range(4)}
    assert {(r["y"], r["x"]): r["v"] for r in few.collect()} == {at: float(np.median(c)) for at, c in near.items()}
    assert raster.median_blur(image.filter("false"), "r", 5, h, w).collect() == []


def test_distance_against_all_pairs(spark):
    h, w = 40, 37
    masks = {1: blobs(h, w, 6, 0.8), 2: np.ones((h, w), bool), 3: blobs(h, w, 7, 0.97), 4: np.pad(np.ones((h - 2, w - 2), bool), 1)}
    got = {(r["image_id"], r["y"], r["x"]): r["distance"] for r in raster.distance_transform(table(spark, masks), None, h, w).collect()}
    assert len(got) == sum(int(m.sum()) for m in masks.values())
    for k, m in masks.items():
        none = np.argwhere(~m)
        for y, x in np.argwhere(m):
            d = got[k, int(y), int(x)]
            assert d is None if not len(none) else abs(d - np.hypot(none[:, 0] - y, none[:, 1] - x).min()) < 1e-12
    bounded = raster.distance_transform(table(spark, {4: masks[4]}), 3, h, w).filter(F.col("distance").isNotNull())
    assert bounded.agg(F.max("distance")).first()[0] == 3.0


def test_distance_of_a_large_solid_mask(spark):
    """Linear in the pixels: each used to meet all others of its column."""
    side = 700
    rows = spark.range(side).select(F.lit(1).alias("image_id"), F.col("id").cast("int").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    solid = rows.filter("not (y = 350 and x = 350)")
    got = raster.distance_transform(solid, None, side, side)
    off = F.hypot(F.col("y") - 350, F.col("x") - 350)
    assert got.filter(F.abs(F.col("distance") - off) > 1e-9).count() == 0 and got.count() == side * side - 1


def test_lower_envelope():
    rng = random.Random(8)
    for _ in range(300):
        at = sorted(rng.sample(range(60), rng.randint(1, 20)))
        height = [rng.randint(0, 40) ** 2 * rng.randint(0, 1) for _ in at]
        ask = sorted(rng.sample(range(60), 15))
        assert raster.lower_envelope(at, height, ask) == [min((q - p) ** 2 + f for p, f in zip(at, height, strict=True)) for q in ask]


def shuffled_rows(spark):
    """Rows that all stages so far have written to shuffles."""
    sc = spark.sparkContext
    gateway = sc._gateway
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def cost(spark, df):
    before = shuffled_rows(spark)
    df.write.format("noop").mode("overwrite").save()
    return shuffled_rows(spark) - before


def test_window_codes_over_tiles(spark):
    masks, top, left = {1: blobs(150, 140, 1), 2: blobs(20, 30, 2)}, -9, 120
    for h, w in ((3, 3), (5, 3), (2, 2)):
        want = {}
        for k, m in masks.items():
            for y, x in np.argwhere(m):
                for bit in range(h * w):
                    at = k, int(y) + top - (bit // w - h // 2), int(x) + left - (bit % w - w // 2)
                    want[at] = want.get(at, 0) | 1 << bit
        pixels = table(spark, masks, top, left)  # with repeated rows
        assert cells(raster.window_code(pixels, h, w, background=True), "code") == sorted((*at, c) for at, c in want.items())
        assert cells(raster.dilate(pixels, h, w)) == sorted(want)
        assert cells(raster.erode(pixels, h, w)) == sorted(at for at, c in want.items() if c == (1 << h * w) - 1)
    ring = raster.extract_patches(pixels, pixels.limit(50)).collect()
    assert len(ring) == 50 and all(r["patch"][4] == (r["y"] is not None and r["image_id"] is not None) for r in ring)


def test_kinds_and_spurs_do_not_depend_on_tiles(spark):
    """The same drawing inside a tile and across four."""
    m = {1: blobs(60, 60, 9) & (np.random.default_rng(9).random((60, 60)) < 0.6)}
    for work in (skeleton.fix_hollow_cross, skeleton.classify_pixels, lambda p: skeleton.remove_1px_spurs(skeleton.classify_pixels(p))):
        inside, across = (sorted((r[1] - d, r[2] - d, r[3]) for r in work(table(spark, m, d, d)).collect()) for d in (20, 100))
        assert inside and inside == across


def test_a_pixel_is_sent_once_for_its_window(spark):
    pixels = table(spark, {k: blobs(64, 64, k) for k in range(8)}).dropna().dropDuplicates().cache()
    n = pixels.count()
    typed = skeleton.classify_pixels(pixels).cache()
    typed.count()
    for df in (raster.window_code(pixels), raster.hit_or_miss(raster.window_code(pixels), skeleton.junction_patterns(spark), "sum"), skeleton.classify_pixels(pixels), skeleton.remove_1px_spurs(typed)):
        assert cost(spark, df) < 1.5 * n
    assert cost(spark, raster.extract_patches(pixels, pixels)) < 3 * n
    kernel = spark.range(49).selectExpr("cast(id div 7 - 3 as int) as dy", "cast(id % 7 - 3 as int) as dx", "cast(id as double) as w")
    assert cost(spark, raster.convolve(pixels.withColumn("v", F.lit(1.0)), kernel)) < 1.5 * n


@pytest.mark.parametrize("name", ["hit_or_miss", "hit_or_miss_rows", "junction_patterns"])
def test_window_queries_send_a_pixel_twice_at_most(spark, name):
    """Once to tell pixels apart and once to their tiles: cells of windows are neither sent nor held by a task as rows."""
    made = catalog.QUERIES[name](spark, SMOKE)
    n = Tables(spark, SMOKE).fx_pixels.count()
    assert n < cost(spark, made) < 2.5 * n


def test_kernels_add_up_over_tiles(spark):
    rng = random.Random(5)
    values = [(1, rng.randrange(3), rng.randint(-4, 8), rng.randint(124, 131), rng.choice([None, 0.5, 2.0, -1.0])) for _ in range(60)]
    taps = [(o, i, dy, dx, rng.choice([None, 1.0, -2.0, 0.25])) for o in (7, 9) for i in (0, 1) for dy in (-3, 0, 1) for dx in (-1, 2)]
    want = {}
    for k, i, y, x, v in values:
        for o, of, dy, dx, w in taps:
            if of == i:
                at = k, o, y + dy, x + dx
                want[at] = want.get(at) if v is None or w is None else (want.get(at) or 0.0) + v * w
    got = raster.spread(spark.createDataFrame(values, "image_id long, i int, y int, x int, v double"), spark.createDataFrame(taps, "o long, i long, dy int, dx int, w double"))
    assert {(r["image_id"], r["o"], r["y"], r["x"]): r["v"] for r in got.collect()} == want and got.count() == len(want)


def test_composed_kernels_send_a_value_once(spark):
    values = table(spark, {k: blobs(64, 64, k) for k in range(8)}).dropna().dropDuplicates().selectExpr("*", "0 as i", "1D as v").cache()
    n = values.count()
    base = spark.range(64).selectExpr("cast(id % 2 as int) as kernel_id", "cast(id div 8 - 4 as int) as dy", "cast(id % 8 - 4 as int) as dx", "cast(id as double) as w")
    weights = spark.createDataFrame([(o, 0, k, 1.0) for o in (0, 1) for k in (0, 1)], "o int, i int, kernel_id int, weight double")
    assert cost(spark, kernels.apply_composed(values, weights, base)) < 1.5 * n + 1000


def test_blur_looks_at_the_windows_that_hold_cells_only(monkeypatch):
    makes, seen, sort = [], [], np.sort
    monkeypatch.setattr(raster, "over_tiles", lambda cells, halo, make, *_: makes.append(make))
    monkeypatch.setattr(np, "sort", lambda a, **how: seen.append(a.shape) or sort(a, **how))

    class Image:
        filter = lambda self, _: self

    monkeypatch.setattr(raster.F, "col", lambda _: type("C", (), {"isNotNull": lambda self: True})())
    raster.median_blur(Image(), "r", 5, 48, 48)
    values = np.full((132, 132), np.nan)
    values[2:50, 2:50] = np.arange(48 * 48).reshape(48, 48)
    y, x, v = makes[0](~np.isnan(values), values, -2, -2)
    assert seen == [(48, 48, 25)]  # of 128 x 128 windows before
    assert len(v) == 48 * 48 and v[(y == 26) & (x == 26)] == values[26, 26]
    assert [len(c) for c in makes[0](~np.isnan(values), np.full((132, 132), np.nan), -2, -2)] == [0, 0, 0]
