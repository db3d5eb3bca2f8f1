"""Statistics of kernels, weights and angle stacks.

``weights`` has (sample_id, kernel_id, k, r, type, w), ``kernel`` (kernel_id, dy, dx, w) and ``stack``
(image_id, theta, y, x, v).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filigree.sources.scratch import saved

from .raster import spread


#: Parts that a range of values is cut into by each round of a selection; a range of no more than SORTED values is sorted.
PARTS, SORTED = 1024, 4096


def order_statistics(values: DataFrame, key: str, value: str, asked: DataFrame) -> DataFrame:
    """(key, rank, v): the value of each rank from 0 in each group, exactly, without holding or sorting a group.

    ``asked`` has key and rank. Each asked rank has a range of values that holds it. A round counts the values
    of a range in PARTS parts, and the part that holds the rank, from its least to its largest value, is the
    next range, until these are the same or the range holds no more than SORTED values, which are then sorted; every
    other round parts it by orders of magnitude. What a group keeps is bounded by these numbers times its ranks. Values must
    be finite; ranks that a group does not have give no row.
    """
    own = values.select(key, F.col(value).cast("double").alias("_w"))
    whole = own.groupBy(key).agg(F.count("*").alias("_n"), F.min("_w").alias("_lo"), F.max("_w").alias("_hi"))
    state = saved(asked.select(key, F.col("rank").cast("long").alias("rank")).distinct().join(whole, key).filter("rank >= 0 and rank < _n").select(key, "rank", "_lo", "_hi", F.lit(0).cast("long").alias("_below"), F.col("_n").alias("_c")))
    large = F.expr(f"_lo < _hi and _c > {SORTED}")
    done, turn = state.filter(~large), 0
    while not (wide := state.filter(large).drop("_c")).isEmpty():
        ranges = wide.select(key, "_lo", "_hi").distinct()
        # Halves, where the width of a range would overflow.
        off, width = F.col("_w") - F.col("_lo"), F.col("_hi") - F.col("_lo")
        half_off, half_width = F.col("_w") / 2 - F.col("_lo") / 2, F.col("_hi") / 2 - F.col("_lo") / 2
        share = F.when(half_width > 1e300, half_off / half_width).otherwise(off / width)
        if turn % 2:  # by orders of magnitude, for values of very different sizes
            size = lambda c: F.when(F.col(c) == 0, 0.0).otherwise(F.signum(c) * (F.log(F.abs(c)) + 746))
            share = F.when(size("_hi") > size("_lo"), (size("_w") - size("_lo")) / (size("_hi") - size("_lo"))).otherwise(share)
        turn += 1
        at = F.floor(share * PARTS)
        inside = own.join(ranges, key).filter("_w between _lo and _hi").withColumn("_part", F.least(at, F.lit(PARTS - 1)))
        parts = inside.groupBy(key, "_lo", "_hi", "_part").agg(F.count("*").alias("_c"), F.min("_w").alias("_a"), F.max("_w").alias("_z"))
        before = F.sum("_c").over(Window.partitionBy(key, "_lo", "_hi").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        parts = parts.withColumn("_before", F.coalesce(before, F.lit(0)))
        first = F.col("_below") + F.col("_before")
        held = wide.join(parts, [key, "_lo", "_hi"]).filter((F.col("rank") >= first) & (F.col("rank") < first + F.col("_c")))
        state = saved(held.select(key, "rank", F.col("_a").alias("_lo"), F.col("_z").alias("_hi"), first.alias("_below"), "_c"))
        done = done.unionByName(state.filter(~large))
    few = done.filter("_lo < _hi")
    own = own.join(few.select(key, "_lo", "_hi").distinct(), key).filter("_w between _lo and _hi")
    own = own.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_lo", "_hi").orderBy("_w")) - 1)
    found = few.withColumn("_at", F.col("rank") - F.col("_below")).join(own, [key, "_lo", "_hi", "_at"]).select(key, "rank", F.col("_w").alias("v"))
    return found.unionByName(done.filter("_lo = _hi").select(key, "rank", F.col("_lo").alias("v")))


def weight_quantiles(weights: DataFrame, bands: int = 3) -> DataFrame:
    """Median and nested bands of each kernel's weights, by linear interpolation: q0 is the innermost.

    Weights that are null, NaN or infinite don't count; a kernel without others has null quantiles.
    """
    share = {"median": 0.5}
    for i in range(bands):
        half = (i + 1) / (bands + 1) / 2
        share |= {f"q{i}": 0.5 + half, f"minus_q{i}": 0.5 - half}
    known = weights.select("kernel_id", F.col("w").cast("double").alias("w")).filter(F.abs("w") < float("inf"))
    names = F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(p).alias("p")) for k, p in share.items()])).alias("q")
    spots = known.groupBy("kernel_id").agg(F.count("*").alias("n")).select("kernel_id", "n", names).select("kernel_id", "q.name", (F.col("q.p") * (F.col("n") - 1)).alias("at"))
    spots = saved(spots.select("kernel_id", "name", "at", F.floor("at").alias("low"), F.ceil("at").alias("high")))
    asked = spots.select("kernel_id", F.explode(F.array("low", "high")).alias("rank"))
    found = saved(order_statistics(known, "kernel_id", "w", asked))
    for side in ("low", "high"):
        spots = spots.join(found.select("kernel_id", F.col("rank").alias(side), F.col("v").alias(f"_{side}")), ["kernel_id", side])
    value = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("at") - F.col("low"))
    wide = spots.groupBy("kernel_id").agg(*[F.max(F.when(F.col("name") == k, value)).alias(k) for k in share])
    return weights.select("kernel_id").distinct().join(wide, "kernel_id", "left")


def edges(low: float, high: float, bins: int, space: str = "linear", scale: float | None = None) -> list[float]:
    """``bins`` edges from low to high, evenly on the scale."""
    if space == "linear":
        return np.linspace(low, high, bins).tolist()
    if space == "log":
        return np.logspace(math.log10(low), math.log10(high), bins).tolist()
    if space == "symlog":
        c = abs(high - low) * 2 / bins if scale is None else scale
        lo, hi = (math.copysign(math.log10(1 + abs(v) / c), v) for v in (low, high))
        return [math.copysign(c * (10 ** abs(v) - 1), v) for v in np.linspace(lo, hi, bins)]
    raise ValueError(f"unknown space {space}")


def weight_histogram(weights: DataFrame, bins: int = 20, space: str = "linear", norm: str | None = "sum") -> DataFrame:
    """(kernel_id, bin, n, density) of the bins that have weights; the last bin is closed on the right.

    The two ends are read first; that is one row.
    """
    ends = weights.agg(F.min("w"), F.max("w")).first()
    if ends[0] is None:
        return weights.select("kernel_id", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("density"))
    cut = edges(ends[0], ends[1], bins, space)
    at = F.lit(0)
    for e in cut[1:-1]:
        at = at + (F.col("w") >= e).cast("int")
    counts = weights.filter("w is not null").groupBy("kernel_id", at.cast("long").alias("bin")).agg(F.count("*").alias("n"))
    if norm is None:
        return counts.withColumn("density", F.col("n").cast("double"))
    total = getattr(F, norm)("n").over(Window.partitionBy("kernel_id"))
    return counts.withColumn("density", F.col("n") / total)


def weight_summary(weights: DataFrame) -> DataFrame:
    return weights.groupBy("kernel_id", "k", "r", "type").agg(F.avg("w").alias("mean"), F.stddev_pop("w").alias("std"))


def pair_complex(weights: DataFrame) -> DataFrame:
    """(sample_id, k, r, re, im): real and imaginary weight of one (k, r); what has no partner has a null there."""
    part = lambda t: F.max(F.when(F.col("type") == t, F.col("w")))
    return weights.groupBy("sample_id", "k", "r").agg(part("R").alias("re"), part("I").alias("im"))


def flatten_complex(weights: DataFrame, how: str = "norm") -> DataFrame:
    """(sample_id, k, r, w): modulus of each pair (an unpaired weight stays as it is), or angle of the pairs only."""
    pairs = pair_complex(weights)
    both = F.col("re").isNotNull() & F.col("im").isNotNull()
    if how == "angle":
        return pairs.filter(both).select("sample_id", "k", "r", F.atan2("im", "re").alias("w"))
    return pairs.select("sample_id", "k", "r", F.when(both, F.hypot("re", "im")).otherwise(F.coalesce("re", "im")).alias("w"))


def normalize_kernels(kernel: DataFrame) -> DataFrame:
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("kernel_id"))) + 1e-8
    return kernel.withColumn("w", F.col("w") / norm)


def kernel_radius(kernel: DataFrame, eps: float = 0.01) -> DataFrame:
    """(kernel_id, radius) of the smallest centred square with all weights of at least eps times the largest."""
    top = F.max(F.abs("w")).over(Window.partitionBy("kernel_id"))
    far = F.greatest(F.abs("dy"), F.abs("dx"))
    rows = kernel.withColumn("_s", F.abs("w") / top)
    return rows.groupBy("kernel_id").agg(F.coalesce(F.max(F.when(F.col("_s") >= eps, far)), F.lit(0)).alias("radius"))


def compose_kernels(weights: DataFrame, kernel: DataFrame) -> DataFrame:
    """(o, i, dy, dx, w): sums of the base kernels, weighted by weights (o, i, kernel_id, weight)."""
    return weights.join(kernel, "kernel_id").groupBy("o", "i", "dy", "dx").agg(F.sum(F.col("weight") * F.col("w")).alias("w"))


def apply_composed(values: DataFrame, weights: DataFrame, kernel: DataFrame) -> DataFrame:
    """(image_id, o, y, x, v) of values (image_id, i, y, x, v): kernels are combined first, which shuffles less."""
    # A kernel base and its weights belong to one layer, which bounds their size.
    return spread(values, compose_kernels(weights, kernel))


def ridge_fit(rows: DataFrame, features: list[str], targets: list[str], alpha: float = 0.1, bias: bool = False) -> dict[str, list[float]]:
    """Coefficients of each target: the Gram matrix is summed by Spark, and its few rows are solved here."""
    x = [F.col(c) for c in features] + ([F.lit(1.0)] if bias else [])
    n = len(x)
    sums = [F.sum(x[i] * x[j]).alias(f"g{i}_{j}") for i in range(n) for j in range(i, n)]
    sums += [F.sum(x[i] * F.col(t)).alias(f"t{k}_{i}") for k, t in enumerate(targets) for i in range(n)]
    row = rows.agg(*sums).first()
    gram = np.array([[float(row[f"g{min(i, j)}_{max(i, j)}"] or 0) for j in range(n)] for i in range(n)]) + alpha * np.eye(n)
    return {t: np.linalg.solve(gram, [float(row[f"t{k}_{i}"] or 0) for i in range(n)]).tolist() for k, t in enumerate(targets)}


def ridge_quality(rows: DataFrame, target: str, predicted: str) -> DataFrame:
    """mse and r2; r2 is 1 for an mse below 1e-12."""
    sse = F.sum(F.pow(F.col(target) - F.col(predicted), 2))
    sst = F.sum(F.col(target) * F.col(target)) - F.count(target) * F.avg(target) * F.avg(target)
    mse = sse / F.count(target)
    return rows.agg(mse.alias("mse"), F.when(mse < 1e-12, 1.0).otherwise(1 - sse / sst).alias("r2"))


def spectral_power(stack: DataFrame, angles: int, keys: list[str] = ("image_id",)) -> DataFrame:
    """(keys, frequency, power): squared moduli of the transform along theta, summed over the pixels."""
    keys = list(keys)
    cells = stack.groupBy(*keys, "theta", "y", "x").agg(F.sum("v").alias("v"))
    each = cells.withColumn("frequency", F.explode(F.sequence(F.lit(0), F.lit(angles - 1))))
    turn = 2 * math.pi / angles * F.col("frequency") * F.col("theta")
    parts = each.groupBy(*keys, "y", "x", "frequency").agg(F.sum(F.col("v") * F.cos(turn)).alias("re"), F.sum(F.col("v") * F.sin(turn)).alias("im"))
    return parts.groupBy(*keys, "frequency").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("power"))


def spectral_share(power: DataFrame, angles: int, keys: list[str] = ("image_id",)) -> DataFrame:
    """Power of the frequencies up to half of the angles over their sum."""
    low = power.filter(F.col("frequency") <= angles // 2)
    return low.withColumn("share", F.col("power") / F.sum("power").over(Window.partitionBy(*keys)))


def disk(size: int):
    """Predicate: the cell is in the largest centred disk of a square raster."""
    c = (size - 1) / 2
    return 2 * F.hypot(F.col("y") - c, F.col("x") - c) <= size


def polar_grid(spark, h: int, w: int | None = None, center: tuple[float, float] | None = None) -> DataFrame:
    """(y, x, rho, phi) of every cell; phi is measured from the y axis."""
    w = h if w is None else w
    cy, cx = ((h - 1) / 2, (w - 1) / 2) if center is None else center
    grid = spark.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    dy, dx = F.col("y") - cy, F.col("x") - cx
    return grid.select("y", "x", F.hypot(dy, dx).alias("rho"), F.atan2(dx, dy).alias("phi"))


def radial_kernel(spark, size: int, k: int, r: float, std: float = 0.5, oversampling: int = 1, phase: float = 0.0, normalize: str | None = None) -> DataFrame:
    """(y, x, re, im): a gaussian ring times exp(i k phi), averaged over the oversampled cells, normalised."""
    o = max(1, round(oversampling))
    grid = polar_grid(spark, size * o)
    ring = F.exp(-F.pow(F.col("rho") - r * o, 2) / (2 * (std * o) ** 2)) / (std * o * math.sqrt(2 * math.pi))
    ring = F.when(F.col("rho") == 0, 0.0).otherwise(ring) if k else ring
    turn = k * (F.col("phi") + phase)
    cells = grid.select(F.floor(F.col("y") / o).alias("y"), F.floor(F.col("x") / o).alias("x"), (ring * F.cos(turn)).alias("re"), (ring * F.sin(turn)).alias("im"))
    out = cells.groupBy("y", "x").agg(F.avg("re").alias("re"), F.avg("im").alias("im"))
    if normalize is None:
        return out
    size_ = F.hypot("re", "im")
    total = {"square": F.sqrt(F.sum(size_ * size_)), "abs": F.sum(size_), "sum": F.hypot(F.sum("re"), F.sum("im"))}[normalize]
    norm = out.agg((total + 1e-8).alias("_n"))
    return out.crossJoin(F.broadcast(norm)).select("y", "x", (F.col("re") / F.col("_n")).alias("re"), (F.col("im") / F.col("_n")).alias("im"))


def sort_by_share(power: DataFrame, keys: list[str] = ("image_id",)) -> DataFrame:
    """The power at frequency 0, the largest first."""
    return power.filter("frequency = 0").orderBy(F.col("power").desc(), *keys)
