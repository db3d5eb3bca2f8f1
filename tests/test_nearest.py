"""Nearest nodes by growing cells and densities by a bounded radius, against all pairs."""

import math
import random

from filigree.operators import match

KEYS = ["graph_id"]


def nodes(spark, rows):
    return spark.createDataFrame(rows, "graph_id long, node_id long, y double, x double").repartition(3)


def scattered(seed):
    """Graphs of very different scales, with clusters, outliers, equal places and lines."""
    rng = random.Random(seed)
    rows = [(1, k, rng.uniform(0, 100), rng.uniform(0, 100)) for k in range(80)]
    rows += [(2, k, rng.gauss(0, 1e-5), rng.gauss(5, 1e-5)) for k in range(60)] + [(2, 60, 1e6, -1e6)]
    rows += [(3, k, float(k % 4), 7.0) for k in range(20)]
    rows += [(4, k, float(rng.randrange(6)), float(rng.randrange(6))) for k in range(50)]
    return rows


def brute(pred, target):
    out = {}
    for g, i, y, x in pred:
        near = [(math.hypot(y - v, x - u), j) for h, j, v, u in target if h == g]
        if near:
            out[g, i] = min(near)
    return out


def test_nearest(spark):
    pred, target = scattered(1), scattered(2)
    pred += [(2, 99, -1e7, 3.0), (1, 99, 500.0, 50.0), (9, 0, 1.0, 1.0)]
    want = brute(pred, target)
    odd = [(1, 200, None, 1.0), (1, 201, float("nan"), 1.0), (1, 202, float("inf"), 0.0)]
    got = match.nearest(nodes(spark, pred + odd), nodes(spark, target + odd[:2]), KEYS).collect()
    assert len(got) == len(want)
    for r in got:
        d, j = want[r["graph_id"], r["pred_node"]]
        assert abs(r["distance"] - d) <= 1e-12 * max(d, 1e-9) and r["target_node"] == j
    assert match.nearest(nodes(spark, []), nodes(spark, target), KEYS).collect() == []
    assert match.nearest(nodes(spark, pred), nodes(spark, []), KEYS).collect() == []


def test_nearest_in_one_large_graph(spark):
    """Four hundred million pairs, of which few are looked at."""
    rng = random.Random(3)
    side = lambda: nodes(spark, [(1, k, rng.uniform(0, 1000), rng.uniform(0, 1000)) for k in range(20_000)])
    got = match.nearest(side(), side(), KEYS)
    assert got.count() == 20_000 and got.filter("distance > 60").isEmpty()


def test_density_within_its_bound(spark):
    pred, target = scattered(4), scattered(5)
    for sigma in (0.5, 20.0):
        got = {(r["graph_id"], r["node_id"]): r["density"] for r in match.node_density(nodes(spark, pred), nodes(spark, target), KEYS, sigma).collect()}
        weigh = lambda a, b: math.exp(-((a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2) / (2 * sigma**2)) if a[0] == b[0] else 0.0  # noqa: E731, B023
        for a in pred:
            own = min(max(sum(weigh(a, b) for b in pred) - 1, 0), 1)
            cross = min(sum(weigh(a, b) for b in target), 1)
            assert abs(got[a[:2]] - (own + cross) / 2) <= 2 * match.DENSITY_ERROR


def test_density_reach():
    for most in (1, 30, 10**9):
        reach = match.density_reach(most, 2.0)
        assert most * math.exp(-(reach**2) / 8.0) <= match.DENSITY_ERROR * 1.0001
