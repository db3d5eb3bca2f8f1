"""Exact order statistics by refined histograms, and small cycles, against brute force."""

import itertools
import random

import numpy as np
import pytest

from filigree.operators import kernels, rewrite

KEYS = ["graph_id"]


@pytest.mark.parametrize("size", [4096, 30])
def test_quantiles(spark, monkeypatch, size):
    monkeypatch.setattr(kernels, "SORTED", size)
    rng = np.random.default_rng(1)
    groups = {
        0: rng.standard_normal(2000), 1: np.exp(rng.uniform(-600, 600, 300)) * rng.choice([-1, 1], 300), 2: np.full(50, 2.5), 3: np.array([7.0]),
        4: rng.integers(0, 3, 400).astype(float), 5: np.array([-1.7e308, 1.7e308, 0.0, 5e-324]), 6: np.nextafter(1.0, 2.0, dtype=float) * np.ones(3) + np.array([0, 2.3e-16, 0]),
    }
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs]
    odd = [(0, None), (0, float("nan")), (0, float("inf")), (9, None), (9, float("-inf"))]
    out = {r["kernel_id"]: r for r in kernels.weight_quantiles(spark.createDataFrame(rows + odd, "kernel_id int, w double").repartition(3)).collect()}
    assert set(out) == {*groups, 9} and out[9]["median"] is None and out[9]["q2"] is None
    for k, vs in groups.items():
        for name, p in {"median": 0.5, "q0": 0.625, "minus_q0": 0.375, "q1": 0.75, "minus_q1": 0.25, "q2": 0.875, "minus_q2": 0.125}.items():
            with np.errstate(over="ignore", invalid="ignore"):
                want = np.quantile(vs, p)
            if k != 5:  # there numpy's own interpolation overflows
                assert abs(out[k][name] - want) <= 1e-12 * abs(want), (k, name)


@pytest.mark.parametrize("size", [4096, 1])
def test_order_statistics_of_every_rank(spark, monkeypatch, size):
    monkeypatch.setattr(kernels, "SORTED", size)
    rng = random.Random(2)
    rows = [(g, float(rng.choice([rng.randint(-3, 3), rng.gauss(0, 1e9), rng.gauss(0, 1e-9)]))) for g in range(3) for _ in range(70)]
    values = spark.createDataFrame(rows, "g int, w double").repartition(4)
    asked = spark.createDataFrame([(g, k) for g in range(4) for k in range(-1, 72)], "g int, rank int")
    got = sorted(tuple(r) for r in kernels.order_statistics(values, "g", "w", asked).collect())
    assert got == [(g, k, v) for g in range(3) for k, v in enumerate(sorted(w for h, w in rows if h == g))]


def brute_cycles(edges, places, distance):
    links = {frozenset(e) for e in edges if e[0] != e[1]}
    near = lambda ids: all(np.hypot(*np.subtract(places[a], places[b])) < distance for a, b in itertools.combinations(ids, 2))
    joined = lambda a, b: frozenset((a, b)) in links
    out = []
    for ids in itertools.combinations(sorted(places), 3):
        if all(joined(a, b) for a, b in itertools.combinations(ids, 2)) and near(ids):
            out.append(list(ids))
    for a, b, c, d in itertools.permutations(sorted(places), 4):
        if a == min(a, b, c, d) and b < d and joined(a, b) and joined(b, c) and joined(c, d) and joined(d, a) and not joined(a, c) and not joined(b, d) and near((a, b, c, d)):
            out.append([a, b, c, d])
    return sorted(out)


def test_cycles(spark):
    rng = random.Random(3)
    branches, nodes, want = [], [], []
    for g in range(6):
        places = {k: (rng.uniform(0, 10), rng.uniform(0, 10)) for k in range(13)}
        edges = [(rng.randrange(13), rng.randrange(13)) for _ in range(10 + 6 * g)]
        edges += edges[:3] + [(b, a) for a, b in edges[:2]]
        branches += [(g, k, a, b) for k, (a, b) in enumerate(edges)]
        nodes += [(g, k, *p) for k, p in places.items()]
        want += [(g, c) for c in brute_cycles(edges, places, 7.0)]
    b = spark.createDataFrame(branches, "graph_id int, branch_id long, node1 long, node2 long")
    n = spark.createDataFrame(nodes, "graph_id int, node_id long, y double, x double")
    assert sorted((r["graph_id"], list(r["cycle_nodes"])) for r in rewrite.small_cycles(b, n, KEYS, 7.0).collect()) == sorted(want)
    assert len(want) > 15


def test_cycles_at_a_hub(spark):
    """A star of 10,000 whose rays would meet in fifty million pairs, with two cycles through its hub."""
    edges = [(0, k) for k in range(1, 10_001)] + [(1, 2), (3, 20_000), (20_000, 4)]
    b = spark.createDataFrame([(1, k, *e) for k, e in enumerate(edges)], "graph_id int, branch_id long, node1 long, node2 long")
    n = spark.createDataFrame([(1, k, 0.0, k / 1e6) for k in [*range(10_001), 20_000]], "graph_id int, node_id long, y double, x double")
    got = sorted(list(r["cycle_nodes"]) for r in rewrite.small_cycles(b, n, KEYS, 1.0).collect())
    assert got == [[0, 1, 2], [0, 3, 20_000, 4]]
