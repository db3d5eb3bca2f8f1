"""The auction over sparse pairs against the exact solver."""

import itertools
import random
import numpy as np
import pytest

from filigree.operators import match


def pairs_of(gain):
    return [(int(i), int(j), float(gain[i, j])) for i, j in np.argwhere(gain > 0)]


@pytest.mark.parametrize("seed", range(60))
def test_best_total(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 25, 2)
    gain = np.maximum(np.round(rng.uniform(-3 if seed % 2 else -20, 5, (n, m)), int(rng.integers(0, 5))), 0)
    got = match.assign_sparse(pairs_of(gain))
    assert len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
    assert abs(sum(gain[i, j] for i, j in got) - sum(gain[i, j] for i, j in match.assign(gain))) < 1e-9


def test_a_part_of_twenty_thousand_nodes():
    """Its gain table would have a hundred million cells."""
    n = 100
    rng = np.random.default_rng(1)
    a, b = (np.argwhere(np.ones((n, n))) + rng.uniform(-0.5, 0.5, (n * n, 2)) for _ in range(2))
    near = []
    for di in (-1, 0, 1):
        for dj in (-1, 0, 1):
            i, j = np.meshgrid(range(n), range(n), indexing="ij")
            u, v = i + di, j + dj
            inside = (u >= 0) & (u < n) & (v >= 0) & (v < n)
            p, q = (i * n + j)[inside], (u * n + v)[inside]
            gain = 1.2 - np.hypot(*(a[p] - b[q]).T)
            near += [(int(x), int(y), float(g)) for x, y, g in zip(p, q, gain, strict=True) if g > 0]
    got = match.assign_sparse(near)
    worth = {(x, y): g for x, y, g in near}
    best = sum(worth[k] for k in got)
    greedy, used = 0.0, set()
    for x, y, g in sorted(near, key=lambda r: -r[2]):
        if (0, x) not in used and (1, y) not in used:
            used |= {(0, x), (1, y)}
            greedy += g
    assert greedy < best < n * n * 1.2


def test_both_solvers_in_spark(spark, monkeypatch):
    rng = np.random.default_rng(7)
    side = lambda: spark.createDataFrame([(g, k, float(y), float(x)) for g in range(2) for k, (y, x) in enumerate(rng.uniform(0, 12, (40, 2)))], "graph_id long, node_id long, y double, x double")
    pred, target = side(), side()
    exact = sorted(map(tuple, match.match_nodes(pred, target, ["graph_id"], 2.5).collect()))
    monkeypatch.setattr(match, "DENSE", 0)
    assert sorted(map(tuple, match.match_nodes(pred, target, ["graph_id"], 2.5).collect())) == exact


def stages(spark):
    sc = spark.sparkContext
    gateway = sc._gateway
    found = sc._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return [found.apply(k) for k in range(found.size())]


def grid(spark, graphs, nodes, off=0.0):
    rows = spark.range(graphs * nodes).selectExpr(f"id div {nodes} as graph_id", f"id % {nodes} as node_id")
    return rows.selectExpr("*", f"node_id div 20 * 100D + {off} as y", f"node_id % 20 * 100D + {off} as x")


def test_matching_sends_the_driver_no_table(spark):
    """Written tables of a few MB were broadcast by their files' sizes, which are a tenth of what the driver then held."""
    before = sum(s.resultSize() for s in stages(spark))
    pairs = match.match_nodes(grid(spark, 1500, 200), grid(spark, 1500, 200, 3.0), ["graph_id"], 20)
    assert pairs.count() == 300_000
    assert sum(s.resultSize() for s in stages(spark)) - before < 1_500_000


def test_pairs_that_share_no_node_are_parts_at_once(spark):
    rows = [(0, k, k + 1000, 1.0, 2.0) for k in range(20_000)] + [(1, 0, 0, 1.0, 2.0), (1, 0, 1, 2.0, 1.0), (1, 1, 1, 1.5, 1.5), (1, 2, 2, 3.0, 0.0)]
    gains = spark.createDataFrame(rows, "graph_id long, pred_node long, target_node long, distance double, gain double")
    before = sum(s.shuffleWriteRecords() for s in stages(spark))
    parts = match.gain_parts(gains, ["graph_id"])
    got = parts.collect()
    assert sum(s.shuffleWriteRecords() for s in stages(spark)) - before < 2.5 * len(rows)
    assert len(got) == len(rows) and {(r["pred_node"], r["component"]) for r in got if r["graph_id"]} == {(0, 0), (1, 0), (2, 4)}
    best = match.assign_component(parts.filter("graph_id = 1"), ["graph_id"]).collect()
    assert sorted((r["pred_node"], r["target_node"]) for r in best) == [(0, 0), (1, 1)]


def test_parts_come_to_python_many_in_a_batch(spark):
    rng = random.Random(8)
    rows = [(g, f"k{g % 3}", c, 2 * c + i, 2 * c + j, float(rng.randrange(9)), rng.random() - 0.2) for g in range(4) for c in range(9) for i in (0, 1) for j in (0, 1) if (i, j) != (1, 1) or c % 2]
    pairs = spark.createDataFrame(rows, "graph int, name string, component long, pred_node long, target_node long, distance double, gain double")
    out = match.assign_component(pairs, ["graph", "name"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan  # a call for each part before
    got = {tuple(r) for r in out.collect()}
    want = set()
    for g in range(4):
        for c in range(9):
            own = {(p, t): (d, gain) for graph, _, part, p, t, d, gain in rows if (graph, part) == (g, c)}
            best = max((s for n in range(3) for s in itertools.combinations(own, n) if len({p for p, _ in s}) == len({t for _, t in s}) == n), key=lambda s: sum(own[k][1] for k in s))
            want |= {(g, f"k{g % 3}", *k, own[k][0]) for k in best}
    assert got == want
