"""Hard negatives and whitening against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from filigree.llm import hard_negatives, queries, whitening

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<double>, score double, slot int, x string"


def fine(v):
    return v is not None and all(c is not None and math.isfinite(c) for c in v)


def brute(rows, every=10, positives=5, negatives=3):
    """Anchors are rows whose id is divisible by ``every``."""
    kept = {}
    for k, label, v in rows:
        if label is not None and fine(v):
            x = (label, [max(min(math.floor(256 * c), 1 << 23), -(1 << 23)) for c in v])
            if k is None:
                kept[None, len(kept)] = x
            elif (k, 0) not in kept or x < kept[k, 0]:
                kept[k, 0] = x
    dot = lambda a, b: sum(p * q for p, q in zip(a, b))  # noqa: E731, B905
    last = lambda k: math.inf if k[0] is None else k[0]
    out = []
    for a, (label, x) in kept.items():
        if a[0] is None or a[0] % every:
            continue
        near = sorted((-dot(x, y), last(b), b[0]) for b, (other, y) in kept.items() if other == label and b != a)[:positives]
        for p, _, positive in near:
            found = sorted((-dot(x, y), last(b), b[0]) for b, (other, y) in kept.items() if other != label and -50 * p <= 100 * dot(x, y) <= -95 * p)
            out += [(a[0], positive, n, k, -p, -s) for n, (s, _, k) in enumerate(found[:negatives], 1)]
    return sorted(out, key=str)


def mined(spark, rows, every=10):
    df = spark.createDataFrame([(*r, 1.0, 2, "q") for r in rows], SCHEMA).repartition(3)
    out = hard_negatives.mine(df, F.col("vec_id") % every == 0)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def vectors(n, d, seed, spread=1.0, copies=0):
    """Vectors around a few directions, of many lengths if spread is over 1, with copies of one of them."""
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, d))
    v = middle[rng.integers(0, 6, n)] + 0.4 * rng.standard_normal((n, d))
    v *= np.exp(rng.uniform(0, np.log(spread), n))[:, None] / np.linalg.norm(v, axis=1)[:, None] if spread > 1 else 1
    v[:copies] = v[0]
    return [(k, int(rng.integers(0, 4)), v[k].tolist()) for k in range(n)]


def test_mine_clustered(spark, monkeypatch):
    for name in ("ROWS", "SAMPLE", "ANCHORS"):
        monkeypatch.setattr(hard_negatives, name, 32)
    rows = vectors(420, 12, 1, spread=30)
    assert mined(spark, rows) == brute(rows)


def test_mine_ties_and_copies(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROWS", 64)
    rows = vectors(200, 6, 2, copies=80)
    assert mined(spark, rows) == brute(rows)


def test_mine_odd_rows(spark):
    rows = vectors(60, 4, 3)
    rows += [(100, None, [1.0] * 4), (None, 1, [1.0, 0.5, 0.2, 0.1]), (None, 2, [1.0, 0.5, 0.2, 0.1]), (101, 1, None), (102, 1, [1.0, None, 0.0, 0.0])]
    rows += [(103, 1, [float("nan")] * 4), (104, 2, [float("inf")] * 4), (110, 1, []), (111, 1, [0.3]), (112, 2, [0.0] * 4), (20, 3, [9.0] * 4), (21, 0, [1e12, 0.0, 0.0, 0.0])]
    rows += [(130, 2, [-1e300, 2.0, 1.0, 0.0]), (-50, 1, [1.0, 1.0, 0.0, 0.0]), (30, 1, rows[30][2]), (131, 1, [0.9, 0.5, 0.2, 0.1, 0.7])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0]), (1, 2, [1.0])]) == []


def test_ranges_hold_every_row_over_the_threshold():
    rng = np.random.default_rng(4)
    u = rng.standard_normal((3000, 5))
    u /= np.linalg.norm(u, axis=1)[:, None]
    for cosine in (-0.9, -0.3, 0.0, 0.2, 0.6, 0.95, 1.0):
        low, high = hard_negatives.feasible(u[:40], np.full(40, cosine))
        for k in range(40):
            near = u[u @ u[k] >= cosine]
            assert ((near >= low[k]) & (near <= high[k])).all()
    low, high = hard_negatives.feasible(u[:40], np.full(40, 0.97))
    assert (high - low).max() < 0.6  # and it does select


def test_mine_small_table(spark):
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op12_hard_negatives(spark, SMALL).collect()), key=str)
    assert got == brute(rows, 50)


# --- whitening


def reference(rows, scale=1024, offset=100_000):
    """(n, sums, whole rows, components as rows, eigenvalues, trace) by a dense decomposition of long numbers."""
    width = max((len(v) for _, v in rows if fine(v)), default=0)
    x = [[min(max(math.floor(scale * (v[k] if k < len(v) else 0)) + offset, -(2**31)), 2**31 - 1) for k in range(width)] for _, v in rows if fine(v)]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, sums, strict=True)] for r in x])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, sums, x, v.T[::-1], e[::-1], e.sum(), centred


def whitened(spark, rows, **k):
    df = spark.createDataFrame([(*r, "a", 1) for r in rows], "vec_id long, embedding array<double>, component string, n int").repartition(3)
    return whitening.whitened(df, offset=100_000, **k).collect()


def check(spark, rows, components=8):
    n, sums, x, vectors, e, trace, centred = reference(rows)
    got = whitened(spark, rows, components=components)
    count = min(components, int((e > 1e-12 * trace).sum()))
    assert len(got) == n * count
    ids = [k for k, v in rows if fine(v)]
    deviation = {}
    for k, r in zip(ids, x, strict=True):
        deviation.setdefault(k, []).append(sum((n * a - s) ** 2 for a, s in zip(r, sums, strict=True)))
    z = {}
    for r in got:
        assert r["n"] == n and r["deviation"] in [d if d < 2**63 else None for d in deviation[r["vec_id"]]]
        assert abs(r["explained"] - e[r["component"] - 1] / trace) <= 1e-9 * r["explained"]
        assert r["identity_error"] < 1e-8
        z.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r["whitened"])
    return z, ids, centred, vectors, e, count


def test_whiten_random(spark):
    rng = np.random.default_rng(1)
    rows = [(k, v) for k, v in enumerate((rng.standard_normal((300, 12)) * np.linspace(1, 3, 12) + 50).tolist())]
    z, ids, centred, vectors, e, count = check(spark, rows)
    want = centred @ vectors[:count].T / np.sqrt(e[:count])
    got = np.array([[z[k][c][0] for c in range(1, count + 1)] for k in ids])
    sign = np.sign((want * got).sum(0))
    assert np.abs(got - want * sign).max() < 1e-8


def test_whiten_equal_eigenvalues(spark):
    rows = [(k, np.eye(6)[k % 6].tolist()) for k in range(60)] + [(100 + k, (-np.eye(6)[k % 6]).tolist()) for k in range(60)]
    z, ids, *_, count = check(spark, rows)
    assert count == 6
    got = np.array([[z[k][c][0] for c in range(1, 7)] for k in ids])
    assert np.abs(got.T @ got / len(got) - np.eye(6)).max() < 1e-9


def test_whiten_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(k, v) for k, v in enumerate(rng.standard_normal((40, 5)).tolist())]
    rows += [(50, None), (51, [1.0, None]), (52, [float("nan")]), (53, [float("-inf"), 1.0]), (54, []), (55, [0.5]), (None, [1.0] * 5), (3, [2.0] * 5), (56, [1e300, 0.0, 0.0, 0.0, 0.0])]
    check(spark, rows)
    assert whitened(spark, [(1, [1.0, 2.0])]) == [] and whitened(spark, [(1, [3.0]), (2, [3.0])]) == []
    assert whitened(spark, [(1, None)]) == []
    check(spark, [(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.5, 4.0])])  # one direction only


def test_tolerance_stops_early():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((500, 80)) * np.r_[np.linspace(30, 9, 8), np.ones(72)]
    x -= x.mean(0)
    calls = []

    def product(c):
        calls.append(1)
        return x.T @ (x @ c)

    v, s = whitening.bidiagonalise(product, 80, 8, np.linalg.norm(x), tolerance=1e-12)
    assert len(calls) < 50
    assert np.abs(s - np.linalg.svd(x, compute_uv=False)[:8]).max() < 1e-9
    assert np.abs(x.T @ (x @ v.T) - v.T * s**2).max() < 1e-6


@pytest.mark.parametrize("kind", ["random", "ties", "low rank", "scales"])
def test_bidiagonalise(kind):
    rng = np.random.default_rng(5)
    x = {"random": lambda: rng.standard_normal((200, 30)), "ties": lambda: np.vstack([np.eye(30)] * 4), "low rank": lambda: rng.standard_normal((200, 3)) @ rng.standard_normal((3, 30)), "scales": lambda: rng.standard_normal((200, 30)) * np.logspace(0, -8, 30)}[kind]()
    x = x - x.mean(0)
    v, s = whitening.bidiagonalise(lambda c: x.T @ (x @ c), 30, 8, np.linalg.norm(x))
    assert np.abs(s - np.linalg.svd(x, compute_uv=False)[:8]).max() < 1e-12 * s[0]
    assert np.abs(v @ v.T - np.eye(8)).max() < 1e-12


def test_whiten_small_table(spark):
    got = queries.op13_whitening(spark, SMALL).toPandas()
    x = np.array([r["embedding"] for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").orderBy("vec_id").select("embedding").collect()])
    x = np.floor(1024 * x)
    e, v = np.linalg.eigh(np.cov(x.T, bias=True))
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = (x - x.mean(0)) @ v[:, ::-1][:, :8] / np.sqrt(e[::-1][:8])
    assert np.abs(z - want * np.sign((want * z).sum(0))).max() < 1e-7
