"""Branches of skeletons over several tiles, and how their tables are joined."""

import numpy as np
import pytest

from filigree.operators import components, rewrite, skeleton
from filigree.plans import catalog
from filigree.sources.scratch import BROADCAST_BYTES, saved


def drawn(h, w, seed, n=60):
    """Kinds of the pixels of random lines, thinned; lines cross, touch and run along the edges of tiles."""
    rng, m = np.random.default_rng(seed), np.zeros((h, w), bool)
    for k in range(n):
        (y1, x1), (y2, x2) = rng.integers(0, (h, w), (2, 2))
        if k % 5 == 0:
            y1 = y2 = min(127, h - 2) + k // 5 % 2
        t = np.linspace(0, 1, 2 * max(h, w))
        m[np.round(y1 + t * (y2 - y1)).astype(int), np.round(x1 + t * (x2 - x1)).astype(int)] = True
    v = skeleton._levels(skeleton.thinned(m, 10**6), True)
    return np.where(v > 0, v + 1 - skeleton._table("endpoint")[skeleton.codes(v > 0)], 0)


KINDS = {1: drawn(270, 300, 1), 2: drawn(40, 50, 2, 8), 3: np.pad(np.full((1, 400), 2), 1), 4: np.full((1, 1), 3)}


def table(spark, kinds, top=0, left=0):
    rows = [(k, int(y) + top, int(x) + left, int(v[y, x])) for k, v in kinds.items() for y, x in zip(*np.nonzero(v), strict=True)]
    return spark.createDataFrame([*rows, (1, None, 3, 2), (None, 1, 1, 2)], "image_id long, y int, x int, kind int").repartition(4)


def runs(kind):
    """{(y, x): branch}: by a walk over each branch, cell by cell."""
    at = {(int(y), int(x)): int(kind[y, x]) for y, x in zip(*np.nonzero(kind), strict=True)}

    def hides(y, x):
        nodes = [k for k, (a, b) in enumerate(skeleton.RING) if at.get((y + a, x + b), 2) != 2]
        return {j for k in nodes for j, (a, b) in enumerate(skeleton.RING) if max(abs(a - skeleton.RING[k][0]), abs(b - skeleton.RING[k][1])) <= 1}

    links = {p: set() for p, v in at.items() if v == 2}
    for y, x in links:
        for k, (a, b) in enumerate(skeleton.RING):
            if (a, b) < (0, 0) and (q := (y + a, x + b)) in links and k not in hides(y, x):
                links[y, x].add(q)
                links[q].add((y, x))
    out = {}
    for p in sorted(links):
        if p not in out:
            stack, n = [p], len(set(out.values()))
            while stack:
                if (q := stack.pop()) not in out:
                    out[q] = n
                    stack += links[q]
    return out


WANT = {k: runs(v) for k, v in KINDS.items()}


@pytest.fixture
def plans(spark, monkeypatch):
    """The plans of all tables that the operators of skeletons write, where every table may be broadcast by its size."""
    found = []
    monkeypatch.setattr(skeleton, "saved", lambda df: found.append(plan(df)) or saved(df))
    monkeypatch.setattr(skeleton, "connected_components", lambda *a: saved(components.connected_components(*a)))
    names = [f"spark.sql.{a}autoBroadcastJoinThreshold" for a in ("", "adaptive.")]
    before = {n: spark.conf.get(n, None) for n in names}
    for n in names:
        spark.conf.set(n, "1g")
    yield found
    for n, v in before.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("top, left", [(0, 0), (-140, -9)])
def test_branches_over_tiles(spark, top, left):
    got = [tuple(r) for r in skeleton.label_branches(table(spark, KINDS, top, left)).select("image_id", "branch_id", "y", "x").collect()]
    assert sorted(got) == sorted((k, n, y + top, x + left) for k, w in WANT.items() for (y, x), n in w.items())


def test_pixels_of_branches_meet_as_rows_and_not_on_the_driver(spark, plans):
    """They were broadcast, as they look small by their files."""
    plans.append(plan(skeleton.label_branches(table(spark, {2: KINDS[2]}))))
    assert "SortMergeJoin" in plans[-1] and not any("BroadcastHashJoin" in p for p in plans)


def test_branches_bound_what_joins_broadcast(spark):
    names = [f"spark.sql.{a}autoBroadcastJoinThreshold" for a in ("", "adaptive.")]
    before = [spark.conf.get(n, None) for n in names]
    for n in names:
        spark.conf.unset(n)
    try:
        skeleton.label_branches(table(spark, {4: KINDS[4]}))
        assert [int(spark.conf.get(n)) for n in names] == [BROADCAST_BYTES] * 2
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_runs_of_small_images_need_no_graph(spark, monkeypatch):
    """Each pixel was a node of the graph of all images."""
    edges = []
    monkeypatch.setattr(skeleton, "connected_components", lambda e, *a: edges.append(e.count()) or components.connected_components(e, *a))
    assert skeleton.label_branches(table(spark, {2: KINDS[2]})).count() == len(WANT[2])
    assert edges == [0]


def around(kind, y, x):
    return [(y + a, x + b) for a, b in skeleton.RING if 0 <= y + a < kind.shape[0] and 0 <= x + b < kind.shape[1]]


def test_ends_and_branches_over_tiles(spark):
    skeleton_ = saved(table(spark, KINDS))
    _, ends, nodes = skeleton.parse_skeleton(skeleton_, keep_open=True)
    number = {k: {(int(y), int(x)): n for n, (y, x) in enumerate(np.argwhere((v != 0) & (v != 2)))} for k, v in KINDS.items()}
    assert sorted(map(tuple, nodes.select("image_id", "node_id", "y", "x").collect())) == sorted((k, n, *at) for k, v in number.items() for at, n in v.items())
    want = {(k, b, number[k][p], *p) for k, w in WANT.items() for at, b in w.items() for p in around(KINDS[k], *at) if p in number[k]}
    got = sorted(map(tuple, ends.select("image_id", "branch_id", "node_id", "y", "x").collect()))
    assert got == sorted(want)
    pairs = {}
    for k, b, n, *_ in want:
        pairs.setdefault((k, b), set()).add(n)
    whole = sorted((k, b, min(v), max(v)) for (k, b), v in pairs.items() if len(v) > 1)
    order = {k: [b for i, b, *_ in whole if i == k] for k in KINDS}
    pixels, branches, _ = skeleton.parse_skeleton(skeleton_)
    assert sorted(map(tuple, branches.select("image_id", "branch_id", "node1", "node2").collect())) == [(k, order[k].index(b), *n) for k, b, *n in whole]
    kept = sorted((k, order[k].index(b), *at) for k, w in WANT.items() for at, b in w.items() if b in order[k])
    assert sorted(map(tuple, pixels.select("image_id", "branch_id", "y", "x").collect())) == kept


def test_ends_of_branches_are_no_broadcast(spark, plans):
    skeleton.parse_skeleton(table(spark, {2: KINDS[2]}), keep_open=True)
    assert len(plans) > 2 and not any("BroadcastHashJoin" in p for p in plans)


def test_parts_of_parsed_skeletons_are_no_broadcast(spark, plans):
    """The join that gave nodes and branches their numbers is gone, and that of pixels and branches is a merge join."""
    plans += [plan(df) for df in skeleton.parse_skeleton(table(spark, {2: KINDS[2]}))]
    assert len(plans) > 6 and not any("BroadcastHashJoin" in p for p in plans)
    assert not any("Join" in p for p in plans if "node_id" in p and "kind" in p)


def test_skeletons_of_labels_are_no_broadcast(spark, plans):
    out = skeleton.skeleton_of_labels(skeleton.label_branches(table(spark, {2: KINDS[2]})))
    assert "BroadcastHashJoin" not in plan(out)
    assert {(r.y, r.x) for r in out.collect()} == set(WANT[2])


def test_short_spurs_are_the_same_in_one_tile_and_four(spark):
    got = []
    for top, left in [(0, 0), (-20, -25)]:
        rows = skeleton.remove_short_spurs(table(spark, {2: KINDS[2]}, top, left), 6).filter("image_id = 2").select("y", "x", "kind").collect()
        got.append(sorted((y - top, x - left, k) for y, x, k in rows))
    assert got[0] == got[1]
    tips = {}
    for (y, x), b in WANT[2].items():
        tips.setdefault(b, set()).update(p for p in around(KINDS[2], y, x) if KINDS[2][p] == 1)
    short = [b for b, t in tips.items() if t and list(WANT[2].values()).count(b) < 6]
    gone = {p for p, b in WANT[2].items() if b in short}
    assert short and gone.isdisjoint((y, x) for y, x, _ in got[0])


def test_short_spurs_are_no_broadcast(spark, plans):
    plans.append(plan(skeleton.remove_short_spurs(table(spark, {2: KINDS[2]}), 4)))
    assert len(plans) > 6 and not any("BroadcastHashJoin" in p for p in plans)


def test_masks_to_graphs_labels_fused_nodes(spark):
    """The pixels of nodes that became a part of a branch were left out, as a spur's junction."""
    spur = np.zeros((14, 64), bool)
    spur[10, 3:61] = spur[6:10, 30] = True
    rows = [(1, int(y), int(x)) for y, x in np.argwhere(spur)]
    branches, nodes, labels = rewrite.masks_to_graphs(spark.createDataFrame(rows, "image_id long, y int, x int"), 7)
    assert branches.count() == 1 and nodes.count() == 2
    assert sorted(tuple(r) for r in labels.select("y", "x").collect()) == [(10, x) for x in range(4, 60)]
    assert {r.branch_id for r in labels.collect()} == {r.branch_id for r in branches.collect()}


def test_fused_nodes_follow_later_lookups(spark):
    keys = ["image_id"]
    lookups = [spark.createDataFrame(rows, "image_id long, old_id long, new_id long") for rows in ([(1, 0, 0)], [(1, 0, 5), (1, 3, None), (1, 7, 7)])]
    first = spark.createDataFrame([(1, 0, 2.9, 3.0), (1, 3, 4.0, 4.0), (1, 7, 8.0, 8.0)], "image_id long, branch_id long, y double, x double")
    last = spark.createDataFrame([(1, 9, 8.5, 8.2), (1, 6, 8.1, 8.9)], "image_id long, branch_id long, y double, x double")
    got = rewrite._last_fused([(1, first), (2, last)], lookups, keys)
    assert sorted(tuple(r) for r in got.select("branch_id", "y", "x").collect()) == [(5, 2, 3), (6, 8, 8)]


def test_fused_nodes_beside_a_spur(spark):
    """The smallest branch at the node may be the spur, which the lookup does not list."""
    nodes = spark.createDataFrame([(1, n, float(n), 1.0) for n in range(3)], "image_id long, node_id long, y double, x double")
    branches = spark.createDataFrame([(1, 0, 1, 9), (1, 1, 0, 1), (1, 2, 1, 2)], "image_id long, branch_id long, node1 long, node2 long")
    lookup = spark.createDataFrame([(1, 1, 1), (1, 2, 1)], "image_id long, old_id long, new_id long")
    got = rewrite.fused_pixels(nodes, branches, nodes.filter("node_id = 1").select("image_id", "node_id"), lookup, ["image_id"])
    assert [tuple(r) for r in got.collect()] == [(1, 1, 1.0, 1.0)]


def test_the_query_of_graphs_gives_branches_nodes_and_pixels(spark):
    rows = catalog.QUERIES["masks_to_graphs"](spark, "/root/testdata/sf0.001").toPandas()
    assert set(rows["part"]) == {"branch", "node", "pixel"}
    pixels, branches = rows[rows["part"] == "pixel"], rows[rows["part"] == "branch"]
    assert not pixels.duplicated(["image_id", "y", "x"]).any()
    own = set(map(tuple, branches[["image_id", "branch_id"]].to_numpy()))
    assert set(map(tuple, pixels[["image_id", "branch_id"]].to_numpy())) <= own


def test_clean_up_broadcasts_no_written_table(spark, plans, monkeypatch):
    """Nodes and branches look small by their files, and the driver held all of them several times."""
    monkeypatch.setattr(rewrite.scratch, "saved", lambda df: plans.append(plan(df)) or saved(df))
    monkeypatch.setattr(rewrite, "connected_components", lambda *a: rewrite.saved(components.connected_components(*a)))
    _, branches, nodes = skeleton.parse_skeleton(table(spark, {2: KINDS[2]}))
    plans.clear()
    rewrite._cleaned(branches.hint("merge"), nodes.hint("merge"), ["image_id"], **rewrite.by_width(5))
    assert sum("SortMergeJoin" in p for p in plans) > 6
    assert not any("BroadcastHashJoin" in p for p in plans if "component" not in p)
