"""Hand-made cases: shapes whose kinds, graphs and scores are known."""

import itertools
import random
import struct
import zlib

import numpy as np
import pytest

from filigree.operators import components, graph, match, metrics, paths, raster, rewrite, skeleton, tiles

KEYS = ["graph_id"]


def pixels(spark, *shapes: str):
    rows = [(k, y, x) for k, s in enumerate(shapes) for y, line in enumerate(s.split()) for x, c in enumerate(line) if c == "1"]
    return spark.createDataFrame(rows, "image_id long, y int, x int")


def kinds(df, image=0):
    return {(r.y, r.x): r.kind for r in df.collect() if r.image_id == image}


def edges(spark, rows):
    return spark.createDataFrame([(0, k, min(a, b), max(a, b)) for k, (a, b) in enumerate(rows)], "graph_id long, branch_id long, node1 long, node2 long")


def spots(spark, rows):
    return spark.createDataFrame([(0, k, float(y), float(x)) for k, (y, x) in enumerate(rows)], "graph_id long, node_id long, y double, x double")


def ends(df):
    return sorted((r.node1, r.node2) for r in df.collect())


def test_kinds_of_small_shapes(spark):
    shapes = ["00000 00100 01110 00100 00000", "00000 01010 00100 01010 00000", "0000 0110 0110 0000", "00000 01010 00100 00100 00000", "000 010 000"]
    out = skeleton.classify_pixels(pixels(spark, *shapes))
    plus, cross, square, y3, solo = (kinds(out, k) for k in range(5))
    assert plus[2, 2] == 4 and sum(v == 1 for v in plus.values()) == 4
    # The corner of a block is a junction of four that also looks like an end, which takes one off.
    assert cross[2, 2] == 4 and square[1, 1] == 3 and y3[2, 2] == 3 and solo[1, 1] == 1


def test_hollow_cross_is_filled(spark):
    out = skeleton.fix_hollow_cross(pixels(spark, "00100 00100 11011 00100 00100"))
    assert (2, 2) in {(r.y, r.x) for r in out.collect()}


def test_thin_keeps_shape_and_small_parts_go(spark):
    thick = pixels(spark, " ".join(["0" * 20] + ["0" + "1" * 18 + "0"] * 3 + ["0" * 20]))
    thinned = skeleton.thin(thick)
    assert {r.y for r in thinned.collect()} == {2}
    assert skeleton.thin(thinned).count() == thinned.count()
    assert skeleton.remove_small_components(pixels(spark, "1100 0000 0001 0011")).count() == 3


def test_largest_component_takes_the_first_of_equals(spark):
    out = skeleton.largest_component(pixels(spark, "11001 00001"), 1)
    assert {(r.y, r.x) for r in out.collect()} == {(0, 0), (0, 1)}


def test_parse_skeleton_finds_branches_between_nodes(spark):
    line = "0000000 0111110 0000000"
    kinds_ = skeleton.classify_pixels(pixels(spark, line))
    px, branches, nodes = skeleton.parse_skeleton(kinds_)
    assert ends(branches) == [(0, 1)] and nodes.count() == 2 and px.count() == 3


def test_close_slots_follow_the_ring():
    assert skeleton.close_slots(0) == 0b10000011 and skeleton.close_slots(1) == 0b10001111


def test_components_join_out_of_order_links(spark):
    rows = [(0, a, b) for a, b in [(4, 5), (0, 1), (2, 3), (3, 4), (1, 2), (9, 9)]]
    df = spark.createDataFrame(rows, "graph_id long, a long, b long")
    out = {r.id: r.component for r in components.connected_components(df, "a", "b", KEYS).collect()}
    assert out == {**dict.fromkeys(range(6), 0), 9: 9}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_union_find(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(200 + k, 201 + k) for k in range(40)]
    root = list(range(300))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in rows:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    out = components.connected_components(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()
    assert {r.id: r.component for r in out} == {x: find(x) for x in {v for e in rows for v in e}}


def test_empty_tables_give_empty_results(spark):
    none = spark.createDataFrame([], "graph_id long, branch_id long, node1 long, node2 long")
    nodes = spark.createDataFrame([], "graph_id long, node_id long, y double, x double")
    assert components.connected_components(none, "node1", "node2", KEYS).count() == 0
    assert rewrite.clean_graph(none, nodes, KEYS, spurs=3, node=2, cycles=3)[0].count() == 0
    assert paths.edit_distance(none, nodes, none, nodes, KEYS, 5).count() == 0


def test_fusing_a_path_and_a_ring(spark):
    nodes = spots(spark, [(0, 0), (0, 1), (0, 2)])
    one = spark.createDataFrame([(0, 1)], "graph_id long, node_id long")
    branches, left, _ = rewrite.fuse_nodes(edges(spark, [(0, 1), (1, 2)]), nodes, one, KEYS)
    assert ends(branches) == [(0, 2)] and left.count() == 2
    every = nodes.select("graph_id", "node_id")
    branches, left, _ = rewrite.fuse_nodes(edges(spark, [(0, 1), (1, 2), (0, 2)]), nodes, every, KEYS)
    assert branches.count() == 0 and left.count() == 0


def test_a_node_with_three_branches_is_not_fused(spark):
    nodes = spots(spark, [(0, 0), (0, 1), (0, 2), (1, 1)])
    hub = spark.createDataFrame([(0, 1)], "graph_id long, node_id long")
    branches, left, _ = rewrite.fuse_nodes(edges(spark, [(0, 1), (1, 2), (1, 3)]), nodes, hub, KEYS)
    assert branches.count() == 3 and left.count() == 4


def test_parallel_branches_and_a_small_triangle(spark):
    assert rewrite.merge_parallel_branches(edges(spark, [(0, 1), (0, 1)]), KEYS)[0].count() == 1
    nodes = spots(spark, [(0, 0), (0, 3), (3, 0), (50, 50)])
    branches, left, _ = rewrite.collapse_small_cycles(edges(spark, [(0, 1), (1, 2), (0, 2), (2, 3)]), nodes, KEYS, 10)
    assert ends(branches) == [(0, 3)]
    at = {r.node_id: (r.y, r.x) for r in left.collect()}
    assert at[0] == pytest.approx((1, 1)) and at[3] == (50, 50)


def test_near_nodes_merge_as_one_chain(spark):
    nodes = spots(spark, [(0, k) for k in (0, 3, 1, 4, 2, 5)])
    branches, left, _ = rewrite.merge_near_nodes(edges(spark, [(0, 5)]), nodes, KEYS, node=1)
    assert branches.count() == 0 and left.count() == 1


def test_bridging_two_ends(spark):
    nodes = spots(spark, [(0, 0), (0, 2), (0, 5), (0, 8)])
    pairs = spark.createDataFrame([(0, 1, 2)], "graph_id long, a long, b long")
    px = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 6)], "graph_id long, branch_id long, y int, x int")
    branches, left, drawn = rewrite.bridge_nodes(edges(spark, [(0, 1), (2, 3)]), nodes, px, pairs, KEYS)
    assert ends(branches) == [(0, 3)] and left.count() == 2
    assert {(r.branch_id, r.x) for r in drawn.collect()} == {(0, x) for x in (1, 2, 3, 4, 5, 6)}


def test_path_lengths(spark):
    v = spark.createDataFrame([(0, k, float(y), float(x)) for k, (y, x) in enumerate([(0, 0), (0, 3), (4, 3)])], "path_id long, seq long, y double, x double")
    assert graph.path_length(v, close_loop=False).first().length == 7
    assert graph.path_length(v).first().length == 12


def brute(gain):
    n, m = gain.shape
    best = 0.0
    for k in range(min(n, m) + 1):
        for rows in itertools.combinations(range(n), k):
            for cols in itertools.permutations(range(m), k):
                best = max(best, sum(gain[i, j] for i, j in zip(rows, cols, strict=True)))
    return best


@pytest.mark.parametrize("seed", range(6))
def test_assignment_is_optimal(seed):
    rng = np.random.default_rng(seed)
    gain = rng.normal(0.2, 1, (rng.integers(1, 6), rng.integers(1, 6))).round(2)
    chosen = match.assign(gain)
    assert len({i for i, _ in chosen}) == len({j for _, j in chosen}) == len(chosen)
    assert sum(gain[i, j] for i, j in chosen) == pytest.approx(brute(gain))


def test_edit_distance_of_split_and_extra_branches(spark):
    target, nt = edges(spark, [(0, 1)]), spots(spark, [(0, 0), (0, 100)])
    pred, np_ = edges(spark, [(0, 2), (1, 2)]), spots(spark, [(0, 0), (0, 100), (0, 50)])
    row = paths.edit_distance(pred, np_, target, nt, KEYS, 5).first()
    assert (row.diff_pred, row.diff_target) == (0, 0)
    matches = match.match_nodes(np_, nt, KEYS, 5)
    adjacency = paths.adjacency_of(pred, target, matches, KEYS)
    assert [r.label for r in paths.label_edge_diff(pred, adjacency, KEYS).collect()] == [2, 2]
    assert [r.label for r in paths.label_edge_diff(target, adjacency, KEYS, "target").collect()] == [3]
    extra = edges(spark, [(0, 1), (1, 2)])
    row = paths.edit_distance(extra, np_, target, nt, KEYS, 5).first()
    assert (row.diff_pred, row.diff_target) == (1, 0)
    score = metrics.topo_report(paths.edit_distance(extra, np_, target, nt, KEYS, 5), KEYS).first()
    assert score.precision == pytest.approx(0.5, abs=1e-4) and score.recall == pytest.approx(1, abs=1e-4)


def test_greedy_never_beats_the_optimum(spark):
    pred, target = spots(spark, [(0, 0), (0, 4), (3, 3)]), spots(spark, [(0, 3), (1, 7), (3, 0)])
    gains = match.match_weights(pred, target, KEYS, 10)
    worth = {(r.pred_node, r.target_node): r.gain for r in gains.collect()}
    total = lambda df: sum(worth[r.pred_node, r.target_node] for r in df.collect())
    assert total(match.greedy_match(gains, KEYS)) <= total(match.match_nodes(pred, target, KEYS, 10)) + 1e-9


def test_pyramid_drops_odd_rows(spark):
    dense = spark.createDataFrame([(0, y, x, float(y * 5 + x)) for y in range(5) for x in range(5)], "image_id long, y int, x int, v double")
    assert raster.avg_pyramid(dense, 1, 5, 5).filter("level = 1").count() == 4


def test_symlog_space_and_radial_kernel(spark):
    from pyspark.sql import functions as F

    from filigree.functions import geometry
    from filigree.operators import kernels

    values = spark.range(1).select(geometry.symlog_space(-10, 10, 5).alias("v")).first().v
    assert len(values) == 5 and values[2] == pytest.approx(0) and values == sorted(values)
    rows = kernels.radial_kernel(spark, 5, 1, 1.5, oversampling=2, normalize="square")
    assert rows.agg(F.sum(F.col("re") ** 2 + F.col("im") ** 2)).first()[0] == pytest.approx(1, abs=1e-6)


def test_clean_graph_keeps_the_lineage_of_branches(spark):
    # A line 0-1-2-3 with a spur at 1, a far loop of two parallel branches between 4 and 5, and an end at 6.
    nodes = spots(spark, [(0, 0), (0, 30), (0, 60), (0, 90), (90, 0), (90, 40), (90, 90), (3, 30)])
    branches = edges(spark, [(0, 1), (1, 2), (2, 3), (1, 7), (4, 5), (4, 5), (5, 6)])
    kept, _, lookup = rewrite.clean_graph(branches, nodes, KEYS, spurs=5, simplify="both")
    got = {r.old_id: r.new_id for r in lookup.collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: None, 4: 4, 5: 4, 6: 4}
    assert {r.branch_id for r in kept.collect()} == {0, 4}


def test_masks_to_graphs_labels_the_pixels_of_its_branches(spark):
    line = "".join("1" if 3 <= x <= 37 else "0" for x in range(41))
    mask = pixels(spark, " ".join([*["0" * 41] * 3, *[line] * 3, *["0" * 41] * 3]))
    branches, nodes, labels = rewrite.masks_to_graphs(mask, 5)
    assert branches.count() == 1 and nodes.count() == 2
    assert {r.branch_id for r in labels.collect()} == {r.branch_id for r in branches.collect()}


def test_tangents_of_a_branch_without_length_are_null(spark):
    nodes = spots(spark, [(5, 5), (5, 5)])
    cells = spark.createDataFrame([(0, 0, 5, 5)], "graph_id long, branch_id long, y long, x long")
    rows = graph.terminal_tangents(edges(spark, [(0, 1)]), nodes, cells, KEYS).collect()
    assert [(r.ty, r.tx) for r in rows] == [(None, None)] * 2


def test_images_are_read(spark, tmp_path):
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    color = np.arange(60, dtype=np.uint8).reshape(5, 4, 3)
    for name, kind, a in (("grey", b"P5", grey), ("color", b"P6", color)):
        raw = b"".join(b"\0" + a[y].tobytes() for y in range(len(a)))
        head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0 if kind == b"P5" else 2, 0, 0, 0)
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
        (tmp_path / f"{name}.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))
    (tmp_path / "none.png").write_bytes(b"no image")
    got = {(r.origin.rsplit("/", 1)[1], r.y, r.x): (r.b, r.g, r.r) for r in raster.read_images(spark, f"file://{tmp_path}", lines=2).collect()}
    want = {("grey.png", y, x): (int(grey[y, x]),) * 3 for y in range(3) for x in range(4)}
    want |= {("color.png", y, x): tuple(int(v) for v in color[y, x][::-1]) for y in range(5) for x in range(4)}
    assert got == want


def test_images_are_written(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, 2)], "image_id long, y int, x int")
    raster.write_tables({"pixels": df}, f"file://{tmp_path}/out")
    assert spark.read.parquet(f"file://{tmp_path}/out/pixels").count() == 1


def test_streams_agree_with_batches(spark):
    from filigree.sources.scratch import saved
    from filigree.streaming.metrics import stream_macro, stream_micro

    counts = saved(spark.createDataFrame([(k, 3 + k, 6 + k, 2, 5) for k in range(6)], "image_id long, correct_pred long, total_pred long, correct_target long, total_target long").repartition(3))
    stream = lambda: spark.readStream.schema(counts.schema).option("maxFilesPerTrigger", 1).parquet(counts._scratch)
    assert tuple(stream_micro(stream()).first()) == pytest.approx(tuple(metrics.micro(counts).first()))
    assert tuple(stream_macro(stream()).first()) == pytest.approx(tuple(metrics.macro(counts).first()))


def test_empty_streams_give_what_empty_batches_give(spark, tmp_path):
    from filigree.streaming.metrics import stream_f1_topo, stream_macro, stream_micro

    schema = "image_id long, correct_pred long, total_pred long, correct_target long, total_target long"
    stream = lambda: spark.readStream.schema(schema).parquet(f"file://{tmp_path}")
    assert stream_micro(stream()).count() == stream_macro(stream()).count() == 0
    assert stream_f1_topo(stream(), lambda b: b).first().score is None


def test_distances_are_exact_at_any_depth(spark):
    rng = random.Random(9)
    grids = {0: {(y, x) for y in range(14) for x in range(17) if (y, x) != (2, 3)}, 1: {(y, x) for y in range(14) for x in range(17)}}
    grids[2] = {c for c in grids[1] if rng.random() < 0.95}
    df = spark.createDataFrame([(k, y, x) for k, g in grids.items() for y, x in g], "image_id long, y long, x long")
    got = {(r.image_id, r.y, r.x): r.distance for r in raster.distance_transform(df, None, 14, 17).collect()}
    assert len(got) == df.count()
    for (k, y, x), d in got.items():
        free = [(y - v) ** 2 + (x - u) ** 2 for v, u in grids[1] - grids[k]]
        assert d == (pytest.approx(min(free) ** 0.5) if free else None)


def test_blocks_hold_each_cell_once(spark):
    """Negative, distant, repeated and null coordinates; a whole block, whose number is negative."""
    cells = [(0, y, x) for y in range(-8, 8) for x in range(-8, 8)] + [(0, 3, 3), (1, 3, 3), (1, 2**31 - 1, -(2**31)), (1, None, 5), (1, None, 5), (1, 5, None), (1, None, None), (None, 7, 7)]
    for kind in ("int", "long"):
        pixels = spark.createDataFrame(cells, f"branch_id long, y {kind}, x {kind}")
        blocks = tiles.in_blocks(pixels, ["branch_id"])
        got = tiles.cells_of(tiles.joined_blocks(blocks.unionByName(blocks), ["branch_id"]), ["branch_id"])
        assert dict(got.dtypes) == dict(pixels.dtypes)
        assert blocks.count() == 4 + 6 and sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, set(cells)))


def test_lines_are_drawn_by_all_tasks(spark):
    segments = spark.createDataFrame([(k, 0.0, 0.0, 0.0, 50.0) for k in range(40)], "branch_id long, y1 double, x1 double, y2 double, x2 double").coalesce(1)
    drawn = rewrite.draw_segments(segments, ["branch_id"])
    assert drawn.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and drawn.count() == 40 * 51


def test_bridges_send_no_row_for_each_pixel(spark):
    """Two ends become one branch; pixels keep their cells, are returned once, and meet as blocks."""
    branches = spark.createDataFrame([(0, 0, 0, 1), (0, 1, 2, 3), (0, 2, 4, 5)], "g long, branch_id long, node1 long, node2 long")
    nodes = spark.createDataFrame([(0, 0, 0.0, 0.0), (0, 1, 0.0, 99.0), (0, 2, 0.0, 105.0), (0, 3, 0.0, 200.0), (0, 4, 9.0, 0.0), (0, 5, 9.0, 9.0)], "g long, node_id long, y double, x double")
    pixels = [(0, 0, 0, x) for x in range(100)] * 2 + [(0, 1, 0, x) for x in range(105, 201)] + [(0, 2, 9, x) for x in range(10)] + [(0, 9, 1, 1)]
    given = spark.createDataFrame(pixels, "g long, branch_id long, y int, x int")
    pairs = spark.createDataFrame([(0, 1, 2)], "g long, a long, b long")
    whole, _, out = rewrite.bridge_nodes(branches, nodes, given, pairs, ["g"])
    assert {tuple(r) for r in whole.collect()} == {(0, 0, 0, 3), (0, 2, 4, 5)}
    want = {(0, 0, 0, x) for x in range(201)} | {(0, 2, 9, x) for x in range(10)} | {(0, 9, 1, 1)}
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and set(got) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "bit_or" in plan
