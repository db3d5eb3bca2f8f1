"""Queries of column expressions, filters, windows, sorts and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigree.functions import geometry as g
from filigree.operators import graph, raster
from filigree.sources import images
from filigree.sources.scratch import shared_dir

from .registry import query


def R():
    return g.rect(F.col("h"), F.col("w"), F.col("y"), F.col("x"))


def S():
    """Each rectangle's mirror image."""
    return g.rect(F.col("w"), F.col("h"), F.col("x"), F.col("y"))


def r6(c):
    return F.round(c, 6)


def sides(r, prefix: str = ""):
    return [r[k].alias(prefix + k) for k in ("h", "w", "y", "x")]


@query("rect_props", "SELECT rect_id, y + floor(h / 2) AS cy, x + floor(w / 2) AS cx, y + h AS bottom, x + w AS rightmost, h * w AS area FROM fx_rects")
def _(t):
    return t.fx_rects.select("rect_id", g.center(R())["y"].alias("cy"), g.center(R())["x"].alias("cx"), g.bottom(R()).alias("bottom"), g.right(R()).alias("rightmost"), g.area(R()).alias("area"))


@query("rect_round", """SELECT rect_id, CAST(round_even(h / 2, 0) AS BIGINT) AS h, CAST(round_even(w / 2, 0) AS BIGINT) AS w,
  CAST(round_even(y / 2, 0) AS BIGINT) AS y, CAST(round_even(x / 2, 0) AS BIGINT) AS x FROM fx_rects""")
def _(t):
    return t.fx_rects.select("rect_id", *sides(g.rounded(g.scale(R(), 0.5))))


@query("rect_from", """SELECT rect_id, abs(h - y) AS h, abs(w - x) AS w, least(y, h) AS y, least(x, w) AS x,
  CASE WHEN h < y OR w < x THEN 0 ELSE h - y END AS ph, CASE WHEN h < y OR w < x THEN 0 ELSE w - x END AS pw,
  CASE WHEN h < y OR w < x THEN 0 ELSE y END AS py, CASE WHEN h < y OR w < x THEN 0 ELSE x END AS px,
  y - floor(h / 2) AS cy, x - floor(w / 2) AS cx FROM fx_rects""")
def _(t):
    c = [F.col(k) for k in ("y", "x", "h", "w")]
    around = g.from_center(c[0], c[1], c[2], c[3])
    return t.fx_rects.select("rect_id", *sides(g.from_points(*c)), *sides(g.from_points(*c, ensure_positive=True), "p"), around["y"].alias("cy"), around["x"].alias("cx"))


@query("rect_is_empty", "SELECT rect_id, (h = 1 OR w = 1) AS flag FROM fx_rects")
def _(t):
    return t.fx_rects.select("rect_id", g.is_empty(g.rect(F.col("h") - 1, F.col("w") - 1)).alias("flag"))


@query("rect_union", "SELECT grp, max(y + h) - min(y) AS h, max(x + w) - min(x) AS w, min(y) AS y, min(x) AS x FROM fx_rects GROUP BY grp")
def _(t):
    return t.fx_rects.groupBy("grp").agg(g.union_all(R()).alias("r")).select("grp", *sides(F.col("r")))


@query("rect_union_pair", """SELECT rect_id, greatest(y + h, x + w) - least(y, x) AS h, greatest(x + w, y + h) - least(x, y) AS w,
  least(y, x) AS y, least(x, y) AS x FROM fx_rects""")
def _(t):
    return t.fx_rects.select("rect_id", *sides(g.union(R(), S())))


@query("rect_intersection", """SELECT rect_id, CASE WHEN e THEN 0 ELSE b - a END AS h, CASE WHEN e THEN 0 ELSE b - a END AS w,
  CASE WHEN e THEN 0 ELSE a END AS y, CASE WHEN e THEN 0 ELSE a END AS x FROM (
  SELECT rect_id, greatest(y, x) AS a, least(y + h, x + w) AS b, least(y + h, x + w) < greatest(y, x) AS e FROM fx_rects)""")
def _(t):
    return t.fx_rects.select("rect_id", *sides(g.intersection(R(), S())))


@query("rect_intersection_group", """SELECT grp, CASE WHEN e THEN 0 ELSE b - a END AS h, CASE WHEN e THEN 0 ELSE d - c END AS w,
  CASE WHEN e THEN 0 ELSE a END AS y, CASE WHEN e THEN 0 ELSE c END AS x FROM (
  SELECT grp, a, b, c, d, b < a OR d < c AS e FROM (
  SELECT grp, max(y) AS a, min(y + h) AS b, max(x) AS c, min(x + w) AS d FROM fx_rects GROUP BY grp))""")
def _(t):
    return t.fx_rects.groupBy("grp").agg(g.intersection_all(R()).alias("r")).select("grp", *sides(F.col("r")))


@query("rect_translate", "SELECT rect_id, h, w, y + 3 AS y, x - 2 AS x FROM fx_rects")
def _(t):
    return t.fx_rects.select("rect_id", *sides(g.translate(R(), 3, -2)))


@query("rect_scale", "SELECT rect_id, h * 2 AS h, w * 0.5 AS w, y * 2 AS y, x * 0.5 AS x FROM fx_rects")
def _(t):
    return t.fx_rects.select("rect_id", *sides(g.scale(R(), 2.0, 0.5)))


@query("rect_clip", """SELECT rect_id, CASE WHEN e THEN 0 ELSE b - a END AS h, CASE WHEN e THEN 0 ELSE d - c END AS w,
  CASE WHEN e THEN 0 ELSE a END AS y, CASE WHEN e THEN 0 ELSE c END AS x FROM (
  SELECT rect_id, a, b, c, d, b < a OR d < c AS e FROM (
  SELECT rect_id, greatest(y, 0) AS a, least(y + h, 50) AS b, greatest(x, 0) AS c, least(x + w, 60) AS d FROM fx_rects))""")
def _(t):
    return t.fx_rects.select("rect_id", *sides(g.clip(R(), 50, 60)))


@query("rect_pad", "SELECT rect_id, h + 4 AS h, w + 6 AS w, y - 1 AS y, x - 4 AS x FROM fx_rects")
def _(t):
    return t.fx_rects.select("rect_id", *sides(g.pad(R(), 1, 2, 3, 4)))


@query("bbox_filter", "SELECT rect_id, (10 BETWEEN y AND y + h AND 20 BETWEEN x AND x + w) AS flag FROM fx_rects WHERE y BETWEEN 5 AND 60 AND x BETWEEN 5 AND 60")
def _(t):
    kept = t.fx_rects.filter(raster.inside((5, 5, 60, 60)))
    return kept.select("rect_id", g.contains(R(), g.point(10, 20)).alias("flag"))


@query("point_ops", "SELECT rect_id, (y + h) * 2 AS y, (x + w) * 2 AS x, least(greatest(y, 10), 40) AS ly, least(greatest(x, 20), 70) AS lx FROM fx_rects")
def _(t):
    p = g.point(F.col("y"), F.col("x"))
    moved, clipped = g.times(g.add(p, g.point(F.col("h"), F.col("w"))), 2), g.clip_point(p, g.rect(30, 50, 10, 20))
    return t.fx_rects.select("rect_id", moved["y"].alias("y"), moved["x"].alias("x"), clipped["y"].alias("ly"), clipped["x"].alias("lx"))


@query("point_distance", "SELECT rect_id, round(sqrt((y - h) * (y - h) + (x - w) * (x - w)), 6) AS d FROM fx_rects")
def _(t):
    return t.fx_rects.select("rect_id", r6(g.distance(F.col("y"), F.col("x"), F.col("h"), F.col("w"))).alias("d"))


@query("ceil_multiple", "SELECT rect_id, CAST(ceil(rect_id / 32.0) * 32 AS BIGINT) AS v FROM fx_rects")
def _(t):
    return t.fx_rects.select("rect_id", g.ceil_multiple(F.col("rect_id")).cast("long").alias("v"))


@query("normalize_vector", "SELECT rect_id, round(y / (n + 1e-8), 6) AS y, round(x / (n + 1e-8), 6) AS x, round(n, 6) AS n FROM (SELECT *, sqrt(y * y + x * x) AS n FROM fx_rects)")
def _(t):
    y, x, n = g.normalize(F.col("y"), F.col("x"))
    return t.fx_rects.select("rect_id", r6(y).alias("y"), r6(x).alias("x"), r6(n).alias("n"))


@query("cos_sin_multiples", """SELECT rect_id, k, round(cos(k * radians(y)), 6) AS c, round(sin(k * radians(y)), 6) AS s
  FROM fx_rects, (SELECT unnest([1, 2, 3, 4]) AS k)""")
def _(t):
    a = F.radians("y")
    each = t.fx_rects.select("rect_id", F.posexplode(g.cos_sin_multiples(F.cos(a), F.sin(a), 4)).alias("k", "v"))
    return each.select("rect_id", (F.col("k") + 1).alias("k"), r6("v.c").alias("c"), r6("v.s").alias("s"))


@query("simplify_angle", """SELECT rect_id, CASE WHEN r <= 90 THEN r ELSE r - 180 END AS a FROM (
  SELECT rect_id, (((x * 17 - y * 5) % 180) + 180) % 180 AS r FROM fx_rects)""")
def _(t):
    return t.fx_rects.select("rect_id", g.simplify_angle(F.col("x") * 17 - F.col("y") * 5, 2).alias("a"))


@query("rotate_vectors", """SELECT rect_id, round(y * cos(radians(30)) + x * sin(radians(30)), 6) AS y,
  round(x * cos(radians(30)) - y * sin(radians(30)), 6) AS x FROM fx_rects""")
def _(t):
    y, x = g.rotate_vector(F.col("y"), F.col("x"), 30)
    return t.fx_rects.select("rect_id", r6(y).alias("y"), r6(x).alias("x"))


@query("symlog", """SELECT rect_id, round(CASE WHEN abs(x - 50) <= 5 THEN (x - 50) / 0.9 ELSE sign(x - 50) * 5 * (1 / 0.9 + ln(abs(x - 50) / 5) / 10) END, 6) AS v,
  round(CASE WHEN abs(y / 10) <= 5 / 0.9 THEN y / 10 * 0.9 ELSE 5 * pow(10, y / 50 - 1 / 0.9) END, 6) AS back FROM fx_rects""")
def _(t):
    return t.fx_rects.select("rect_id", r6(g.symlog(F.col("x") - 50, 5)).alias("v"), r6(g.symlog_back(F.col("y") / 10, 5)).alias("back"))


@query("symlog_space", """WITH e AS (SELECT path_id, lo, hi, (hi - lo) / 7 AS t FROM (SELECT path_id, min(y) AS lo, max(y) AS hi FROM fx_vertices GROUP BY path_id) WHERE hi > lo),
  s AS (SELECT path_id, t, unnest(range(7)) AS i, CASE WHEN abs(lo) <= t THEN lo / 0.9 ELSE sign(lo) * t * (1 / 0.9 + ln(greatest(abs(lo), 1e-300) / t) / 10) END AS lo,
    CASE WHEN abs(hi) <= t THEN hi / 0.9 ELSE sign(hi) * t * (1 / 0.9 + ln(greatest(abs(hi), 1e-300) / t) / 10) END AS hi FROM e)
  SELECT path_id, i, round(CASE WHEN abs(v) <= t / 0.9 THEN v * 0.9 ELSE sign(v) * t * pow(10, sign(v) * (v / t) - 1 / 0.9) END, 5) + 0.0 AS v
  FROM (SELECT path_id, t, i, lo + (hi - lo) * i / 6 AS v FROM s)""")
def _(t):
    ends = t.fx_vertices.groupBy("path_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).filter("hi > lo")
    return ends.select("path_id", F.posexplode(g.symlog_space(F.col("lo"), F.col("hi"), 7)).alias("i", "v")).withColumn("v", F.round("v", 5))


@query("unravel_index", "SELECT rect_id, CAST(rect_id // 35 % 11 AS BIGINT) AS i, CAST(rect_id // 7 % 5 AS BIGINT) AS j, CAST(rect_id % 7 AS BIGINT) AS k FROM fx_rects")
def _(t):
    return t.fx_rects.select("rect_id", *[c.cast("long").alias(n) for n, c in zip("ijk", g.unravel_index(F.col("rect_id"), (11, 5, 7)), strict=True)])


@query("clip_value", "SELECT rect_id, least(greatest(y, 20), 80) AS v FROM fx_rects")
def _(t):
    return t.fx_rects.select("rect_id", g.clip_value(F.col("y"), 20, 80).alias("v"))


@query("polar_grid", "SELECT image_id, y, x, round(sqrt((y - 23.5) * (y - 23.5) + (x - 23.5) * (x - 23.5)), 6) AS rho, round(atan2(x - 23.5, y - 23.5), 6) AS phi FROM fx_pixels")
def _(t):
    dy, dx = F.col("y") - 23.5, F.col("x") - 23.5
    return t.fx_pixels.select("image_id", "y", "x", r6(F.hypot(dy, dx)).alias("rho"), r6(F.atan2(dx, dy)).alias("phi"))


@query("border_guard", """SELECT graph_id, side, node_id, (y - 128) * (y - 128) + (x - 128) * (x - 128) < 108 * 108
  AND y > 20 AND y < 236 AND x > 20 AND x < 236 AS flag FROM fx_nodes""")
def _(t):
    return t.fx_nodes.select("graph_id", "side", "node_id", g.border_guard(F.col("y"), F.col("x"), 256, 256, 20).alias("flag"))


# --- windows, sorts and sets


@query("consecutive_distance", """SELECT path_id, seq, round(sqrt(pow(y - lag(y) OVER w, 2) + pow(x - lag(x) OVER w, 2)), 6) AS step
  FROM fx_vertices WINDOW w AS (PARTITION BY path_id ORDER BY seq)""")
def _(t):
    return graph.consecutive_distance(t.fx_vertices).select("path_id", "seq", r6("step").alias("step"))


@query("running_id", """SELECT graph_id, side, branch_id, CAST(sum(CASE WHEN node1 <> node2 THEN 1 ELSE 0 END)
  OVER (PARTITION BY graph_id, side ORDER BY branch_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM fx_branches""")
def _(t):
    keys = ["graph_id", "side"]
    return graph.running_id(t.fx_branches, keys, "branch_id", F.col("node1") != F.col("node2")).select(*keys, "branch_id", "running")


@query("rank_in_group", "SELECT graph_id, side, node_id, CAST(dense_rank() OVER (PARTITION BY graph_id, side ORDER BY node_id) - 1 AS BIGINT) AS new_id FROM fx_nodes")
def _(t):
    return graph.compact_ids(t.fx_nodes, ["graph_id", "side"], "node_id").select("graph_id", "side", "node_id", "new_id")


@query("sort_edges", "SELECT graph_id, side, branch_id, node1, node2 FROM fx_branches ORDER BY graph_id, side, node1, node2, branch_id")
def _(t):
    return t.fx_branches.orderBy("graph_id", "side", "node1", "node2", "branch_id")


@query("largest_group", """SELECT image_id, y, n FROM (SELECT image_id, y, count(*) AS n, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, y) AS k
  FROM fx_pixels GROUP BY image_id, y) WHERE k = 1""")
def _(t):
    rows = t.fx_pixels.groupBy("image_id", "y").agg(F.count("*").alias("n"))
    best = rows.groupBy("image_id").agg(F.max(F.struct("n", (-F.col("y")).alias("m"))).alias("b"))
    return best.select("image_id", (-F.col("b.m")).alias("y"), "b.n")


@query("set_difference", "SELECT DISTINCT image_id, y, x FROM fx_masks WHERE layer = 'pred' EXCEPT SELECT image_id, y, x FROM fx_masks WHERE layer = 'target'")
def _(t):
    a, b = (t.fx_masks.filter(F.col("layer") == k).select("image_id", "y", "x") for k in ("pred", "target"))
    return a.exceptAll(b)


@query("set_intersection", "SELECT image_id, y, x FROM fx_masks WHERE layer = 'pred' INTERSECT SELECT image_id, y, x FROM fx_masks WHERE layer = 'target'")
def _(t):
    a, b = (t.fx_masks.filter(F.col("layer") == k).select("image_id", "y", "x") for k in ("pred", "target"))
    return a.intersect(b)


@query("set_union", "SELECT graph_id, side, node1 AS node_id FROM fx_branches UNION SELECT graph_id, side, node2 FROM fx_branches")
def _(t):
    a, b = (t.fx_branches.select("graph_id", "side", F.col(k).alias("node_id")) for k in ("node1", "node2"))
    return a.union(b).distinct()


# --- images and tables in stores


@query("read_images", "SELECT image_id, y, x, b, g, r FROM fx_image")
def _(t):
    path = shared_dir(t.spark)
    images.write_images(t.fx_image, path)
    return images.read_stored(t.spark, path)


@query("write_tables", "SELECT graph_id, side, branch_id, node1, node2, n1.y AS y1, n2.y AS y2 FROM fx_branches JOIN fx_nodes n1 USING (graph_id, side) JOIN fx_nodes n2 USING (graph_id, side) WHERE n1.node_id = node1 AND n2.node_id = node2")
def _(t):
    path = shared_dir(t.spark)
    raster.write_tables({"branches": t.fx_branches, "nodes": t.fx_nodes}, path, "graph_id")
    branches, nodes = (t.spark.read.parquet(f"{path}/{name}").drop("bucket") for name in ("branches", "nodes"))
    for k in "12":
        own = nodes.select("graph_id", "side", F.col("node_id").alias(f"node{k}"), F.col("y").alias(f"y{k}"))
        branches = branches.join(own, ["graph_id", "side", f"node{k}"])
    return branches.select("graph_id", "side", "branch_id", "node1", "node2", "y1", "y2")


# --- rasters as tables


@query("binarize_image", "SELECT image_id, y, x FROM fx_image WHERE (b + g + r) / 3.0 / 255 > 0.5")
def _(t):
    return raster.binarize_image(t.fx_image)


@query("scale_image", "SELECT image_id, y, x, k AS channel, round((CASE k WHEN 0 THEN b WHEN 1 THEN g ELSE r END) / 255.0, 6) AS v FROM fx_image, (SELECT unnest([0, 1, 2]) AS k)")
def _(t):
    return raster.scale_image(t.fx_image).withColumn("v", r6("v"))


@query("raster_to_pixels", "SELECT image_id, y, x FROM fx_image WHERE r <> 0")
def _(t):
    return raster.raster_to_pixels(t.fx_image, "r")


@query("pixels_to_raster", """SELECT i.image_id, CAST(r.y AS INT) AS y, CAST(c.x AS INT) AS x, CASE WHEN p.image_id IS NULL THEN 0 ELSE 1 END AS v
  FROM (SELECT DISTINCT image_id FROM fx_pixels) i CROSS JOIN (SELECT unnest(range(48)) AS y) r CROSS JOIN (SELECT unnest(range(48)) AS x) c
  LEFT JOIN fx_pixels p ON p.image_id = i.image_id AND p.y = r.y AND p.x = c.x""")
def _(t):
    return raster.pixels_to_raster(t.fx_pixels, t.fx_pixels, 48, 48)


@query("crop_pad", "SELECT image_id, y - 14 AS y, x - 9 AS x FROM fx_pixels WHERE y BETWEEN 14 AND 33 AND x BETWEEN 9 AND 38")
def _(t):
    return raster.crop(t.fx_pixels, (48, 48), (20, 30))


@query("clip_pad_center", "SELECT image_id, y + 6 AS y, x - 14 AS x FROM fx_pixels WHERE x BETWEEN 14 AND 33")
def _(t):
    return raster.crop(t.fx_pixels, (48, 48), (60, 20))


@query("clip_pair", "SELECT 0 AS k, image_id, y - 9 AS y, x AS x FROM fx_pixels WHERE y BETWEEN 9 AND 38 UNION ALL SELECT 1, image_id, y, x - 6 FROM fx_pixels WHERE y < 30 AND x BETWEEN 6 AND 53")
def _(t):
    a, b = raster.clip_pair(t.fx_pixels, t.fx_pixels.filter("y < 30"), (48, 48), (30, 60))
    return a.select(F.lit(0).alias("k"), "image_id", "y", "x").unionByName(b.select(F.lit(1).alias("k"), "image_id", "y", "x"))


@query("pad_pair", "SELECT 0 AS k, image_id, y AS y, x + 6 AS x FROM fx_pixels UNION ALL SELECT 1, image_id, y + 9, x FROM fx_pixels WHERE y < 30")
def _(t):
    a, b = raster.pad_pair(t.fx_pixels, t.fx_pixels.filter("y < 30"), (48, 48), (30, 60))
    return a.select(F.lit(0).alias("k"), "image_id", "y", "x").unionByName(b.select(F.lit(1).alias("k"), "image_id", "y", "x"))


@query("cat_crop", "SELECT image_id, y - 9 AS y, x, 0 AS channel FROM fx_pixels WHERE y BETWEEN 9 AND 38 UNION ALL SELECT image_id, y, x, 1 FROM fx_pixels WHERE y < 30")
def _(t):
    p = t.fx_pixels.withColumn("channel", F.lit(0))
    return raster.cat_crop(p, p.filter("y < 30"), (48, 48), (30, 48))


@query("select_by_mask", "SELECT i.image_id, i.y, i.x, i.r FROM fx_image i WHERE EXISTS (SELECT 1 FROM fx_pixels p WHERE p.image_id = i.image_id AND p.y = i.y AND p.x = i.x)")
def _(t):
    return raster.select_by_mask(t.fx_image, t.fx_pixels).select("image_id", "y", "x", "r")


@query("apply_roi", "SELECT p.image_id, p.y, p.x FROM fx_pixels p JOIN fx_image i ON p.image_id = i.image_id AND p.y = i.y AND p.x = i.x WHERE i.r >= 60")
def _(t):
    return raster.select_by_mask(t.fx_pixels, t.fx_image.filter("r >= 60"))


@query("threshold_class", "SELECT image_id, y, x FROM fx_image WHERE r / 255.0 > 0.5")
def _(t):
    return raster.threshold_class(t.fx_image.withColumn("p", F.col("r") / 255.0), "p").select("image_id", "y", "x")


@query("mask_pair", """WITH m AS MATERIALIZED (SELECT image_id, layer, y, x FROM fx_masks)
  SELECT * FROM (SELECT * FROM m WHERE layer <> 'target') SEMI JOIN (SELECT * FROM m WHERE layer = 'target') r USING (image_id, y, x)""")
def _(t):
    return raster.mask_pair(t.fx_masks, "target").select("image_id", "layer", "y", "x")


@query("index_to_mask", """SELECT n.graph_id, n.side, n.node_id, EXISTS (SELECT 1 FROM fx_branches b WHERE b.graph_id = n.graph_id AND b.side = n.side
  AND b.node1 = b.node2 AND b.node1 = n.node_id) AS flag FROM fx_nodes n""")
def _(t):
    loops = t.fx_branches.filter("node1 = node2").withColumnRenamed("node1", "node_id")
    return raster.index_to_mask(t.fx_nodes, loops, ["graph_id", "side", "node_id"]).select("graph_id", "side", "node_id", "flag")


@query("validate_layers", """WITH line AS MATERIALIZED (SELECT DISTINCT image_id * 48 + y AS image_id, layer FROM fx_masks)
  SELECT i.image_id, l.layer FROM (SELECT DISTINCT image_id FROM line) i CROSS JOIN (SELECT unnest(['pred', 'target', 'skel_pred', 'skel_target']) AS layer) l
  ANTI JOIN line m ON m.image_id = i.image_id AND m.layer = l.layer""")
def _(t):
    # Each line of an image counts as an image, as whole images lack no layer.
    lines = t.fx_masks.withColumn("image_id", F.col("image_id") * 48 + F.col("y"))
    return raster.validate_layers(lines, ("pred", "target", "skel_pred", "skel_target"))
