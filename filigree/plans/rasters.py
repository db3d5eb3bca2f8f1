"""Queries of neighbourhoods, components and skeletons."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigree.operators import raster, skeleton
from filigree.sources.scratch import saved

from .registry import query

CELL = ["image_id", "y", "x"]
OFFS = "offs AS (SELECT k, k // 3 - 1 AS dy, k % 3 - 1 AS dx FROM (SELECT unnest(range(9)) AS k))"
CODES = OFFS + """, codes AS (SELECT p.image_id, p.y - o.dy AS y, p.x - o.dx AS x, CAST(sum(1 << o.k) AS BIGINT) AS code
  FROM fx_pixels p CROSS JOIN offs o GROUP BY ALL)"""


def _values(family: str) -> str:
    rows = ", ".join(f"({p}, {n})" for p, n in skeleton.pattern_masks()[family])
    return f"(VALUES {rows}) AS {family}(pos, neg)"


def _hit(family: str, code: str = "c.code") -> str:
    return f"EXISTS (SELECT 1 FROM {_values(family)} WHERE {code} & pos = pos AND {code} & neg = 0)"


@query("extract_patches", f"""WITH {CODES} SELECT p.image_id, p.y, p.x,
  array_to_string([(code >> k) & 1 for k in range(9)], '') AS patch FROM fx_pixels p JOIN codes USING (image_id, y, x)""")
def _(t):
    out = raster.extract_patches(t.fx_pixels, t.fx_pixels)
    return out.withColumn("patch", F.array_join(F.transform("patch", lambda v: v.cast("string")), ""))


@query("extract_ring", f"""WITH {CODES} SELECT p.image_id, p.y, p.x,
  array_to_string([(code >> k) & 1 for k in [1, 3, 5, 7]], '') AS ring FROM fx_pixels p JOIN codes USING (image_id, y, x)""")
def _(t):
    out = raster.extract_ring(t.fx_pixels, t.fx_pixels, [[0, 1, 0], [1, 0, 1], [0, 1, 0]])
    return out.withColumn("ring", F.array_join(F.transform("ring", lambda v: v.cast("string")), ""))


@query("neighbour_code", f"""WITH {CODES} SELECT image_id, y, x, CAST(((code >> 0) & 1) + ((code >> 1) & 1) * 2 + ((code >> 2) & 1) * 4
  + ((code >> 5) & 1) * 8 + ((code >> 8) & 1) * 16 + ((code >> 7) & 1) * 32 + ((code >> 6) & 1) * 64 + ((code >> 3) & 1) * 128 AS BIGINT) AS code
  FROM codes WHERE code & 16 <> 0""")
def _(t):
    return raster.neighbour_code(t.fx_pixels).withColumn("code", F.col("code").cast("long"))


@query("hit_or_miss", f"WITH {CODES} SELECT image_id, y, x FROM codes c WHERE code & 16 <> 0 AND {_hit('junction3')}")
def _(t):
    p = skeleton.junction_patterns(t.spark).filter("family = 'junction3'")
    return raster.hit_or_miss(raster.window_code(t.fx_pixels), p).select(*CELL)


@query("hit_or_miss_rows", f"""WITH {CODES} SELECT image_id, y, x, (SELECT count(*) FROM {_values('endpoint')} WHERE c.code & pos = pos AND c.code & neg = 0) AS n
  FROM codes c WHERE code & 16 <> 0""")
def _(t):
    p = skeleton.junction_patterns(t.spark).filter("family = 'endpoint'")
    return raster.hit_or_miss(raster.window_code(t.fx_pixels), p, "sum").select(*CELL, "n")


@query("dilate", f"WITH {CODES} SELECT image_id, y, x FROM codes")
def _(t):
    return raster.dilate(t.fx_pixels)


@query("erode", f"WITH {OFFS} SELECT v.image_id, v.y - o.dy AS y, v.x - o.dx AS x FROM fx_vessels v CROSS JOIN offs o GROUP BY ALL HAVING count(*) = 9")
def _(t):
    return raster.erode(t.fx_vessels)


@query("convolve", f"""WITH {OFFS} SELECT i.image_id, i.y + o.dy AS y, i.x + o.dx AS x, CAST(sum(i.r * (o.k + 1)) AS DOUBLE) AS v
  FROM fx_image i CROSS JOIN offs o GROUP BY ALL""")
def _(t):
    kernel = t.spark.range(9).select((F.floor(F.col("id") / 3) - 1).alias("dy"), (F.col("id") % 3 - 1).alias("dx"), (F.col("id") + 1).cast("double").alias("w"))
    return raster.convolve(t.fx_image, kernel, "r")


@query("median_blur", """SELECT i.image_id, i.y, i.x, quantile_cont(n.r, 0.5) AS v FROM fx_image i
  CROSS JOIN (SELECT k // 3 - 1 AS dy, k % 3 - 1 AS dx FROM (SELECT unnest(range(9)) AS k)) o
  JOIN fx_image n ON n.image_id = i.image_id AND n.y = least(greatest(i.y + o.dy, 0), 47) AND n.x = least(greatest(i.x + o.dx, 0), 47) GROUP BY ALL""")
def _(t):
    return raster.median_blur(t.fx_image, "r", 3, 48, 48)


@query("avg_pyramid", """WITH a AS (SELECT image_id, y, x, CAST(r AS DOUBLE) AS v FROM fx_image),
  b AS (SELECT image_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM a GROUP BY ALL), c AS (SELECT image_id, y // 2 AS y, x // 2 AS x, avg(v) AS v FROM b GROUP BY ALL)
  SELECT 0 AS level, image_id, y, x, v FROM a UNION ALL SELECT 1, image_id, y, x, v FROM b UNION ALL SELECT 2, image_id, y, x, v FROM c""")
def _(t):
    return raster.avg_pyramid(t.fx_image, 2, 48, 48, "r")


@query("distance_transform", """WITH o AS (SELECT a - 3 AS dy, b - 3 AS dx FROM (SELECT unnest(range(7)) AS a), (SELECT unnest(range(7)) AS b) WHERE (a - 3) * (a - 3) + (b - 3) * (b - 3) <= 9)
  SELECT v.image_id, v.y, v.x, round(sqrt(min(CASE WHEN q.image_id IS NULL AND v.y + dy BETWEEN 0 AND 47 AND v.x + dx BETWEEN 0 AND 47 THEN dy * dy + dx * dx END)), 6) AS distance
  FROM fx_vessels v CROSS JOIN o LEFT JOIN fx_vessels q ON q.image_id = v.image_id AND q.y = v.y + dy AND q.x = v.x + dx GROUP BY ALL""")
def _(t):
    return raster.distance_transform(t.fx_vessels, None, 48, 48).withColumn("distance", F.round("distance", 6))


# --- components


def _closure(side: str) -> str:
    return f"""WITH RECURSIVE reach AS (SELECT image_id, y, x, y * 100 + x AS root FROM fx_pixels
  UNION SELECT p.image_id, p.y, p.x, r.root FROM reach r JOIN fx_pixels p ON p.image_id = r.image_id AND {side})"""


EIGHT = "p.y BETWEEN r.y - 1 AND r.y + 1 AND p.x BETWEEN r.x - 1 AND r.x + 1"
FOUR = "abs(p.y - r.y) + abs(p.x - r.x) <= 1"


@query("components_pixels", _closure(EIGHT) + " SELECT image_id, y, x, CAST(min(root) AS BIGINT) AS component FROM reach GROUP BY ALL")
def _(t):
    out = skeleton.components_pixels(t.fx_pixels)
    first = F.shiftright("component", 31) * 100 + F.col("component").bitwiseAND(F.lit((1 << 31) - 1))
    return out.withColumn("component", first)


@query("remove_small_components", _closure(EIGHT) + """, c AS (SELECT image_id, y, x, min(root) AS c FROM reach GROUP BY ALL)
  SELECT image_id, y, x FROM (SELECT *, count(*) OVER (PARTITION BY image_id, c) AS n FROM c) WHERE n >= 3""")
def _(t):
    return skeleton.remove_small_components(t.fx_pixels, 3)


@query("largest_component", _closure(FOUR) + """, c AS (SELECT image_id, y, x, min(root) AS c FROM reach GROUP BY ALL),
  s AS (SELECT image_id, c, row_number() OVER (PARTITION BY image_id ORDER BY count(*) DESC, c) AS k FROM c GROUP BY image_id, c)
  SELECT c.image_id, c.y, c.x FROM c JOIN s USING (image_id, c) WHERE k = 1""")
def _(t):
    return skeleton.largest_component(t.fx_pixels, 1)


@query("component_sizes", _closure(EIGHT) + """, c AS (SELECT image_id, y, x, min(root) AS c FROM reach GROUP BY ALL)
  SELECT image_id, CAST(c AS BIGINT) AS component, count(*) AS n FROM c GROUP BY ALL""")
def _(t):
    from filigree.operators.metrics import component_sizes

    first = F.shiftright("component", 31) * 100 + F.col("component").bitwiseAND(F.lit((1 << 31) - 1))
    return component_sizes(skeleton.components_pixels(t.fx_pixels), ["image_id"]).withColumn("component", first)


@query("roi_mask", """SELECT i.image_id, i.y, i.x FROM fx_image i CROSS JOIN (SELECT k // 5 - 2 AS dy, k % 5 - 2 AS dx FROM (SELECT unnest(range(25)) AS k)) o
  JOIN fx_image n ON n.image_id = i.image_id AND n.y = least(greatest(i.y + o.dy, 0), 47) AND n.x = least(greatest(i.x + o.dx, 0), 47)
  WHERE i.y >= 4 GROUP BY i.image_id, i.y, i.x HAVING quantile_cont(n.r, 0.5) > 5""")
def _(t):
    return skeleton.roi_mask(t.fx_image, 48, 48)


# --- skeletons


@query("junction_patterns", f"""WITH {CODES} SELECT image_id, y, x, {_hit('junction3')} AS j3, {_hit('junction4')} AS j4, {_hit('endpoint')} AS e, {_hit('hollow')} AS h FROM codes c""")
def _(t):
    flags = skeleton._flags(raster.window_code(t.fx_pixels, background=True), "junction3", "junction4", "endpoint", "hollow")
    return flags.select(*CELL, F.col("junction3").alias("j3"), F.col("junction4").alias("j4"), F.col("endpoint").alias("e"), F.col("hollow").alias("h"))


@query("classify_pixels", f"""WITH {CODES} SELECT image_id, y, x, CAST(CASE WHEN {_hit('junction4')} THEN 4 WHEN {_hit('junction3')} THEN 3 ELSE 2 END
  - CASE WHEN {_hit('endpoint')} THEN 1 ELSE 0 END AS INT) AS kind FROM codes c WHERE code & 16 <> 0""")
def _(t):
    return skeleton.classify_pixels(t.fx_pixels, fix_hollow=False)


def _codes(table: str) -> str:
    return f"(SELECT p.image_id, p.y - o.dy AS y, p.x - o.dx AS x, CAST(sum(1 << o.k) AS BIGINT) AS code FROM {table} p CROSS JOIN offs o GROUP BY ALL)"


def _around(table: str) -> str:
    """How many pixels of a table are in each cell's window."""
    return f"(SELECT p.image_id, p.y - o.dy AS y, p.x - o.dx AS x, count(*) AS n FROM {table} p CROSS JOIN offs o GROUP BY ALL)"


LEVEL = f"CASE WHEN {_hit('junction4')} THEN 3 WHEN {_hit('junction3')} THEN 2 ELSE 1 END"


def _kinds_of(table: str) -> str:
    """The repaired levels (lv) and the kinds (kinds) of a table's pixels."""
    return f"""lv0 AS MATERIALIZED (SELECT image_id, y, x, CASE WHEN code & 16 = 0 THEN 0 ELSE {LEVEL} END AS v, {_hit('hollow')} AS hollow FROM {_codes(table)} c),
  mid AS (SELECT * FROM lv0 WHERE hollow), fix AS MATERIALIZED (SELECT image_id, y, x, hollow, CASE WHEN hollow THEN 1 ELSE greatest(v - coalesce(n, 0), 0) END AS v FROM lv0 LEFT JOIN {_around('mid')} USING (image_id, y, x)),
  full_ AS (SELECT * FROM fix WHERE v > 0), again AS (SELECT image_id, y, x, {LEVEL} AS own FROM {_codes('full_')} c),
  lv AS MATERIALIZED (SELECT image_id, y, x, CAST(CASE WHEN hollow THEN own ELSE v END AS INT) AS v FROM full_ JOIN again USING (image_id, y, x)),
  kinds AS MATERIALIZED (SELECT image_id, y, x, CAST(v + 1 - CASE WHEN {_hit('endpoint')} THEN 1 ELSE 0 END AS INT) AS kind FROM lv JOIN {_codes('lv')} c USING (image_id, y, x))"""


#: Two passes a round; eight rounds are more than the lines of the fixture are wide, and a round without change changes nothing.
THIN = """ring(i, dy, dx) AS (VALUES (0, -1, -1), (1, -1, 0), (2, -1, 1), (3, 0, 1), (4, 1, 1), (5, 1, 0), (6, 1, -1), (7, 0, -1)),
  cur AS (SELECT image_id, y, x, 0 AS k FROM fx_vessels UNION ALL
    SELECT image_id, y, x, k + 1 FROM (SELECT image_id, y, x, k, r, (r >> 1) & 1 AS n, (r >> 3) & 1 AS e, (r >> 5) & 1 AS s, (r >> 7) & 1 AS w FROM (
      SELECT p.image_id, p.y, p.x, p.k, CAST(sum(CASE WHEN q.x IS NULL THEN 0 ELSE 1 << o.i END) AS INT) AS r FROM cur p CROSS JOIN ring o
      LEFT JOIN cur q ON q.image_id = p.image_id AND q.y = p.y + o.dy AND q.x = p.x + o.dx GROUP BY ALL))
    WHERE k < 16 AND NOT (bit_count(r) BETWEEN 2 AND 6 AND bit_count((255 - r) & (((r >> 1) | (r << 7)) & 255)) = 1
      AND CASE WHEN k % 2 = 0 THEN n * e * s + e * s * w ELSE n * e * w + n * s * w END = 0)),
  th AS MATERIALIZED (SELECT image_id, y, x FROM cur WHERE k = 16)"""
VESSELS = f"{OFFS}, {THIN}, {_kinds_of('th')}"
HIDDEN = f"""{VESSELS}, close AS (SELECT a.i, a.dy, a.dx, bit_or(1 << b.i) AS m FROM ring a JOIN ring b ON greatest(abs(a.dy - b.dy), abs(a.dx - b.dx)) <= 1 GROUP BY ALL),
  near AS (SELECT n.image_id, n.y - c.dy AS y, n.x - c.dx AS x, bit_or(c.m) AS hidden FROM kinds n CROSS JOIN close c WHERE n.kind <> 2 GROUP BY ALL),
  own AS MATERIALIZED (SELECT image_id, y, x, CAST(coalesce(hidden, 0) AS INT) AS hidden, y * 100000 + x AS id FROM kinds LEFT JOIN near USING (image_id, y, x) WHERE kind = 2)"""
BRANCHES = f"""{HIDDEN}, back AS (SELECT a.image_id, a.id AS u, b.id AS v FROM own a JOIN ring o ON (o.dy < 0 OR o.dy = 0 AND o.dx < 0) AND (a.hidden >> o.i) & 1 = 0
    JOIN own b ON b.image_id = a.image_id AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
  both_ AS MATERIALIZED (SELECT * FROM back UNION SELECT image_id, v, u FROM back),
  reach AS (SELECT image_id, id, id AS root FROM own UNION SELECT r.image_id, l.v, r.root FROM reach r JOIN both_ l ON l.image_id = r.image_id AND l.u = r.id),
  first_ AS (SELECT image_id, id, min(root) AS root FROM reach GROUP BY image_id, id),
  br AS MATERIALIZED (SELECT image_id, CAST(dense_rank() OVER (PARTITION BY image_id ORDER BY root) - 1 AS BIGINT) AS branch_id, y, x FROM own JOIN first_ USING (image_id, id))"""
ENDS = f"""{BRANCHES}, node AS (SELECT image_id, y, x, CAST(row_number() OVER (PARTITION BY image_id ORDER BY y, x) - 1 AS BIGINT) AS node_id FROM kinds WHERE kind <> 2),
  tips AS (SELECT DISTINCT b.image_id, b.branch_id, n.node_id, n.y, n.x FROM br b CROSS JOIN ring o JOIN node n ON n.image_id = b.image_id AND n.y = b.y + o.dy AND n.x = b.x + o.dx)"""


@query("fix_hollow_cross", f"WITH {OFFS}, {_kinds_of('fx_pixels')} SELECT image_id, y, x, v FROM lv")
def _(t):
    return skeleton.fix_hollow_cross(t.fx_pixels)


def _kinds(t):
    return saved(skeleton.classify_pixels(skeleton.thin(t.fx_vessels)))


@query("thin", f"WITH RECURSIVE {THIN} SELECT * FROM th")
def _(t):
    return skeleton.thin(t.fx_vessels)


@query("remove_1px_spurs", f"""WITH {OFFS}, {_kinds_of('fx_pixels')}, joint AS (SELECT * FROM kinds WHERE kind >= 3),
  spur AS (SELECT k.image_id, k.y, k.x FROM kinds k SEMI JOIN {_around('joint')} USING (image_id, y, x) WHERE k.kind = 1),
  low AS MATERIALIZED (SELECT * FROM (SELECT image_id, y, x, CASE WHEN coalesce(n, 0) NOT IN (1, 2) THEN kind WHEN kind <= 1 THEN 0 WHEN kind = 4 AND n = 1 THEN 3 ELSE 2 END AS kind
    FROM kinds LEFT JOIN {_around('spur')} USING (image_id, y, x)) WHERE kind > 0)
  SELECT image_id, y, x, CAST(CASE WHEN {_hit('endpoint')} THEN 1 ELSE kind END AS INT) AS kind FROM low JOIN {_codes('low')} c USING (image_id, y, x)""")
def _(t):
    return skeleton.remove_1px_spurs(saved(skeleton.classify_pixels(t.fx_pixels)))


@query("remove_short_spurs")
def _(t):
    return skeleton.remove_short_spurs(_kinds(t), 4)


@query("drop_close_neighbours", f"WITH RECURSIVE {HIDDEN} SELECT image_id, y, x, hidden FROM own")
def _(t):
    return skeleton.drop_close_neighbours(_kinds(t))


@query("label_branches", f"WITH RECURSIVE {BRANCHES} SELECT image_id, branch_id, y, x FROM br")
def _(t):
    return skeleton.label_branches(_kinds(t))


@query("branch_ends", f"WITH RECURSIVE {ENDS} SELECT * FROM tips")
def _(t):
    pixels, ends, _ = skeleton.parse_skeleton(_kinds(t), keep_open=True)
    return ends


@query("parse_skeleton", f"""WITH RECURSIVE {ENDS} SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY branch_id) - 1 AS BIGINT) AS branch_id, node1, node2
  FROM (SELECT image_id, branch_id, min(node_id) AS node1, max(node_id) AS node2 FROM tips GROUP BY image_id, branch_id) WHERE node1 < node2""")
def _(t):
    return skeleton.parse_skeleton(_kinds(t))[1]


@query("skeleton_of_labels", f"WITH RECURSIVE {HIDDEN} SELECT image_id, y, x FROM own")
def _(t):
    return skeleton.skeleton_of_labels(skeleton.label_branches(_kinds(t)))


@query("masks_to_graphs")
def _(t):
    from filigree.operators.rewrite import masks_to_graphs

    branches, nodes, pixels = masks_to_graphs(t.fx_vessels, 5, 2)
    rows = branches.withColumn("part", F.lit("branch")).unionByName(nodes.withColumn("part", F.lit("node")), True)
    return rows.unionByName(pixels.withColumns({c: F.col(c).cast("double") for c in ("y", "x")}).withColumn("part", F.lit("pixel")), True)
