"""Graphs, images, rectangles and weights that queries run on, derived from the given tables.

The texts hold in Spark and DuckDB; a table in braces is another table or fixture.
"""

from __future__ import annotations

FIXTURES: dict[str, str] = {
    "unnested": """
SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS pos, unnest(embedding) AS w FROM {embeddings}
""",
    "fx_branches": """
SELECT graph_id, side,
       CAST(row_number() OVER (PARTITION BY graph_id, side
            ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS BIGINT) AS branch_id,
       least(a, b) AS node1, greatest(a, b) AS node2
FROM (
  SELECT l_suppkey AS graph_id, 'pred' AS side, l_partkey % 30 AS a, l_orderkey % 30 AS b,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM {lineitem} WHERE l_quantity <= 2 AND l_discount < 0.085
  UNION ALL
  SELECT l_suppkey AS graph_id, 'target' AS side, l_partkey % 30 AS a, l_orderkey % 30 AS b,
         l_orderkey, l_linenumber, l_partkey, l_extendedprice
  FROM {lineitem} WHERE l_quantity <= 2 AND l_discount > 0.015
) t
""",
    "fx_nodes": """
SELECT DISTINCT graph_id, side, node_id,
       CAST((node_id * 37 + graph_id * 11) % 256
            + CASE WHEN side = 'pred' THEN (node_id * 7 + graph_id) % 5 - 2 ELSE 0 END AS DOUBLE) AS y,
       CAST((node_id * 101 + graph_id * 29) % 256
            + CASE WHEN side = 'pred' THEN (node_id * 3 + graph_id) % 5 - 2 ELSE 0 END AS DOUBLE) AS x
FROM (
  SELECT graph_id, side, node1 AS node_id FROM {fx_branches}
  UNION ALL
  SELECT graph_id, side, node2 AS node_id FROM {fx_branches}
) t
""",
    "fx_pixels": """
SELECT DISTINCT l_suppkey AS image_id,
       CAST(l_partkey % 48 AS INT) AS y, CAST(l_orderkey % 48 AS INT) AS x
FROM {lineitem}
""",
    "fx_vessels": """
SELECT i.image_id, r.y, c.x
FROM (SELECT DISTINCT l_suppkey AS image_id FROM {lineitem}) i
CROSS JOIN (SELECT DISTINCT CAST(l_partkey % 48 AS INT) AS y FROM {lineitem}) r
CROSS JOIN (SELECT DISTINCT CAST(l_partkey % 48 AS INT) AS x FROM {lineitem}) c
WHERE r.y BETWEEN 2 AND 45 AND c.x BETWEEN 2 AND 45
  AND (abs(r.y - 24 - (abs((c.x + 7 * i.image_id) % 24 - 12) - 6)) <= 1
       OR abs(2 * c.x - 20 - r.y) <= 2
       OR abs(3 * c.x - 120 + r.y) <= 3)
""",
    "fx_masks": """
SELECT DISTINCT l_suppkey AS image_id, 'pred' AS layer,
       CAST(l_partkey % 48 AS INT) AS y, CAST(l_orderkey % 48 AS INT) AS x
FROM {lineitem} WHERE l_discount < 0.075
UNION ALL
SELECT DISTINCT l_suppkey AS image_id, 'target' AS layer,
       CAST(l_partkey % 48 AS INT) AS y, CAST(l_orderkey % 48 AS INT) AS x
FROM {lineitem} WHERE l_discount > 0.025
UNION ALL
SELECT DISTINCT l_suppkey AS image_id, 'skel_pred' AS layer,
       CAST(l_partkey % 48 AS INT) AS y, CAST(l_orderkey % 48 AS INT) AS x
FROM {lineitem} WHERE l_discount < 0.075 AND l_quantity <= 15
UNION ALL
SELECT DISTINCT l_suppkey AS image_id, 'skel_target' AS layer,
       CAST(l_partkey % 48 AS INT) AS y, CAST(l_orderkey % 48 AS INT) AS x
FROM {lineitem} WHERE l_discount > 0.025 AND l_quantity <= 15
""",
    "fx_image": """
SELECT i.image_id, r.y, c.x,
       CAST((r.y * 3 + c.x * 5 + i.image_id) % 256 AS INT) AS b,
       CAST((r.y * 5 + c.x * 3 + i.image_id) % 256 AS INT) AS g,
       CAST(CASE WHEN (r.y - 24) * (r.y - 24) + (c.x - 24) * (c.x - 24) <= 400
                 THEN 60 + (r.y * 7 + c.x * 13 + i.image_id * 5) % 180
                 WHEN r.y < 4 AND c.x < 4 THEN 90
                 ELSE (r.y + c.x) % 5 END AS INT) AS r
FROM (SELECT DISTINCT l_suppkey AS image_id FROM {lineitem}) i
CROSS JOIN (SELECT DISTINCT CAST(l_partkey % 48 AS INT) AS y FROM {lineitem}) r
CROSS JOIN (SELECT DISTINCT CAST(l_partkey % 48 AS INT) AS x FROM {lineitem}) c
""",
    "fx_vertices": """
SELECT user_id AS path_id,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS seq,
       value AS y, CAST(event_id % 97 AS DOUBLE) AS x
FROM {events}
""",
    "fx_rects": """
SELECT o_orderpriority AS grp, o_orderkey AS rect_id,
       CAST(1 + o_orderkey % 17 AS DOUBLE) AS h, CAST(1 + o_custkey % 13 AS DOUBLE) AS w,
       CAST(o_custkey % 100 AS DOUBLE) AS y, CAST(o_orderkey % 100 AS DOUBLE) AS x
FROM {orders}
""",
    "fx_weights": """
SELECT vec_id AS sample_id, label, CAST(pos AS INT) AS kernel_id,
       CAST(pos % 4 AS INT) AS k, CAST(floor((pos % 32) / 4) AS INT) AS r,
       CASE WHEN pos < 32 THEN 'R' ELSE 'I' END AS type, CAST(w AS DOUBLE) AS w
FROM {unnested}
""",
    "fx_stack": """
SELECT DISTINCT l_suppkey AS image_id, CAST(l_linenumber % 8 AS INT) AS theta,
       CAST(l_partkey % 8 AS INT) AS y, CAST(l_orderkey % 8 AS INT) AS x,
       CAST((l_partkey + l_orderkey) % 16 AS DOUBLE) AS v
FROM {lineitem} WHERE l_quantity <= 25
""",
}

#: Where the two dialects differ.
SPARK_ONLY: dict[str, str] = {
    "unnested": """
SELECT vec_id, label, pos, w FROM {embeddings} LATERAL VIEW posexplode(embedding) t AS pos, w
""",
}
