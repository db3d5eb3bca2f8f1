"""Queries of graphs: relabelling, views, rewriting, matching and paths."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import functions as F

from filigree.operators import graph, match, paths, rewrite
from filigree.operators.components import connected_components
from filigree.sources.scratch import saved

from .registry import query

KEYS = ["graph_id", "side"]
K = "graph_id, side"
INC = f"inc AS (SELECT {K}, branch_id, node1 AS node_id FROM fx_branches UNION SELECT {K}, branch_id, node2 FROM fx_branches)"
DEG = INC + f""", deg AS (SELECT n.graph_id, n.side, n.node_id, n.y, n.x, count(i.branch_id) AS degree
  FROM fx_nodes n LEFT JOIN inc i ON i.graph_id = n.graph_id AND i.side = n.side AND i.node_id = n.node_id GROUP BY ALL)"""
D12 = "sqrt((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))"
#: Node clusters of the merge queries: nodes with equal id modulo ten.
CLUSTER = "node_id % 10"


def r6(c):
    return F.round(c, 6)


def sides(df):
    return (df.filter(F.col("side") == k).drop("side") for k in ("pred", "target"))


# --- relabelling


@query("compact_ids", f"SELECT {K}, node_id, CAST(dense_rank() OVER (PARTITION BY {K} ORDER BY node_id) - 1 AS BIGINT) AS new_id FROM fx_nodes")
def _(t):
    return graph.compact_ids(t.fx_nodes, KEYS, "node_id").select(*KEYS, "node_id", "new_id")


def _lookup(t):
    new = F.when(F.col("node_id") % 7 != 0, F.expr(CLUSTER))
    return t.fx_nodes.select(*KEYS, F.col("node_id").alias("old_id"), new.alias("new_id"))


@query("apply_lookup", f"SELECT {K}, branch_id, CASE WHEN node1 % 2 = 1 THEN node1 WHEN node1 % 7 <> 0 THEN node1 % 10 END AS node1, node2 FROM fx_branches")
def _(t):
    # Ids that a lookup does not list stay.
    return graph.apply_lookup(t.fx_branches, _lookup(t).filter("old_id % 2 = 0"), KEYS, "node1")


@query("add_background", f"SELECT {K}, branch_id + 1 AS branch_id FROM fx_branches")
def _(t):
    return graph.add_background(t.fx_branches.select(*KEYS, "branch_id"), "branch_id")


@query("invert_lookup", f"SELECT {K}, node_id % 10 AS new_id, min(node_id) AS old_id, count(*) AS n FROM fx_nodes WHERE node_id % 7 <> 0 GROUP BY ALL")
def _(t):
    return graph.invert_lookup(_lookup(t), KEYS)


@query("merge_coordinates", f"""SELECT {K}, node_id % 10 AS node_id, round(sum(y * (node_id + 1e-8)) / sum(node_id + 1e-8), 6) AS y,
  round(sum(x * (node_id + 1e-8)) / sum(node_id + 1e-8), 6) AS x FROM fx_nodes GROUP BY {K}, node_id % 10""")
def _(t):
    lookup = t.fx_nodes.select(*KEYS, F.col("node_id").alias("old_id"), F.expr(CLUSTER).alias("new_id"))
    out = graph.merge_coordinates(t.fx_nodes, lookup, KEYS, F.col("node_id"))
    return out.withColumns({"y": r6("y"), "x": r6("x")})


def _pixels(t):
    """Two pixels for each branch, so that there are labels."""
    spots = F.array(F.col("node1").cast("int"), (F.col("node2") + 40).cast("int"))
    return t.fx_branches.select(*KEYS, "branch_id", F.explode(spots).alias("y"), (F.col("branch_id") % 50).cast("int").alias("x"))


PIX = f"pix AS (SELECT {K}, branch_id, CAST(node1 AS INT) AS y, CAST(branch_id % 50 AS INT) AS x FROM fx_branches UNION ALL SELECT {K}, branch_id, CAST(node2 + 40 AS INT), CAST(branch_id % 50 AS INT) FROM fx_branches)"


@query("relabel_pixels", f"WITH {PIX} SELECT {K}, branch_id % 5 AS branch_id, y, x FROM pix WHERE branch_id % 4 <> 0")
def _(t):
    lookup = t.fx_branches.select(*KEYS, F.col("branch_id").alias("old_id"), F.when(F.col("branch_id") % 4 != 0, F.col("branch_id") % 5).alias("new_id"))
    return graph.relabel_pixels(_pixels(t), lookup, KEYS)


@query("branch_sizes", f"WITH {PIX} SELECT {K}, branch_id, count(*) AS n_pixels FROM pix GROUP BY ALL")
def _(t):
    return graph.branch_sizes(_pixels(t), KEYS)


@query("shuffle_nodes", f"SELECT {K}, node_id AS old_id, CAST(row_number() OVER (PARTITION BY {K} ORDER BY CASE WHEN node_id % 5 = 0 THEN 30 - node_id END NULLS LAST, node_id) - 1 AS BIGINT) AS new_id FROM fx_nodes")
def _(t):
    listed = t.fx_nodes.filter("node_id % 5 = 0").withColumn("pos", 30 - F.col("node_id"))
    return graph.shuffle_nodes(t.fx_nodes, listed, KEYS)


# --- views


@query("adjacency_list", f"WITH {INC} SELECT {K}, branch_id, min(node_id) AS node1, max(node_id) AS node2 FROM inc GROUP BY ALL")
def _(t):
    return graph.adjacency_list(graph.incidence(t.fx_branches, KEYS), KEYS)


@query("edge_list", f"SELECT {K}, branch_id, node1, node2 FROM fx_branches WHERE node1 <> node2")
def _(t):
    return graph.edge_list(graph.incidence(t.fx_branches.filter("node1 <> node2"), KEYS), KEYS)


@query("node_graph", f"""SELECT b.graph_id, b.side, node1, node2, min(branch_id) AS branch_id, count(*) AS n_branches, p.y AS y1, p.x AS x1, q.y AS y2, q.x AS x2
  FROM fx_branches b JOIN fx_nodes p ON p.graph_id = b.graph_id AND p.side = b.side AND p.node_id = node1
  JOIN fx_nodes q ON q.graph_id = b.graph_id AND q.side = b.side AND q.node_id = node2 WHERE node1 <> node2 GROUP BY ALL""")
def _(t):
    return graph.node_graph(t.fx_branches, t.fx_nodes, KEYS)


@query("branch_adjacency", f"WITH {INC} SELECT DISTINCT a.graph_id, a.side, a.branch_id AS branch1, b.branch_id AS branch2 FROM inc a JOIN inc b USING (graph_id, side, node_id)")
def _(t):
    return graph.branch_adjacency(t.fx_branches, KEYS)


@query("node_adjacency", f"WITH {INC} SELECT DISTINCT a.graph_id, a.side, a.node_id AS node_a, b.node_id AS node_b FROM inc a JOIN inc b USING (graph_id, side, branch_id)")
def _(t):
    return graph.node_adjacency(t.fx_branches, KEYS)


@query("node_degree", f"WITH {DEG} SELECT {K}, node_id, degree FROM deg")
def _(t):
    return graph.node_degree(t.fx_branches, t.fx_nodes, KEYS)


@query("endpoints", f"WITH {DEG} SELECT {K}, node_id FROM deg WHERE degree = 1")
def _(t):
    return graph.endpoints(t.fx_branches, t.fx_nodes, KEYS)


@query("graph_counts", f"SELECT {K}, (SELECT count(*) FROM fx_nodes n WHERE n.graph_id = b.graph_id AND n.side = b.side) AS n_nodes, count(*) AS n_branches FROM fx_branches b GROUP BY {K}")
def _(t):
    return graph.graph_counts(t.fx_branches, t.fx_nodes, KEYS)


@query("path_length", """SELECT path_id, round(sum(coalesce(sqrt(pow(y - py, 2) + pow(x - px, 2)), 0)) + sqrt(pow(min_by(y, seq) - max_by(y, seq), 2) + pow(min_by(x, seq) - max_by(x, seq), 2)), 6) AS length
  FROM (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px FROM fx_vertices WINDOW w AS (PARTITION BY path_id ORDER BY seq)) GROUP BY path_id""")
def _(t):
    return graph.path_length(t.fx_vertices).withColumn("length", r6("length"))


@query("path_length_open", """SELECT path_id, round(sum(coalesce(sqrt(pow(y - py, 2) + pow(x - px, 2)), 0)), 6) AS length
  FROM (SELECT *, lag(y) OVER w AS py, lag(x) OVER w AS px FROM fx_vertices WINDOW w AS (PARTITION BY path_id ORDER BY seq)) GROUP BY path_id""")
def _(t):
    return graph.path_length(t.fx_vertices, close_loop=False).withColumn("length", r6("length"))


def _drawn(t):
    b = t.fx_branches
    for k in ("1", "2"):
        b = b.join(t.fx_nodes.select(*KEYS, F.col("node_id").alias(f"node{k}"), F.col("y").alias(f"y{k}"), F.col("x").alias(f"x{k}")), [*KEYS, f"node{k}"])
    return rewrite.draw_segments(b, [*KEYS, "branch_id"])


SEG = """seg AS (SELECT b.graph_id, b.side, branch_id, CAST(p.y AS BIGINT) AS y1, CAST(p.x AS BIGINT) AS x1, CAST(q.y - p.y AS BIGINT) AS dy, CAST(q.x - p.x AS BIGINT) AS dx
  FROM fx_branches b JOIN fx_nodes p ON p.graph_id = b.graph_id AND p.side = b.side AND p.node_id = node1 JOIN fx_nodes q ON q.graph_id = b.graph_id AND q.side = b.side AND q.node_id = node2),
  run AS (SELECT *, greatest(abs(dy), abs(dx)) AS n, unnest(range(greatest(abs(dy), abs(dx)) + 1)) AS k FROM seg),
  drawn AS (SELECT graph_id, side, branch_id, CAST(y1 + CASE WHEN n = 0 THEN 0 ELSE sign(dy) * ((2 * abs(dy) * k + n - 1) // (2 * n)) END AS BIGINT) AS y,
  CAST(x1 + CASE WHEN n = 0 THEN 0 ELSE sign(dx) * ((2 * abs(dx) * k + n - 1) // (2 * n)) END AS BIGINT) AS x FROM run)"""


@query("draw_segments", f"WITH {SEG} SELECT {K}, branch_id, y, x FROM drawn")
def _(t):
    return _drawn(t)


def _tangents(own: str) -> str:
    """The tangents of nodes with a branch_id, the rows of ``own``."""
    return f"""{SEG}, inc2 AS (SELECT {K}, branch_id, unnest([node1, node2]) AS node_id FROM fx_branches WHERE node1 <> node2),
  own AS ({own}), near AS (SELECT n.graph_id, n.side, n.node_id, d.y - n.y AS dy, d.x - n.x AS dx
  FROM fx_nodes n JOIN own USING (graph_id, side, node_id) JOIN drawn d ON d.graph_id = n.graph_id AND d.side = n.side AND d.branch_id = own.branch_id
  WHERE d.y >= greatest(n.y - 21, 0) AND d.y < greatest(n.y - 21, 0) + 42 AND d.x >= greatest(n.x - 21, 0) AND d.x < greatest(n.x - 21, 0) + 42),
  m AS (SELECT {K}, node_id, sum(dy * w) / sum(w) AS y, sum(dx * w) / sum(w) AS x FROM (SELECT *, exp(-0.5 * pow(sqrt(dy * dy + dx * dx) - 7, 2) / 49) AS w FROM near) GROUP BY ALL)
  SELECT {K}, node_id, round(-y / sqrt(y * y + x * x), 6) AS ty, round(-x / sqrt(y * y + x * x), 6) AS tx FROM m"""


@query("node_tangents", f"WITH {_tangents(f'SELECT {K}, node_id, min(branch_id) AS branch_id FROM inc2 GROUP BY ALL')}")
def _(t):
    ends = graph.incidence(t.fx_branches.filter("node1 <> node2"), KEYS).groupBy(*KEYS, "node_id").agg(F.min("branch_id").alias("branch_id"))
    out = graph.node_tangents(t.fx_nodes.join(ends, [*KEYS, "node_id"]), _drawn(t), KEYS)
    return out.withColumns({"ty": r6("ty"), "tx": r6("tx")})


@query("terminal_tangents", f"WITH {_tangents(f'SELECT {K}, node_id, min(branch_id) AS branch_id FROM inc2 GROUP BY ALL HAVING count(*) = 1')}")
def _(t):
    b = t.fx_branches.filter("node1 <> node2")
    return graph.terminal_tangents(b, t.fx_nodes, _drawn(t), KEYS).withColumns({"ty": r6("ty"), "tx": r6("tx")})


# --- rewriting


@query("delete_nodes", f"SELECT {K}, branch_id, node1, node2 FROM fx_branches WHERE node1 % 4 <> 0 AND node2 % 4 <> 0")
def _(t):
    gone = t.fx_nodes.filter("node_id % 4 = 0").select(*KEYS, "node_id")
    return rewrite.delete_nodes(t.fx_branches, t.fx_nodes, gone, KEYS)[0]


FUSE = DEG.replace("WITH ", "") + f""", two AS (SELECT {K}, node_id FROM deg WHERE degree = 2),
  link AS (SELECT a.graph_id, a.side, a.branch_id AS b1, b.branch_id AS b2 FROM inc a JOIN inc b USING (graph_id, side, node_id) JOIN two USING (graph_id, side, node_id)),
  reach AS (SELECT {K}, branch_id, branch_id AS root FROM fx_branches UNION SELECT l.graph_id, l.side, l.b2, r.root FROM reach r JOIN link l ON l.graph_id = r.graph_id AND l.side = r.side AND l.b1 = r.branch_id),
  root AS (SELECT {K}, branch_id, min(root) AS root FROM reach GROUP BY ALL),
  ends AS (SELECT {K}, branch_id, unnest([node1, node2]) AS node_id FROM fx_branches),
  whole AS (SELECT e.graph_id, e.side, r.root AS branch_id, min(e.node_id) AS node1, max(e.node_id) AS node2 FROM ends e JOIN root r USING (graph_id, side, branch_id)
    ANTI JOIN two ON two.graph_id = e.graph_id AND two.side = e.side AND two.node_id = e.node_id GROUP BY ALL)"""


@query("fuse_nodes", f"WITH RECURSIVE {FUSE} SELECT {K}, branch_id, node1, node2 FROM whole")
def _(t):
    two = graph.node_degree(t.fx_branches, t.fx_nodes, KEYS).filter("degree = 2")
    return rewrite.fuse_nodes(t.fx_branches, t.fx_nodes, two, KEYS)[0]


@query("simplify_degree2", f"WITH RECURSIVE {FUSE} SELECT {K}, node1 AS node_id FROM whole UNION SELECT {K}, node2 FROM whole")
def _(t):
    return rewrite.simplify_degree2(t.fx_branches, t.fx_nodes, KEYS)[1].select(*KEYS, "node_id")


@query("fused_pixels", f"""WITH RECURSIVE {FUSE}, own AS (SELECT {K}, node_id, min(branch_id) AS branch_id FROM inc JOIN two USING (graph_id, side, node_id) GROUP BY ALL)
  SELECT o.graph_id, o.side, r.root AS branch_id, n.y, n.x FROM own o JOIN root r USING (graph_id, side, branch_id) JOIN fx_nodes n ON n.graph_id = o.graph_id AND n.side = o.side AND n.node_id = o.node_id
  SEMI JOIN whole w ON w.graph_id = o.graph_id AND w.side = o.side AND w.branch_id = r.root""")
def _(t):
    two = graph.node_degree(t.fx_branches, t.fx_nodes, KEYS).filter("degree = 2").select(*KEYS, "node_id")
    lookup = rewrite.fuse_nodes(t.fx_branches, t.fx_nodes, two, KEYS)[2]
    return rewrite.fused_pixels(t.fx_nodes, t.fx_branches, two, lookup, KEYS)


def _pairs(t):
    """Ends of a graph in pairs: the first with the second, and so on."""
    ends = graph.compact_ids(graph.endpoints(t.fx_branches, t.fx_nodes, KEYS), KEYS, "node_id", "k")
    both = ends.groupBy(*KEYS, F.floor(F.col("k") / 2).alias("p")).agg(F.min("node_id").alias("a"), F.max("node_id").alias("b"))
    return saved(both.filter("a < b").select(*KEYS, "a", "b"))


#: Ends in pairs, what their branches become when each pair is one, and the branches that are left.
PAIRS = DEG.replace("WITH ", "") + f""", tip AS (SELECT {K}, node_id, row_number() OVER (PARTITION BY {K} ORDER BY node_id) - 1 AS k FROM deg WHERE degree = 1),
  couple AS (SELECT {K}, min(node_id) AS a, max(node_id) AS b FROM tip GROUP BY {K}, k // 2 HAVING min(node_id) < max(node_id)),
  joint AS (SELECT {K}, node_id, o.branch_id, c.a FROM (SELECT {K}, a, unnest([a, b]) AS node_id FROM couple) c JOIN inc o USING (graph_id, side, node_id)),
  link AS (SELECT x.graph_id, x.side, x.branch_id AS b1, y.branch_id AS b2 FROM joint x JOIN joint y USING (graph_id, side, a)),
  reach AS (SELECT {K}, branch_id, branch_id AS root FROM fx_branches UNION SELECT l.graph_id, l.side, l.b2, r.root FROM reach r JOIN link l ON l.graph_id = r.graph_id AND l.side = r.side AND l.b1 = r.branch_id),
  root AS (SELECT {K}, branch_id, min(root) AS root FROM reach GROUP BY ALL),
  ends AS (SELECT {K}, branch_id, unnest([node1, node2]) AS node_id FROM fx_branches),
  whole AS (SELECT e.graph_id, e.side, r.root AS branch_id, min(e.node_id) AS node1, max(e.node_id) AS node2 FROM ends e JOIN root r USING (graph_id, side, branch_id)
    ANTI JOIN joint ON joint.graph_id = e.graph_id AND joint.side = e.side AND joint.node_id = e.node_id GROUP BY ALL)"""


@query("fuse_node_pairs", f"WITH RECURSIVE {PAIRS} SELECT {K}, branch_id, node1, node2 FROM whole")
def _(t):
    return rewrite.fuse_node_pairs(t.fx_branches, t.fx_nodes, _pairs(t), KEYS)[0]


@query("bridge_nodes")
def _(t):
    t = SimpleNamespace(fx_branches=saved(t.fx_branches), fx_nodes=saved(t.fx_nodes))  # read ten times
    return rewrite.bridge_nodes(t.fx_branches, t.fx_nodes, _drawn(t).withColumns({k: F.col(k).cast("int") for k in "yx"}), _pairs(t), KEYS)[2]


@query("merge_parallel_branches", f"SELECT {K}, min(branch_id) AS branch_id, node1, node2 FROM fx_branches GROUP BY ALL")
def _(t):
    return rewrite.merge_parallel_branches(t.fx_branches, KEYS)[0]


@query("merge_clusters", f"""SELECT {K}, branch_id, least(c1, c2) AS node1, greatest(c1, c2) AS node2 FROM (
  SELECT b.graph_id, b.side, branch_id, node1, node2, p.c AS c1, q.c AS c2 FROM fx_branches b
  JOIN (SELECT *, min(node_id) OVER (PARTITION BY {K}, node_id % 10) AS c FROM fx_nodes) p ON p.graph_id = b.graph_id AND p.side = b.side AND p.node_id = node1
  JOIN (SELECT *, min(node_id) OVER (PARTITION BY {K}, node_id % 10) AS c FROM fx_nodes) q ON q.graph_id = b.graph_id AND q.side = b.side AND q.node_id = node2)
  WHERE c1 <> c2 OR node1 = node2""")
def _(t):
    clusters = t.fx_nodes.select(*KEYS, "node_id", F.expr(CLUSTER).alias("cluster_id"))
    return rewrite.merge_clusters(t.fx_branches, t.fx_nodes, clusters, KEYS)[0]


@query("near_join", f"SELECT a.graph_id, a.side, a.node_id AS a, b.node_id AS b, round({D12}, 6) AS distance FROM fx_nodes a JOIN fx_nodes b USING (graph_id, side) WHERE a.node_id < b.node_id AND {D12} <= 20")
def _(t):
    return rewrite.near_join(t.fx_nodes, KEYS, 20).withColumn("distance", r6("distance"))


NEAR = f"""WITH RECURSIVE link AS (SELECT a.graph_id, a.side, a.node_id AS u, b.node_id AS v FROM fx_nodes a JOIN fx_nodes b USING (graph_id, side) WHERE {D12} <= 20),
  reach AS (SELECT {K}, node_id, node_id AS root FROM fx_nodes UNION SELECT l.graph_id, l.side, l.v, r.root FROM reach r JOIN link l ON l.graph_id = r.graph_id AND l.side = r.side AND l.u = r.node_id),
  root AS (SELECT {K}, node_id, min(root) AS root FROM reach GROUP BY ALL)"""


@query("merge_near_nodes", NEAR + f"""SELECT b.graph_id, b.side, branch_id, least(p.root, q.root) AS node1, greatest(p.root, q.root) AS node2 FROM fx_branches b
  JOIN root p ON p.graph_id = b.graph_id AND p.side = b.side AND p.node_id = node1 JOIN root q ON q.graph_id = b.graph_id AND q.side = b.side AND q.node_id = node2
  WHERE p.root <> q.root OR node1 = node2""")
def _(t):
    return rewrite.merge_near_nodes(t.fx_branches, t.fx_nodes, KEYS, node=20)[0]


@query("connected_components", f"""WITH RECURSIVE reach AS (SELECT {K}, node_id, node_id AS root FROM fx_nodes UNION SELECT b.graph_id, b.side,
  CASE WHEN b.node1 = r.node_id THEN b.node2 ELSE b.node1 END, r.root FROM reach r JOIN fx_branches b ON b.graph_id = r.graph_id AND b.side = r.side AND (b.node1 = r.node_id OR b.node2 = r.node_id))
  SELECT {K}, node_id AS id, min(root) AS component FROM reach GROUP BY {K}, node_id""")
def _(t):
    return connected_components(t.fx_branches, "node1", "node2", KEYS)


@query("unite_clusters", f"""WITH RECURSIVE member AS (SELECT {K}, branch_id AS cluster_id, unnest([node1, node2]) AS item_id FROM fx_branches),
  reach AS (SELECT {K}, item_id, item_id AS root FROM member UNION SELECT n.graph_id, n.side, n.item_id, r.root FROM reach r
  JOIN member m ON m.graph_id = r.graph_id AND m.side = r.side AND m.item_id = r.item_id JOIN member n ON n.graph_id = m.graph_id AND n.side = m.side AND n.cluster_id = m.cluster_id)
  SELECT {K}, item_id, min(root) AS cluster_id FROM reach GROUP BY {K}, item_id""")
def _(t):
    from filigree.operators.clusters import unite_clusters

    members = t.fx_branches.select(*KEYS, F.col("branch_id").alias("cluster_id"), F.explode(F.array("node1", "node2")).alias("item_id"))
    return unite_clusters(members, KEYS)


@query("cluster_pairs", f"SELECT a.graph_id, a.side, a.node_id % 10 AS cluster_id, a.node_id AS a, b.node_id AS b FROM fx_nodes a JOIN fx_nodes b USING (graph_id, side) WHERE a.node_id < b.node_id AND a.node_id % 10 = b.node_id % 10")
def _(t):
    from filigree.operators.clusters import cluster_pairs

    return cluster_pairs(t.fx_nodes.select(*KEYS, F.expr(CLUSTER).alias("cluster_id"), F.col("node_id").alias("item_id")), KEYS)


#: Short branches from a junction to an end go; junctions that two branches are left of are fused.
SPURS = DEG.replace("WITH ", "") + f""", two_ends AS (SELECT b.graph_id, b.side, b.branch_id, a.node_id AS n1, c.node_id AS n2, a.degree AS d1, c.degree AS d2, sqrt((a.y - c.y) * (a.y - c.y) + (a.x - c.x) * (a.x - c.x)) AS d FROM fx_branches b
    JOIN deg a ON a.graph_id = b.graph_id AND a.side = b.side AND a.node_id = node1 JOIN deg c ON c.graph_id = b.graph_id AND c.side = b.side AND c.node_id = node2),
  spur AS (SELECT {K}, CASE WHEN d1 = 1 THEN n1 ELSE n2 END AS node_id, CASE WHEN d1 = 1 THEN n2 ELSE n1 END AS junction FROM two_ends WHERE (d1 = 1) <> (d2 = 1) AND d < 60),
  b2 AS MATERIALIZED (SELECT b.* FROM fx_branches b WHERE NOT EXISTS (SELECT 1 FROM spur s WHERE s.graph_id = b.graph_id AND s.side = b.side AND s.node_id IN (b.node1, b.node2))),
  inc2 AS (SELECT {K}, branch_id, node1 AS node_id FROM b2 UNION SELECT {K}, branch_id, node2 FROM b2),
  two AS MATERIALIZED (SELECT {K}, node_id FROM inc2 SEMI JOIN (SELECT {K}, junction AS node_id FROM spur) j USING (graph_id, side, node_id) GROUP BY ALL HAVING count(*) = 2),
  link AS (SELECT a.graph_id, a.side, a.branch_id AS x, b.branch_id AS z FROM inc2 a JOIN inc2 b USING (graph_id, side, node_id) JOIN two USING (graph_id, side, node_id)),
  reach AS (SELECT {K}, branch_id, branch_id AS root FROM b2 UNION SELECT l.graph_id, l.side, l.z, r.root FROM reach r JOIN link l ON l.graph_id = r.graph_id AND l.side = r.side AND l.x = r.branch_id),
  root AS (SELECT {K}, branch_id, min(root) AS root FROM reach GROUP BY ALL),
  ends AS (SELECT {K}, branch_id, unnest([node1, node2]) AS node_id FROM b2),
  whole AS (SELECT e.graph_id, e.side, r.root AS branch_id, min(e.node_id) AS node1, max(e.node_id) AS node2 FROM ends e JOIN root r USING (graph_id, side, branch_id)
    ANTI JOIN two ON two.graph_id = e.graph_id AND two.side = e.side AND two.node_id = e.node_id GROUP BY ALL)"""


@query("remove_spurs_by_distance", f"WITH RECURSIVE {SPURS} SELECT {K}, branch_id, node1, node2 FROM whole")
def _(t):
    return rewrite.remove_spurs_by_distance(t.fx_branches, t.fx_nodes, KEYS, 60)[0]


CYCLES = f"""e AS (SELECT DISTINCT {K}, node1 AS p, node2 AS q FROM fx_branches WHERE node1 <> node2),
  s AS (SELECT {K}, p, q FROM e UNION SELECT {K}, q, p FROM e), d AS (SELECT a.graph_id, a.side, a.node_id AS p, b.node_id AS q, {D12} AS d FROM fx_nodes a JOIN fx_nodes b USING (graph_id, side)),
  c3 AS (SELECT x.graph_id, x.side, x.p AS n1, x.q AS n2, y.q AS n3, CAST(NULL AS BIGINT) AS n4 FROM s x JOIN s y ON y.graph_id = x.graph_id AND y.side = x.side AND y.p = x.q AND y.q > x.q
    JOIN s z ON z.graph_id = x.graph_id AND z.side = x.side AND z.p = y.q AND z.q = x.p WHERE x.p < x.q),
  c4 AS (SELECT w.graph_id, w.side, w.p AS n1, w.q AS n2, x.q AS n3, y.q AS n4 FROM s w JOIN s x ON x.graph_id = w.graph_id AND x.side = w.side AND x.p = w.q AND x.q > w.p
    JOIN s y ON y.graph_id = w.graph_id AND y.side = w.side AND y.p = x.q AND y.q > w.q JOIN s z ON z.graph_id = w.graph_id AND z.side = w.side AND z.p = y.q AND z.q = w.p
    WHERE w.p < w.q AND NOT EXISTS (SELECT 1 FROM s c WHERE c.graph_id = w.graph_id AND c.side = w.side AND (c.p = w.p AND c.q = x.q OR c.p = w.q AND c.q = y.q))),
  a AS (SELECT * FROM c3 UNION ALL SELECT * FROM c4),
  cyc AS (SELECT {K}, n1, n2, n3, n4 FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.graph_id = a.graph_id AND d.side = a.side AND d.d >= 150 AND d.p IN (n1, n2, n3, n4) AND d.q IN (n1, n2, n3, n4)))"""


@query("small_cycles", f"WITH {CYCLES} SELECT * FROM cyc")
def _(t):
    c = rewrite.small_cycles(t.fx_branches, t.fx_nodes, KEYS, 150)
    return c.select(*KEYS, *[F.get("cycle_nodes", k).alias(f"n{k + 1}") for k in range(4)])


@query("bounded_cycles", f"WITH {CYCLES} SELECT * FROM a")
def _(t):
    c = rewrite.small_cycles(t.fx_branches, t.fx_nodes, KEYS, float("inf"))
    return c.select(*KEYS, *[F.get("cycle_nodes", k).alias(f"n{k + 1}") for k in range(4)])


@query("collapse_small_cycles", f"""WITH RECURSIVE {CYCLES}, on_cycle AS (SELECT {K}, n1, unnest([n1, n2, n3, n4]) AS node_id FROM cyc),
  near AS (SELECT {K}, n1 AS u, node_id AS v FROM on_cycle WHERE node_id IS NOT NULL UNION SELECT {K}, node_id, n1 FROM on_cycle WHERE node_id IS NOT NULL),
  reach AS (SELECT {K}, node_id, node_id AS root FROM fx_nodes UNION SELECT l.graph_id, l.side, l.v, r.root FROM reach r JOIN near l ON l.graph_id = r.graph_id AND l.side = r.side AND l.u = r.node_id),
  root AS (SELECT {K}, node_id, min(root) AS root FROM reach GROUP BY ALL)
  SELECT b.graph_id, b.side, branch_id, least(p.root, q.root) AS node1, greatest(p.root, q.root) AS node2 FROM fx_branches b
  JOIN root p ON p.graph_id = b.graph_id AND p.side = b.side AND p.node_id = node1 JOIN root q ON q.graph_id = b.graph_id AND q.side = b.side AND q.node_id = node2
  WHERE p.root <> q.root OR node1 = node2""")
def _(t):
    return rewrite.collapse_small_cycles(t.fx_branches, t.fx_nodes, KEYS, 150)[0]


@query("clean_graph")
def _(t):
    return rewrite.clean_graph(t.fx_branches, t.fx_nodes, KEYS, spurs=40, node=10, cycles=60, simplify="both")[0]


@query("clean_graph_by_width")
def _(t):
    return rewrite.clean_graph_by_width(t.fx_branches, t.fx_nodes, KEYS, 13)[0]


# --- matching

AB = "fx_nodes a JOIN fx_nodes b ON a.graph_id = b.graph_id AND a.side = 'pred' AND b.side = 'target'"
NEAREST = f"""near AS (SELECT graph_id, pred_node, target_node, distance FROM (SELECT a.graph_id, a.node_id AS pred_node, b.node_id AS target_node, {D12} AS distance,
  row_number() OVER (PARTITION BY a.graph_id, a.node_id ORDER BY {D12}, b.node_id) AS k FROM {AB}) WHERE k = 1),
  back AS (SELECT graph_id, pred_node, target_node FROM (SELECT a.graph_id, a.node_id AS pred_node, b.node_id AS target_node,
  row_number() OVER (PARTITION BY b.graph_id, b.node_id ORDER BY {D12}, a.node_id) AS k FROM {AB}) WHERE k = 1)"""


@query("cross_distance", f"SELECT a.graph_id, a.node_id AS pred_node, b.node_id AS target_node, round({D12}, 6) AS distance FROM {AB}")
def _(t):
    return match.cross_distance(*sides(t.fx_nodes), ["graph_id"]).withColumn("distance", r6("distance"))


@query("distance_matrix", f"SELECT a.graph_id, a.side, round(max({D12}), 6) AS diameter, count(*) AS n FROM fx_nodes a JOIN fx_nodes b USING (graph_id, side) GROUP BY ALL")
def _(t):
    return match.distance_matrix(t.fx_nodes, KEYS).groupBy(*KEYS).agg(r6(F.max("distance")).alias("diameter"), F.count("*").alias("n"))


@query("nearest_node", f"WITH {NEAREST} SELECT graph_id, pred_node, target_node, round(distance, 6) AS distance FROM near")
def _(t):
    out = match.nearest(*sides(saved(t.fx_nodes)), ["graph_id"])
    return out.withColumn("distance", r6("distance"))


@query("mutual_nearest", f"WITH {NEAREST} SELECT graph_id, pred_node, target_node, round(distance, 6) AS distance FROM near JOIN back USING (graph_id, pred_node, target_node) WHERE distance <= 20")
def _(t):
    out = match.mutual_nearest(match.cross_distance(*sides(t.fx_nodes), ["graph_id"], 20), ["graph_id"])
    return out.withColumn("distance", r6("distance"))


DENSITY = f"""dens AS (SELECT a.graph_id, a.side, a.node_id, (least(greatest(sum(CASE WHEN a.side = b.side THEN exp(-{D12} * {D12} / 800.0) ELSE 0 END) - 1, 0), 1)
  + least(sum(CASE WHEN a.side <> b.side THEN exp(-{D12} * {D12} / 800.0) ELSE 0 END), 1)) / 2 AS density FROM fx_nodes a JOIN fx_nodes b ON a.graph_id = b.graph_id GROUP BY ALL)"""


@query("node_density", f"WITH {DENSITY} SELECT graph_id, node_id, round(density, 6) AS density FROM dens WHERE side = 'pred'")
def _(t):
    return match.node_density(*sides(t.fx_nodes), ["graph_id"], 20.0).withColumn("density", r6("density"))


@query("match_limits", f"WITH {NEAREST}, {DENSITY} SELECT n.graph_id, pred_node AS node_id, round(least(greatest(40 * (1 - density), 2), 40), 6) AS max_distance FROM near n JOIN dens d ON d.graph_id = n.graph_id AND d.side = 'target' AND d.node_id = n.target_node")
def _(t):
    return match.match_limits(*sides(t.fx_nodes), ["graph_id"], 40, 20.0).withColumn("max_distance", r6("max_distance"))


@query("match_weights", f"SELECT graph_id, pred_node, target_node, round(m - d, 6) AS weight, round(20 - d, 6) AS gain FROM (SELECT a.graph_id, a.node_id AS pred_node, b.node_id AS target_node, {D12} AS d, max({D12}) OVER (PARTITION BY a.graph_id) AS m FROM {AB}) WHERE d < 20")
def _(t):
    out = match.match_weights(*sides(t.fx_nodes), ["graph_id"], 20).filter("gain > 0")
    return out.select("graph_id", "pred_node", "target_node", r6("weight").alias("weight"), r6("gain").alias("gain"))


def best_of(gains: str) -> str:
    """All choices of pairs that share no node, part by part of the pairs that gain, and the best of each part.

    ``gains`` selects (graph_id, p, q, d, g): a pair, its distance and its gain.
    """
    return f"""gains AS MATERIALIZED ({gains}),
  steps AS (SELECT DISTINCT x.graph_id, x.p AS a, y.p AS b FROM gains x JOIN gains y ON x.graph_id = y.graph_id AND x.q = y.q),
  reach AS (SELECT graph_id, a, b FROM steps UNION SELECT r.graph_id, r.a, s.b FROM reach r JOIN steps s ON s.graph_id = r.graph_id AND s.a = r.b),
  part AS (SELECT graph_id, a AS p, min(b) AS c FROM reach GROUP BY graph_id, a),
  listed AS MATERIALIZED (SELECT g.*, c, row_number() OVER (PARTITION BY g.graph_id, c ORDER BY d, g.p, q) AS k FROM gains g JOIN part USING (graph_id, p)),
  choice AS (SELECT DISTINCT graph_id, c, 0::BIGINT AS k, []::BIGINT[] AS ps, []::BIGINT[] AS qs, 0.0::DOUBLE AS total FROM listed
    UNION ALL SELECT x.graph_id, x.c, x.k + 1, CASE WHEN take THEN list_append(ps, l.p) ELSE ps END, CASE WHEN take THEN list_append(qs, l.q) ELSE qs END, total + CASE WHEN take THEN g ELSE 0 END
    FROM choice x JOIN listed l ON l.graph_id = x.graph_id AND l.c = x.c AND l.k = x.k + 1, (VALUES (true), (false)) v(take)
    WHERE NOT take OR NOT list_contains(ps, l.p) AND NOT list_contains(qs, l.q)),
  won AS (SELECT graph_id, arg_max(ps, total) AS ps, arg_max(qs, total) AS qs FROM choice GROUP BY graph_id, c),
  best AS MATERIALIZED (SELECT graph_id, unnest(ps) AS p, unnest(qs) AS q FROM won)"""


BEST = best_of(f"SELECT *, 20 - d AS g FROM (SELECT a.graph_id, a.node_id AS p, b.node_id AS q, {D12} AS d FROM {AB}) WHERE d < 20")
BEST_PAIRS = f"WITH RECURSIVE {BEST} SELECT graph_id, p AS pred_node, q AS target_node, round(d, 6) AS distance FROM best JOIN gains USING (graph_id, p, q)"
#: Limits of 20 that crowds around the nearest node opposite lessen.
CROWDED = f"""{NEAREST}, {DENSITY}, own_limit AS (
    SELECT graph_id, 'pred' AS side, pred_node AS node_id, least(greatest(20 * (1 - density), 1), 20) AS m FROM near JOIN dens USING (graph_id) WHERE dens.side = 'target' AND dens.node_id = target_node
    UNION ALL SELECT graph_id, 'target', target_node, least(greatest(20 * (1 - density), 1), 20) FROM back JOIN dens USING (graph_id) WHERE dens.side = 'pred' AND dens.node_id = pred_node),
  """ + best_of(f"""SELECT * FROM (SELECT a.graph_id, a.node_id AS p, b.node_id AS q, {D12} AS d, (lp.m + lq.m) / 2 - {D12} AS g FROM {AB}
    JOIN own_limit lp ON lp.graph_id = a.graph_id AND lp.side = 'pred' AND lp.node_id = a.node_id JOIN own_limit lq ON lq.graph_id = b.graph_id AND lq.side = 'target' AND lq.node_id = b.node_id) WHERE g > 0 AND d <= 20""")


@query("match_nodes", BEST_PAIRS)
def _(t):
    return match.match_nodes(*sides(saved(t.fx_nodes)), ["graph_id"], 20).withColumn("distance", r6("distance"))


@query("match_nodes_crowded", f"WITH RECURSIVE {CROWDED} SELECT graph_id, p AS pred_node, q AS target_node, round(d, 6) AS distance FROM best JOIN gains USING (graph_id, p, q)")
def _(t):
    return match.match_nodes(*sides(saved(t.fx_nodes)), ["graph_id"], 20, 20.0).withColumn("distance", r6("distance"))


@query("assign_component", BEST_PAIRS)
def _(t):
    gains = saved(match.match_gains(*sides(t.fx_nodes), ["graph_id"], 20))
    return match.assign_component(match.gain_parts(gains, ["graph_id"]), ["graph_id"]).withColumn("distance", r6("distance"))


@query("greedy_match", f"""WITH pairs AS (SELECT a.graph_id, a.node_id AS p, b.node_id AS q, {D12} AS d FROM {AB}),
  listed AS (SELECT graph_id, list({{'p': p, 'q': q, 'd': d}} ORDER BY d, p, q) AS xs FROM pairs WHERE d < 20 GROUP BY graph_id),
  taken AS (SELECT graph_id, unnest(list_reduce(list_transform(xs, lambda x: [x]), lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: y.p = x[1].p OR y.q = x[1].q)) > 0 THEN acc ELSE list_concat(acc, x) END)) AS x FROM listed)
  SELECT graph_id, x.p AS pred_node, x.q AS target_node, round(x.d, 6) AS distance FROM taken""")
def _(t):
    out = match.greedy_match(match.match_gains(*sides(t.fx_nodes), ["graph_id"], 20), ["graph_id"])
    return out.withColumn("distance", r6("distance"))


def _same(t):
    """Nodes with one id on both sides, as a match."""
    pred, target = sides(t.fx_nodes.select("graph_id", "side", "node_id"))
    both = pred.join(target, ["graph_id", "node_id"]).filter("node_id % 3 <> 0")
    return saved(both.select("graph_id", F.col("node_id").alias("pred_node"), F.col("node_id").alias("target_node")))


@query("semi_anti_nodes", """SELECT a.graph_id, a.node_id, EXISTS (SELECT 1 FROM fx_nodes b WHERE b.side = 'target' AND b.graph_id = a.graph_id AND b.node_id = a.node_id)
  AND a.node_id % 3 <> 0 AS matched FROM fx_nodes a WHERE a.side = 'pred'""")
def _(t):
    pred, _ = sides(t.fx_nodes)
    hit, miss = match.split_matched(pred, _same(t), ["graph_id"], "pred_node")
    return hit.select("graph_id", "node_id", F.lit(True).alias("matched")).unionByName(miss.select("graph_id", "node_id", F.lit(False).alias("matched")))


# --- paths

HOPS = """stop AS (SELECT a.graph_id, a.node_id FROM fx_nodes a JOIN fx_nodes b ON a.graph_id = b.graph_id AND a.node_id = b.node_id AND a.side = 'pred' AND b.side = 'target' WHERE a.node_id % 3 <> 0),
  s AS (SELECT graph_id, side, node1 AS p, node2 AS q FROM fx_branches UNION SELECT graph_id, side, node2, node1 FROM fx_branches),
  walk AS (SELECT s.graph_id, s.side, s.p AS source, s.q AS node, 1 AS hops FROM s JOIN stop ON stop.graph_id = s.graph_id AND stop.node_id = s.p
  UNION SELECT w.graph_id, w.side, w.source, s.q, w.hops + 1 FROM walk w JOIN s ON s.graph_id = w.graph_id AND s.side = w.side AND s.p = w.node
  WHERE w.hops < 30 AND w.node <> w.source AND s.q <> w.source AND NOT EXISTS (SELECT 1 FROM stop WHERE stop.graph_id = w.graph_id AND stop.node_id = w.node)),
  hop AS (SELECT graph_id, side, source, node, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY ALL)"""


def _paths(t):
    ids = _same(t).select("graph_id", F.col("pred_node").alias("node_id"))
    return [paths.unmatched_paths(b, ids, ["graph_id"]) for b in sides(t.fx_branches)]


#: The links between nodes, the ways by hops, and of the shortest ones the one with the smallest branches, step by step.
WAYS = """lk AS MATERIALIZED (SELECT graph_id, side, p, q, min(branch_id) AS branch_id FROM (SELECT graph_id, side, node1 AS p, node2 AS q, branch_id FROM fx_branches
    UNION ALL SELECT graph_id, side, node2, node1, branch_id FROM fx_branches) GROUP BY ALL),
  way AS (SELECT l.graph_id, l.side, p AS source, q AS node, 1::BIGINT AS hops, [branch_id] AS path FROM lk l JOIN stop ON stop.graph_id = l.graph_id AND stop.side = l.side AND stop.node_id = l.p
  UNION ALL SELECT w.graph_id, w.side, w.source, l.q, w.hops + 1, min(list_append(w.path, l.branch_id)) FROM way w
  JOIN lk l ON l.graph_id = w.graph_id AND l.side = w.side AND l.p = w.node
  JOIN hop h ON h.graph_id = w.graph_id AND h.side = w.side AND h.source = w.source AND h.node = l.q AND h.hops = w.hops + 1
  WHERE w.node <> w.source AND l.q <> w.source AND NOT EXISTS (SELECT 1 FROM stop WHERE stop.graph_id = w.graph_id AND stop.side = w.side AND stop.node_id = w.node)
  GROUP BY w.graph_id, w.side, w.source, l.q, w.hops + 1)"""
#: The same node ids on both sides as matches; pair is what a match is called on both sides.
SAME = """stop AS MATERIALIZED (SELECT a.graph_id, s.side, a.node_id, a.node_id AS pair FROM fx_nodes a JOIN fx_nodes b ON a.graph_id = b.graph_id AND a.node_id = b.node_id
  AND a.side = 'pred' AND b.side = 'target', (VALUES ('pred'), ('target')) s(side) WHERE a.node_id % 3 <> 0)"""
MATCHED = BEST + """, stop AS MATERIALIZED (SELECT graph_id, 'pred' AS side, p AS node_id, p AS pair FROM best UNION ALL SELECT graph_id, 'target', q, p FROM best)"""
BY_HOPS = """s AS MATERIALIZED (SELECT graph_id, side, node1 AS p, node2 AS q FROM fx_branches UNION SELECT graph_id, side, node2, node1 FROM fx_branches),
  walk AS (SELECT s.graph_id, s.side, s.p AS source, s.q AS node, 1 AS hops FROM s JOIN stop ON stop.graph_id = s.graph_id AND stop.side = s.side AND stop.node_id = s.p
  UNION SELECT w.graph_id, w.side, w.source, s.q, w.hops + 1 FROM walk w JOIN s ON s.graph_id = w.graph_id AND s.side = w.side AND s.p = w.node
  WHERE w.hops < 30 AND w.node <> w.source AND s.q <> w.source AND NOT EXISTS (SELECT 1 FROM stop WHERE stop.graph_id = w.graph_id AND stop.side = w.side AND stop.node_id = w.node)),
  hop AS MATERIALIZED (SELECT graph_id, side, source, node, CAST(min(hops) AS BIGINT) AS hops FROM walk GROUP BY ALL)"""
#: Pairs of matches that both graphs link, with both ways.
LINKED = WAYS + """, ends AS (SELECT w.graph_id, w.side, a.pair AS x, b.pair AS y, w.hops, w.path FROM way w JOIN stop a ON a.graph_id = w.graph_id AND a.side = w.side AND a.node_id = w.source
    JOIN stop b ON b.graph_id = w.graph_id AND b.side = w.side AND b.node_id = w.node),
  both_ AS MATERIALIZED (SELECT p.graph_id, p.hops AS hp, t.hops AS ht, p.path AS pp, t.path AS pt FROM ends p JOIN ends t ON p.side = 'pred' AND t.side = 'target' AND t.graph_id = p.graph_id AND t.x = p.x AND t.y = p.y),
  used AS MATERIALIZED (SELECT graph_id, 'pred' AS side, unnest(pp) AS branch_id, CASE WHEN hp = 1 AND ht = 1 THEN 1 WHEN ht = 1 THEN 2 WHEN hp = 1 THEN 3 ELSE 0 END AS l FROM both_
    UNION ALL SELECT graph_id, 'target', unnest(pt), CASE WHEN hp = 1 AND ht = 1 THEN 1 WHEN hp = 1 THEN 2 WHEN ht = 1 THEN 3 ELSE 0 END FROM both_),
  label AS (SELECT graph_id, side, branch_id, max(l) AS l FROM used GROUP BY ALL)"""
EDITS = f"""{MATCHED}, {BY_HOPS}, {LINKED}, each AS (SELECT b.graph_id, b.side, CASE WHEN l IS NULL THEN 1 ELSE 0 END AS lone FROM fx_branches b LEFT JOIN label USING (graph_id, side, branch_id)),
  edits AS (SELECT graph_id, count(*) FILTER (side = 'pred') AS n_pred, count(*) FILTER (side = 'target') AS n_target,
  CAST(coalesce(sum(lone) FILTER (side = 'pred'), 0) AS BIGINT) AS diff_pred, CAST(coalesce(sum(lone) FILTER (side = 'target'), 0) AS BIGINT) AS diff_target FROM each GROUP BY graph_id)"""


@query("unmatched_paths", f"WITH RECURSIVE {SAME}, {BY_HOPS}, {WAYS} SELECT graph_id, side, source, node, hops, array_to_string(path, ',') AS path FROM way")
def _(t):
    p, q = _paths(t)
    both = p.withColumn("side", F.lit("pred")).unionByName(q.withColumn("side", F.lit("target")))
    return both.select("graph_id", "side", "source", "node", "hops", F.concat_ws(",", F.col("path").cast("array<string>")).alias("path"))


@query("backtrack_paths", f"""WITH RECURSIVE {SAME}, {BY_HOPS}, {WAYS} SELECT graph_id, source, node, CAST(unnest(range(len(path))) AS INT) AS step, unnest(path) AS branch_id FROM way WHERE side = 'pred'""")
def _(t):
    return paths.backtrack_paths(_paths(t)[0], ["graph_id"])


ADJ = HOPS + """, adj AS (SELECT p.graph_id, p.source, p.node, p.hops AS hops_pred, t.hops AS hops_target FROM hop p JOIN hop t ON p.side = 'pred' AND t.side = 'target'
  AND t.graph_id = p.graph_id AND t.source = p.source AND t.node = p.node JOIN stop ON stop.graph_id = p.graph_id AND stop.node_id = p.node)"""


@query("matched_adjacency", f"""WITH RECURSIVE {ADJ} SELECT graph_id, source, node, hops_pred, hops_target,
  CASE WHEN hops_pred = 1 AND hops_target = 1 THEN 'valid' WHEN hops_target = 1 THEN 'split' WHEN hops_pred = 1 THEN 'fused' ELSE 'both' END AS kind FROM adj""")
def _(t):
    pred, target = sides(t.fx_branches)
    return paths.adjacency_of(pred, target, _same(t), ["graph_id"]).select("graph_id", "source", "node", "hops_pred", "hops_target", "kind")


@query("label_edge_diff", f"WITH RECURSIVE {SAME}, {BY_HOPS}, {LINKED} SELECT b.graph_id, b.side, b.branch_id, CAST(coalesce(l, 0) AS INT) AS label FROM fx_branches b LEFT JOIN label USING (graph_id, side, branch_id)")
def _(t):
    pred, target = sides(t.fx_branches)
    adjacency = paths.adjacency_of(pred, target, _same(t), ["graph_id"])
    out = [paths.label_edge_diff(b, adjacency, ["graph_id"], k).withColumn("side", F.lit(k)) for b, k in ((pred, "pred"), (target, "target"))]
    return out[0].unionByName(out[1])


@query("unique_branches", f'WITH RECURSIVE {SAME}, {BY_HOPS}, {LINKED} SELECT b.graph_id, b.side, b.branch_id, CAST(CASE WHEN l IS NULL THEN 1 ELSE 0 END AS INT) AS "unique" FROM fx_branches b LEFT JOIN label USING (graph_id, side, branch_id)')
def _(t):
    pred, target = sides(t.fx_branches)
    adjacency = paths.adjacency_of(pred, target, _same(t), ["graph_id"])
    out = [paths.unique_branches(b, adjacency, ["graph_id"], k).withColumn("side", F.lit(k)) for b, k in ((pred, "pred"), (target, "target"))]
    return out[0].unionByName(out[1])


def edits(t):
    (bp, bt), (np_, nt) = sides(saved(t.fx_branches)), sides(saved(t.fx_nodes))
    return paths.edit_distance(bp, np_, bt, nt, ["graph_id"], 20)


@query("edit_distance", f"WITH RECURSIVE {EDITS} SELECT * FROM edits")
def _(t):
    return edits(t)


@query("edit_distance_crowded", f"WITH RECURSIVE {EDITS.replace(BEST, CROWDED)} SELECT * FROM edits")
def _(t):
    part = [saved(d) for pair in zip(sides(t.fx_branches), sides(t.fx_nodes), strict=True) for d in pair]
    return paths.edit_distance(*part, ["graph_id"], 20, 20.0)
