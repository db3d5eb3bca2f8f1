"""Queries of scores, kernels, weights, spectra, streams and user functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from filigree.functions import models
from filigree.functions.geometry import border_guard
from filigree.operators import kernels, metrics
from filigree.sources.scratch import saved
from filigree.streaming import metrics as streams

from .graphs import EDITS, edits
from .registry import query


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


PRS = ("precision", "recall", "score")
COUNTS = """counts AS (SELECT image_id, sum(sp * t) AS correct_pred, sum(sp) AS total_pred, sum(st * p) AS correct_target, sum(st) AS total_target FROM (
  SELECT image_id, y, x, max(CASE WHEN layer = 'pred' THEN 1 ELSE 0 END) AS p, max(CASE WHEN layer = 'target' THEN 1 ELSE 0 END) AS t,
  max(CASE WHEN layer = 'skel_pred' THEN 1 ELSE 0 END) AS sp, max(CASE WHEN layer = 'skel_target' THEN 1 ELSE 0 END) AS st FROM fx_masks GROUP BY ALL) GROUP BY image_id),
  total AS (SELECT sum(correct_pred) AS a, sum(total_pred) AS b, sum(correct_target) AS c, sum(total_target) AS d FROM counts)"""
MICRO = COUNTS + ", pr AS (SELECT a / (b + 1e-6) AS p, c / (d + 1e-6) AS r FROM total)"
MICRO_SELECT = "SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r + 1e-6), 6) AS score FROM pr"
MACRO = COUNTS + ", pr AS (SELECT correct_pred / (total_pred + 1e-6) AS p, correct_target / (total_target + 1e-6) AS r FROM counts)"
MACRO_SELECT = "SELECT round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(2 * p * r / (p + r + 1e-6)), 6) AS score FROM pr"


@query("cl_counts", f"WITH {COUNTS} SELECT image_id, CAST(correct_pred AS BIGINT) AS correct_pred, CAST(total_pred AS BIGINT) AS total_pred, CAST(correct_target AS BIGINT) AS correct_target, CAST(total_target AS BIGINT) AS total_target FROM counts")
def _(t):
    return metrics.cl_counts(t.fx_masks)


@query("cl_dice", f"WITH {MICRO} {MICRO_SELECT}")
def _(t):
    return metrics.micro(metrics.cl_counts(t.fx_masks)).withColumns(r6(*PRS))


@query("mean_cl_dice", f"WITH {MACRO} {MACRO_SELECT}")
def _(t):
    return metrics.macro(metrics.cl_counts(t.fx_masks)).withColumns(r6(*PRS))


@query("custom_metric", f"WITH {MACRO} {MACRO_SELECT}")
def _(t):
    return metrics.custom_metric("mean_cl_dice", t.fx_masks).withColumns(r6(*PRS))


@query("metric_report", f"WITH {MICRO}, one AS ({MICRO_SELECT}) SELECT unnest(['precision', 'recall', 'score']) AS name, unnest([precision, recall, score]) AS value FROM one")
def _(t):
    return metrics.metric_report(metrics.micro(metrics.cl_counts(t.fx_masks)).withColumns(r6(*PRS)))


TOPO = f"""{EDITS}, counts AS (SELECT graph_id, n_pred - diff_pred AS correct_pred, n_pred AS total_pred, n_target - diff_target AS correct_target, n_target AS total_target FROM edits)"""
TOPO_MICRO = f"{TOPO}, pr AS (SELECT sum(correct_pred) / (sum(total_pred) + 1e-6) AS p, sum(correct_target) / (sum(total_target) + 1e-6) AS r FROM counts)"
TOPO_EACH = f"{TOPO}, pr AS (SELECT graph_id, correct_pred / (total_pred + 1e-6) AS p, correct_target / (total_target + 1e-6) AS r FROM counts)"


@query("topo_counts", f"WITH RECURSIVE {TOPO} SELECT * FROM counts")
def _(t):
    return metrics.topo_counts(edits(t), ["graph_id"])


@query("topo_report", f"WITH RECURSIVE {TOPO_EACH} {MICRO_SELECT.replace('SELECT', 'SELECT graph_id,')}")
def _(t):
    return metrics.topo_report(edits(t), ["graph_id"]).withColumns(r6(*PRS))


@query("f1_topo", f"WITH RECURSIVE {TOPO_MICRO} {MICRO_SELECT}")
def _(t):
    return metrics.micro(metrics.topo_counts(edits(t), ["graph_id"])).withColumns(r6(*PRS))


@query("mean_f1_topo", f"WITH RECURSIVE {TOPO_EACH} {MACRO_SELECT}")
def _(t):
    return metrics.macro(metrics.topo_counts(edits(t), ["graph_id"])).withColumns(r6(*PRS))


@query("weighted_score", f"""WITH RECURSIVE {TOPO_MICRO}, {MICRO.replace("counts", "dice").replace("total AS", "dice_total AS").replace("FROM total)", "FROM dice_total)").replace("pr AS", "dice_pr AS")},
  two AS (SELECT 2 * d.p * d.r / (d.p + d.r + 1e-6) AS first, 2 * pr.p * pr.r / (pr.p + pr.r + 1e-6) AS second FROM dice_pr d, pr)
  SELECT round(first, 6) AS first, round(second, 6) AS second, round(0.5 * first + 0.5 * second, 6) AS score FROM two""")
def _(t):
    dice, topo = metrics.micro(metrics.cl_counts(t.fx_masks)), metrics.micro(metrics.topo_counts(edits(t), ["graph_id"]))
    return metrics.weighted_score(dice, topo).withColumns(r6("first", "second", "score"))


@query("distinct_rows", "SELECT node1, node2, count(*) AS n FROM fx_branches GROUP BY ALL")
def _(t):
    return metrics.distinct_rows(t.fx_branches, ["node1", "node2"])


# --- weights and kernels


@query("weight_quantiles", """SELECT kernel_id, round(quantile_cont(w, 0.5), 6) AS median, round(quantile_cont(w, 0.625), 6) AS q0, round(quantile_cont(w, 0.375), 6) AS minus_q0,
  round(quantile_cont(w, 0.75), 6) AS q1, round(quantile_cont(w, 0.25), 6) AS minus_q1, round(quantile_cont(w, 0.875), 6) AS q2, round(quantile_cont(w, 0.125), 6) AS minus_q2 FROM fx_weights GROUP BY kernel_id""")
def _(t):
    out = kernels.weight_quantiles(t.fx_weights)
    return out.withColumns(r6(*[c for c in out.columns if c != "kernel_id"]))


@query("weight_histogram", """WITH e AS (SELECT min(w) AS lo, max(w) AS hi FROM fx_weights), b AS (SELECT kernel_id, CAST(least(greatest(
  (SELECT count(*) FROM (SELECT unnest(range(1, 19)) AS i) WHERE w >= lo + (hi - lo) * i / 19.0), 0), 18) AS BIGINT) AS bin FROM fx_weights, e)
  SELECT kernel_id, bin, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY kernel_id), 6) AS density FROM b GROUP BY kernel_id, bin""")
def _(t):
    return kernels.weight_histogram(t.fx_weights, 20).withColumns(r6("density"))


@query("weight_summary", "SELECT kernel_id, k, r, type, round(avg(w), 6) AS mean, round(stddev_pop(w), 6) AS std FROM fx_weights GROUP BY ALL")
def _(t):
    return kernels.weight_summary(t.fx_weights).withColumns(r6("mean", "std"))


PAIRS = "pairs AS (SELECT sample_id, k, r, max(CASE WHEN type = 'R' THEN w END) AS re, max(CASE WHEN type = 'I' THEN w END) AS im FROM fx_weights GROUP BY ALL)"


@query("pair_complex", f"WITH {PAIRS} SELECT sample_id, k, r, round(re, 6) AS re, round(im, 6) AS im FROM pairs")
def _(t):
    return kernels.pair_complex(t.fx_weights).withColumns(r6("re", "im"))


@query("flatten_complex", f"WITH {PAIRS} SELECT sample_id, k, r, round(sqrt(re * re + im * im), 6) AS norm, round(atan2(im, re), 6) AS angle FROM pairs")
def _(t):
    norm = kernels.flatten_complex(t.fx_weights).withColumnRenamed("w", "norm")
    angle = kernels.flatten_complex(t.fx_weights, "angle").withColumnRenamed("w", "angle")
    return norm.join(angle, ["sample_id", "k", "r"]).withColumns(r6("norm", "angle"))


def _kernel(t):
    """Each embedding as a kernel of 8 x 8."""
    w = t.fx_weights
    return w.select(F.col("sample_id").alias("kernel_id"), (F.floor(F.col("kernel_id") / 8) - 4).cast("int").alias("dy"), (F.col("kernel_id") % 8 - 4).alias("dx"), "w", "label")


KERNEL = "kernel AS (SELECT sample_id AS kernel_id, kernel_id // 8 - 4 AS dy, kernel_id % 8 - 4 AS dx, w, label FROM fx_weights)"


@query("normalize_kernels", f"WITH {KERNEL} SELECT kernel_id, dy, dx, round(w / (sqrt(sum(w * w) OVER (PARTITION BY kernel_id)) + 1e-8), 6) AS w FROM kernel")
def _(t):
    return kernels.normalize_kernels(_kernel(t).drop("label")).withColumns(r6("w"))


@query("kernel_radius", f"WITH {KERNEL} SELECT kernel_id, max(greatest(abs(dy), abs(dx))) AS radius FROM (SELECT *, max(abs(w)) OVER (PARTITION BY kernel_id) AS m FROM kernel) WHERE abs(w) / m >= 0.5 GROUP BY kernel_id")
def _(t):
    return kernels.kernel_radius(_kernel(t), 0.5)


def _base(t):
    k = _kernel(t)
    weights = k.groupBy("kernel_id").agg((F.max("label") % 2).alias("o")).select("kernel_id", "o", F.lit(0).alias("i"), (F.col("kernel_id") % 5).cast("double").alias("weight"))
    return weights, k.drop("label")


@query("compose_kernels", f"WITH {KERNEL} SELECT label % 2 AS o, 0 AS i, dy, dx, round(sum(w * (kernel_id % 5)), 6) AS w FROM kernel GROUP BY ALL")
def _(t):
    return kernels.compose_kernels(*_base(t)).withColumns(r6("w"))


@query("apply_composed", f"""WITH {KERNEL}, c AS (SELECT label % 2 AS o, dy, dx, sum(w * (kernel_id % 5)) AS w FROM kernel GROUP BY ALL)
  SELECT image_id, o, y + dy AS y, x + dx AS x, round(sum(w), 5) AS v FROM fx_pixels, c GROUP BY ALL""")
def _(t):
    weights, kernel = _base(t)
    values = t.fx_pixels.select("image_id", "y", "x", F.lit(0).alias("i"), F.lit(1.0).alias("v"))
    out = kernels.apply_composed(values, weights, kernel)
    return out.withColumn("v", F.round("v", 5))


@query("radial_kernel", """WITH ring AS (SELECT dy, dx, CASE WHEN dy = 0 AND dx = 0 THEN 0 ELSE exp(-pow(sqrt(dy * dy + dx * dx) - 1.5, 2) / 0.5) / (0.5 * sqrt(2 * pi())) END AS a
  FROM (SELECT unnest(range(5)) - 2 AS dy), (SELECT unnest(range(5)) - 2 AS dx)),
  kernel AS (SELECT dy, dx, a * cos(atan2(dx, dy)) / (sqrt(sum(a * a) OVER ()) + 1e-8) AS w FROM ring)
  SELECT image_id, 0 AS o, y + dy AS y, x + dx AS x, round(sum(w), 5) + 0.0 AS v FROM fx_pixels, kernel GROUP BY ALL""")
def _(t):
    ring = kernels.radial_kernel(t.spark, 5, 1, 1.5, normalize="square")
    kernel = ring.select(F.lit(0).alias("kernel_id"), (F.col("y") - 2).cast("int").alias("dy"), (F.col("x") - 2).cast("int").alias("dx"), F.col("re").alias("w"))
    weights = t.spark.range(1).select(*[F.lit(0).alias(c) for c in ("o", "i", "kernel_id")], F.lit(1.0).alias("weight"))
    values = t.fx_pixels.select("image_id", "y", "x", F.lit(0).alias("i"), F.lit(1.0).alias("v"))
    return kernels.apply_composed(values, weights, kernel).withColumn("v", F.round("v", 5))


@query("ridge_fit", """WITH s AS (SELECT sum(w * w) + 0.1 AS a, sum(w * x) AS b, sum(x * x) + 0.1 AS c, sum(w * h) AS p, sum(x * h) AS q FROM fx_rects)
  SELECT 'w' AS name, round((p * c - q * b) / (a * c - b * b), 6) AS value FROM s UNION ALL SELECT 'x', round((a * q - b * p) / (a * c - b * b), 6) FROM s""")
def _(t):
    found = kernels.ridge_fit(t.fx_rects, ["w", "x"], ["h"])["h"]
    return t.spark.createDataFrame(list(zip(("w", "x"), found, strict=True)), "name string, value double").withColumns(r6("value"))


@query("ridge_quality", "SELECT round(sum(pow(h - w * 0.5, 2)) / count(*), 6) AS mse, round(1 - sum(pow(h - w * 0.5, 2)) / (var_pop(h) * count(*)), 6) AS r2 FROM fx_rects")
def _(t):
    rows = t.fx_rects.withColumn("p", F.col("w") * 0.5)
    return kernels.ridge_quality(rows, "h", "p").withColumns(r6("mse", "r2"))


POWER = """cell AS (SELECT image_id, theta, y, x, sum(v) AS v FROM fx_stack GROUP BY ALL), part AS (SELECT image_id, y, x, f AS frequency,
  sum(v * cos(2 * pi() * f * theta / 8)) AS re, sum(v * sin(2 * pi() * f * theta / 8)) AS im FROM cell, (SELECT unnest(range(8)) AS f) GROUP BY ALL),
  power AS (SELECT image_id, frequency, sum(re * re + im * im) AS power FROM part GROUP BY ALL)"""


@query("spectral_power", f"WITH {POWER} SELECT image_id, frequency, round(power, 4) AS power FROM power")
def _(t):
    return kernels.spectral_power(t.fx_stack, 8).withColumn("power", F.round("power", 4))


@query("spectral_share", f"WITH {POWER} SELECT image_id, frequency, round(power / sum(power) OVER (PARTITION BY image_id), 6) AS share FROM power WHERE frequency <= 4")
def _(t):
    out = kernels.spectral_share(kernels.spectral_power(t.fx_stack, 8), 8)
    return out.select("image_id", "frequency", F.round("share", 6).alias("share"))


@query("spectral_power_disk", f"WITH {POWER.replace('FROM fx_stack', 'FROM fx_stack WHERE 2 * sqrt(pow(y - 3.5, 2) + pow(x - 3.5, 2)) <= 8')} SELECT image_id, frequency, round(power, 4) AS power FROM power")
def _(t):
    return kernels.spectral_power(t.fx_stack.filter(kernels.disk(8)), 8).withColumn("power", F.round("power", 4))


@query("sort_by_share", f"WITH {POWER} SELECT image_id, frequency, round(power, 4) AS power FROM power WHERE frequency = 0 ORDER BY power DESC")
def _(t):
    return kernels.sort_by_share(kernels.spectral_power(t.fx_stack, 8)).withColumn("power", F.round("power", 4))


# --- streams


def _stream(t, df, files: int = 2):
    """A table as a stream of files, dealt out by a hash of whole rows, so that what belongs together comes apart."""
    df = saved(df.repartition(6, F.xxhash64(*df.columns)))
    return t.spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(df._scratch)


@query("stream_cl_dice", f"WITH {MICRO} {MICRO_SELECT}")
def _(t):
    return streams.stream_cl_dice(_stream(t, t.fx_masks)).withColumns(r6(*PRS))


@query("stream_mean_metric", f"WITH {MACRO} {MACRO_SELECT}")
def _(t):
    return streams.stream_mean_cl_dice(_stream(t, t.fx_masks)).withColumns(r6(*PRS))


@query("stream_f1_topo", f"WITH RECURSIVE {TOPO_MICRO} {MICRO_SELECT}")
def _(t):
    from filigree.operators import paths

    branches = t.fx_branches.select("graph_id", "side", F.lit("branch").alias("kind"), F.col("branch_id").alias("id"), "node1", "node2", F.lit(None).cast("double").alias("y"), F.lit(None).cast("double").alias("x"))
    none = F.lit(None).cast("long")
    nodes = t.fx_nodes.select("graph_id", "side", F.lit("node").alias("kind"), F.col("node_id").alias("id"), none.alias("node1"), none.alias("node2"), "y", "x")

    def counts(rows):
        rows = saved(rows)
        part = []
        for side in ("pred", "target"):
            own = rows.filter(F.col("side") == side)
            part.append(own.filter("kind = 'branch'").select("graph_id", F.col("id").alias("branch_id"), "node1", "node2"))
            part.append(own.filter("kind = 'node'").select("graph_id", F.col("id").alias("node_id"), "y", "x"))
        return metrics.topo_counts(paths.edit_distance(*part, ["graph_id"], 20), ["graph_id"])

    stream = _stream(t, branches.unionByName(nodes), 3)
    return streams.stream_f1_topo_rows(stream, ["graph_id"], counts).withColumns(r6(*PRS))


# --- user functions


@query("node_predicate", """SELECT graph_id, side, node_id FROM fx_nodes WHERE (y - 128) * (y - 128) + (x - 128) * (x - 128) < 93 * 93 AND y > 35 AND y < 221 AND x > 35 AND x < 221""")
def _(t):
    return models.node_predicate(t.fx_nodes, border_guard(F.col("y"), F.col("x"), 256, 256, 35)).select("graph_id", "side", "node_id")


def _red_model():
    """A stand-in for a trained network: the red channel is the score."""
    return lambda x: x[:, 2]


@query("predict_masks", "SELECT image_id, y, x FROM fx_image WHERE r / 255.0 > 0.5")
def _(t):
    return models.predict_masks(t.fx_image, 48, 48, _red_model, roi=None)
