"""Scores of masks and graphs against their targets, over all images or per image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .raster import CELL, KEY

EPS = 1e-6


def cl_counts(layers: DataFrame) -> DataFrame:
    """(image, correct_pred, total_pred, correct_target, total_target) of layers pred, target, skel_pred, skel_target.

    Correct is what of one side's skeleton lies in the other side's mask. Images without any layer are absent.
    """
    has = lambda k: F.max(F.when(F.col("layer") == k, 1).otherwise(0))
    cells = layers.groupBy(*CELL).agg(*[has(k).alias(k) for k in ("pred", "target", "skel_pred", "skel_target")])
    s = lambda c: F.sum(c).cast("long")
    return cells.groupBy(KEY).agg(
        s(F.col("skel_pred") * F.col("target")).alias("correct_pred"), s(F.col("skel_pred")).alias("total_pred"),
        s(F.col("skel_target") * F.col("pred")).alias("correct_target"), s(F.col("skel_target")).alias("total_target"),
    )


def f_score(correct_pred: Column, total_pred: Column, correct_target: Column, total_target: Column, eps: float = EPS) -> list[Column]:
    """precision, recall and score."""
    precision, recall = correct_pred / (total_pred + eps), correct_target / (total_target + eps)
    return [precision.alias("precision"), recall.alias("recall"), (2 * precision * recall / (precision + recall + eps)).alias("score")]


COUNTS = ("correct_pred", "total_pred", "correct_target", "total_target")


def micro(counts: DataFrame) -> DataFrame:
    """precision, recall and score of the sums over all images or graphs."""
    return counts.agg(*[F.sum(c).alias(c) for c in COUNTS]).select(*f_score(*[F.col(c) for c in COUNTS]))


def macro(counts: DataFrame) -> DataFrame:
    """Means of precision, recall and score of each image or graph."""
    each = counts.select(*f_score(*[F.col(c) for c in COUNTS]))
    return each.agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "score")])


def topo_counts(edits: DataFrame, keys: list[str]) -> DataFrame:
    """The counts of edit distances: branches of each side that the other has too."""
    return edits.select(*keys, (F.col("n_pred") - F.col("diff_pred")).alias("correct_pred"), F.col("n_pred").alias("total_pred"),
        (F.col("n_target") - F.col("diff_target")).alias("correct_target"), F.col("n_target").alias("total_target"))


def topo_report(edits: DataFrame, keys: list[str]) -> DataFrame:
    """precision, recall and score of each pair of graphs."""
    counts = topo_counts(edits, keys)
    return counts.select(*keys, *f_score(*[F.col(c) for c in COUNTS]))


def weighted_score(first: DataFrame, second: DataFrame, a: float = 0.5) -> DataFrame:
    """a times the first score and 1 - a times the second; both have one row."""
    x, y = first.select(F.col("score").alias("first")), second.select(F.col("score").alias("second"))
    return x.crossJoin(y).select("first", "second", (a * F.col("first") + (1 - a) * F.col("second")).alias("score"))


def metric_report(scores: DataFrame) -> DataFrame:
    """(name, value) rows of a table with one row of scores."""
    names = scores.columns
    return scores.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{n}', `{n}`" for n in names) + ") as (name, value)"))


def distinct_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """Each different row with how often it occurs."""
    return df.groupBy(*columns).agg(F.count("*").alias("n"))


def component_sizes(labelled: DataFrame, keys: list[str]) -> DataFrame:
    return labelled.groupBy(*keys, "component").agg(F.count("*").alias("n"))


#: Named metrics: the counts of an input, and how they are turned into scores.
METRICS: dict[str, tuple] = {"cl_dice": (cl_counts, micro), "mean_cl_dice": (cl_counts, macro)}


def custom_metric(name: str, data: DataFrame, registry: dict[str, tuple] = METRICS) -> DataFrame:
    counts, score = registry[name]
    return score(counts(data))
