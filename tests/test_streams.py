"""Streams whose images and graphs arrive in pieces give what a batch gives."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from filigree.operators import metrics
from filigree.streaming import metrics as streams

LAYERS = "image_id long, layer string, y int, x int"


def pieces(spark, tmp_path, rows, schema, files):
    """The rows as a stream of so many files, one a batch, in the order given."""
    size = -(-len(rows) // files)
    for k in range(files):
        spark.createDataFrame(rows[k * size : (k + 1) * size], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def random_layers(seed):
    rng = random.Random(seed)
    rows = [(k, layer, rng.randrange(-10, 90), rng.randrange(70)) for k in range(4) for layer in streams.LAYERS for _ in range(900)]
    rows += [(7, "pred", 1, 1)]  # an image of one mask
    return rows


@pytest.mark.parametrize("order", ["shuffled", "layer by layer"])
def test_layers_in_pieces(spark, tmp_path, order):
    rows = random_layers(1)
    batch = metrics.cl_counts(spark.createDataFrame(rows, LAYERS))
    want = {r["image_id"]: tuple(r[c] for c in streams.COUNTS) for r in batch.collect()}
    rows += rows[:500] + [(1, "other", 1, 1), (1, None, 1, 1), (2, "pred", None, 1), (None, "pred", 1, 1)]
    random.Random(2).shuffle(rows)
    if order != "shuffled":
        rows.sort(key=lambda r: str(r[1]))
    stream = pieces(spark, tmp_path, rows, LAYERS, 4)
    got = {r["image_id"]: tuple(r[c] for c in streams.COUNTS) for r in streams.assembled(stream).collect()}
    assert got == want
    if order == "shuffled":
        for ours, theirs in ((streams.stream_cl_dice(stream), metrics.micro(batch)), (streams.stream_mean_cl_dice(stream), metrics.macro(batch))):
            assert tuple(ours.first()) == pytest.approx(tuple(theirs.first()))


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda minute: datetime.datetime(2024, 1, 1, 12, minute)
    schema = LAYERS + ", seen timestamp"
    # One batch a line; Spark drops by the watermark that the batch before already had.
    rows = [(1, "skel_pred", 0, k, at(0)) for k in range(3)]
    rows += [(1, "skel_pred", 0, 3, at(0)), (2, "skel_pred", 0, 0, at(30)), (1, "target", 0, 0, at(29))]
    rows += [(2, "target", 5, k, at(30)) for k in range(3)]
    rows += [(1, "target", 0, 1, at(1)), (2, "target", 0, 0, at(28)), (2, "target", 6, 6, at(30))]  # the first half an hour late
    stream = pieces(spark, tmp_path, rows, schema, 4)
    got = {r["image_id"]: (r["total_pred"], r["correct_pred"]) for r in streams.assembled(stream, "seen", 600).collect()}
    assert got == {1: (4, 1), 2: (1, 1)}


def test_graphs_in_pieces(spark, tmp_path):
    """Each batch counts the graphs that it touches anew, from their distinct rows so far."""
    rows = [(g, k) for g in range(5) for k in range(3 + g)]
    rows += rows[:4]
    random.Random(3).shuffle(rows)
    stream = pieces(spark, tmp_path, rows, "graph_id long, id long", 4)

    def counts(known):
        n = F.count("*")
        return known.groupBy("graph_id").agg(*[n.alias(c) for c in streams.COUNTS])

    got = {r["graph_id"]: r["total_pred"] for r in streams.stream_graph_counts(stream, ["graph_id"], counts).collect()}
    assert got == {g: 3 + g for g in range(5)}
