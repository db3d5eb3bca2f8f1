"""Scores as running aggregates over arriving batches.

A file source is read to its end (``availableNow``); sinks store what a batch gives under its number, so a
batch that runs again replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from filigree.operators.metrics import COUNTS, f_score, macro, micro
from filigree.operators.raster import KEY
from filigree.sources.scratch import shared_dir


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], DataFrame], mode: str) -> DataFrame:
    """Runs a stream to its end; returns the rows of all batches with their batch_id, of an empty stream those of an empty batch 0."""
    root, ran = shared_dir(stream.sparkSession), []

    def store(batch: DataFrame, number: int) -> None:
        each(batch, number).write.mode("overwrite").parquet(f"{root}/out/batch_id={number}")
        ran.append(number)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/log").trigger(availableNow=True).foreachBatch(store).start()
    q.awaitTermination()
    if not ran:
        store(stream.sparkSession.createDataFrame([], stream.schema), 0)
    return stream.sparkSession.read.parquet(f"{root}/out")


def latest(results: DataFrame) -> DataFrame:
    """Of results in complete mode, those of the last batch."""
    last = results.agg(F.max("batch_id").alias("_last"))
    return results.join(F.broadcast(last), F.col("batch_id") == F.col("_last")).drop("batch_id", "_last")


#: A tile of SIDE x SIDE pixels keeps SIDE * SIDE / 2 bytes of state.
SIDE = 64
LAYERS = ("pred", "target", "skel_pred", "skel_target")


def layer_counts(layers: DataFrame, at: str | None = None, delay_seconds: int | None = None) -> DataFrame:
    """A stream of (image, correct_pred, total_pred, correct_target, total_target): what arriving pixels add to the counts.

    ``layers`` is a stream of (image, layer, y, x) whose layers and sides may come in any batches and order.
    The state of a tile is one bit for each of its pixels and layers, so repeated rows add nothing, and the
    sums of an image's rows are its counts. With an event time ``at``, rows later than ``delay_seconds``
    behind the latest one of earlier batches are dropped (Spark's late rows), and a tile without rows for so long is closed: its state goes, and
    pixels that come after that are counted as of a new tile. Rows of other layers or with a null are dropped.
    """
    code = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")) - 1
    own = layers if at is None else layers.withWatermark(at, f"{delay_seconds} seconds")
    moment = F.lit(None).cast("long") if at is None else F.unix_millis(F.col(at).cast("timestamp"))
    tile = lambda c: F.floor(F.col(c) / SIDE).cast("int")
    cell = (F.pmod("y", F.lit(SIDE)) * SIDE + F.pmod("x", F.lit(SIDE))).cast("int")
    cells = own.select(KEY, tile("y").alias("ty"), tile("x").alias("tx"), cell.alias("cell"), code.cast("int").alias("code"), moment.alias("ms"), *([at] if at else []))
    cells = cells.filter("code >= 0").dropna(subset=[KEY, "cell"])

    def counts(bits: np.ndarray) -> np.ndarray:
        pred, target, skel_pred, skel_target = bits
        return np.array([(skel_pred & target).sum(), skel_pred.sum(), (skel_target & pred).sum(), skel_target.sum()])

    def update(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        bits = np.zeros((4, SIDE * SIDE), bool)
        if state.exists:
            bits = np.unpackbits(np.frombuffer(state.get[0], np.uint8)).reshape(4, -1).astype(bool)
        before, latest_ms, new = counts(bits), 0, not state.exists
        for batch in batches:
            bits[batch["code"].to_numpy(), batch["cell"].to_numpy()] = True
            latest_ms = max(latest_ms, 0 if at is None else int(batch["ms"].max()))
        state.update((np.packbits(bits).tobytes(),))
        if at is not None:
            state.setTimeoutTimestamp(max(latest_ms, state.getCurrentWatermarkMs()) + delay_seconds * 1000 + 1)
        added = counts(bits) - before
        if new or added.any():  # an image without a skeleton has a row too
            yield pd.DataFrame([[key[0], *added.tolist()]], columns=[KEY, *COUNTS])

    schema = f"{KEY} {dict(layers.dtypes)[KEY]}, " + ", ".join(f"{c} long" for c in COUNTS)
    timeout = GroupStateTimeout.NoTimeout if at is None else GroupStateTimeout.EventTimeTimeout
    return cells.groupBy(KEY, "ty", "tx").applyInPandasWithState(update, schema, "bits binary", "append", timeout)


def assembled(layers: DataFrame, at: str | None = None, delay_seconds: int | None = None) -> DataFrame:
    """The counts of each image of a stream of layers that is run to its end."""
    added = run_available(layer_counts(layers, at, delay_seconds), lambda b, _: b.groupBy(KEY).agg(*[F.sum(c).alias(c) for c in COUNTS]), "append")
    return added.groupBy(KEY).agg(*[F.sum(c).alias(c) for c in COUNTS])


def stream_cl_dice(layers: DataFrame, at: str | None = None, delay_seconds: int | None = None) -> DataFrame:
    """precision, recall and score over all images of a stream of layers; see ``layer_counts``."""
    return micro(assembled(layers, at, delay_seconds))


def stream_mean_cl_dice(layers: DataFrame, at: str | None = None, delay_seconds: int | None = None) -> DataFrame:
    """Means of the scores of each image of a stream of layers; see ``layer_counts``."""
    return macro(assembled(layers, at, delay_seconds))


def stream_graph_counts(rows: DataFrame, keys: list[str], counts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The counts of each graph of a stream of its rows (branches, nodes, both sides), which may come in any batches and order.

    A batch stores its rows, then counts the graphs that it touches from all their distinct rows so far;
    the last counts of a graph stand. ``counts_of`` gets such rows and gives (keys, counts).
    """
    kept = shared_dir(rows.sparkSession)

    def count(batch: DataFrame, number: int) -> DataFrame:
        batch.write.mode("overwrite").parquet(f"{kept}/batch={number}")
        known = rows.sparkSession.read.schema(f"{', '.join(f'{k} {v}' for k, v in batch.dtypes)}, batch int").parquet(kept)
        # A batch that runs again must not see what a later one stored.
        known = known.filter(F.col("batch") <= number).drop("batch").distinct()
        return counts_of(known.join(batch.select(*keys).distinct(), keys, "left_semi"))

    stored = run_available(rows, count, "append")
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*COUNTS), "batch_id").alias("_c"))
    return newest.select(*keys, "_c.*")


def stream_f1_topo_rows(rows: DataFrame, keys: list[str], counts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """precision, recall and score over all graphs of a stream of their rows; see ``stream_graph_counts``."""
    return micro(stream_graph_counts(rows, keys, counts_of))


def stream_micro(counts: DataFrame) -> DataFrame:
    """precision, recall and score over a stream of counts (A1 or A4)."""
    sums = counts.groupBy().agg(*[F.sum(c).alias(c) for c in COUNTS])
    return latest(run_available(sums.select(*f_score(*[F.col(c) for c in COUNTS])), lambda b, _: b, "complete"))


def stream_macro(counts: DataFrame) -> DataFrame:
    """Means of the scores of each row of a stream of counts."""
    each = counts.select(*f_score(*[F.col(c) for c in COUNTS]))
    means = each.groupBy().agg(*[F.avg(c).alias(c) for c in ("precision", "recall", "score")])
    return latest(run_available(means, lambda b, _: b, "complete"))


def stream_f1_topo(graphs: DataFrame, counts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """precision, recall and score over a stream of graph keys; counts_of gives the counts of a batch of them."""
    stored = run_available(graphs, lambda b, _: counts_of(b).agg(*[F.sum(c).alias(c) for c in COUNTS]), "append")
    return stored.agg(*[F.sum(c).alias(c) for c in COUNTS]).select(*f_score(*[F.col(c) for c in COUNTS]))
