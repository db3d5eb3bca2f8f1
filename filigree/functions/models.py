"""User models and user predicates inside a pipeline."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filigree.operators import raster, skeleton
from filigree.operators.tiles import packed

#: A cell of an image on its way to its model.
CELL = np.dtype([("y", "<i4"), ("x", "<i4"), ("b", "<f4"), ("g", "<f4"), ("r", "<f4")])


def predict_masks(image: DataFrame, h: int, w: int, make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], roi: DataFrame | str | None = "auto", multiple: int = 32, batch_size: int = 4) -> DataFrame:
    """(image, y, x) of the pixels that a model's second class is over one half for.

    make_model gives, once a worker, a function from (n, 3, H, W) values of 0 to 1 to (n, H, W) scores, H and W
    multiples of ``multiple``. roi: a pixel table, "auto" for the region of interest of the image, or None.
    One row holds one image, which is what a model takes.
    """
    hh, ww = (math.ceil(n / multiple) * multiple for n in (h, w))
    first = {c: F.coalesce(F.col(c).cast("int"), F.lit(-1 << 31)) for c in ("y", "x")}
    cells = image.select(raster.KEY, *[v.alias(c) for c, v in first.items()], *[(F.col(c) / 255.0).cast("float").alias(c) for c in "bgr"])
    whole = packed(cells, [raster.KEY], CELL).groupBy(raster.KEY).agg(F.collect_list("cells").alias("cells"))

    @F.pandas_udf("array<float>")
    def flat(parts: pd.Series) -> pd.Series:
        out = []
        for part in parts:
            data = np.frombuffer(b"".join(part), CELL)
            data = data[np.lexsort([data[c] for c in reversed(CELL.names)])]
            out.append(np.stack([data[c] for c in "bgr"], axis=1).ravel())
        return pd.Series(out, dtype=object)

    def factory():
        model = make_model()

        def run(values: np.ndarray) -> np.ndarray:
            x = np.zeros((len(values), 3, hh, ww), np.float32)
            x[:, :, :h, :w] = values.reshape(-1, h, w, 3).transpose(0, 3, 1, 2)
            return model(x)[:, :h, :w].reshape(len(values), -1).astype(np.float32)

        return run

    scores = predict_batch_udf(factory, return_type=T.ArrayType(T.FloatType()), batch_size=batch_size, input_tensor_shapes=[[h * w * 3]])
    each = whole.select(raster.KEY, scores(flat("cells")).alias("s")).select(raster.KEY, F.posexplode("s").alias("i", "score"))
    spots = each.select(raster.KEY, F.floor(F.col("i") / w).cast("int").alias("y"), (F.col("i") % w).cast("int").alias("x"), "score")
    mask = raster.threshold_class(spots, "score").select(*raster.CELL)
    if isinstance(roi, str):
        roi = skeleton.roi_mask(image, h, w)
    return mask if roi is None else raster.select_by_mask(mask, roi)


def node_predicate(nodes: DataFrame, predicate) -> DataFrame:
    """The nodes that a user's predicate keeps: a column, or a function of the table."""
    return predicate(nodes) if callable(predicate) else nodes.filter(predicate)
