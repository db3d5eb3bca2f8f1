"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are 1-, 2- and 3-grams of lower-cased letters (whatever is no letter counts as one space), the
3-grams hashed. Term counts enter as log(1 + count), times the inverse document frequency over all
documents that may be learned from, with unit length. Weights are trained by follow-the-regularised-leader
with an L1 and an L2 penalty on a bounded sample; the temperature of the probabilities is set on a part
of the sample that the weights have not seen.

``und`` with score 0 is the answer for null, empty and letterless texts, and where nothing can be learned.
Repeated rows each get their answer. Other columns are neither read nor changed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, fresh, held_out

LETTERS = 64
HASHED = 1 << 15
TWO, THREE = LETTERS, LETTERS + LETTERS**2
FEATURES = THREE + HASHED

_CODES: np.ndarray | None = None


def _codes(text: str) -> np.ndarray:
    """0 for what is no letter, 1 to 26 for a to z, 27 to 63 for other letters by their remainder."""
    global _CODES
    if _CODES is None:
        own = lambda cp: cp - 96 if 97 <= cp <= 122 else 27 + cp % 37
        _CODES = np.array([own(cp) if chr(cp).isalpha() else 0 for cp in range(1 << 16)], np.uint8)
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    codes = _CODES[np.minimum(points, 0xFFFF)]
    if len(points) and points.max() > 0xFFFF:
        for i in np.flatnonzero(points > 0xFFFF):
            codes[i] = 27 + points[i] % 37 if chr(points[i]).isalpha() else 0
    return codes


def counts(text: str) -> np.ndarray | None:
    """How often each feature occurs; None without a letter."""
    c = _codes(text)
    if not c.any():
        return None
    c = np.r_[0, c, 0].astype(np.int32)
    two = c[:-1] * LETTERS + c[1:]
    three = ((two[:-1] * LETTERS + c[2:]).astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(17)
    return np.bincount(np.concatenate([c[1:-1], TWO + two, THREE + three.astype(np.int32)]), minlength=FEATURES)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        n = counts(text)
        if n is None:
            return None
        at = np.flatnonzero(n)
        v = np.log1p(n[at]) * self.idf[at]
        return at, v / max(np.sqrt((v * v).sum()), 1e-12)

    def logits(self, text: str) -> np.ndarray | None:
        x = self.vector(text)
        return None if x is None else x[1] @ self.weights[x[0]] + self.bias

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        names, score = ["und"] * len(texts), np.zeros(len(texts))
        for i, t in enumerate(texts):
            z = self.logits(t) if isinstance(t, str) and self.languages else None
            if z is not None:
                p = _softmax(z / self.temperature)
                names[i], score[i] = self.languages[int(p.argmax())], float(p.max())
        return names, score


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all these documents each feature occurs, and how many have any."""

    def count(batches):
        seen, total = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for _, part in chunks(batch.column(0).to_pylist()):
                for t in part:
                    if (n := counts(t)) is not None:
                        seen += n > 0
                        total += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, at]), pa.array(np.r_[total, seen[at]])], ["feature", "n"])

    parts = docs.select("text").mapInArrow(count, "feature long, n long")
    rows = parts.groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(FEATURES)
    own = rows[rows.feature >= 0]
    out[own.feature.to_numpy()] = own.n.to_numpy()
    return out, int(rows.n[rows.feature < 0].sum())


def training_sample(docs: DataFrame, size: int) -> DataFrame:
    """About ``size`` documents in equal parts by language (all of a rare one), never more than twice that.

    The ids are chosen without reading a text; their bounded list is then broadcast to the texts.
    """
    known = docs.select("doc_id", "lang")
    per = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    quota = size / max(len(per), 1)
    uniform = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    share = F.create_map(*[F.lit(x) for k, n in per.items() for x in (k, quota / n)])[F.col("lang")] if per else F.lit(0.0)
    ids = known.filter(uniform < share).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * size)
    picked = F.broadcast(ids.select(F.col("doc_id").alias("_id")).distinct())
    return docs.select("doc_id", "text", "lang").join(picked, F.col("doc_id") == F.col("_id")).drop("_id")


def fit(texts, langs, idf, alpha=0.5, beta=1.0, l1=0.02, l2=0.5, epochs=3, seed=3) -> Model:
    names = sorted(set(langs))
    model = Model(names, idf, np.zeros((FEATURES, len(names))), np.zeros(len(names)))
    data = [(x, names.index(k)) for t, k in zip(texts, langs, strict=True) if (x := model.vector(t)) is not None]
    order = np.random.default_rng(seed).permutation(len(data))
    tune, learn = order[: len(order) // 5], order[len(order) // 5 :]
    z, n = np.zeros((FEATURES + 1, len(names))), np.zeros((FEATURES + 1, len(names)))

    def weight(at):
        return np.where(np.abs(z[at]) > l1, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2), 0)

    for _ in range(epochs):
        for i in learn:
            (at, v), k = data[i]
            at, v = np.r_[at, FEATURES], np.r_[v, 1.0]
            w = weight(at)
            p = _softmax(v @ w)
            p[k] -= 1
            g = v[:, None] * p
            s = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - s * w
            n[at] += g * g
    w = weight(np.arange(FEATURES + 1))
    model.weights, model.bias = w[:-1], w[-1]
    if len(tune):
        x = np.array([v @ model.weights[at] + model.bias for (at, v), _ in (data[i] for i in tune)])
        y = np.array([data[i][1] for i in tune])
        loss = lambda t: -np.log(np.maximum(_softmax(x / t)[np.arange(len(y)), y], 1e-12)).mean()
        model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    return model


def train(docs: DataFrame, size: int = 6000) -> Model:
    """Learn from the documents that are not held out: frequencies of all of them, weights of about ``size``."""
    own = docs.filter(~held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    seen, total = document_frequency(own)
    rows = training_sample(own, size).toPandas().sort_values(["doc_id", "lang"])
    return fit(rows["text"].tolist(), rows["lang"].tolist(), np.log((1 + total) / (1 + seen)) + 1)


def language(model: Model, text: Column, spark: SparkSession) -> Column:
    """A struct (lang_pred, score) for a text column."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names, score = shared.value.predict(texts.tolist())
        return pd.DataFrame({"lang_pred": names, "score": score})

    return predict(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score."""
    own = fresh(docs, "_found")
    found = docs.withColumn(own, language(model, F.col("text"), docs.sparkSession))
    return found.withColumns({k: F.col(own)[k] for k in ("lang_pred", "score")}).drop(own)
