"""Helpers that the operators for text share: tables, scratch space, the training split and batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filigree.sources.scratch import discard, saved, shared_dir  # noqa: F401

#: White space that separates words, as bytes and in patterns.
SPACE = r"\x20\x09-\x0D"


#: A batch of rows that Python gets holds at most so many bytes, or one row.
BATCH_BYTES = 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bounds the bytes of the session's Arrow batches by BATCH_BYTES, unless the user has set a bound.

    Spark's own is 10,000 rows or 64 MB, which each task holds several times, in the JVM and in its Python worker.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the fifth of the documents that no model learns from; a null id is held out too."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, ids: DataFrame, column: str, broadcast_rows: int = 500_000) -> DataFrame:
    """``df`` without the rows whose ``column`` is one of ``ids`` (one column); null ids stay.

    The ids are broadcast if they are few, else both sides are shuffled.
    """
    own = fresh(df, "_gone")
    ids = saved(ids.toDF(own).dropna().distinct())
    small = F.broadcast(ids) if ids.count() <= broadcast_rows else ids
    return df.join(small, df[column] == F.col(own), "left_anti")


def chunks(texts: Iterable[str | None], limit: int = 1 << 20) -> Iterator[tuple[int, list[str]]]:
    """The texts, nulls as empty, in lists of about ``limit`` characters, with the index of each list's first."""
    part: list[str] = []
    size = start = 0
    for i, t in enumerate(texts):
        t = t if isinstance(t, str) else ""
        if part and size + len(t) > limit:
            yield start, part
            part, size, start = [], 0, i
        part.append(t)
        size += len(t) + 1
    if part:
        yield start, part
