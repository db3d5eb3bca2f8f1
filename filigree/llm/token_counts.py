"""Token counts of documents in flat token files, which hold ids and end-of-document ids and no index.

Files are read in blocks of equal size, wherever documents end. In a block, one vectorised comparison finds
all end ids. A document that goes over block boundaries is stitched by a prefix scan over the blocks: the
number of ends before a block gives its documents' ordinals, and the last end before it gives the start of
its first document. The scan has two levels, so that not even one file's blocks meet in one task.

Tokens behind a file's last end id are one more document, without an end. An empty file has none. Texts
that are null are empty: no token. Repeated rows are documents of their own, null ids stay null, and other
columns are dropped.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, chunks, saved, shared_dir
from .media import _files, created

#: Bytes of a block, and of a file at which the next one is begun; ids are little-endian and 16 bits wide.
BLOCK_BYTES, FILE_BYTES = 1 << 20, 64 << 20
ID = np.dtype("<u2")
#: Blocks that are scanned as one at the upper level.
SPAN = 256


def _write(root: str, tokenizer_path: str, end: int):
    def run(batches):
        from .tokens import word_tokens

        tokens = word_tokens(tokenizer_path, special=False)
        stream = path = None
        ordinal = 0
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for start, part in chunks(batch.column(1).to_pylist()):
                if stream is None:
                    path, ordinal = f"{root}/{uuid.uuid4().hex}.bin", 0
                    files, own = _files(path)
                    stream = files.open_output_stream(own)
                stream.write(np.concatenate(tokens.encode(part, end)).astype(ID).tobytes())
                n = len(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n), pa.array(np.arange(ordinal, ordinal + n)), pa.array(ids[start : start + n], pa.int64())], ["path", "ordinal", "doc_id"]
                )
                ordinal += n
                if stream.tell() >= FILE_BYTES:
                    stream.close()
                    stream = None
        if stream is not None:
            stream.close()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end: int) -> DataFrame:
    """Writes docs (doc_id, text) to token files; returns (path, ordinal, doc_id): which document is where."""
    bounded_batches(docs.sparkSession)
    root = created(shared_dir(docs.sparkSession))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return saved(rows.mapInArrow(_write(root, tokenizer_path, end), "path string, ordinal long, doc_id long"))


def _blocks(block_bytes: int):
    """(path, block, bytes) for each path: its blocks are planned from its size alone."""

    def run(batches):
        for batch in batches:
            for path in batch.column(0).to_pylist():
                files, own = _files(path)
                size = files.get_file_info(own).size
                n = -(-size // block_bytes)
                yield pa.RecordBatch.from_arrays([pa.array([path] * n, pa.string()), pa.array(np.arange(n)), pa.array([size] * n, pa.int64())], ["path", "block", "bytes"])

    return run


def _scan(end: int, block_bytes: int):
    """Per block: how many ends it has, where the first and last are, and the gaps between them."""

    def run(batches):
        for batch in batches:
            for path, block, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                files, own = _files(path)
                with files.open_input_file(own) as file:
                    file.seek(block * block_bytes)
                    raw = file.read(min(block_bytes, size - block * block_bytes))
                base = block * block_bytes // ID.itemsize
                at = np.flatnonzero(np.frombuffer(raw, ID) == end) + base
                if (block + 1) * block_bytes >= size and (not len(at) or at[-1] < size // ID.itemsize - 1):
                    at = np.r_[at, size // ID.itemsize]  # the tail ends with the file
                first, last = (at[0], at[-1]) if len(at) else (None, None)
                gaps = pa.array([np.diff(at) - 1], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([block], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([first], pa.int64()), pa.array([last], pa.int64()), gaps],
                    ["path", "block", "ends", "first", "last", "gaps"],
                )

    return run


def document_sizes(paths: DataFrame, end: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens) of every document in token files (path)."""
    planned = paths.select("path").distinct().mapInArrow(_blocks(block_bytes), "path string, block long, bytes long")
    dealt = planned.repartition(int(paths.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path", "block")
    scan = saved(dealt.mapInArrow(_scan(end, block_bytes), "path string, block long, ends long, first long, last long, gaps array<long>"))
    rows = scan.withColumn("span", F.floor(F.col("block") / SPAN))
    before = Window.partitionBy("path").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy("path", "span").agg(F.sum("ends").alias("_n"), F.max("last").alias("_l"))
    spans = spans.select("path", "span", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ends"), F.coalesce(F.max("_l").over(before), F.lit(-1)).alias("_last"))
    inside = Window.partitionBy("path", "span").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    known = rows.select("path", "span", "block", F.coalesce(F.sum("ends").over(inside), F.lit(0)).alias("_in"), F.max("last").over(inside).alias("_near"))
    carried = known.join(spans, ["path", "span"]).select("path", "block", (F.col("_ends") + F.col("_in")).alias("skip"), F.coalesce("_near", "_last").alias("previous"))
    full = scan.filter("ends > 0").join(carried, ["path", "block"])
    sizes = F.concat(F.array(F.col("first") - F.col("previous") - 1), F.col("gaps"))
    each = full.select("path", "skip", F.posexplode(sizes).alias("k", "n_tokens"))
    return each.select("path", (F.col("skip") + F.col("k")).alias("ordinal"), "n_tokens")


def token_counts(docs: DataFrame, tokenizer_path: str, end: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_tokens) of docs (doc_id, text), by way of token files."""
    written = write_token_files(docs, tokenizer_path, end)
    sizes = document_sizes(written.select("path"), end, block_bytes)
    return written.join(sizes, ["path", "ordinal"]).select("doc_id", "n_tokens")
