"""Packing: documents become token sequences of one length, by first-fit decreasing in random groups.

Documents are dealt out at random and cut into groups. In a group, each document fills whole sequences of
its own; what is left of it goes, longest first, into the first sequence with room, found by descending a
tournament tree that holds the largest room below each node. Then the emptiest sequences are cut up to
fill the gaps of the fuller ones, and the last partly filled one is cut into sequences whose lengths are
powers of two, which need no padding. What a group gives depends on its documents alone, so a task that
runs again gives the same rows.

A null text is empty: such a document is its end mark alone. Repeated rows are documents of their own.
A null doc_id stays null. Other columns are dropped. An empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

LENGTH = 4096
#: Ends a document.
END = 2
#: Gaps below this many tokens are padded, not filled by a cut.
LEAST_CUT = 16
#: A group is closed at so many documents or tokens.
GROUP_DOCS, GROUP_TOKENS = 4096, 8_000_000
#: So many rows of an Arrow batch are Python strings at a time.
SLICE = 256

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

Piece = tuple[int, int, int]  # document, start, length


class Bins:
    """First fit by a tournament tree over the room in each bin."""

    def __init__(self, count: int, capacity: int):
        self.leaves = 1 << max(count - 1, 0).bit_length()
        self.room = [capacity] * (2 * self.leaves)
        self.count = 0

    def put(self, size: int) -> int:
        """The first bin with room for ``size``, which then has so much less."""
        room, k = self.room, 1
        while k < self.leaves:
            k *= 2
            if room[k] < size:
                k += 1
        found = k - self.leaves
        room[k] -= size
        while k > 1:
            k //= 2
            room[k] = max(room[2 * k], room[2 * k + 1])
        self.count = max(self.count, found + 1)
        return found


def first_fit(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of item numbers by first-fit decreasing; ties in order of number. Each size is 1 to ``length``."""
    bins, out = Bins(len(sizes), length), []
    for k in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        b = bins.put(sizes[k])
        if b == len(out):
            out.append([])
        out[b].append(k)
    return out


def pack(sizes: list[int], length: int = LENGTH, least_cut: int = LEAST_CUT) -> list[list[Piece]]:
    """Sequences of pieces that hold every token of documents with these sizes once."""
    full = [[(d, s, length)] for d, n in enumerate(sizes) for s in range(0, n - length + 1, length)]
    rest = [(d, n - n % length, n % length) for d, n in enumerate(sizes) if n % length]
    bins = [[rest[k] for k in b] for b in first_fit([r[2] for r in rest], length)]
    used = lambda b: sum(p[2] for p in b)
    done = [b for b in bins if length - used(b) < least_cut]
    part = sorted((b for b in bins if length - used(b) >= least_cut), key=used)
    while len(part) > 1:
        to, gap = part[-1], length - used(part[-1])
        while gap and len(part) > 1:
            d, s, n = part[0].pop()
            if n > gap:
                part[0].append((d, s, n - gap))
                s, n = s + n - gap, gap
            to.append((d, s, n))
            gap -= n
            if not part[0]:
                part.pop(0)
        if gap:
            break
        done.append(part.pop())
    return full + done + [s for b in part for s in powers(b, length)]


def powers(pieces: list[Piece], length: int) -> list[list[Piece]]:
    """The same tokens as sequences whose lengths are powers of two, longest first."""
    left, out = pieces[::-1], []
    total = sum(p[2] for p in pieces)
    for size in (1 << b for b in reversed(range(length.bit_length()))):
        if total & size:
            own, need = [], size
            while need:
                d, s, n = left.pop()
                if n > need:
                    left.append((d, s + need, n - need))
                    n = need
                own.append((d, s, n))
                need -= n
            out.append(own)
    return out


def _rows(ids: list, tokens: list[np.ndarray], first: int, length: int) -> tuple[pa.RecordBatch, int]:
    sequences = pack([len(t) for t in tokens], length)
    rows = []
    for k, pieces in enumerate(sequences):
        at = 0
        for d, s, n in pieces:
            crc = zlib.crc32(tokens[d][s : s + n].astype("<u4").tobytes())
            rows.append((ids[d], s, n, crc, len(tokens[d]), first + k, at))
            at += n
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names), first + len(sequences)


def pack_documents(docs: DataFrame, tokenizer_path: str, length: int = LENGTH, end: int = END, seed: int = 11) -> DataFrame:
    """Pieces of all documents (doc_id, text), as SCHEMA; sequences are numbered within each task's range."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        from pyspark import TaskContext

        from .tokens import word_tokens

        tokens = word_tokens(tokenizer_path)
        number = TaskContext.get().partitionId() << 32
        ids, held, total = [], [], 0
        for part in (b.slice(k, SLICE) for b in batches for k in range(0, b.num_rows, SLICE)):
            names, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            at = 0
            while at < len(texts):
                upto, chars = at, 0
                while upto < len(texts) and chars < 1 << 20 and upto - at + len(ids) < GROUP_DOCS:
                    chars += len(texts[upto])
                    upto += 1
                own = tokens.encode(texts[at:upto], end)
                ids += names[at:upto]
                held += own
                total += sum(map(len, own))
                at = upto
                if len(ids) >= GROUP_DOCS or total >= GROUP_TOKENS:
                    out, number = _rows(ids, held, number, length)
                    yield out
                    ids, held, total = [], [], 0
        if ids:
            yield _rows(ids, held, number, length)[0]

    # Repeated rows of one id are dealt out by where they were read.
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.withColumn("_at", F.xxhash64("doc_id", F.spark_partition_id(), F.lit(seed)))
    dealt = dealt.repartition(parts, "_at").sortWithinPartitions("_at", "doc_id", "text")
    return dealt.select("doc_id", "text").mapInArrow(run, SCHEMA)
