"""Byte-level BPE: ids of texts by the ranks of a vocabulary file, and bytes of ids.

A text is cut by the vocabulary's pattern into pre-tokens, each of which is merged apart. Pre-tokens that a
worker has not met lately are laid end to end as one linked list of parts and merged by a queue of ranks: for
each rank a bucket of positions, and over the buckets a bitmap in two levels, a bit for each rank and one for
each word of ranks, in which two searches for the first set bit give the lowest rank that waits. A merge
links two parts and enters the neighbouring pairs that it makes; entries whose pair has changed meanwhile are
skipped when they come up. So n bytes take time in proportion to n, in one pre-token or in many.

A null text is empty and has no ids; so is an empty one. Texts are read whole: long ones by slices of their
pre-tokens, so that only their ids are held. ``encoded`` and ``decoded`` are columns, so repeated rows,
other columns and their names don't matter, and empty tables stay empty. Ids are those of ``encode_ordinary``
of the tiktoken library: special tokens in a text are ordinary text. Null ids decode to null, and so does a
list that holds a null or an id beyond the vocabulary.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import Memo

#: So many ids of merged pre-tokens are remembered by a worker, then it begins anew.
REMEMBERED = 2_000_000
#: So many pre-tokens are looked up at a time.
SLICE = 200_000


class ByteBPE:
    """Encodes by a table of byte strings and their ranks, and decodes by the same table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remembered: int = REMEMBERED):
        self.ranks, self.pattern, self.remembered = ranks, regex.compile(pattern), remembered
        self.size = max(ranks.values(), default=-1) + 1
        self.tokens: list[bytes | None] = [None] * self.size
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.single, self.double = np.full(256, -1, np.int32), np.full(1 << 16, -1, np.int32)
        for token, rank in ranks.items():
            if len(token) <= 2:
                (self.single if len(token) == 1 else self.double)[int.from_bytes(token)] = rank
        # Words of the bitmap have about as many bits as there are words.
        self.shift = max(self.size.bit_length() + 1, 2) // 2
        self.bits = [1 << k for k in range(max(1 << self.shift, (self.size >> self.shift) + 1))]
        self._forget()

    @classmethod
    def from_file(cls, path: str, pattern: str, remembered: int = REMEMBERED) -> ByteBPE:
        with open(path, "rb") as f:
            rows = (line.split() for line in f)
            return cls({base64.b64decode(r[0]): int(r[1]) for r in rows if r}, pattern, remembered)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of non-empty pre-tokens one after another, and how many each has."""
        size = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(size)
        data, n = b"".join(pieces), int(ends[-1]) if len(pieces) else 0
        flat = np.frombuffer(data, np.uint8).astype(np.int64)
        pair = np.full(n, -1, np.int32)
        if n:
            pair[:-1] = self.double[flat[:-1] << 8 | flat[1:]]
            pair[ends - 1] = -1
        starts = bytearray(n + 1)  # 1 where a pre-token starts: parts don't grow past it
        for at in (ends - size).tolist():
            starts[at] = 1
        starts[n] = 1
        rank_of, bits, shift, mask = self.ranks.get, self.bits, self.shift, (1 << self.shift) - 1
        wants = array("i", pair.tobytes())  # the rank of the pair at a position; entries of another one are stale
        after = array("q", range(1, n + 2))  # where the part after the one at a position starts
        before = array("q", range(-1, n))
        # Buckets: those of the bytes as they come are slices of one sorted array, the others grow as lists.
        order = np.argsort(pair, kind="stable")
        order = order[np.searchsorted(pair[order], 0) :]
        ranks, first = np.unique(pair[order], return_index=True)
        given = dict(zip(ranks.tolist(), np.split(order, first[1:]), strict=False)) if len(ranks) else {}
        buckets: dict[int, list[int]] = {}
        words, top = [0] * ((self.size >> shift) + 1), 0
        for rank in given:
            words[rank >> shift] |= bits[rank & mask]
            top |= bits[rank >> shift]
        while top:
            at = (top & -top).bit_length() - 1
            word = words[at]
            rank = at << shift | (word & -word).bit_length() - 1
            words[at] = word = word & (word - 1)
            if not word:
                top &= top - 1
            # Pairs that come up meanwhile are longer than this one, so none of them joins its bucket.
            waiting = given.pop(rank).tolist() if rank in given else []
            if rank in buckets:
                waiting += buckets.pop(rank)
                waiting.sort()
            for seen, k in enumerate(waiting, 1):
                if wants[k] != rank:
                    continue
                gone = after[k]
                after[k] = end = after[gone]
                wants[gone] = lowest = new = -1
                if not starts[end]:
                    before[end] = k
                    new = rank_of(data[k : after[end]], -1)
                    if new >= 0:
                        if new < rank:
                            lowest = new
                        if new in buckets:
                            buckets[new].append(k)
                        else:
                            buckets[new] = [k]
                            words[new >> shift] |= bits[new & mask]
                            top |= bits[new >> shift]
                wants[k] = new
                if not starts[k]:
                    left = before[k]
                    wants[left] = new = rank_of(data[left:end], -1)
                    if new >= 0:
                        if new < rank:
                            lowest = new
                        if new in buckets:
                            buckets[new].append(left)
                        else:
                            buckets[new] = [left]
                            words[new >> shift] |= bits[new & mask]
                            top |= bits[new >> shift]
                if lowest >= 0:  # a lower rank goes first; the others wait
                    if seen < len(waiting):
                        buckets[rank] = waiting[seen:]
                        words[rank >> shift] |= bits[rank & mask]
                        top |= bits[rank >> shift]
                    break
        parts, k = [], 0
        while k < n:
            parts.append(k)
            k = after[k]
        return self._looked_up(data, flat, np.array(parts, np.int64), n), np.diff(np.searchsorted(parts, np.r_[0, ends]))

    def _looked_up(self, data: bytes, flat: np.ndarray, parts: np.ndarray, n: int) -> np.ndarray:
        """The ids of the parts that start at these positions."""
        stops = np.r_[parts[1:], n][: len(parts)]
        ids = np.where(stops - parts == 1, self.single[flat[parts]], -1).astype(np.int32)
        rest = np.flatnonzero(ids < 0)
        ids[rest] = [self.ranks[data[a:b]] for a, b in zip(parts[rest].tolist(), stops[rest].tolist(), strict=True)]
        return ids

    def _forget(self) -> None:
        self.memo = Memo()
        self.ids, self.start, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self) -> None:
        """Merges the pre-tokens that the memo has numbered since the last time."""
        new = [p.encode() for p in self.memo.new]
        whole = np.fromiter((self.ranks.get(p, -1) for p in new), np.int32, len(new))
        apart = np.flatnonzero(whole < 0)
        found, sizes = self.merge([new[k] for k in apart.tolist()])
        count = np.ones(len(new), np.int64)
        count[apart] = sizes
        ids = np.repeat(whole, count)
        ids[ids < 0] = found
        self.start = np.r_[self.start, len(self.ids) + np.cumsum(count) - count]
        self.ids, self.count = np.r_[self.ids, ids], np.r_[self.count, count]
        self.memo.new = []

    def encode(self, texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each has."""
        counts, parts = [], []
        words, owners = [], []  # the pre-tokens at hand, and how many of them the last texts have

        def close() -> None:
            number = np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words))
            self._learn()
            size = self.count[number]
            ends = np.cumsum(size)
            parts.append(self.ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[number] - (ends - size), size)])
            sums = np.diff(np.r_[0, ends][np.r_[0, np.cumsum([k for _, k in owners], dtype=np.int64)]])
            for (text, _), n in zip(owners, sums.tolist(), strict=True):
                counts[text] += n
            words.clear(), owners.clear()
            if len(self.ids) > self.remembered:
                self._forget()

        for k, text in enumerate(texts):
            counts.append(0)
            if not text:
                continue
            found = iter((self.pattern.findall(text),)) if len(text) <= SLICE else _slices(self.pattern, text)
            for part in found:
                words += part
                owners.append((k, len(part)))
                if len(words) >= SLICE:
                    close()
        close()
        return np.concatenate(parts), np.array(counts, np.int64)

    def decode(self, ids: list[int | None] | None) -> bytes | None:
        if ids is None:
            return None
        try:
            return None if ids and min(ids) < 0 else b"".join(map(self.tokens.__getitem__, ids))
        except (IndexError, TypeError):  # an id beyond the vocabulary, or a null
            return None


def _slices(pattern: regex.Pattern, text: str) -> Iterator[list[str]]:
    found = (m[0] for m in pattern.finditer(text))
    while part := list(islice(found, SLICE)):
        yield part


_OPEN: dict[tuple[str, str], ByteBPE] = {}


def vocabulary(path: str, pattern: str) -> ByteBPE:
    """One for each file, pattern and Python worker."""
    if (path, pattern) not in _OPEN:
        _OPEN[path, pattern] = ByteBPE.from_file(path, pattern)
    return _OPEN[path, pattern]


def encoded(text: Column, path: str, pattern: str, spark: SparkSession) -> Column:
    """The ids of a text column, as array<int>; ``path`` names the rank file on every executor."""
    bounded_batches(spark)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(path, pattern)
        for texts in batches:
            ids, counts = bpe.encode(t.as_py() for t in texts)
            yield pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(ids))

    return encode(text)


def decoded(ids: Column, path: str, pattern: str, spark: SparkSession) -> Column:
    """The bytes that a column of ids stands for; text, where they came from one."""
    bounded_batches(spark)

    @F.arrow_udf("binary")
    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = vocabulary(path, pattern)
        for lists in batches:
            yield pa.array([bpe.decode(None if not x.is_valid else x.values.to_pylist()) for x in lists], pa.binary())

    return decode(ids)
