"""N-gram Jaccard join: which documents share 75 % of their word 5-grams, by signature trees.

1. Each text becomes the set of 64-bit hashes of its word 5-grams. Equal sets are one class from then on, named by
   64 bits of all its hashes.
2. A class announces its smallest hashes: as many as two linked sets cannot avoid sharing (the prefix
   filter), and a tenth of the set more, so that linked sets share several. Each batch of rows announces a class
   once, and a hash that several of its classes have twice, so that no hash gathers all its rows in a task. Classes
   that share fewer with anyone than any link needs are out. Those that are left announce all their hashes and
   keep the rarest, as many as the prefix filter asks for; what still shares one is routed into groups by
   connected components.
3. In a group a signature tree is built: its leaves hold a bitmap of a set's hashes, the nodes above the OR
   of their children's bitmaps and the ranges of their sizes and of the labels of what is connected already. Two
   copies of the tree are traversed together; a pair of nodes is pruned if no sets below them can overlap enough by
   bitmaps and sizes, or if all of them have one label. Pairs of leaves that are left are verified on the sets
   themselves. Sets with equal smallest hashes are tried first, and the tree is ordered by label, so that a group of
   near copies, whose pairs are all links, is one label before its pairs are enumerated.
4. A group is dealt out in parts of ``PART``, each linked alone. Of groups with several parts, the roots of what was
   linked are joined next, then all sets that are not yet of one label, by pairs of chunks of ``CHUNK``. Chunks are
   cut by size too, and only chunks whose sizes can link are paired. No group meets in one task.

Texts without a word have the empty set and are linked with nothing. Each row is a document of its own, repeated
rows and rows with a null doc_id too; a null doc_id is linked like others, but names no component unless no
other document is in it. Other columns are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filigree.operators.components import connected_components

from .common import bounded_batches, chunks, discard, fresh, saved

WORDS = 5
#: What a task takes of one group at most from each side, and what of it is dealt out first: a set of n hashes counts as n + EACH.
CHUNK, PART, EACH = 2_000_000, 50_000, 256
FEW = 16
#: Ids that may be broadcast (some 24 MB); beyond, the tables are joined by shuffles.
BROADCAST_ROWS = 500_000

_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RNG.integers(1, 1 << 63, WORDS, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE, _MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_BYTE_LOW = np.where(_SPACE, np.uint64(0), _BYTE[_LOW])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of all texts in a row, and how many words each text has."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    space = _SPACE[data]
    start = np.flatnonzero(~space & np.r_[True, space[:-1]])
    ends = np.cumsum([len(r) + 1 for r in raw])
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    span = np.diff(np.r_[start, len(data)])
    offset = np.arange(start[0], len(data)) - np.repeat(start, span)
    power = np.cumprod(np.full(int(span.max()), _BASE, np.uint64))
    value = _BYTE_LOW[data[start[0] :]] * power[offset]
    h = _mix(np.add.reduceat(value, start - start[0]))
    return h, np.diff(np.r_[0, np.searchsorted(start, ends)])


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted different hashes of each text's 5-word shingles; a shorter text's words are one shingle."""
    h, many = word_hashes(texts)
    n = len(h)
    rolled = np.zeros(max(n - WORDS + 1, 0), np.uint64)
    for k in range(WORDS):
        rolled += h[k : n - WORDS + 1 + k] * _PLACE[k] if len(rolled) else np.uint64(0)
    rolled = _mix(rolled)
    out, at = [], 0
    for m in many:
        if m >= WORDS:
            out.append(np.unique(rolled[at : at + m - WORDS + 1]))
        elif m:
            out.append(_mix(np.array([(h[at : at + m] * _PLACE[:m]).sum() + np.uint64(m)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += m
    return out


def _extra(n: int) -> int:
    """By so many hashes a set of ``n`` announces more than the prefix filter asks for, plus 1."""
    return max(1, n // 10)


def prefix_size(n: int) -> int:
    """How many of its smallest hashes a set of ``n`` announces: all but 75 % and ``_extra``.

    Sets A and B with a Jaccard similarity of 0.75 share at least 0.75 of either. Of the common hashes, at
    least ``_extra`` are then in the prefix of the set whose prefix ends first, and so in the other's too.
    """
    return min(n, n - -(-3 * n // 4) + _extra(n)) if n else 0


def shared_need(n: Column) -> Column:
    """How many announced hashes any link of a set of ``n`` shares at least: ``_extra`` of its smallest partner."""
    return F.greatest(F.lit(1), F.floor(F.ceil(n * 3 / 4) / 10))


def class_of(s: np.ndarray) -> int:
    """The name of a set: 64 bits of all its hashes and their number."""
    return int(_mix(_mix(s ^ _BASE).sum(dtype=np.uint64, keepdims=True) ^ (s.sum(dtype=np.uint64, keepdims=True) * _MIX) ^ np.uint64(len(s)))[0])


def _named(sets: list[np.ndarray]) -> pa.Array:
    return pa.array(np.array([class_of(s) for s in sets], np.uint64).view(np.int64))


def _sets(batches):
    """(doc_id, t1, t2, n, class, prefix) for each row (doc_id, t1, t2, text)."""
    for batch in batches:
        for start, part in chunks(batch.column(3).to_pylist()):
            sets = shingle_sets(part)
            own = [batch.column(k).slice(start, len(part)) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array([len(s) for s in sets], pa.int64()), _named(sets), pa.array([s[: prefix_size(len(s))].tobytes() for s in sets], pa.binary())],
                ["doc_id", "t1", "t2", "n", "class", "prefix"],
            )


def _exploded(batch) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and their classes of (class, hashes), each class once."""
    ids, raw = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
    first = np.unique(ids, return_index=True)[1]
    raw = [raw[k] for k in first]
    return np.frombuffer(b"".join(raw), np.int64), np.repeat(ids[first], [len(r) // 8 for r in raw])


def _in_pieces(columns: dict, size: int = 1 << 18):
    whole = pa.RecordBatch.from_pydict(columns)
    for k in range(0, whole.num_rows, size):
        yield whole.slice(k, size)


def _hashes(batches):
    """(h, class) for each hash of each class."""
    for batch in batches:
        h, ids = _exploded(batch)
        yield from _in_pieces({"h": h, "class": ids})


def _announced(batches):
    """(h, class, c) for each announced hash: c is 0, or -1 if the class is counted already.

    Hashes that several classes of the batch have are counted here: a row with c over 0 (and any h) says how many
    such hashes the class has; of such a hash only two classes are sent on, for those of other batches.
    """
    for batch in batches:
        h, ids = _exploded(batch)
        if not len(h):
            continue
        order = np.lexsort((ids, h))
        h, ids = h[order], ids[order]
        new = np.r_[True, h[1:] != h[:-1]]
        at = np.flatnonzero(new)
        many = np.diff(np.r_[at, len(h)])
        rank = np.arange(len(h)) - np.repeat(at, many)
        shared = np.repeat(many > 1, many)
        found, c = np.unique(ids[shared], return_counts=True)
        keep = rank < 2
        yield from _in_pieces({"h": np.r_[h[keep], found], "class": np.r_[ids[keep], found], "c": np.r_[-shared[keep].astype(np.int64), c]})


def _shared(batches):
    """(class, c) from rows of ``_announced`` sorted by h and class: how many of its hashes another class has too, in parts.

    What is known of the last hash is held back between batches: class, whether another one had it, whether it is counted.
    """
    last = None

    def counted(ids):
        found, c = np.unique(ids, return_counts=True)
        return pa.RecordBatch.from_pydict({"class": found.astype(np.int64), "c": c.astype(np.int64)})

    for batch in batches:
        h, d, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        told = c > 0
        if told.any():
            yield pa.RecordBatch.from_pydict({"class": d[told], "c": c[told]})
        h, d, done = h[~told], d[~told], c[~told] < 0
        if not len(h):
            continue
        before = last is not None and last[2]
        if last is not None:
            h, d, done = np.r_[last[0], h], np.r_[last[1], d], np.r_[last[3], done]
        start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
        done = np.maximum.reduceat(done, start)
        h, d = h[start], d[start]
        same = h[1:] == h[:-1]
        twice = np.r_[before, same] | np.r_[same, False]
        last = (int(h[-1]), int(d[-1]), bool(twice[-1]), bool(done[-1]))
        yield counted(d[:-1][twice[:-1] & ~done[:-1]])
    if last is not None and last[2] and not last[3]:
        yield counted(np.array([last[1]]))


class SignatureTree:
    """Sets in an order that brings alike ones together; level 0 are the sets, each node above has 8 children."""

    FAN = 8

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        self.words = bits // 64
        map_ = np.zeros((len(sets), self.words), np.uint64)
        for k, s in enumerate(sets):
            at = (s >> np.uint64(7)) % np.uint64(bits)
            np.bitwise_or.at(map_[k], (at >> np.uint64(6)).astype(int), np.uint64(1) << (at & np.uint64(63)))
        n = np.array([len(s) for s in sets], np.int64)
        over = n - np.bitwise_count(map_).sum(1, dtype=np.int64)
        self.levels = [(map_, n, n, over)]
        while len(self.levels[-1][1]) > 1:
            map_, low, high, over = self.levels[-1]
            at = np.arange(0, len(low), self.FAN)
            self.levels.append(tuple(f.reduceat(x, at, axis=0) for f, x in zip((np.bitwise_or, np.minimum, np.maximum, np.maximum), self.levels[-1], strict=True)))

    def may_link(self, level: int, i: np.ndarray, j: np.ndarray, other: SignatureTree) -> np.ndarray:
        """False where no pair of sets below nodes i and j of the other tree can reach the similarity."""
        (m1, lo1, hi1, ov1), (m2, lo2, hi2, ov2) = self.levels[level], other.levels[level]
        fit = (4 * hi1[i] >= 3 * lo2[j]) & (4 * hi2[j] >= 3 * lo1[i])
        at = np.flatnonzero(fit)
        a, b = i[at], j[at]
        common = np.bitwise_count(m1[a] & m2[b]).sum(1, dtype=np.int64)
        most = np.minimum(np.minimum(ov1[a], ov2[b]) + common, np.minimum(hi1[a], hi2[b]))
        fit[at] = 7 * most >= 3 * (lo1[a] + lo2[b])
        return fit


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Exactly 100 * common >= 75 * united, on sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    common = int((b[np.minimum(at, len(b) - 1)] == a).sum())
    return 100 * common >= 75 * (len(a) + len(b) - common)


class Labels:
    """What is connected: labels that unite, the smaller one stays."""

    def __init__(self, label: np.ndarray):
        self.own, self.parent, self.changed = label, np.arange(int(label.max()) + 1), False

    def find(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return int(x)

    def unite(self, i: int, j: int) -> bool:
        """Of sets i and j; False if they were one before."""
        a, b = self.find(self.own[i]), self.find(self.own[j])
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.changed = True
        return a != b

    def all(self) -> np.ndarray:
        while not np.array_equal(up := self.parent[self.parent], self.parent):
            self.parent = up
        self.changed = False
        return self.parent[self.own]


def _first_tries(sets: list[np.ndarray], orders: int = 4) -> np.ndarray:
    """Pairs of sets next to each other among those that have one smallest hash, by several orders of the hashes."""
    at = np.cumsum([0, *map(len, sets[:-1])])
    whole, found = np.concatenate(sets), []
    for k in range(orders):
        low = np.minimum.reduceat(_mix(whole ^ _BYTE[k]), at)
        order = np.argsort(low, kind="stable")
        same = np.flatnonzero(low[order][1:] == low[order][:-1])
        found.append(np.c_[order[same], order[same + 1]])
    return np.concatenate(found)


def link(sets: list[np.ndarray], label: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of linked sets that join all of them that links connect, given who is connected already (label, from 0).

    side: with it, only pairs from different sides are looked at.
    """
    if len(sets) < 2:
        return []
    labels, found = Labels(label), []

    def try_(a: int, b: int) -> None:
        if labels.find(label[a]) != labels.find(label[b]) and similar(sets[a], sets[b]):
            labels.unite(a, b)
            found.append((a, b))

    for a, b in _first_tries(sets).tolist():
        if side is None or side[a] != side[b]:
            try_(a, b)
    now = labels.all()
    order = np.array(sorted(range(len(sets)), key=lambda k: (now[k], int(sets[k][0]), len(sets[k]), k)))
    mean = sum(map(len, sets)) / len(sets)
    tree = SignatureTree([sets[k] for k in order], 1 << min(16, max(8, int(4 * mean).bit_length())))
    slab = max(64, (1 << 23) // (8 * tree.words))
    top = len(tree.levels) - 1

    def ranges() -> list[tuple[np.ndarray, np.ndarray]]:
        """The smallest and the largest label below each node, by level."""
        low = high = labels.all()[order]
        out = [(low, high)]
        for _ in range(top):
            at = np.arange(0, len(low), SignatureTree.FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append((low, high))
        return out

    span, stack = ranges(), [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
    while stack:
        level, i, j = stack.pop()
        if len(i) > slab:
            stack += [(level, i[k : k + slab], j[k : k + slab]) for k in range(0, len(i), slab)][::-1]
            continue
        if labels.changed:
            span = ranges()
        low, high = span[level]
        keep = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        if not level:
            keep &= i < j
            if side is not None:
                keep &= side[order[i]] != side[order[j]]
        i, j = i[keep], j[keep]
        keep = tree.may_link(level, i, j, tree)
        i, j = i[keep], j[keep]
        if level:
            n, f = len(tree.levels[level - 1][1]), SignatureTree.FAN
            a = (i[:, None, None] * f + np.arange(f)[None, :, None]).repeat(f, 2).ravel()
            b = (j[:, None, None] * f + np.arange(f)[None, None, :]).repeat(f, 1).ravel()
            keep = (a < n) & (b < n) & (a <= b)
            if len(a):
                stack.append((level - 1, a[keep], b[keep]))
            continue
        for a, b in zip(order[i].tolist(), order[j].tolist(), strict=True):
            try_(a, b)
    return found


LINKS = "a long, b long"


def _linked(keys: int, sides: bool):
    """Links of each run of rows with equal keys: rows are (keys, doc_id, label, side, set), sorted by keys."""

    def links(held):
        sets = [np.frombuffer(x[3], np.uint64) for x in held]
        label = np.unique([x[1] for x in held], return_inverse=True)[1]
        side = np.array([x[2] for x in held])
        return [(held[a][0], held[b][0]) for a, b in link(sets, label, side if sides and side.min() != side.max() else None)]

    def run(batches):
        key, held = None, []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:keys] != key:
                    out += links(held) if held else []
                    key, held = row[:keys], []
                held.append(row[keys:])
            yield _pairs(out)
        yield _pairs(links(held) if held else [])

    return run


def _pairs(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in (0, 1)], ["a", "b"])


def _join(rows: DataFrame, keys: list[str], sides: bool = False) -> DataFrame:
    """Links inside each key: rows have keys, doc_id, label, side and set."""
    columns = [*keys, "doc_id", "label", "side", "set"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "doc_id")
    return dealt.select(*columns).mapInArrow(_linked(len(keys), sides), LINKS)


def _relabel(members: DataFrame, links: DataFrame) -> DataFrame:
    """label: what the links so far connect, by its smallest id."""
    found = connected_components(links, "a", "b").select(F.col("id").alias("doc_id"), F.col("component").alias("_root"))
    return members.drop("label").join(found, "doc_id", "left").withColumn("label", F.coalesce("_root", "doc_id")).drop("_root")


def _bucket() -> Column:
    """A set links only with those of its own size class or the one before or behind it."""
    return F.floor(F.log(4 / 3, F.col("n"))).cast("long")


def _links(members: DataFrame, chunk: int, part: int) -> DataFrame:
    """Links that connect what is to be connected, of members (component, doc_id, n, set)."""
    size = members.groupBy("component").agg(F.sum(F.col("n") + EACH).alias("_n"))
    parts = size.select("component", F.ceil(F.col("_n") / part).alias("parts"))
    members = members.join(parts, "component").withColumn("label", F.col("doc_id")).withColumn("side", F.lit(0))
    own = F.pmod(F.xxhash64("doc_id"), F.col("parts"))
    links = saved(_join(members.withColumn("chunk", own), ["component", "chunk"]))
    large = members.filter("parts > 1")
    if large.isEmpty():
        return links
    labelled = saved(_relabel(large, links))
    roots = labelled.filter("doc_id = label")
    links = links.unionByName(saved(_across(roots, chunk, part)))
    return links.unionByName(saved(_across(_relabel(large, links), chunk, part)))


def _across(members: DataFrame, chunk: int, part: int) -> DataFrame:
    """Links between and inside the chunks of members that are not yet connected.

    Chunks hold sets of one size class; a label with a part's worth of sets has chunks of its own, the others share
    theirs. A pair of chunks with one label, or of sizes too far apart, needs no look.
    """
    members = members.withColumn("bucket", _bucket())
    weight = F.sum(F.col("n") + EACH)
    size = members.groupBy("component", "bucket", "label").agg(weight.alias("_n"))
    # Small groups are cut into parts; of larger ones, FEW chunks or more, so that their pairs do not grow with the square of the parts.
    chunks_ = F.least(F.ceil(weight / part), F.greatest(F.lit(FEW), F.ceil(weight / chunk)))
    total = members.groupBy("component", "bucket").agg(chunks_.alias("_all"))
    share = size.join(total, ["component", "bucket"]).select(
        "component", "bucket", "label", (F.col("_n") >= part).alias("_own"), F.ceil(F.col("_n") / part).alias("_m"), "_all"
    )
    cut = members.join(share, ["component", "bucket", "label"])
    alone = F.xxhash64("label", "bucket", F.pmod(F.xxhash64("doc_id"), F.col("_m")))
    cut = cut.withColumn("chunk", F.when(F.col("_own"), alone).otherwise(F.xxhash64(F.lit("shared"), "bucket", F.pmod(F.xxhash64("label"), F.col("_all")))))
    cut = saved(cut.select("component", "doc_id", "n", "set", "label", "bucket", "chunk"))
    seen = saved(cut.groupBy("component", "bucket", "chunk").agg(F.min("label").alias("lo"), F.max("label").alias("hi")))
    x, y = (seen.select("component", *(F.col(c).alias(f"{c}{k}") for c in ("bucket", "chunk", "lo", "hi"))) for k in (1, 2))
    one = (F.col("lo1") == F.col("hi1")) & (F.col("lo2") == F.col("hi2")) & (F.col("lo1") == F.col("lo2"))
    near = (F.col("bucket1") < F.col("bucket2")) & (F.col("bucket2") - F.col("bucket1") <= 1) | (F.col("bucket1") == F.col("bucket2")) & (F.col("chunk1") <= F.col("chunk2"))
    pairs = x.join(y, "component").filter(near & ~one).select("component", "chunk1", "chunk2")
    left = pairs.withColumn("chunk", F.col("chunk1")).withColumn("side", F.lit(0))
    right = pairs.filter("chunk1 <> chunk2").withColumn("chunk", F.col("chunk2")).withColumn("side", F.lit(1))
    rows = cut.join(left.unionByName(right), ["component", "chunk"])
    return _join(rows, ["component", "chunk1", "chunk2"], sides=True)


def _full(batches):
    """(class, n, set) of (text): the whole set of each class, once a batch."""
    for batch in batches:
        for _, part in chunks(batch.column(0).to_pylist()):
            found = list({class_of(s): s for s in shingle_sets(part) if len(s)}.values())
            n, raw = pa.array([len(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())
            yield pa.RecordBatch.from_arrays([_named(found), n, raw], ["class", "n", "set"])


def _by_hash(rows: DataFrame) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "h").sortWithinPartitions("h", "class")


def _small(ids: DataFrame) -> DataFrame:
    """A saved table of ids, broadcast if its rows are few."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def near_components(docs: DataFrame, chunk: int = CHUNK, part: int = PART) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text)."""
    return _components(docs.select("doc_id", "text"), chunk, part).select("doc_id", "n_shingles", "component_id")


def _components(docs: DataFrame, chunk: int, part: int) -> DataFrame:
    """(doc_id, t1, t2, n_shingles, component_id, root): t1 and t2 name the row's text, root its component."""
    bounded_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(), "text")
    sets = saved(texts.mapInArrow(_sets, "doc_id long, t1 long, t2 long, n long, class long, prefix binary"))
    named = saved(sets.drop("prefix"))
    classes = saved(named.filter("n > 0").groupBy("class").agg(F.min("n").alias("n"), F.min("doc_id").alias("rep"), F.min(F.struct("t1", "t2")).alias("t")))
    announced = sets.filter("n > 0").select("class", "prefix").mapInArrow(_announced, "h long, class long, c long")
    parts = saved(_by_hash(announced).mapInArrow(_shared, "class long, c long"))
    discard(sets)
    count = parts.groupBy("class").agg(F.sum("c").alias("_c")).join(classes.select("class", "n", "t"), "class")
    able = saved(count.filter(F.col("_c") >= shared_need(F.col("n"))).select("t.t1", "t.t2"))
    picked = texts.select("t1", "t2", "text").join(_small(able), ["t1", "t2"], "left_semi").select("text")
    full = saved(picked.mapInArrow(_full, "class long, n long, set binary").groupBy("class").agg(F.first("n").alias("n"), F.first("set").alias("set")))
    # All hashes of those that are left, the rarest first: the prefix filter in its usual order.
    each = full.select("class", "set").mapInArrow(_hashes, "h long, class long")
    blocks = each.groupBy("h").agg(F.count("*").alias("_size")).filter("_size > 1")
    order = Window.partitionBy("class").orderBy("_size", "h")
    ranked = each.join(blocks, "h").withColumns({"_rank": F.row_number().over(order), "_all": F.count("*").over(Window.partitionBy("class"))})
    # Its hashes that nobody shares come first.
    rare = F.col("_rank") + F.col("n") - F.col("_all") <= F.col("n") - F.ceil(F.col("n") * 3 / 4) + 1
    kept = saved(ranked.join(full.select("class", "n"), "class").filter(rare).select("h", "class"))
    again = kept.groupBy("h").agg(F.min("class").alias("hub"), F.max("class").alias("_last")).filter("hub < _last").drop("_last")
    edges = kept.join(again, "h").select("class", "hub").distinct()
    routes = connected_components(edges, "class", "hub")
    sizes = routes.groupBy("component").count().filter("count > 1").select("component")
    members = saved(routes.join(sizes, "component", "left_semi").select(F.col("id").alias("class"), "component"))
    whole = full.join(_small(members), "class").select("component", F.col("class").alias("doc_id"), "n", "set")
    links = _links(whole, chunk, part)
    roots = connected_components(links, "a", "b").select(F.col("id").alias("class"), F.col("component").alias("_root"))
    rooted = classes.select("class", "rep").join(roots, "class", "left").withColumn("_root", F.coalesce("_root", "class"))
    least = rooted.groupBy("_root").agg(F.min("rep").alias("component_id"))
    found = rooted.join(least, "_root").select("class", "component_id", F.col("_root").alias("root"))
    out = named.join(found, "class", "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), own.alias("component_id"), "root")


def _text_keys() -> list[Column]:
    """128 bits of hashes of the text."""
    return [F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), F.col("text")).alias("t2")]


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of linked ones: that of the smallest doc_id, one of repeated ones. All columns stay.

    Rows without a doc_id come last in their group; texts without a word all stay.
    """
    keys = ["_doc", "t1", "t2"]
    rows = saved(_components(docs, CHUNK, PART).filter("n_shingles > 0").withColumnRenamed("doc_id", "_doc").select(*keys, "root"))
    first = F.min(F.struct(F.col("_doc").isNull().alias("none"), *keys))
    # Written, so that Spark can broadcast them or split the rows of a large group.
    groups = saved(rows.groupBy("root").agg(first.alias("f"), F.count("*").alias("many")).filter("many > 1"))
    stays = F.col("_doc").eqNullSafe(F.col("f._doc")) & (F.col("t1") == F.col("f.t1")) & (F.col("t2") == F.col("f.t2"))
    told = saved(rows.join(_small(groups), "root").select(*keys, stays.alias("stays")).groupBy(*keys, "stays").agg(F.count("*").alias("many")))
    own = [fresh(docs, k) for k in keys]
    named = docs.withColumns(dict(zip(own, [F.col("doc_id").cast("long"), *_text_keys()], strict=True)))

    def meet(df: DataFrame, others: DataFrame, how: str) -> DataFrame:
        others = _small(others.select(*(F.col(k).alias(f"_of_{o}") for k, o in zip(keys, own, strict=True))))
        on = [F.col(o).eqNullSafe(F.col(f"_of_{o}")) for o in own]
        return df.join(others, on[0] & on[1] & on[2], how)

    left, twice = meet(named, told.filter("not stays"), "left_anti"), told.filter("stays and many > 1")
    if not twice.isEmpty():
        left = meet(left, twice, "left_anti").unionByName(meet(left, twice, "left_semi").dropDuplicates(own))
    return left.select(*docs.columns)
