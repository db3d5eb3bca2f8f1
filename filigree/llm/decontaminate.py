"""Benchmark items in documents, by SimHash fingerprints of item-sized windows. DataFrame functions only.

Texts are lower-cased (A to Z) and cut into words; shingles are five words in a row. Similarity is weighted:
every shingle counts as often as it occurs, so it is the common count over the united count, and an item
is found in a document if one of the document's windows of the item's size reaches ``SIMILARITY``. A document
shorter than the item is one window.

1. Items fall into size classes by their number of words. A window of a class that reaches ``SIMILARITY`` with
   an item of m shingles holds 3 / 7 of both their shingles, 6 m / 7 if it has the item's size; so only windows
   with so many shingles of any items of the class, in any order and place, are fingerprinted.
2. The fingerprint is the SimHash of the window's features, ``BITS`` bits. A feature is a shingle with the number
   of its occurrence in the window, so weighted similarity is that of sets of features, and all weigh one.
3. Multi-index: fingerprints are cut into blocks of ``BLOCK`` bits. Two within ``RADIUS`` differ in at most
   ``RADIUS // blocks`` bits of some block, so looking a window's blocks up among all variants of the blocks of
   the items of its class misses no pair within the radius.
4. Pairs within the radius are verified by the exact similarity.

The radius: at a similarity of 0.75 the cosine of two feature sets is 6 / 7 or more, so a bit differs with a
probability of 0.172 at most, and of 120 bits 20.7 +- 4.1 differ; 45 or more do in less than one of 10 million
such pairs.

A text of fewer than five words has one shingle, all its words; empty and null texts have none and match nothing.
Equal texts are looked at once. Each row of a document gets its matches, repeated rows and rows with a null
doc_id too; items of one item_id count as one, null too. Other columns are dropped, or kept by ``clean``.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, discard, fresh, saved

WORDS, SIMILARITY = 5, 0.75
BITS, BLOCK, RADIUS = 120, 8, 44
#: A fingerprint is kept in two numbers of so many bits.
HALF = BITS // 2
#: Bits that one sum counts, each in a lane of so many bits.
LANES, LANE = 3, 21
#: Rows of shingles, texts or index entries that may be broadcast (some 24 MB); beyond, Spark joins by shuffles.
BROADCAST_ROWS = 500_000
KEYS = ["k1", "k2"]


def words_of(text: Column) -> Column:
    """The words of a text; letters A to Z in lower case, no others changed."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), f"[{SPACE}]+"), "")


def shingle_at(words: Column, at: Column, width: Column) -> Column:
    return F.xxhash64(F.slice(words, at + 1, width))


def shingles_of(words: Column, width: Column) -> Column:
    """The hashes of all runs of ``width`` words in order, repeated ones too."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: shingle_at(words, i, width))).otherwise(F.array().cast("array<bigint>"))


def features_of(shingles: Column) -> Column:
    """Shingles as a set: the second occurrence of one, and so on, is another feature."""
    before = lambda x, i: F.size(F.filter(F.slice(shingles, F.lit(1), i), lambda y: y == x))
    numbered = F.transform(shingles, lambda x, i: F.when(before(x, i) == 0, x).otherwise(F.xxhash64(x, before(x, i))))
    return F.when(F.size(F.array_distinct(shingles)) == F.size(shingles), shingles).otherwise(numbered)


def fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, f1, f2) by the column features: a bit is set if more features have it than not."""
    each = rows.select(*keys, F.explode("features").alias("_f")).withColumn("_g", F.xxhash64("_f", F.lit(1)))
    at = range(0, HALF, LANES)
    # Written as SQL text, as there are so many of them.
    spread = lambda h, k: " | ".join(f"shiftleft(shiftright({h}, {k + j}) & 1L, {LANE * j})" for j in range(LANES))
    grouped = each.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.expr(f"sum({spread(h, k)}) AS {h}{k}") for h in ("_f", "_g") for k in at))
    set_ = lambda h, k, j: f"if(2 * (shiftright({h}{k}, {LANE * j}) & {(1 << LANE) - 1}L) > _n, {1 << (k + j)}L, 0L)"
    half = lambda h: F.expr(" | ".join(set_(h, k, j) for k in at for j in range(LANES)))
    return grouped.select(*keys, half("_f").alias("f1"), half("_g").alias("f2"))


def blocks(f1: str, f2: str) -> Column:
    """The fingerprint's blocks, lowest first, of two columns."""
    whole = lambda f, ks: [f"shiftright({f}, {k})" for k in ks]
    rest = HALF % BLOCK
    across = [f"shiftright({f1}, {HALF - rest}) | shiftleft({f2}, {rest})"] if rest else []
    parts = whole(f1, range(0, HALF - BLOCK + 1, BLOCK)) + across + whole(f2, range((BLOCK - rest) % BLOCK, HALF - BLOCK + 1, BLOCK))
    return F.expr(f"array({', '.join(f'({x}) & {(1 << BLOCK) - 1}L' for x in parts)})")


def masks() -> list[int]:
    """All changes of a block by RADIUS // blocks bits or fewer."""
    near = RADIUS // (BITS // BLOCK)
    return [sum(1 << b for b in c) for k in range(near + 1) for c in combinations(range(BLOCK), k)]


def _hint(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n words, width of shingles, m shingles, features, f1, f2) of every item with a word; item is a key of its own."""
    rows = benchmark.select("item_id", words_of(F.col("text")).alias("_words")).filter(F.size("_words") > 0)
    rows = rows.withColumns({"n": F.size("_words"), "width": F.least(F.lit(WORDS), F.size("_words"))})
    rows = rows.withColumn("_s", shingles_of(F.col("_words"), F.col("width")))
    rows = saved(rows.select(F.monotonically_increasing_id().alias("item"), "item_id", "n", "width", F.size("_s").alias("m"), "_s", features_of(F.col("_s")).alias("features")))
    return saved(rows.join(fingerprints(rows, ["item"]), "item"))


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the keys of their texts, k1 and k2: 128 bits of hashes."""
    return docs.withColumns({"k1": F.xxhash64("text"), "k2": F.xxhash64(F.lit(1), F.col("text"))})


def hits_of(texts: DataFrame, items: DataFrame) -> DataFrame:
    """(keys, n, width, m, places): where a text has shingles of items of the class n; only those with enough."""
    rows = keyed(texts).select(*KEYS, words_of(F.col("text")).alias("words"))
    known = saved(items.select("width", "n", "m", F.explode("_s").alias("h")).distinct())
    widths = [r.width for r in known.groupBy("width").count().sort("width").collect()] or [WORDS]  # five at most
    found = []
    for w in widths:
        last = F.size("words") - w
        # An outer explode: an inner one would have Spark cut the words twice.
        each = rows.select(*KEYS, "words", F.explode_outer(F.when(last >= 0, F.sequence(F.lit(0), last))).alias("at"))
        each = each.select(*KEYS, "at", F.when(F.col("at").isNotNull(), shingle_at(F.col("words"), F.col("at"), F.lit(w))).alias("h"))
        own = known.filter(F.col("width") == w)
        found.append(each.join(_hint(own, own.count()), "h").select(*KEYS, "n", "width", "m", "at"))
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    places = hits.groupBy(*KEYS, "n", "width", "m").agg(F.sort_array(F.collect_set("at")).alias("places"))
    return places.filter(4 * F.size("places") >= 3 * F.col("m"))


def windows_of(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(keys, n, m, start, features) of every window with enough shingles of items of its class."""
    texts = docs.select("text")
    hits = saved(hits_of(texts, items))
    keys = saved(hits.select(*KEYS).distinct())
    held = keyed(texts).join(_hint(keys, keys.count()), KEYS, "left_semi").groupBy(*KEYS).agg(F.first("text").alias("text"))
    held = held.select(*KEYS, words_of(F.col("text")).alias("words"))
    rows = hits.join(held, KEYS)
    n, m, places = F.col("n"), F.col("m"), F.col("places")
    size = F.least(m, F.size("words") - F.col("width") + 1)
    rows = rows.withColumns({"need": F.ceil(3 * (m + size) / 7).cast("int"), "last": F.greatest(F.size("words") - n, F.lit(0))})
    # The first hit of a window is hit r: then it starts behind hit r - 1, and hit r + need - 1 is still in it.
    low = lambda r: F.greatest(F.when(r > 0, F.get(places, r - 1) + 1).otherwise(0), F.get(places, r + F.col("need") - 1) - m + 1)
    high = lambda r: F.least(F.get(places, r), F.col("last"))
    run = lambda r: F.when(low(r) <= high(r), F.sequence(low(r), high(r))).otherwise(F.array().cast("array<int>"))
    enough = F.size("places") - F.col("need")
    starts = F.when(enough >= 0, F.flatten(F.transform(F.sequence(F.lit(0), enough), run)))
    rows = rows.select(*KEYS, "n", "m", shingles_of(F.col("words"), F.col("width")).alias("_s"), F.explode_outer(starts).alias("start"))
    return rows.filter(F.col("start").isNotNull()).select(*KEYS, "n", "m", "start", features_of(F.slice("_s", F.col("start") + 1, F.col("m"))).alias("features"))


def proposals(windows: DataFrame, items: DataFrame) -> DataFrame:
    """(keys, n, start, item): windows (keys, n, start, f1, f2) and items of their class within RADIUS, by the multi-index."""
    variants = F.expr(f"array({', '.join(f'{x}L' for x in masks())})")
    index = items.select("item", F.col("n").alias("_n"), F.col("f1").alias("_i1"), F.col("f2").alias("_i2"), F.posexplode(blocks("f1", "f2")).alias("_block", "_value"))
    index = saved(index.select("item", "_n", "_i1", "_i2", "_block", F.explode(F.transform(variants, lambda x: F.col("_value").bitwiseXOR(x))).alias("_variant")))
    probes = windows.select(*KEYS, "n", "start", "f1", "f2", F.posexplode(blocks("f1", "f2")).alias("block", "value"))
    on = (F.col("n") == F.col("_n")) & (F.col("block") == F.col("_block")) & (F.col("value") == F.col("_variant"))
    near = F.expr("bit_count(f1 ^ _i1) + bit_count(f2 ^ _i2)") <= RADIUS
    return probes.join(_hint(index, index.count()), on).filter(near).select(*KEYS, "n", "start", "item").distinct()


def matched_texts(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(keys, item_id, similarity): every item that a text holds, with its best window's similarity; saved."""
    items = items_of(benchmark)
    windows = saved(windows_of(docs, items))
    near = proposals(saved(fingerprints(windows, [*KEYS, "n", "start"])), items)
    own = items.select("item", "item_id", "m", F.col("features").alias("_ifeatures"))
    full = near.join(windows.drop("m"), [*KEYS, "n", "start"]).join(_hint(own, 32 * items.count()), "item")
    both = F.size(F.array_intersect("features", "_ifeatures"))
    checked = full.select(*KEYS, "item_id", both.alias("_both"), (F.size("features") + F.col("m") - both).alias("_union"))
    checked = checked.filter(100 * F.col("_both") >= int(100 * SIMILARITY) * F.col("_union"))
    out = saved(checked.groupBy(*KEYS, "item_id").agg(F.max(F.col("_both") / F.col("_union")).alias("similarity")))
    discard(windows)
    return out


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity): every item that a row of docs (doc_id, text) holds."""
    found = matched_texts(docs, benchmark)
    rows = keyed(docs.select("doc_id", "text")).select("doc_id", *KEYS)
    return rows.join(_hint(found, found.count()), KEYS).select("doc_id", "item_id", "similarity")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold an item; all columns and other rows stay."""
    gone = saved(matched_texts(docs, benchmark).select(*KEYS).distinct())
    own = [fresh(docs, f"_{k}") for k in KEYS]
    rows = docs.withColumns(dict(zip(own, (F.xxhash64("text"), F.xxhash64(F.lit(1), F.col("text"))), strict=True)))
    return rows.join(_hint(gone.toDF(*own), gone.count()), own, "left_anti").select(*docs.columns)
