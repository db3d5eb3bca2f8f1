"""Connected components, and what is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filigree.sources.scratch import discard, saved


def _stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Each node's neighbours move to the smallest node among them; at the end every node points at its root."""
    both = edges.select(*keys, "u", "v").unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).select(*keys, "u", F.least("u", "m").alias("m"))
    large = both.join(low, [*keys, "u"]).filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.distinct()
    low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
    moved = large.join(low, [*keys, "u"]).select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select(*keys, "u", F.col("m").alias("v"))).filter("u > v").distinct()


def connected_components(edges: DataFrame, a: str, b: str, keys: list[str] = ()) -> DataFrame:
    """(keys, id, component) for every node of an edge (a, b); component is the smallest id that it reaches.

    By turns of large and small stars, so that the rounds grow with the logarithm of a component's size and
    no node gathers its component. Within ``keys``, components are apart. Nodes whose only edge is a loop
    are components of their own; edges with a null end are left out.
    """
    keys = list(keys)
    all_edges = edges.select(*keys, F.col(a).alias("u"), F.col(b).alias("v")).dropna(subset=["u", "v"])
    links = saved(all_edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    loops = links.filter("u = v").select(*keys, F.col("u").alias("id"))
    state, mark = links.filter("u > v"), None
    while True:
        before, state = state, saved(_stars(state, keys))
        if mark is not None:  # the first state is a part of links, which the result reads
            discard(before)
        # The sum of hashes is taken as a decimal, which cannot overflow.
        total = F.sum(F.xxhash64(*keys, "u", "v").cast("decimal(38,0)"))
        new = tuple(state.agg(F.count("*"), total).first())
        if new == mark:
            break
        mark = new
    roots = state.select(*keys, F.col("v").alias("id")).unionByName(loops).distinct()
    own = roots.join(state.select(*keys, F.col("u").alias("id")), [*keys, "id"], "left_anti")
    return state.select(*keys, F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        own.select(*keys, "id", F.col("id").alias("component"))
    )
