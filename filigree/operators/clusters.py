"""Clusters as (keys, cluster_id, item_id) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components


def unite_clusters(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, item_id, cluster_id): clusters that share an item become one, named by its smallest item."""
    hub = members.groupBy(*keys, "cluster_id").agg(F.min("item_id").alias("_hub"))
    edges = members.join(hub, [*keys, "cluster_id"]).select(*keys, F.col("_hub").alias("a"), F.col("item_id").alias("b"))
    found = connected_components(edges, "a", "b", keys)
    return found.select(*keys, F.col("id").alias("item_id"), F.col("component").alias("cluster_id"))


def cluster_pairs(members: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cluster_id, a, b): every pair of items of a cluster, as a result; links need ``unite_clusters`` only."""
    a, b = (members.withColumnRenamed("item_id", k) for k in ("a", "b"))
    return a.join(b, [*keys, "cluster_id"]).filter("a < b")
