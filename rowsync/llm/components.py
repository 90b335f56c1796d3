"""Connected components of a link table, as Spark joins and aggregates.

Alternates the large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond"). A hub's neighbours are never gathered:
each step takes the smallest neighbour by a partial aggregate, writes it and joins
it back: both sides of the join are then read by an exchange of their own, which
lets AQE split a hub's rows. Every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _state(edges: DataFrame):
    return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``links``; the component is the
    smallest node reachable. Links with a null end and loops are ignored."""
    x, y = F.col(a), F.col(b)
    edges = written(links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "cc")
    before = _state(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u != v").distinct()
        # small star: all of u's smaller neighbours and u point to the smallest
        large = written(large, "cc-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            least.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u != v").distinct(), "cc")
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
