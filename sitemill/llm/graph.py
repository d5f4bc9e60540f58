"""Connected components of a link table, as Spark joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitemill.session import materialise


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
    return r[0], r[1]


def components(links: DataFrame) -> DataFrame:
    """(id, root) for every id of ``links`` (a, b): root is the smallest id that links reach.

    Alternates two steps until nothing changes. Large star: each node passes its smallest
    neighbour (or itself) to its larger neighbours. Small star: each node passes its smallest
    neighbour to its smaller ones and takes it itself. Both keep components connected and end
    in one star for each. A round is two aggregations with map-side combine and two equi joins
    on narrow rows; only the edge count and a checksum come to the driver.
    """
    edges = links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "links")
    state = _state(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        edges = materialise(small, "stars")
        before, state = state, _state(edges)
        if state == before:
            break
    roots = edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
