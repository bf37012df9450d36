"""Connected components of an edge table by alternating large-star and small-star steps, on the executors alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Link the neighbours of each node to its smallest neighbour: the larger ones (both), or the smaller ones."""
    arcs = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else edges
    least = cut(arcs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "star")
    met = arcs.join(least, "a")
    if both:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a long, b long) edges in any order -> (node, component): component is the smallest node reachable.

    Self-links, repeated and reversed edges and nulls are allowed; nodes without an edge are not returned.
    The number of rounds is logarithmic; each round writes its edges to the shared folder."""
    now = cut(edges.where("a is not null and b is not null and a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = _state(now)
    while seen[0]:
        now = cut(_star(cut(_star(now, True), "large"), False), "small")
        state = _state(now)
        if state == seen:
            break
        seen = state
    tops = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(tops)
