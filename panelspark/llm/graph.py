"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import stage


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """One row ``(node, component)`` per node that is not the smallest of its component.

    Large-star and small-star steps in turn: every node hands its larger neighbours, then its smaller
    ones, to the smallest neighbour it knows. A step keeps at most as many edges as it found, so a hub
    never turns into pairs, and chains shorten by half at least. Each round is a staged table; no edge
    comes to the driver. Loops and edges with a null end are left out; an empty list gives no row.
    """
    known = F.col(src).isNotNull() & F.col(dst).isNotNull()
    ends = edges.where(known).select(F.greatest(src, dst).alias("a"), F.least(src, dst).alias("b"))
    current = stage(ends.where("a != b").distinct(), "edges")
    state = _state(current)
    while state[0]:
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = (both.join(least, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        parent = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(parent, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(parent.select("a", F.col("m").alias("b"))).distinct())
        current = stage(small, "edges")
        state, before = _state(current), state
        if state == before:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component"))


def _state(edges: DataFrame) -> tuple:
    """Count and order-free digest of an edge list."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())
