"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.operators.joins import broadcast_if_small
from labelloom.staging import stage


#: Edges from which a node is heavy. There are at most so many times fewer heavy nodes than edges.
HEAVY = 500


def _with_least(edges: DataFrame, least: Column) -> DataFrame:
    """Edges ``u, v`` with ``m``, the least neighbour of ``u``. The few heavy nodes' is broadcast where it is small, so that
    no task gets all edges of one; the edges of others are shuffled."""
    found = stage(edges.groupBy("u").agg(least.alias("m"), F.count("*").alias("n")), "least")
    heavy = found.filter(F.col("n") > HEAVY).select("u", "m")
    light = found.filter(F.col("n") <= HEAVY).select("u", "m")
    if heavy.isEmpty():
        return edges.join(light, "u")
    heavy = broadcast_if_small(heavy)
    return edges.join(heavy, "u").unionAll(edges.join(heavy, "u", "left_anti").join(light, "u").select("u", "v", "m"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge, the component being its smallest node.

    Alternating large-star and small-star steps (Kiveris et al. 2014): each links a node's neighbours to the smallest
    of them. Every step is one aggregation with partial minima and one join, see :func:`_with_least`. Steps are written to the shared folder, so a lost executor costs one step at most. Loops and
    repeated edges do no harm; an empty table gives an empty one.
    """
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    pairs = stage(pairs, "edges")
    while True:
        both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least(F.min("v"), F.first("u"))).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.distinct(), "large-star")
        small = _with_least(large, F.min("v")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = stage(small.select("e.u", "e.v").filter("u <> v").distinct(), "small-star")
        changed = small.exceptAll(pairs).limit(1).count() + pairs.exceptAll(small).limit(1).count()
        pairs = small
        if not changed:
            break
    nodes = pairs.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    return nodes.unionAll(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
