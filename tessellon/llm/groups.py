"""Consolidating pairwise matches into groups by low-diameter decomposition.

Every vertex draws an exponential shift. Clusters grow from all vertices at
once, a vertex with a large shift starting early, and each vertex joins the
cluster that reaches it first. Clusters contract to super-vertices, the edges
between clusters are the next level's graph, and at the end the assignments of
all levels are composed. A vertex only ever takes a label that came along an
edge, so cutting growth off after `rounds` hops never joins what isn't linked;
it only leaves more to the next level.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.plans.lineage import cut


def _decompose(arcs: DataFrame, level: int, rate: float, rounds: int) -> DataFrame:
    """(v, c): the cluster of every vertex of arcs (u, v), which hold both directions."""
    unit = (F.shiftrightunsigned(F.xxhash64("u", F.lit(level)), 11).cast("double") + 0.5) / float(1 << 53)
    state = arcs.select("u").distinct().select("u", (F.log(unit) / rate).alias("at"), F.col("u").alias("c"))
    for i in range(rounds):
        if i and i % 2 == 0:
            state = cut(state)  # small plans of one shape keep the driver small
        told = arcs.join(state, "u").select(F.col("v").alias("u"), (F.col("at") + 1.0).alias("at"), "c")
        # numbers only, so that this is a hash aggregate; of two that come at one time either will do
        state = state.unionByName(told).groupBy("u").agg(F.min_by("c", "at").alias("c"), F.min("at").alias("at")).select("u", "at", "c")
    return state.select(F.col("u").alias("v"), "c")


def components(edges: DataFrame, rate: float = 0.05, rounds: int = 4, max_levels: int = 60) -> DataFrame:
    """(v bigint, root bigint) for every vertex of edges (a bigint, b bigint).

    Self-loops and nulls are ignored; repeated and reversed edges count once.
    Vertices without an edge to another vertex don't come out. An empty input
    gives an empty result.
    """
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    left = edges.where("a is not null and b is not null and a <> b").select(a, b).distinct()
    levels: list[DataFrame] = []
    for level in range(max_levels):
        arcs = cut(left.select(F.col("a").alias("u"), F.col("b").alias("v")).union(left.select("b", "a")))
        if arcs.isEmpty():
            break
        found = cut(_decompose(arcs, level, rate, rounds))
        levels.append(found)
        ends = arcs.where("u < v").join(found.select(F.col("v").alias("u"), F.col("c").alias("a")), "u")
        ends = ends.join(found.select("v", F.col("c").alias("b")), "v").where("a <> b")
        left = ends.select(a, b).distinct()
    else:
        raise RuntimeError("the decomposition did not end")
    if not levels:
        return left.select(F.col("a").alias("v"), F.col("b").alias("root"))
    above = levels[-1].select(F.col("v").alias("c"), F.col("c").alias("root"))
    for found in reversed(levels[:-1]):
        above = found.join(above, "c", "left").select(F.col("v").alias("c"), F.coalesce("root", "c").alias("root"))
    return above.select(F.col("c").alias("v"), "root")


def name_groups(matches: DataFrame, names: DataFrame, rate: float = 0.05, rounds: int = 4) -> DataFrame:
    """(entity_name, group_name): every distinct non-null name of `names` (name) and `matches` (a, b strings) with the smallest name of its group.

    Null ends make no match; a name that matches only itself or nothing is its
    own group. Names are compared as they stand, the empty string included.
    Other columns are ignored.
    """
    pairs = matches.select("a", "b").where("a is not null and b is not null and a <> b")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    every = names.select("name").union(matches.select("a")).union(matches.select("b")).where("name is not null").distinct()
    every = cut(every.withColumn("id", F.monotonically_increasing_id()))
    ends = pairs.join(every.select(F.col("name").alias("a"), F.col("id").alias("ia")), "a").join(every.select(F.col("name").alias("b"), F.col("id").alias("ib")), "b")
    roots = cut(components(ends.select(F.col("ia").alias("a"), F.col("ib").alias("b")), rate, rounds))
    linked = every.join(roots.withColumnRenamed("v", "id"), "id", "left").select("name", F.coalesce("root", "id").alias("root"))
    least = linked.groupBy("root").agg(F.min("name").alias("group_name"))
    return linked.join(least, "root").select(F.col("name").alias("entity_name"), "group_name")
