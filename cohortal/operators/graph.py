"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortal.session import materialize


def connected_components(
    edges: DataFrame, a: str = "a", b: str = "b", node: str = "node", root: str = "root"
) -> DataFrame:
    """One row per node that has an edge: the node and the least node of its component.

    Alternates large-star and small-star rounds. Each round is two shuffles of the edge
    table, an aggregate that combines before it shuffles and a join that Spark may split
    on a hot node (its sides are two plain exchanges, which is what the checkpoint of the
    aggregate is for); nothing is gathered per component. Rounds are checkpointed. Edges with
    a null end are ignored, loops and repeated edges are allowed, an empty table gives an
    empty result.
    """
    e = materialize(
        edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
        .where("u is not null and v is not null")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    loops = e.where("u = v")
    e = e.where("u > v")
    while not _all_stars(e):
        e = materialize(_small_star(_large_star(e)))
    stars = e.select(F.col("u").alias(node), F.col("v").alias(root))
    centres = e.select(F.col("v").alias(node), F.col("v").alias(root)).distinct()
    alone = (
        loops.select(F.col("u").alias(node))
        .join(stars.select(node).union(centres.select(node)), node, "left_anti")
        .select(node, F.col(node).alias(root))
    )
    return stars.unionByName(centres).unionByName(alone)


def _all_stars(e: DataFrame) -> bool:
    """Whether every edge leads from a leaf of one edge to a centre; centres are least, as u > v."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(
        e.select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("centre"))
    )
    roles = ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre"))
    return roles.where("leaf + centre > 1").isEmpty()


def _large_star(e: DataFrame) -> DataFrame:
    """Link every greater neighbour of a node to the least of the node and its neighbours."""
    both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u > v")
        .distinct()
    )


def _small_star(e: DataFrame) -> DataFrame:
    """Link a node and its lesser neighbours to the least of these."""
    least = materialize(e.groupBy("u").agg(F.min("v").alias("m")))
    moved = e.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()
