"""Connected components of a confirmed-relation graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.operators.keyed import attach
from pairwright.session import cut_lineage


def star_edges(members: DataFrame, group: str, node: str) -> DataFrame:
    """Edges from every member of a group to its smallest member: n - 1 edges and never all pairs."""
    centres = members.groupBy(group).agg(F.min(node).alias("v"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = attach(members, centres, [group], spread=[node])
    return joined.select(F.col(node).alias("u"), "v").where("u <> v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node with an edge; the component is its smallest node.

    Alternates large-star and small-star steps: each node links its neighbours to the smallest one,
    so long chains collapse in a logarithmic number of rounds. Minima are aggregated before the
    shuffle and hot centres are salted. Rounds are checkpointed; it stops when a round changes nothing.
    """
    stars = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    size = stars.count()
    while True:
        before, before_size = stars, size
        stars = cut_lineage(_small_star(_large_star(stars)))
        size = stars.count()
        # edges are distinct, so equal counts and no new edge mean that nothing changed
        if size == before_size and stars.join(before, ["u", "v"], "left_anti").isEmpty():
            roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = attach(both.where("v > u"), lowest, ["u"], spread=["v"])
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    lowest = down.groupBy("u").agg(F.min("v").alias("m"))
    smaller = attach(down, lowest, ["u"], spread=["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(lowest.select("u", F.col("m").alias("v"))).distinct()


def crossing_components(labels: DataFrame, blocks: DataFrame, node: str, block: str) -> DataFrame:
    """Components with their size and how many outer blocks they touch."""
    joined = labels.withColumnRenamed("node", node).join(blocks.select(node, block), node)
    per_block = joined.groupBy("component", block).agg(F.count(F.lit(1)).alias("_n"))
    return per_block.groupBy("component").agg(
        F.sum("_n").alias("n_items"), F.count(F.lit(1)).alias("n_blocks"), (F.count(F.lit(1)) > 1).alias("crosses")
    )
