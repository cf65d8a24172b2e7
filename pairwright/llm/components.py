"""Connected components of many small groups and a few very large ones.

Each round joins every node's neighbours to the smallest node around it and then contracts what lies in one task by
union-find, so stars and short chains need two or three rounds. Rounds are cut with checkpoints; large nodes are left to the
splitting of skewed joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwright.session import cut_lineage


def contracted(edges: DataFrame) -> DataFrame:
    """Star edges ``u > v`` with the same components inside each partition."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict[int, int] = {}

        def root(node: int) -> int:
            top = node
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(node, node) != top:
                parent[node], node = top, parent[node]
            return top

        for batch in batches:
            for u, v in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        stars = [(node, root(node)) for node in parent]
        yield pd.DataFrame([s for s in stars if s[0] != s[1]], columns=["u", "v"], dtype="int64")

    return edges.select("u", "v").where("u <> v").mapInPandas(run, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` of every node with an edge; the component is its smallest node."""
    stars = cut_lineage(contracted(edges))
    while True:
        ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("up")).unionByName(stars.select(F.col("v").alias("node"), F.lit(0).alias("up")))
        # settled when every node has one edge up, or only edges from below
        unsettled = ends.groupBy("node").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where("ups > 1 or (ups = 1 and low = 0)")
        if unsettled.isEmpty():
            roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(lowest, "u")
        hooked = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(lowest.select("u", F.col("m").alias("v")))
        stars = cut_lineage(contracted(hooked.where("u <> v").distinct()))
