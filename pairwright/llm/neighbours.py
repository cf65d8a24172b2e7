"""Approximate nearest neighbours by stable projections and kd-trees with a chi-square stopping test.

Vectors are projected to ``DIMENSIONS`` numbers by a Gaussian (2-stable) matrix. A projected squared distance divided by the true
one then follows a chi-square law, so candidates come in the order of projected distance and are verified on the original vectors,
until the chance that an unseen vector is closer than the k-th best falls below 1 - ``CONFIDENCE``: the search stops at
projected distance r when r^2 > q d_k^2, q being the chi-square quantile.

Equal vectors are one point with its smallest ids (``NEIGHBOURS`` + 1 of them; more can never be among the nearest, as ties go to the
smaller id). Points are dealt to cells by a kd-tree over a bounded sample of projections, every point is indexed, and each cell has a
kd-tree of its own. A query first searches its own cell; the bound it finds decides by the same test which other cells it must
visit, and the best of all cells are merged. The test's answers depend on the data alone, not on the dealing, but for ties of
projected distance.

Vectors that are null or zero, or hold null or non-finite components, take no part; so do rows with a null id. Vectors of another length than most
are only compared with their like: a search runs within one length. Fewer candidates than k are all returned. Repeated rows (same id and vector)
count once; one id with different vectors is a candidate with each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pairwright.llm.registry import query
from pairwright.operators.keyed import attach
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

DIMENSIONS = 8
NEIGHBOURS = 10
CONFIDENCE = 0.93
CELL_ROWS = 20_000
SAMPLE = 20_000
LEAF = 128
SEED = 11
QUERY_STEP = 100


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile for an even number of degrees of freedom, by bisection on the Poisson form of the law."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    lo, hi = 0.0, 1.0
    while below(hi) < p:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


def projection(length: int, dimensions: int = DIMENSIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, length]).standard_normal((length, dimensions))


class KdTree:
    """Balanced kd-tree; its leaves, with their bounding boxes, come out by distance from a point."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF) -> None:
        self.points = points
        self.leaves: list[np.ndarray] = []
        self._cut(np.arange(len(points)), leaf)
        self.low = np.array([points[rows].min(axis=0) for rows in self.leaves])
        self.high = np.array([points[rows].max(axis=0) for rows in self.leaves])

    def _cut(self, rows: np.ndarray, leaf: int) -> None:
        if len(rows) <= leaf:
            self.leaves.append(rows)
            return
        mine = self.points[rows]
        axis = int(np.argmax(np.ptp(mine, axis=0)))
        order = np.argpartition(mine[:, axis], len(rows) // 2)
        self._cut(rows[order[: len(rows) // 2]], leaf)
        self._cut(rows[order[len(rows) // 2 :]], leaf)

    def incremental(self, point: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """Leaves by the squared distance of their box, which no point of them or of later ones undercuts, with their rows and
        the rows' own squared distances."""
        off = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        gaps = (off * off).sum(axis=1)
        for leaf in np.argsort(gaps, kind="stable"):
            rows = self.leaves[leaf]
            apart = self.points[rows] - point
            yield float(gaps[leaf]), rows, (apart * apart).sum(axis=1)


def search(tree: KdTree, vectors: np.ndarray, point: np.ndarray, vector: np.ndarray, weights: np.ndarray, k: int, quantile: float, bound: float):
    """Distances and rows of the nearest found; rows stand for ``weights`` ids and ``k`` ids are wanted. ``bound`` is a known k-th distance."""
    distances, found, limit = np.zeros(0), np.zeros(0, "i8"), bound
    for reach, rows, apart in tree.incremental(point):
        if reach > quantile * limit * limit:
            break
        rows = rows[apart <= quantile * limit * limit]
        off = vectors[rows] - vector
        mine = np.sqrt((off * off).sum(axis=1))
        near = mine <= limit
        if not near.any():
            continue
        distances, found = np.r_[distances, mine[near]], np.r_[found, rows[near]]
        order = np.argsort(distances, kind="stable")
        distances, found = distances[order], found[order]
        held = np.cumsum(weights[found])
        if held[-1] >= k:
            limit = min(limit, float(distances[np.searchsorted(held, k)]))
            keep = distances <= limit
            distances, found = distances[keep], found[keep]
    return list(zip(distances.tolist(), found.tolist(), strict=True))


def points_of(vectors: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """``vector, ids``: distinct usable vectors as doubles with their ``k + 1`` smallest ids."""
    values = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), values.alias("vector"))
    fine = "forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(vector, x -> x <> 0)"
    # -0.0 and 0.0 are one number
    rows = rows.where(fine).withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0))).distinct()
    # smallest ids per vector and salt first, so a vector that many rows share never meets in one task
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    first = salted.withColumn("_n", F.row_number().over(Window.partitionBy("vector", "_salt").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    ranked = first.withColumn("_n", F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))).where(F.col("_n") <= k + 1)
    return ranked.groupBy("vector").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))


class Cells:
    """A kd-tree over a sample of projections, cut into cells; each cell is the box that its splits leave."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.splits: list[tuple] = []
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        width = sample.shape[1]
        self.root = self._cut(sample, cells, np.full(width, -np.inf), np.full(width, np.inf))

    def _cut(self, points: np.ndarray, cells: int, low: np.ndarray, high: np.ndarray) -> int:
        if cells <= 1 or len(points) < 2 or not np.ptp(points, axis=0).max():
            self.boxes.append((low, high))
            return -len(self.boxes)
        axis = int(np.argmax(np.ptp(points, axis=0)))
        value = float(np.median(points[:, axis]))
        if not (points[:, axis] < value).any():
            value = float(points[points[:, axis] > value, axis].min())
        under = points[:, axis] < value
        upper, lower = low.copy(), high.copy()
        upper[axis], lower[axis] = value, value
        children = self._cut(points[under], cells // 2, low, lower), self._cut(points[~under], cells - cells // 2, upper, high)
        self.splits.append((axis, value, *children))
        return len(self.splits) - 1

    def of(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), "i8")
        stack = [(self.root, np.arange(len(points)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -node - 1
                continue
            axis, value, under, over = self.splits[node]
            low = points[rows, axis] < value
            stack += [(under, rows[low]), (over, rows[~low])]
        return out

    @property
    def low(self) -> np.ndarray:
        return np.array([box[0] for box in self.boxes])

    @property
    def high(self) -> np.ndarray:
        return np.array([box[1] for box in self.boxes])


def nearest_neighbours(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, confidence: float = CONFIDENCE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``step``, against all rows."""
    quantile = chi_square_quantile(confidence, DIMENSIONS)
    points = cut_lineage(points_of(vectors, k).withColumn("length", F.size("vector")))
    total = points.count()
    sample = points.orderBy(F.xxhash64("vector")).limit(SAMPLE).select("length", "vector").collect()
    forest = {
        length: Cells(np.array([r["vector"] for r in sample if r["length"] == length]) @ projection(length), max(1, -(-total // CELL_ROWS)))
        for length in {r["length"] for r in sample}
    }

    def project(pdf: pd.DataFrame, length: int) -> tuple[np.ndarray, np.ndarray]:
        mine = np.array(pdf["vector"].tolist(), "f8").reshape(len(pdf), length)
        return mine, mine @ projection(length)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cell = np.zeros(len(batch), "i8")
            for length, rows in batch.groupby("length").indices.items():
                if length in forest:
                    cell[rows] = forest[length].of(project(batch.iloc[rows], length)[1])
            yield batch.assign(cell=cell)

    kinds = "vector array<double>, ids array<long>, length int, cell long"
    placed = cut_lineage(points.mapInPandas(place, kinds))
    # a point is searched for once, however many queries have its vector
    asked = vectors.where(f"vec_id % {step} = 0").select(F.col("vec_id").cast("long").alias("query_id"), F.transform("embedding", lambda x: x.cast("double") + F.lit(0.0)).alias("vector")).distinct()
    seekers = cut_lineage(placed.join(asked.select("vector").distinct(), "vector", "left_semi").select("vector", "length", "cell"))

    def within(bounded: bool):
        def run(key, seek: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
            out = []
            if len(seek) and len(pdf):
                length = int(key[0])
                mine, flat = project(pdf, length)
                ids = pdf["ids"].tolist()
                weights = np.array([len(i) for i in ids])
                tree = KdTree(flat)
                theirs, aims = project(seek, length)
                bounds = seek["bound"].to_numpy("f8") if bounded else np.full(len(seek), np.inf)
                for n in range(len(seek)):
                    for distance, row in search(tree, mine, aims[n], theirs[n], weights, k + 1, quantile, bounds[n]):
                        out.append((length, int(key[1]), theirs[n].tolist(), ids[row], distance))
            return pd.DataFrame(out, columns=["length", "home", "vector", "ids", "score"])

        return run

    result = "length int, home long, vector array<double>, ids array<long>, score double"
    homes = seekers.select(F.col("length").alias("_l"), F.col("cell").alias("_c"), "vector")
    first = cut_lineage(homes.groupBy("_l", "_c").cogroup(placed.groupBy("length", "cell")).applyInPandas(within(False), result))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        boxes = {length: (cells.low, cells.high) for length, cells in forest.items()}
        for batch in batches:
            out = []
            for length, home, vector, bound in zip(batch["length"], batch["home"], batch["vector"], batch["bound"], strict=True):
                if length in boxes:
                    aim = np.asarray(vector) @ projection(length)
                    low, high = boxes[length]
                    off = np.maximum(np.maximum(low - aim, aim - high), 0)
                    for cell in np.flatnonzero((off * off).sum(axis=1) <= quantile * bound * bound):
                        if cell != home:
                            out.append((length, int(cell), vector, bound))
            yield pd.DataFrame(out, columns=["_l", "_c", "vector", "bound"])

    # the k-th distance in the home cell; with too few points there, every cell is visited
    held = first.groupBy("length", "home", "vector").agg(F.sum(F.size("ids")).alias("_n"), F.max("score").alias("_far"))
    bound = F.when(F.col("_n") >= k + 1, F.col("_far")).otherwise(F.lit(math.inf))
    routed = held.select("length", "home", "vector", bound.alias("bound")).mapInPandas(route, "_l int, _c long, vector array<double>, bound double")
    others = placed.select(F.col("length").alias("l2"), F.col("cell").alias("c2"), "vector", "ids")
    second = routed.groupBy("_l", "_c").cogroup(others.groupBy("l2", "c2")).applyInPandas(within(True), result)
    met = first.unionByName(second).select("vector", "score", F.explode("ids").alias("vec_id"))
    best = met.withColumn("_n", F.row_number().over(Window.partitionBy("vector").orderBy("score", "vec_id"))).where(F.col("_n") <= k + 1)
    lists = best.groupBy("vector").agg(F.array_sort(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    answers = attach(asked, cut_lineage(lists), ["vector"], spread=["query_id"])
    others_only = F.filter("near", lambda x: x["vec_id"] != F.col("query_id"))
    ranked = answers.select("query_id", F.posexplode(F.slice(others_only, 1, k)).alias("_p", "_x"))
    return ranked.select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_x.vec_id").alias("vec_id"), F.col("_x.score").alias("score"))


@query("op2_projected_neighbours")
def op2_projected_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    return nearest_neighbours(table(spark, folder, "embeddings"))
