"""Exact top-k by integer inner product: a table of distances to pivots bounds every score, candidates are taken in bound order.

Components become floor(256 x). With one more coordinate, sqrt(M^2 - |v|^2) for candidates (M the largest norm) and 0 for queries, the
inner product is (|q|^2 + M^2 - d^2) / 2 for a Euclidean distance d, so the k best scores are the k nearest. Pivots are picked by
farthest-first traversal of a bounded sample (``SAMPLE`` rows, only this choice depends on it); the distance of every vector to every
pivot is computed once. The triangle inequality gives d(q, v) >= max over pivots of |d(q, p) - d(v, p)|, an upper bound on the score; a
candidate is evaluated only while its bound reaches the k-th score found. Bounds carry a slack above their rounding error; scores are exact.

On the cluster, candidates form tiles of at most ``TILE_ROWS`` rows with the same nearest two pivots; a tile is one packed row, cut into leaves
of ``LEAF_ROWS``, and each tile and leaf has the range of its distances to each pivot. A query is searched in its own tile first, where the tile
is made, and the queries of neighbouring tiles then form packed blocks. Blocks are read beside every tile whose ranges leave room for a score they
must reach: nothing is shuffled for it, so disk follows the input and not queries times tiles. A task holds one tile and one
block at a time, takes leaves by falling bound and keeps ``k`` rows a query. Where bounds do not bite (random directions) this is a blocked
search of the stated queries against all rows.

Rows with a null id or vector, or holding null components or components whose 256-fold is not finite, take no part. Zero and empty vectors do.
A shorter vector counts as filled up with zeros. Rows with the query's own id are not its candidates; other repeated rows each are one. Repeated
query rows repeat their answers. Ties go to the smaller id. Scores beyond 64 bits are the nearest 64-bit number. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.llm.registry import query
from pairwright.session import cut_lineage
from pairwright.sources.tables import table

NEIGHBOURS = 5
QUERY_STEP = 50
PIVOTS = 32
SAMPLE = 2_048
TILE_ROWS = 16_384
LEAST_TILE_ROWS = 2_048
TILE_BYTES = 32 << 20
LEAF_ROWS = 256
CHUNK_LEAVES = 8
BLOCK_QUERIES = 2_048
CHUNK_QUERIES = 1_024
CHUNK_HITS = 1 << 18
TILE_PARTS = 32
BLOCK_PARTS = 16
FIRST_CHUNK = 64
SLACK = 1e-5

LONG = (-(2**63), 2**63 - 1)
EXACT = 2.0**53
#: Largest squared norms up to which sums of products are whole numbers that four and eight bytes hold.
EXACT_4, EXACT_8 = 2.0**24, 2.0**52
SHORT = 2**15 - 1
PACKED = "id long, vector binary, norm double, length int, largest double"
FOUND = "slots binary, found binary, scores binary"
TILES = f"tile int, ids binary, vectors binary, lows binary, highs binary, low array<double>, high array<double>, own binary, asked binary, {FOUND}"
BLOCKS = f"block int, own binary, asked binary, homes binary, least binary, cut binary, near array<double>, far array<double>, reach double, floor long, {FOUND}"


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """``id, vector, norm, length, largest``: usable vectors as packed floor(256 x), of two bytes a component where they fit, with squared norms."""
    rows = vectors.where("vec_id is not null and embedding is not null").select(
        F.col("vec_id").cast("long").alias("id"), F.transform("embedding", lambda x: F.lit(256.0) * x.cast("double")).alias("scaled")
    )
    fine = rows.where("forall(scaled, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("scaled")
            lengths = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
            found = np.split(flat, np.cumsum(lengths)[:-1])
            largest = [float(np.abs(values).max(initial=0)) for values in found]
            data = [(values.astype("<i2") if most <= SHORT else values).tobytes() for values, most in zip(found, largest, strict=True)]
            with np.errstate(over="ignore"):
                norms = [float(values @ values) for values in found]
            columns = [pa.array(data, pa.binary()), pa.array(norms), pa.array(lengths, pa.int32()), pa.array(largest)]
            yield pa.record_batch([batch.column("id"), *columns], names=["id", "vector", "norm", "length", "largest"])

    return fine.mapInArrow(pack, PACKED)


def padded(table: pa.Table | pa.RecordBatch, width: int) -> np.ndarray:
    """Packed vectors as a matrix, filled up with zeros."""
    data, lengths = table.column("vector").to_pylist(), table.column("length").to_pylist()
    if all(n == width and len(d) == 2 * n for d, n in zip(data, lengths, strict=True)):
        return np.frombuffer(b"".join(data), "<i2").reshape(len(data), width).astype("f8")
    out = np.zeros((len(data), width))
    for at, (d, n) in enumerate(zip(data, lengths, strict=True)):
        out[at, :n] = np.frombuffer(d, "<i2" if len(d) == 2 * n else "f8")
    return out


def farthest_first(vectors: np.ndarray, top: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Pivots and their extra coordinates; fewer than ``count`` when the sample has no more distinct points."""
    extra = np.sqrt(np.maximum(top - (vectors * vectors).sum(axis=1), 0))
    points = np.c_[vectors, extra]
    chosen = [0]
    apart = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and apart.max() > 0:
        chosen.append(int(apart.argmax()))
        apart = np.minimum(apart, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return vectors[chosen], extra[chosen]


@dataclass(frozen=True)
class Space:
    """What every task knows: the pivots, the largest squared norm and the width and number type of packed vectors."""

    width: int
    top: float
    kind: str
    pivots: np.ndarray
    extra: np.ndarray

    def matrix(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.kind).reshape(-1, self.width).astype("f8")

    def packed(self, vectors: np.ndarray) -> bytes:
        return vectors.astype(self.kind).tobytes()

    @property
    def dense(self) -> str | None:
        """The number type in which products of matrices are exact, if there is one."""
        return "f4" if self.top < EXACT_4 else "f8" if self.top < EXACT_8 else None

    def candidates(self, vectors: np.ndarray) -> np.ndarray:
        """Distances to the pivots, as candidates."""
        with np.errstate(over="ignore", invalid="ignore"):
            own = np.sqrt(np.maximum(self.top - (vectors * vectors).sum(axis=1), 0))
            return np.sqrt(np.maximum(2 * self.top - 2 * (vectors @ self.pivots.T) - 2 * np.outer(own, self.extra), 0))

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        """The same as queries, which have no extra coordinate."""
        with np.errstate(over="ignore", invalid="ignore"):
            return np.sqrt(np.maximum((vectors * vectors).sum(axis=1)[:, None] + self.top - 2 * (vectors @ self.pivots.T), 0))

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        near = np.argsort(self.candidates(vectors), axis=1, kind="stable")[:, :2]
        return (near[:, 0] * len(self.pivots) + near[:, -1]).astype("i4")


def tile_plan(packed: DataFrame, space: Space, tile_rows: int) -> tuple[np.ndarray, np.ndarray, int]:
    """First tile and number of tiles of every cell, and how many there are: small cells share a tile. At most pivots^2 counts are fetched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([pa.array(space.cells(padded(batch, space.width)))], names=["cell"])

    counts = sorted(packed.select("vector", "length").mapInArrow(run, "cell int").groupBy("cell").count().collect())
    first, parts = np.zeros(len(space.pivots) ** 2, "i4"), np.ones(len(space.pivots) ** 2, "i4")
    at, room = -1, 0
    for cell, n in counts:
        share = -(-n // tile_rows)
        if share > 1 or n > room:
            at, room = at + 1, tile_rows
        first[cell], parts[cell] = at, share
        at, room = at + share - 1, 0 if share > 1 else room - n
    return first, parts, at + 1


def tiled(packed: DataFrame, space: Space, first: np.ndarray, parts: np.ndarray, step: int, k: int) -> DataFrame:
    """One row a tile: its candidates in leaves, ranges of distances, its queries (``own, asked``) and their best here."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of a large cell are dealt in turn
        seen = np.full(len(first), TaskContext.get().partitionId(), "i8")
        for batch in batches:
            mine = padded(batch, space.width)
            cell = space.cells(mine)
            order = np.argsort(cell, kind="stable")
            counts = np.bincount(cell, minlength=len(first))
            turn = np.empty(len(cell), "i8")
            turn[order] = np.arange(len(cell)) - np.repeat(np.cumsum(counts) - counts, counts)
            tile = first[cell] + (seen[cell] + turn) % parts[cell]
            seen += counts
            vectors = pa.array([row.tobytes() for row in mine.astype(space.kind)], pa.binary())
            yield pa.record_batch([pa.array(tile.astype("i4")), batch.column("id"), vectors], names=["tile", "id", "vector"])

    def build(table: pa.Table) -> pa.Table:
        ids, mine = table["id"].to_numpy(), space.matrix(b"".join(table["vector"].to_pylist()))
        gaps = space.candidates(mine)
        # equal vectors stand by their ids, so that the first of a tie come first
        order = np.lexsort((ids, gaps.min(axis=1).astype("f4"), gaps.argmin(axis=1)))
        ids, mine, gaps = ids[order], mine[order], gaps[order]
        starts = np.arange(0, len(ids), LEAF_ROWS)
        lows, highs = np.minimum.reduceat(gaps, starts), np.maximum.reduceat(gaps, starts)
        asked = np.flatnonzero(ids % step == 0)
        here, own, vectors = Tile(ids, mine, gaps, space.top), ids[asked], mine[asked]
        norms, reached = (vectors * vectors).sum(axis=1), space.queries(vectors)
        best = [here.best(own[n], vectors[n], norms[n], reached[n], LONG[0], k) for n in range(len(asked))]
        slots = np.repeat(np.arange(len(best)), [len(found) for found, _ in best]).astype("i4")
        found, scores = (np.concatenate([np.zeros(0, "i8"), *(pair[side] for pair in best)]).astype("i8") for side in (0, 1))
        row = (table["tile"][0].as_py(), ids.tobytes(), space.packed(mine), lows.tobytes(), highs.tobytes(), lows.min(axis=0).tolist(), highs.max(axis=0).tolist(), own.tobytes(), space.packed(vectors), slots.tobytes(), found.tobytes(), scores.tobytes())
        return _one_row(row, TILES)

    return packed.select("id", "vector", "length").mapInArrow(place, "tile int, id long, vector binary").groupBy("tile").applyInArrow(build, TILES)


def _one_row(values: tuple, ddl: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [field.split() for field in ddl.split(", ")]
    return pa.table({name: pa.array([value], kinds[kind]) for value, (name, kind) in zip(values, fields, strict=True)})


class Tile:
    """Candidates of one tile, searched in the order of their bounds."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, gaps: np.ndarray, top: float) -> None:
        self.ids, self.vectors, self.gaps, self.top = ids, vectors, gaps, top
        self.largest = float(np.abs(vectors).max(initial=0))

    def scores(self, rows: np.ndarray, vector: np.ndarray, wide: bool) -> np.ndarray:
        if not wide:
            return (self.vectors[rows] @ vector).astype("i8")
        asked = [int(x) for x in vector]
        sums = (sum(int(x) * y for x, y in zip(self.vectors[row], asked, strict=True)) for row in rows)
        return np.array([min(max(s, LONG[0]), LONG[1]) for s in sums], "i8")

    def best(self, own: int, vector: np.ndarray, norm: float, gaps: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the ``k`` best with at least ``least``; ``gaps`` are the query's distances to the pivots."""
        reach = norm + self.top
        with np.errstate(over="ignore", invalid="ignore"):
            low = np.abs(self.gaps - gaps).max(axis=1)
            bound = (reach - low * low) / 2 + SLACK * reach
        # norms beyond doubles bound nothing
        bound[np.isnan(bound)] = np.inf
        rows = np.flatnonzero((bound >= least) & (self.ids != own))
        rows = rows[np.argsort(-bound[rows], kind="stable")]
        bound = bound[rows]
        wide = len(vector) * self.largest * float(np.abs(vector).max(initial=0)) >= EXACT
        found, scored, at, size = np.zeros(0, "i8"), np.zeros(0, "i8"), 0, FIRST_CHUNK
        while at < len(rows) and bound[at] >= least:
            found, scored = np.r_[found, rows[at : at + size]], np.r_[scored, self.scores(rows[at : at + size], vector, wide)]
            order = np.lexsort((self.ids[found], ~scored))[:k]
            found, scored = found[order], scored[order]
            if len(found) == k:
                least = max(least, int(scored[-1]))
            at, size = at + size, 2 * size
        keep = scored >= least
        return self.ids[found[keep]], scored[keep]


def first_k(groups: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` best of every group, best first, and their ranks from 0."""
    order = np.lexsort((ids, ~scores, groups))
    ordered = groups[order]
    starts = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]][: len(ordered)])
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < k], rank[rank < k]


class Block:
    """Queries of neighbouring tiles and the ``k`` best that this task has found for each so far.

    ``least`` and ``cut`` are a score and an id that a row has to come before; a query that has not met ``k`` rows yet is ``short`` and takes any.
    """

    def __init__(self, own: np.ndarray, vectors: np.ndarray, gaps: np.ndarray, homes: np.ndarray, least: np.ndarray, cut: np.ndarray, short: np.ndarray, top: float, dense: str | None, k: int) -> None:
        self.own, self.vectors, self.gaps, self.homes = own, vectors, gaps, homes
        self.least, self.cut, self.short = least.copy(), cut.copy(), short.copy()
        self.norms = (vectors * vectors).sum(axis=1)
        self.top, self.dense, self.k = top, dense, k
        self.asked = vectors.astype(dense) if dense else None
        self.many = np.zeros(len(own), "i8")
        self.found, self.scores = np.zeros((len(own), k), "i8"), np.zeros((len(own), k), "i8")

    def bounds(self, asked: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
        """The most that each query can score in each range."""
        off = np.zeros((len(asked), len(lows)))
        for gaps, low, high in zip(self.gaps[asked].T, lows.T, highs.T, strict=True):
            np.maximum(off, low - gaps[:, None], out=off)
            np.maximum(off, gaps[:, None] - high, out=off)
        reach = (self.norms[asked] + self.top)[:, None]
        return (reach - off * off) / 2 + SLACK * reach

    def meet(self, number: int, ids: np.ndarray, vectors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> None:
        """Search a tile: leaves by falling bound, chunks of them against chunks of queries, in products of matrices."""
        away = np.flatnonzero(self.homes != number)
        away = away[self.bounds(away, lows.min(axis=0, keepdims=True), highs.max(axis=0, keepdims=True))[:, 0] >= self.least[away]]
        for at in range(0, len(away), CHUNK_QUERIES):
            asked = away[at : at + CHUNK_QUERIES]
            bound = self.bounds(asked, lows, highs)
            leaves = np.argsort(-bound.max(axis=0), kind="stable")
            for start in range(0, len(leaves), CHUNK_LEAVES):
                some = leaves[start : start + CHUNK_LEAVES]
                fit = bound[:, some] >= self.least[asked][:, None]
                some, who = np.sort(some[fit.any(axis=0)]), asked[fit.any(axis=1)]
                if len(some):
                    rows = np.concatenate([np.arange(leaf * LEAF_ROWS, min((leaf + 1) * LEAF_ROWS, len(ids))) for leaf in some])
                    self.sift(vectors[rows] @ self.asked[who].T, ids[rows], who)

    def sift(self, scores: np.ndarray, ids: np.ndarray, who: np.ndarray) -> None:
        """Take in the rows whose scores (rows x queries) come among the ``k`` best so far; many at once are taken half by half."""
        least = self.least[who].astype(scores.dtype)
        good = scores >= least
        if (count := np.count_nonzero(good)) > CHUNK_HITS:
            good &= (scores > least) | self.short[who] | (ids[:, None] < self.cut[who])
            count = np.count_nonzero(good)
            if count > CHUNK_HITS and len(ids) > 1:
                half = len(ids) // 2
                self.sift(scores[:half], ids[:half], who)
                self.sift(scores[half:], ids[half:], who)
                return
        if count:
            rows, columns = np.divmod(np.flatnonzero(good), len(who))
            self.take(who[columns], ids[rows], scores[rows, columns].astype("i8"))

    def take(self, slots: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        better = self.short[slots] | (scores > self.least[slots]) | (scores == self.least[slots]) & (ids < self.cut[slots])
        better &= ids != self.own[slots]
        if not better.any():
            return
        touched = np.unique(slots[better])
        before = np.arange(self.k) < self.many[touched][:, None]
        slots = np.r_[np.repeat(touched, self.many[touched]), slots[better]]
        ids, scores = np.r_[self.found[touched][before], ids[better]], np.r_[self.scores[touched][before], scores[better]]
        kept, rank = first_k(slots, ids, scores, self.k)
        self.found[slots[kept], rank], self.scores[slots[kept], rank] = ids[kept], scores[kept]
        self.many[touched] = np.bincount(np.searchsorted(touched, slots[kept]), minlength=len(touched))
        # a whole answer bounds what may follow, if it is stricter than what the home tile asks
        last = kept[rank == self.k - 1]
        at, score, cut = slots[last], scores[last], ids[last]
        stricter = self.short[at] | (score > self.least[at]) | (score == self.least[at]) & (cut < self.cut[at])
        at, score, cut = at[stricter], score[stricter], cut[stricter]
        self.least[at], self.cut[at], self.short[at] = score, cut, False

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, ids and scores of what was found."""
        held = np.arange(self.k) < self.many[:, None]
        return np.repeat(np.arange(len(self.many)), self.many), self.found[held], self.scores[held]

    def meet_wide(self, number: int, tile: Tile) -> None:
        """The same one query after the other, for numbers beyond exact products."""
        for n in np.flatnonzero(self.homes != number):
            found, scores = tile.best(self.own[n], self.vectors[n], self.norms[n], self.gaps[n], int(self.least[n]), self.k)
            self.take(np.full(len(found), n), found, scores)


def blocked(tiles: DataFrame, space: Space, per_block: int, k: int) -> DataFrame:
    """The queries of ``per_block`` neighbouring tiles in one row, with what their home tiles gave them and the ranges that a pair is judged by."""

    def gather(table: pa.Table) -> pa.Table:
        table = table.sort_by("tile")
        own = [np.frombuffer(data, "i8") for data in table["own"].to_pylist()]
        sizes = [len(part) for part in own]
        own, vectors = np.concatenate(own), b"".join(table["asked"].to_pylist())
        homes = np.repeat(table["tile"].to_numpy(), sizes).astype("i4")
        slots = np.concatenate([np.frombuffer(data, "i4") + at for data, at in zip(table["slots"].to_pylist(), np.cumsum(sizes) - sizes, strict=True)]).astype("i4")
        found, scores = (np.frombuffer(b"".join(table[name].to_pylist()), "i8") for name in ("found", "scores"))
        least, cut = np.full(len(own), LONG[0], "i8"), np.full(len(own), LONG[1], "i8")
        kept, rank = first_k(slots, found, scores, k)
        last = kept[rank == k - 1]
        least[slots[last]], cut[slots[last]] = scores[last], found[last]
        mine = space.matrix(vectors)
        gaps = space.queries(mine)
        with np.errstate(over="ignore"):
            reach = float((mine * mine).sum(axis=1).max() + space.top)
        row = (table["block"][0].as_py(), own.tobytes(), vectors, homes.tobytes(), least.tobytes(), cut.tobytes(), gaps.min(axis=0).tolist(), gaps.max(axis=0).tolist(), reach, int(least.min()), slots.tobytes(), found.tobytes(), scores.tobytes())
        return _one_row(row, BLOCKS)

    some = tiles.where("length(own) > 0").select(F.expr(f"int(tile div {per_block})").alias("block"), "tile", "own", "asked", "slots", "found", "scores")
    return some.groupBy("block").applyInArrow(gather, BLOCKS)


def met(tiles: DataFrame, blocks: DataFrame, space: Space, k: int) -> DataFrame:
    """``block, slots, found, scores``: the best of the tiles that each task reads, for the queries that do not have their home there.

    Parts of tiles are read beside parts of blocks, without a shuffle; a pair of rows that cannot matter stays in the JVM.
    """
    off = F.expr("aggregate(zip_with(zip_with(low, far, (x, y) -> x - y), zip_with(near, high, (x, y) -> x - y), (x, y) -> greatest(x, y)), 0D, (m, x) -> greatest(m, x))")
    pairs = tiles.select("tile", "ids", "vectors", "lows", "highs", "low", "high").coalesce(TILE_PARTS).hint("shuffle_replicate_nl").crossJoin(blocks.drop("slots", "found", "scores").coalesce(BLOCK_PARTS))
    fit = pairs.where((F.col("reach") - off * off) / 2 + SLACK * F.col("reach") >= F.col("floor"))
    names = ["tile", "ids", "vectors", "lows", "highs", "block", "own", "asked", "homes", "least", "cut"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, Block] = {}
        number, here = None, ()
        for batch in batches:
            for row in range(batch.num_rows):
                value = {name: batch.column(name)[row] for name in names}
                block = value["block"].as_py()
                if block not in held:
                    own, least, cut = (np.frombuffer(value[name].as_py(), "i8") for name in ("own", "least", "cut"))
                    asked = space.matrix(value["asked"].as_py())
                    short = (least == LONG[0]) & (cut == LONG[1])
                    held[block] = Block(own, asked, space.queries(asked), np.frombuffer(value["homes"].as_py(), "i4"), least, cut, short, space.top, space.dense, k)
                if value["tile"].as_py() != number:
                    number = value["tile"].as_py()
                    ids, vectors = np.frombuffer(value["ids"].as_py(), "i8"), space.matrix(value["vectors"].as_py())
                    if space.dense:
                        lows, highs = (np.frombuffer(value[name].as_py()).reshape(-1, len(space.pivots)) for name in ("lows", "highs"))
                        here = (ids, vectors.astype(space.dense), lows, highs)
                    else:
                        here = (Tile(ids, vectors, space.candidates(vectors), space.top),)
                (held[block].meet if space.dense else held[block].meet_wide)(number, *here)
        for block, best in held.items():
            slots, found, scores = best.best()
            columns = [pa.array([block], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (slots.astype("i4"), found, scores))]
            yield pa.record_batch(columns, names=["block", "slots", "found", "scores"])

    return fit.select(*names).mapInArrow(run, f"block int, {FOUND}")


def ranked(blocks: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """What home tiles and the others gave, merged query by query."""

    def merge(table: pa.Table) -> pa.Table:
        own = np.frombuffer(next(data for data in table["own"].to_pylist() if data is not None), "i8")
        slots, found, scores = (np.frombuffer(b"".join(table[name].to_pylist()), kind) for name, kind in (("slots", "i4"), ("found", "i8"), ("scores", "i8")))
        kept, rank = first_k(slots, found, scores, k)
        return pa.table({"query_id": own[slots[kept]], "rank": (rank + 1).astype("i4"), "vec_id": found[kept], "score": scores[kept]})

    names = ["block", "own", "slots", "found", "scores"]
    both = blocks.select(*names).unionByName(found.withColumn("own", F.lit(None).cast("binary")).select(*names))
    return both.groupBy("block").applyInArrow(merge, "query_id long, rank int, vec_id long, score long")


def top_k(vectors: DataFrame, k: int = NEIGHBOURS, step: int = QUERY_STEP, count: int = PIVOTS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``step``, against all rows."""
    spark = vectors.sparkSession
    packed = cut_lineage(packed_vectors(vectors))
    total, width, top, largest, asking = packed.agg(F.count(F.lit(1)), F.max("length"), F.max("norm"), F.max("largest"), F.count_if(F.col("id") % step == 0)).first()
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = max(width, 1)
    sample = packed.orderBy(F.xxhash64("id")).limit(SAMPLE).toArrow()
    space = Space(width, top, "<i2" if largest <= SHORT else "f8", *farthest_first(padded(sample, width), top, count))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = max(LEAST_TILE_ROWS, total // (4 * tasks))
    first, parts, tiles = tile_plan(packed, space, max(1, min(tile_rows, spread, TILE_BYTES // (8 * (width + len(space.pivots))))))
    held = cut_lineage(tiled(packed, space, first, parts, step, k))
    blocks = cut_lineage(blocked(held, space, max(1, BLOCK_QUERIES * tiles // asking), k))
    return ranked(blocks, cut_lineage(met(held, blocks, space, k)), k)


OP12_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and list_count(embedding) = len(embedding)
    and coalesce(list_bool_and(list_transform(embedding, lambda x: isfinite(x))), true)
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from usable q join usable c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), ranked as (
  select query_id, row_number() over (partition by query_id order by score desc, vec_id) as rank, vec_id, score from scored
)
select query_id, rank::int as rank, vec_id, score from ranked where rank <= 5
"""


@query("op12_pivot_search", OP12_SQL)
def op12_pivot_search(spark: SparkSession, folder: str) -> DataFrame:
    return top_k(table(spark, folder, "embeddings"))
