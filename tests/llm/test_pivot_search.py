"""Exact top-k search against brute force."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from pairwright.llm import pivot_search
from pairwright.llm.pivot_search import Block, Tile, farthest_first, top_k

SCHEMA = "vec_id long, embedding array<double>, label int, tile int"
LIMITS = -(2**63), 2**63 - 1


def brute(rows, k=5, step=50):
    usable = []
    for vec_id, vector in rows:
        if vec_id is not None and vector is not None and all(x is not None and math.isfinite(256 * x) for x in vector):
            usable.append((vec_id, [math.floor(256 * x) for x in vector]))
    out = []
    for own, q in usable:
        if own % step == 0:
            scores = [(-min(max(sum(a * b for a, b in zip(q, v, strict=False)), LIMITS[0]), LIMITS[1]), i) for i, v in usable if i != own]
            out += [(own, rank, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def found(spark, rows, **options):
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    return sorted(map(tuple, top_k(frame, **options).select("query_id", "rank", "vec_id", "score").collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_over_many_tiles(spark, seed):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(12)] for _ in range(6)]
    rows = [(n, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for n in range(1_500)]
    rows += [(2_000 + n, rows[0][1]) for n in range(400)]  # copies: ties and a cell too large for a tile
    rows += [(3_000 + 50 * n, [0.0] * 12) for n in range(3)] + [(-50, [-1.0] * 12)]
    rng.shuffle(rows)
    assert found(spark, rows, tile_rows=64, count=8) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, [0.5, -0.5]), (50, [1e-9, -1e-9]), (1, [0.1]), (2, []), (3, None), (4, [None, 1.0]), (5, [math.inf, 0.0]), (6, [math.nan, 0.0])]
    rows += [(None, [1.0, 1.0]), (100, [1e30, 1e30]), (7, [1e30, -1e30]), (8, [3e15, 1.0]), (7, [1e30, -1e30]), (0, [0.5, -0.5]), (9, [1e308, 1.0])]
    assert found(spark, rows) == brute(rows)


def test_few_rows(spark):
    assert found(spark, []) == []
    assert found(spark, [(50, [1.0])]) == []
    assert found(spark, [(50, [0.0]), (1, [0.0])]) == [(50, 1, 1, 0)]


def test_stops_early():
    rng = np.random.default_rng(3)
    vectors = np.floor(256 * np.concatenate([rng.normal(c, 0.02, (500, 8)) for c in rng.normal(0, 1, (20, 8))]))
    top = float((vectors * vectors).sum(axis=1).max())
    pivots, extra = farthest_first(vectors[::37], top, 16)
    own = np.sqrt(top - (vectors * vectors).sum(axis=1))
    gaps = np.sqrt(np.maximum(2 * top - 2 * vectors @ pivots.T - 2 * np.outer(own, extra), 0))
    tile = Tile(np.arange(len(vectors)), vectors, gaps, top)
    seen = []
    scores = tile.scores
    tile.scores = lambda rows, vector, wide: seen.append(len(rows)) or scores(rows, vector, wide)
    q = vectors[123]
    asked = np.sqrt(q @ q + top - 2 * pivots @ q)
    ids, best = tile.best(123, q, float(q @ q), asked, LIMITS[0], 5)
    exact = vectors @ q
    order = np.lexsort((np.arange(len(vectors)), -exact))
    assert ids.tolist() == [i for i in order.tolist() if i != 123][:5]
    assert sum(seen) < len(vectors) / 4


def test_queries_do_not_travel_with_tiles(spark):
    """Many queries that every tile may answer: what is shuffled follows the rows, not queries times tiles."""
    rng = np.random.default_rng(5)
    rows = [(n, v.tolist()) for n, v in enumerate(rng.normal(0, 1, (4_000, 12)))]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    assert len(found(spark, rows, step=4, tile_rows=64, count=8)) == 5 * 1_000
    assert written() - before < 3 * 4_000 * 12 * 8


@pytest.mark.parametrize("hits", [1, 40, 1 << 18])
@pytest.mark.parametrize("spread", [1, 3, 60])
def test_blocks_of_queries_equal_brute_force(monkeypatch, hits, spread):
    """Chunks in which most scores tie, and queries whose home gave fewer than k rows."""
    monkeypatch.setattr(pivot_search, "CHUNK_HITS", hits)
    monkeypatch.setattr(pivot_search, "LEAF_ROWS", 16)
    rng = np.random.default_rng(spread)
    vectors = rng.integers(-spread, spread, (700, 6)).astype("f8")
    ids, tiles = rng.permutation(700), np.arange(700) // 100
    top = float((vectors * vectors).sum(axis=1).max())
    pivots, extra = farthest_first(vectors[::7], top, 4)
    space = pivot_search.Space(6, top, "<i2", pivots, extra)
    gaps, asked = space.candidates(vectors), np.arange(0, 700, 9)
    exact = (vectors[asked] @ vectors.T).astype("i8")
    k, least, cut = 5, np.full(len(asked), LIMITS[0]), np.full(len(asked), LIMITS[1])
    for n, own in enumerate(asked[: len(asked) // 2]):
        home = [(-exact[n, r], ids[r]) for r in range(700) if tiles[r] == tiles[own] and r != own]
        least[n], cut[n] = -sorted(home)[k - 1][0], sorted(home)[k - 1][1]
    block = Block(ids[asked], vectors[asked], space.queries(vectors[asked]), tiles[asked], least, cut, least == LIMITS[0], top, space.dense, k)
    for tile in range(7):
        mine = np.flatnonzero(tiles == tile)
        starts = np.arange(0, len(mine), 16)
        lows, highs = np.minimum.reduceat(gaps[mine], starts), np.maximum.reduceat(gaps[mine], starts)
        block.meet(tile, ids[mine], vectors[mine].astype(space.dense), lows, highs)
    slots, got, scores = block.best()
    for n, own in enumerate(asked):
        away = sorted((-exact[n, r], ids[r]) for r in range(700) if tiles[r] != tiles[own])[:k]
        away = [pair for pair in away if least[n] == LIMITS[0] or pair < (-least[n], cut[n])]
        assert list(zip((-scores[slots == n]).tolist(), got[slots == n].tolist(), strict=True)) == away


def test_norms_beyond_doubles(spark):
    rows = [(50 * n, [(-1.0) ** n * 10.0 ** (n % 7 * 50), float(n)]) for n in range(20)] + [(n + 1, [1e200, -float(n)]) for n in range(20)]
    assert found(spark, rows, tile_rows=4) == brute(rows)
