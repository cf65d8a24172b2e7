"""The thresholded set join against brute force, and what boilerplate costs it."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import setjoin


def brute(sets, threshold):
    first = {}
    for owner in sorted(sets):
        first.setdefault(frozenset(sets[owner]), owner)
    out = {(first[frozenset(s)], owner, len(s), len(s), len(s)) for owner, s in sets.items() if first[frozenset(s)] != owner}
    for (s, a), (t, b) in itertools.combinations(sorted(first.items(), key=lambda item: item[1]), 2):
        both = len(s & t)
        if both and both * setjoin.PPM >= threshold * len(s | t):
            out.add((a, b, len(s), len(t), both))
    return out


def frame_of(spark, sets):
    rows = [("s", owner, token) for owner, s in sets.items() for token in s]
    frame = spark.createDataFrame(rows, "space string, owner long, id long")
    return frame.select("space", "owner", F.xxhash64("id").alias("a"), F.col("id").alias("b"))


@pytest.mark.parametrize("threshold", [100_000, 550_000, 700_000, 1_000_000])
def test_equals_brute_force(spark, threshold):
    draw = random.Random(threshold)
    sets = {}
    for owner in range(150):
        base = sets[draw.randrange(owner)] if owner and draw.random() < 0.6 else set(draw.sample(range(400), draw.randrange(1, 40)))
        sets[owner] = {t for t in base if draw.random() < 0.93} | set(draw.sample(range(400), draw.randrange(0, 4))) or {1}
    sets |= {500 + k: {7, 8, 9} for k in range(30)}
    found = setjoin.similar_sets(frame_of(spark, sets), "space", "owner", ["a", "b"], F.lit(threshold))
    assert {tuple(r)[1:6] for r in found.select("space", "left", "right", "n_left", "n_right", "n_both").collect()} == brute(sets, threshold)


def test_boilerplate_is_never_paired(spark, monkeypatch):
    """A thousand owners share forty tokens and have sixty of their own: no pair is made."""
    sets = {owner: set(range(40)) | {1_000 + 60 * owner + k for k in range(60)} for owner in range(1_000)}
    sets[2_000] = set(sets[5]) - {0}
    made = []
    keep = setjoin.Rounds.keep

    def counted(rounds, frame, forget=True):
        frame = keep(rounds, frame, forget)
        made.append((frame.columns, frame.count()))
        return frame

    monkeypatch.setattr(setjoin.Rounds, "keep", counted)
    found = setjoin.similar_sets(frame_of(spark, sets), "space", "owner", ["a", "b"], F.lit(550_000))
    assert [tuple(r)[1:6] for r in found.select("space", "left", "right", "n_left", "n_right", "n_both").collect()] == [(5, 2_000, 100, 99, 99)]
    pairs = [n for columns, n in made if "right" in columns]
    assert pairs == [1] and max(n for _, n in made) == sum(map(len, sets.values()))


def test_empty_null_and_large_sets(spark):
    empty = frame_of(spark, {1: {1}}).limit(0)
    assert setjoin.similar_sets(empty, "space", "owner", ["a", "b"], F.lit(550_000)).isEmpty()
    sets = {1: set(range(70_000)), 2: set(range(1, 70_001)), 3: {5}}
    rows = frame_of(spark, sets).withColumn("space", F.lit(None).cast("string"))
    found = setjoin.similar_sets(rows, "space", "owner", ["a", "b"], F.lit(900_000)).collect()
    assert [(r["space"], r["left"], r["right"], r["n_both"]) for r in found] == [(None, 1, 2, 69_999)]
