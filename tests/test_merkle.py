"""Hash tries: order independence, descent to what differs, and rows named."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairwright.functions.canonical import sha256_hex
from pairwright.operators import merkle


def row_digest():
    return sha256_hex(F.col("v").cast("string"))


def frame(spark, rows):
    return spark.createDataFrame(rows, "p string, v long").withColumn("n", F.lit("clash")).withColumn("digest", F.lit("clash"))


@pytest.mark.parametrize("leaf_rows", [1, 8, 10_000])
def test_names_exactly_the_changed_rows(spark, leaf_rows):
    draw = random.Random(leaf_rows)
    rows = [(draw.choice(["a", "b", None]), draw.randrange(500)) for _ in range(1_500)]
    pinned = [row for row in rows if draw.random() > 0.01] + [("a", 1_000), ("new", 1), (None, 7)]
    found = merkle.pinned_differences(frame(spark, rows).repartition(5), frame(spark, pinned), ["p"], row_digest(), leaf_rows)
    digests = {r["v"]: r["d"] for r in spark.range(1_001).select(F.col("id").alias("v")).select("v", row_digest().alias("d")).collect()}
    now, pin = Counter((p, digests[v]) for p, v in rows), Counter((p, digests[v]) for p, v in pinned)
    assert {tuple(r) for r in found.collect()} == {(*key, now[key], pin[key]) for key in now | pin if now[key] != pin[key]}


def test_equal_tables_have_one_trie_and_no_difference(spark):
    rows = [("a", n % 90) for n in range(400)]
    random.Random(1).shuffle(rows)
    one, two = (merkle.entries(f, ["p"], row_digest()) for f in (frame(spark, rows), frame(spark, sorted(rows)).repartition(7)))
    depth = merkle.trie_depth(one, ["p"], 4)
    left, right = merkle.trie(one, ["p"], depth), merkle.trie(two, ["p"], depth)
    assert depth == 2 and sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect()))
    assert {r["n"] for r in left.where("level = 0").collect()} == {400}
    assert merkle.differing_leaves(left, right, ["p"]).isEmpty()
    assert merkle.pinned_differences(frame(spark, []), frame(spark, []), ["p"], row_digest()).isEmpty()


def test_descent_reads_only_below_what_differs(spark, monkeypatch):
    rows = [("a", n) for n in range(2_000)]
    one = merkle.entries(frame(spark, rows), ["p"], row_digest())
    two = merkle.entries(frame(spark, rows[:-1]), ["p"], row_digest())
    left, right = merkle.trie(one, ["p"], 3), merkle.trie(two, ["p"], 3)
    wrong, keep = [], merkle.cut_lineage

    def counted(rows):
        rows = keep(rows)
        wrong.append(rows.count())
        return rows

    monkeypatch.setattr(merkle, "cut_lineage", counted)
    assert merkle.differing_leaves(left, right, ["p"]).count() == 1
    assert wrong == [1, 1, 1, 1]


@pytest.mark.parametrize("depth", [0, 2])
def test_paired_tries_are_the_single_ones(spark, depth):
    rows, pinned = ([(p, n % m) for n in range(300) for p in ("a", None)] for m in (90, 100))
    held = merkle.paired_entries(frame(spark, rows), frame(spark, pinned + [("new", 1)]), ["p"], row_digest())
    tries = merkle.paired_tries(held, ["p"], depth)
    for got, one in zip(tries, (rows, pinned + [("new", 1)]), strict=True):
        want = merkle.trie(merkle.entries(frame(spark, one), ["p"], row_digest()), ["p"], depth)
        assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_rows_of_both_sides_are_written_once(spark, monkeypatch):
    """A thousand rows and their pin are one table of entries; nothing else that is written has a row for each of them."""
    sizes = []

    def measured(keep):
        def kept(*given, **named):
            frame = keep(*given, **named)
            sizes.append(frame.count())
            return frame

        return kept

    monkeypatch.setattr(merkle, "cut_lineage", measured(merkle.cut_lineage))
    monkeypatch.setattr("pairwright.session.Rounds.keep", measured(__import__("pairwright.session").session.Rounds.keep))
    rows = [("a", n) for n in range(1_000)]
    assert merkle.pinned_differences(frame(spark, rows), frame(spark, rows[1:]), ["p"], row_digest()).count() == 1
    assert sum(size >= 999 for size in sizes) == 1
