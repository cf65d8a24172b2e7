"""The keyed operators against plain Spark and Python, with one key holding most of the rows."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pairwright.operators.keyed import attach, blocked_window, merge_sides, over_groups, tally_sides
from pairwright.plans import factorial


def rows_of(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.fixture(scope="module")
def skewed(spark):
    """40% of the rows belong to key 7; ids are shuffled."""
    draw = random.Random(5)
    rows = [(7 if i % 5 < 2 else draw.randrange(200), i, draw.randrange(50)) for i in range(4000)]
    draw.shuffle(rows)
    return spark.createDataFrame(rows, "k long, id long, v long").repartition(7).cache()


def test_attach_equals_plain_join(spark, skewed):
    side = spark.range(150).select(F.col("id").alias("k"), (F.col("id") * 3).alias("w"))
    for how in ("inner", "left", "left_anti", "left_semi"):
        assert rows_of(attach(skewed, side, ["k"], how=how, spread=["id"])) == rows_of(skewed.join(side, "k", how))


def test_attach_aligns_key_types(spark, skewed):
    side = spark.range(150).select(F.col("id").cast("int").alias("k"), F.lit(1).alias("w"))
    assert attach(skewed, side, ["k"], spread=["id"]).count() == skewed.where("k < 150").count()


def test_attach_spreads_the_hot_key(spark, skewed):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        side = spark.range(200).select(F.col("id").alias("k"), F.lit(1).alias("w"))

        def largest(frame):
            sizes = frame.where("k = 7").groupBy(F.spark_partition_id()).count().collect()
            return max(row["count"] for row in sizes)

        assert largest(skewed.join(side, "k")) == skewed.where("k = 7").count()
        assert largest(attach(skewed, side, ["k"], spread=["id"])) < 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_over_groups_equals_window(skewed):
    window = Window.partitionBy("k")
    expected = skewed.withColumn("first", F.min("id").over(window)).withColumn("total", F.sum("v").over(window))
    found = over_groups(skewed, ["k"], spread=["id"], first=F.min("id"), total=F.sum("v"))
    assert rows_of(found.select("k", "id", "first", "total")) == rows_of(expected.select("k", "id", "first", "total"))


@pytest.mark.parametrize("width", [1, 37, 10_000])
def test_blocked_window_equals_window(skewed, width):
    window = Window.partitionBy("k").orderBy("id")
    expected = skewed.select(
        "k",
        "id",
        (F.row_number().over(window) - 1).cast("long").alias("at"),
        F.sum("v").over(window.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.lag("v").over(window).alias("before"),
    )
    found = blocked_window(
        skewed,
        ["k"],
        ["id"],
        F.expr(f"id div {width}"),
        position="at",
        running={"run": F.col("v")},
        previous={"before": F.col("v")},
    )
    assert rows_of(found.select("k", "id", "at", "run", "before")) == rows_of(expected)


def test_blocked_window_keeps_null_previous_values(spark):
    rows = spark.createDataFrame([(1, 0, None), (1, 1, 5), (1, 2, None), (1, 3, 6)], "k long, id long, v long")
    found = blocked_window(rows, ["k"], ["id"], F.expr("id div 2"), previous={"p": F.col("v")})
    assert [row["p"] for row in found.orderBy("id").collect()] == [None, None, 5, None]


def test_tally_and_merge_sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "a"), (2, "b")], "k long, v string")
    right = spark.createDataFrame([(2, "c"), (3, "d")], "k long, v string")
    assert rows_of(tally_sides(["k"], l=left, r=right)) == [(1, 2, 0), (2, 1, 1), (3, 0, 1)]
    merged = {row["k"]: (row["l"], row["r"]) for row in merge_sides(["k"], ["v"], left, right).collect()}
    assert merged[1][1] is None and merged[2][0]["v"] == "b" and merged[2][1]["v"] == "c" and merged[3][0] is None


def test_null_keys_are_a_group(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), (3, 3)], "k long, id long")
    found = over_groups(rows, ["k"], spread=["id"], n=F.count(F.lit(1)))
    assert rows_of(found) == [(3, 3, 1), (None, 1, 2), (None, 2, 2)]
    running = blocked_window(rows, ["k"], ["id"], F.expr("id div 2"), running={"upto": F.col("id")})
    assert rows_of(running.select("k", "id", "upto")) == [(3, 3, 3), (None, 1, 1), (None, 2, 3)]


def test_a_key_with_a_sixtieth_of_the_rows_is_split(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(60_000).select(F.when(F.col("id") % 60 == 0, -1).otherwise(F.col("id")).alias("k"), "id")
        found = over_groups(rows, ["k"], spread=["id"], n=F.count(F.lit(1))).where("k = -1")
        assert found.count() == 1000
        assert found.groupBy(F.spark_partition_id()).count().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_highest_of_all_earlier_rows(spark):
    draw = random.Random(12)
    rows = [(draw.choice(["a", "a", "b", None]), at, draw.choice([None, draw.randrange(100)])) for at in range(200)]
    frame = spark.createDataFrame(rows, "k string, at long, v long").repartition(6)
    for block in (F.expr("at div 7"), None):
        found = blocked_window(frame, ["k"], ["at"], block, highest={"top": F.col("v")})
        got = {(r["k"], r["at"]): r["top"] for r in found.collect()}
        for k, at, _ in rows:
            assert got[k, at] == max((v for j, t, v in rows if j == k and t < at and v is not None), default=None)


def test_cells_out_of_order(spark):
    plan = spark.createDataFrame([(c, f"k{c}") for c in range(6)], "cell long, k string")
    actual = spark.createDataFrame([("k0", 0), ("k3", 1), ("k1", 2), ("k2", 3), ("zz", 4), ("k5", 5), ("k4", 60_000_000)], "k string, at long")
    found = factorial.order_audit(plan, actual, ["k"], "at")
    assert {(r["k"], r["code"]) for r in found.collect()} == {("k1", "cell.order"), ("k2", "cell.order"), ("k4", "cell.order")}
    assert factorial.order_audit(plan, actual.limit(0), ["k"], "at").isEmpty()
