"""Pointer jumping on deep, wide and broken trees, and trees told twice."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import trees


def test_long_chain_stays_linear(spark):
    size = 100_000
    nodes = spark.range(size).select(
        F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0).cast("long").alias("ordinal")
    )
    placed = trees.intervals(nodes)
    assert all(kind in ("bigint", "boolean") for _, kind in placed.dtypes)  # no lists
    wrong = placed.where(f"enter <> node or depth <> node or size <> {size} - node or top <> 0 or above is distinct from parent")
    assert placed.count() == size and wrong.isEmpty()


def brute(rows):
    """State, depth, top of every node of ``{node: parent}``."""
    out = {}
    for node in rows:
        line, at = [node], rows[node]
        while at is not None and at in rows and at not in line:
            line.append(at)
            at = rows[at]
        if at is None:
            out[node] = ("rooted", len(line) - 1, line[-1])
        elif at not in rows:
            out[node] = ("lost", len(line), line[-1])
        else:
            out[node] = ("circle" if at == node else "endless", None, None)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_climb_on_random_links(spark, seed):
    draw = random.Random(seed)
    rows = {n: draw.choice([None, 999, draw.randrange(120), draw.randrange(120), max(n - 1, 0)]) for n in range(120)}
    rows[0], rows[1] = None, 1
    frame = spark.createDataFrame(list(rows.items()), "node long, parent long")
    expected = brute(rows)
    found = {r["node"]: r for r in trees.climb(frame, sizes=True, sums={"odd": F.col("node") % 2}).collect()}
    children = {}
    for node, parent in rows.items():
        children.setdefault(parent, []).append(node)
    for node, (state, depth, top) in expected.items():
        assert found[node]["state"] == state
        if state in ("rooted", "lost"):
            assert (found[node]["depth"], found[node]["top"]) == (depth, top)
            line, at = [], node
            while at in rows:
                line.append(at)
                at = rows[at]
            below, stack = 0, [node]
            while stack:
                below += 1
                stack.extend(children.get(stack.pop(), []))
            assert found[node]["odd"] == sum(n % 2 for n in line) and found[node]["size"] == below


def test_scopes_with_null_keys_and_clashing_names(spark):
    rows = [(None, "r", None, 0, 7), (None, "a", "r", 1, 7), (None, "b", "r", 0, 7), ("s", "r", None, 0, 7), ("s", "a", "r", 0, 7)]
    nodes = spark.createDataFrame(rows, "scope string, node string, parent string, ordinal long, size int")
    found = {(r["scope"], r["node"]): (r["index"], r["parent_index"]) for r in trees.preorder(nodes, scope=["scope"]).collect()}
    assert found == {(None, "r"): (0, None), (None, "b"): (1, 0), (None, "a"): (2, 0), ("s", "r"): (0, None), ("s", "a"): (1, 0)}
    assert trees.preorder(nodes.limit(0), scope=["scope"]).isEmpty()


def test_nearest_retained_over_long_runs(spark):
    chain = spark.range(300).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"))
    found = trees.nearest_retained(chain, F.col("node") % 100 == 0).collect()
    assert {r["node"]: (r["nearest"], r["distance"]) for r in found} == {n: ((n - 1) // 100 * 100, (n - 1) % 100 + 1) for n in range(1, 300)}
    circle = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (4, 9), (5, None)], "node long, parent long")
    assert trees.nearest_retained(circle, F.lit(False)).isEmpty()


LISTS = {
    "clean": ([("r", None), ("a", "r"), ("b", None)], [("r", "a"), ("a", "b")], set()),
    "dangling_child": ([("r", None)], [("r", "x")], {("r", "x", "dangling_child")}),
    "duplicate_child": ([("r", None), ("a", "r"), ("b", "r")], [("r", "a"), ("r", "b"), ("a", "b")], {("r", "b", "duplicate_child"), ("a", "b", "duplicate_child")}),
    "listed_twice": ([("r", None), ("a", "r")], [("r", "a"), ("r", "a")], {("r", "a", "duplicate_child")}),
    "parent_mismatch": ([("r", None), ("a", "r"), ("b", "r")], [("r", "a"), ("a", "b")], {("a", "b", "parent_mismatch")}),
    "unlisted": ([("r", None), ("a", "r")], [], {(None, "a", "parent_mismatch"), (None, None, "root_count")}),
    "dangling_parent": ([("r", None), ("a", "x")], [("r", "a")], {(None, "a", "dangling_parent")}),
    "cycle": ([("r", None), ("a", "b"), ("b", "a"), ("c", "a")], [("b", "a"), ("a", "b"), ("a", "c")], {(None, "a", "cycle"), (None, "b", "cycle"), (None, "c", "disconnected")}),
    "unknown_lister": ([("r", None), ("a", None), ("b", "a")], [("x", "a"), ("a", "b")], {(None, "a", "disconnected"), (None, "b", "disconnected")}),
    "duplicate_node": ([("r", None), ("r", None)], [], {(None, "r", "duplicate_node_id")}),
    "depth": ([(str(n), None) for n in range(67)], [(str(n), str(n + 1)) for n in range(66)], {(None, "65", "depth"), (None, "66", "depth")}),
    "empty": ([], [], {(None, None, "root_count")}),
}


@pytest.mark.parametrize("case", sorted(LISTS))
def test_child_lists(spark, case):
    nodes, lists, expected = LISTS[case]
    frame = spark.createDataFrame(nodes, "node string, parent string").withColumn("code", F.lit("clash"))
    issues = trees.child_list_issues(frame, spark.createDataFrame(lists, "node string, child string"))
    assert {(r["node"], r["child"], r["code"].split(".")[1]) for r in issues.collect()} == expected


def test_child_lists_in_scopes(spark):
    nodes = spark.createDataFrame([("s", "r", True), ("s", "a", True), ("t", "r", None)], "scope string, node string, ignored boolean").withColumn("parent", F.lit(None).cast("string"))
    lists = spark.createDataFrame([("s", "r", "a"), ("t", "r", "a")], "scope string, node string, child string")
    issues = trees.child_list_issues(nodes, lists, ignored="ignored", scope=["scope"])
    assert {tuple(r) for r in issues.collect()} == {("s", None, "r", "accessibility.root"), ("t", "r", "a", "accessibility.dangling_child")}
