"""Trees, graphs, similarity, scoring and streams against brute force on small inputs."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from pairwright.operators import graph, scoring, similarity, trees
from pairwright.session import cut_lineage
from pairwright.streaming.publish import publish_stream


def random_tree(seed, size):
    draw = random.Random(seed)
    rows, counts = [("s", "0", None, 0)], {}
    for i in range(1, size):
        parent = str(draw.randrange(max(0, i - 6), i))
        rows.append(("s", str(i), parent, counts.get(parent, 0)))
        counts[parent] = counts.get(parent, 0) + 1
    draw.shuffle(rows)
    return rows


def walk(rows):
    children = {}
    for _, node, parent, ordinal in rows:
        children.setdefault(parent, []).append((ordinal, node))
    out, stack = {}, [(node, None, 0) for _, node in sorted(children[None])]
    while stack:
        node, above, depth = stack.pop()
        out[node] = (len(out), above, depth)
        index = out[node][0]
        stack.extend((child, index, depth + 1) for _, child in sorted(children.get(node, []), reverse=True))
    return out


SCHEMA = "scope string, node string, parent string, ordinal long"


@pytest.mark.parametrize("seed", [1, 2])
def test_preorder_matches_walk_and_ignores_input_order(spark, seed):
    rows = random_tree(seed, 60)
    twin = [("t", *row[1:]) for row in rows]
    frame = spark.createDataFrame(rows + twin, SCHEMA).repartition(5)
    found = trees.preorder(frame, scope=["scope"]).collect()
    expected = walk(rows)
    for scope in ("s", "t"):
        mine = {r["node"]: (r["index"], r["parent_index"], r["depth"]) for r in found if r["scope"] == scope}
        assert mine == expected
    stored = spark.createDataFrame([(v[0], v[1], [r[3] for r in rows if r[1] == k][0]) for k, v in expected.items()],
                                   "index long, parent_index long, child_ordinal long")
    assert trees.preorder_issues(stored).count() == 0


def test_deep_chain_cycle_and_dangling(spark):
    chain = [("c", str(i), str(i - 1) if i else None, 0) for i in range(67)]
    frame = spark.createDataFrame(chain, SCHEMA)
    found = {(r["node"], r["code"]) for r in trees.tree_issues(frame.drop("scope", "ordinal")).collect()}
    assert found == {("65", "tree.depth"), ("66", "tree.depth")}
    loop = [("r", None), ("a", "b"), ("b", "a"), ("x", "a"), ("d", "gone"), ("e", "d")]
    issues = trees.tree_issues(spark.createDataFrame(loop, "node string, parent string"))
    assert {(r["node"], r["code"]) for r in issues.collect()} == {
        ("a", "tree.cycle"), ("b", "tree.cycle"), ("x", "tree.disconnected"), ("d", "tree.dangling_parent"), ("e", "tree.disconnected")
    }


def test_splice_lifts_in_order(spark):
    rows = [("s", n, p, o) for n, p, o in [("r", None, 0), ("a", "r", 0), ("b", "r", 1), ("c", "r", 2), ("b1", "b", 0), ("b2", "b", 1), ("b11", "b1", 0)]]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = trees.splice(frame.drop("scope"), F.col("node").isin("b", "b1"))
    assert {r["node"]: (r["parent"], r["ordinal"]) for r in found.collect()} == {
        "r": (None, 0), "a": ("r", 0), "b11": ("r", 1), "b2": ("r", 2), "c": ("r", 3)
    }


def test_reopened_subtree(spark):
    rows = [(0, None, 0), (1, 0, 0), (2, 1, 0), (3, 0, 1), (4, 1, 1)]
    found = trees.preorder_issues(spark.createDataFrame(rows, "index long, parent_index long, child_ordinal long"))
    assert [tuple(r) for r in found.collect()] == [(4, "tree.preorder")]


def test_components_match_union_find(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(170)]
    edges += [(i, i + 1) for i in range(400, 440)] + [(500, i) for i in range(501, 600)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = sorted((find(u), find(v)))
            parent[b] = a
    expected = {node: find(node) for node in list(parent)}
    found = graph.connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in found.collect()} == expected


def test_star_edges_are_linear(spark):
    members = spark.range(500).select(F.lit("hot").alias("g"), F.col("id").alias("n"))
    assert graph.star_edges(members, "g", "n").count() == 499


@pytest.mark.parametrize(("applications", "overall", "within"), [(5, 1e-6, 1e-6), (70, 1e-6, 1e-6), (70, 0.3, 0.2), (40, 0.55, 0.7)])
def test_shingles_match_brute_force(spark, applications, overall, within):
    draw = random.Random(applications)
    words = [f"w{i}" for i in range(6)]
    docs = [(f"app{i % applications:02}", draw.choice(["x", "y"]), " ".join(draw.choices(words, k=draw.randrange(2, 12)))) for i in range(2 * applications)]
    sets = {}
    for app, lang, text in docs:
        tokens = text.split(" ")
        for i in range(len(tokens) - 4):
            for language in ("all", lang):
                sets.setdefault((language, app), set()).add(tuple(tokens[i : i + 5]))
    expected = {}
    for (la, a), (lb, b) in itertools.product(sets, sets):
        both = len(sets[la, a] & sets[lb, b])
        if la == lb and a < b and both:
            union = len(sets[la, a] | sets[lb, b])
            if both >= (overall if la == "all" else within) * union:
                expected[la, a, b] = (len(sets[la, a]), len(sets[lb, b]), both, both * 1_000_000 // union)
    frame = spark.createDataFrame(docs, "app string, lang string, text string")
    found = similarity.shingle_similarity(frame, "app", "lang", "text", overall, within)
    assert {(r["language"], r["left"], r["right"]): (r["n_left"], r["n_right"], r["n_both"], r["jaccard_ppm"]) for r in found.collect()} == expected


def test_ranking_metrics_with_ties_and_single_class(spark):
    draw = random.Random(9)
    rows = [("a", draw.randrange(20), draw.random() < 0.3) for _ in range(300)] + [("one", 5, True), ("one", 9, True)]
    frame = spark.createDataFrame(rows, "k string, s long, y boolean")
    counts = scoring.histogram(frame, ["k"], "s", F.col("y"))
    found = {r["k"]: r for r in scoring.ranking_metrics(counts, ["k"]).collect()}
    scored = [(s, y) for k, s, y in rows if k == "a"]
    positives = [s for s, y in scored if y]
    negatives = [s for s, y in scored if not y]
    auroc = sum((p > q) + 0.5 * (p == q) for p in positives for q in negatives) / len(positives) / len(negatives)
    precision = last = 0.0
    for threshold in sorted({s for s, _ in scored}, reverse=True):
        taken = [y for s, y in scored if s >= threshold]
        recall = sum(taken) / len(positives)
        precision += (recall - last) * sum(taken) / len(taken)
        last = recall
    assert found["a"]["auroc"] == pytest.approx(auroc)
    assert found["a"]["average_precision"] == pytest.approx(precision)
    assert found["one"]["auroc"] is None and found["one"]["average_precision"] is None


def test_bootstrap_is_partition_independent_and_flags_undefined(spark):
    draw = random.Random(4)
    rows = [(c, m, draw.randrange(100), draw.randrange(2), 2) for c in range(4) for m in ("a", "b") for _ in range(6)]
    frame = spark.createDataFrame(rows, "cluster long, model string, score long, pos long, n long").groupBy("cluster", "model", "score").agg(
        F.sum("pos").alias("pos"), F.sum("n").alias("n")
    )
    one = sorted(map(tuple, scoring.bootstrap_precision(frame, ["a", "b"], 20).collect()))
    two = sorted(map(tuple, scoring.bootstrap_precision(frame.repartition(6), ["a", "b"], 20).collect()))
    assert [r[0] for r in one] == [r[0] for r in two] and [r[1] for r in one] == pytest.approx([r[1] for r in two])
    flat = frame.withColumn("pos", F.col("n"))
    interval = scoring.bootstrap_intervals(scoring.bootstrap_precision(flat, ["a", "b"], 5), "a", ["b"]).first()
    assert (interval["n_undefined"], interval["lower_ppm"]) == (5, None)
    gates = spark.createDataFrame([(True,)], "passed boolean")
    undefined = scoring.bootstrap_intervals(scoring.bootstrap_precision(flat, ["a", "b"], 5), "a", ["b"])
    assert scoring.claim_gate(undefined, gates).first()["claim"] is False


def test_stream_publication_over_several_batches(spark, tmp_path):
    source, store = str(tmp_path / "in"), str(tmp_path / "store")
    for batch in ([(1, "p", 0), (2, "q", 1)], [(1, "p", 2), (2, "x", 3), (3, "r", 4)]):
        spark.createDataFrame(batch, "id long, pub string, at long").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("id long, pub string, at long").option("maxFilesPerTrigger", 1).parquet(source)
    publish_stream(stream, store, str(tmp_path / "cp"), "id", "pub", "at", str(tmp_path / "log")).awaitTermination()
    stored = {r["id"]: r["pub"] for r in spark.read.parquet(store).collect()}
    assert len(stored) == 3 and stored[1] == "p" and spark.read.parquet(store).count() == 3
    actions = sorted(r["action"] for r in spark.read.parquet(str(tmp_path / "log")).collect())
    assert actions == ["conflict", "noop", "publish", "publish", "publish"]


def test_lineage_cut_is_reliable(spark):
    frame = cut_lineage(spark.range(10).repartition(3))
    assert frame.count() == 10 and spark.sparkContext.getCheckpointDir() is not None


def test_deep_chains_and_long_circles(spark):
    chain = [(i, i - 1 if i else None, 0) for i in range(200)]
    nodes = spark.createDataFrame(chain, "node long, parent long, ordinal long")
    found = {r["node"]: (r["index"], r["depth"]) for r in trees.preorder(nodes).collect()}
    assert found == {i: (i, i) for i in range(200)}
    assert trees.exclude_subtrees(nodes, nodes.where("node = 0")).isEmpty()
    circle = spark.createDataFrame([(i, (i + 1) % 200) for i in range(200)], "node long, parent long")
    codes = {r["code"] for r in trees.tree_issues(circle).where("node is not null").collect()}
    assert codes == {"tree.cycle"}
    both = spark.createDataFrame([("a", None), ("b", "a"), ("b", None)], "node string, parent string")
    assert ("b", "tree.two_parents") in set(map(tuple, trees.tree_issues(both).collect()))


def test_preorder_names_each_fault_once(spark):
    rows = [(0, None, 0), (1, 0, 0), (2, 9, 0), (3, -1, 0), (4, 5, 0), (5, 4, 0)]
    stored = spark.createDataFrame(rows, "index long, parent_index long, child_ordinal long")
    found = sorted(map(tuple, trees.preorder_issues(stored).collect()))
    assert found == [(2, "tree.dangling_parent"), (3, "tree.dangling_parent"), (4, "tree.parent_order")]
