"""Injected faults: pairs of records, replayed traces and property values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pairwright.catalogue import references
from pairwright.operators import bindings, sequence, trees


def test_pair_binding(spark):
    visible = spark.createDataFrame([("a", "m", "g"), ("b", "m", None), ("c", "m", "g"), ("d", "m", "g"), ("f", "m", None)], "id string, m string, g string")
    sealed = spark.createDataFrame([("a", "m", "g", 0), ("b", "x", "g", 1), ("d", "m", "g", 0), ("e", "m", "g", 1), ("f", "m", None, None)], "id string, m2 string, g2 string, odd int")
    bound = {"pair.manifest": (F.col("m"), F.col("m2")), "pair.group": (F.col("g"), F.col("g2"))}
    ours = spark.createDataFrame([("a", "1"), ("d", "2"), ("d", "2"), ("f", None)], "id string, digest string")
    theirs = spark.createDataFrame([("a", "2"), ("d", "2"), ("f", None)], "id string, digest string")
    found = bindings.pair_binding(visible, sealed, ["id"], bound, {"pair.family": F.col("odd") == 1}, (ours, theirs, "digest"))
    assert {tuple(r) for r in found.collect()} == {
        ("b", "pair.manifest"), ("b", "pair.group"), ("b", "pair.family"), ("c", "pair.evidence_id"), ("e", "pair.evidence_id"), ("d", "pair.cas_overlap")
    }
    assert bindings.pair_binding(visible.limit(0), sealed.limit(0), ["id"], bound).isEmpty()


PLAN = [(0, "x"), (1, "y"), (2, "z")]
FAILED = [(0, "x", "satisfied"), (1, "y", "unsatisfied"), (2, "z", "not_reached")]
TRACES = {
    "success": (PLAN, [(o, a, "satisfied") for o, a in PLAN], (True, None), set()),
    "failed": (PLAN, FAILED, (False, "y"), set()),
    "derived_success": (PLAN, FAILED, (True, "y"), {(None, "derived_success"), (1, "actions"), (2, "actions")}),
    "derived_step": (PLAN, FAILED, (False, "x"), {(None, "derived_failed_step"), (0, "actions"), (1, "actions")}),
    "unknown_step": (PLAN, FAILED, (False, "w"), {(None, "derived_failed_step"), (0, "actions"), (1, "actions")}),
    "missing_step": (PLAN, FAILED[:2], (False, "y"), {(2, "actions")}),
    "other_action": (PLAN, [FAILED[0], FAILED[1], (2, "w", "not_reached")], (False, "y"), {(2, "actions")}),
    "more_steps": (PLAN, [*FAILED, (3, "w", "not_reached")], (False, "y"), {(3, "actions")}),
    "status": (PLAN, [FAILED[0], FAILED[1], (2, "z", "satisfied")], (False, "y"), {(2, "actions")}),
    "no_outcome": (PLAN, FAILED, None, {(0, "outcome"), (1, "outcome"), (2, "outcome")}),
    "no_steps": ([], [], (True, None), {(None, "outcome")}),
}


@pytest.fixture(scope="module")
def replayed(spark):
    plan = spark.createDataFrame([(t, *row) for t, (p, _, _, _) in TRACES.items() for row in p], "t string, o long, a string")
    steps = spark.createDataFrame([(t, *row) for t, (_, s, _, _) in TRACES.items() for row in s], "t string, o long, a string, status string")
    outcomes = spark.createDataFrame([(t, *o) for t, (_, _, o, _) in TRACES.items() if o], "t string, success boolean, failed string")
    found = sequence.trace_replay(plan, steps, outcomes, "t", "o", "a", "status", "success", "failed").collect()
    return {(r["t"], r["o"], r["code"]) for r in found}


@pytest.mark.parametrize("name", sorted(TRACES))
def test_trace_replay(replayed, name):
    assert {(o, code) for t, o, code in replayed if t == name} == {(o, f"trace.{code}") for o, code in TRACES[name][3]}


def test_state_values(spark):
    rows = [
        (1, "checked", "maybe", {"state_value"}), (2, "checked", "mixed", set()), (3, "expanded", "7", {"state_value"}), (4, "expanded", None, {"state_value"}),
        (5, "editable", "none", set()), (6, "invalid", "spelling", set()), (7, "invalid", "mixed", {"state_value"}), (8, None, "x", {"property_name"}),
        (9, "", "x", {"property_name"}), (10, "n" * 65, "x", {"property_name"}), (11, "level", "anything", set()), (12, "busy", "mixed", {"state_value"}),
        (13, "n" * 64, None, set()), (14, "pressed", "false", set()),
    ]
    properties = [row[:3] for row in rows] + [(15, "busy", "true"), (15, "busy", "true"), (16, "busy", "true"), (17, "busy", "1"), (17, "busy", "true")]
    frame = spark.createDataFrame(properties, "node long, name string, value string").withColumn("code", F.lit("clash"))
    found = {(r["node"], r["code"].split(".")[1]) for r in trees.state_issues(frame, ["node"], "name", "value").collect()}
    expected = {(node, code) for node, _, _, codes in rows for code in codes}
    assert found == expected | {(15, "duplicate_property"), (17, "duplicate_property"), (17, "state_value")}


def test_commit_binding_query(spark, tmp_path):
    """A null text and an unknown language break nothing; a longer payload breaks both codes, a reversed one the digest alone."""
    rows = [(1, "ab", "en"), (2, "ab", "fr"), (3, "ab", "de"), (4, "aa", "de"), (5, None, "fr"), (6, "ab", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = references.commit_binding(spark, str(tmp_path)).collect()
    assert {tuple(r) for r in found} == {(2, "commit.sha256"), (2, "commit.byte_length"), (3, "commit.sha256")}
