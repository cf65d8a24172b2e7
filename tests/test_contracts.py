"""Fault injection: break one field of a valid record, expect one code."""

from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pairwright.functions import canonical as C
from pairwright.functions import scalars as S
from pairwright.functions.jsontext import defect_code, nfc
from pairwright.operators import audit, bindings, labels, refs, scoring, sequence, splits
from pairwright.operators.rules import reference_rules, violations
from pairwright.operators.visible import visible_features
from pairwright.plans import factorial, policy
from pairwright.sources import codecs, files, publish


def codes(frame):
    return sorted(row["code"] for row in frame.collect())


def test_canonical_json_escapes_and_order(spark):
    value = "\x00\x1f \\u001F \x0b/\x7f   é\n\t\"\\\x1b"
    row = spark.createDataFrame([(value, None, 7)], "s string, gone string, n long").select(
        C.canonical_json({"z": F.col("n"), "a": F.col("s"), "m": {"y": F.col("gone"), "b": F.lit(True)}}).alias("j")
    )
    expected = '{"a":' + json.dumps(value, ensure_ascii=False) + ',"m":{"b":true,"y":null},"z":7}'
    assert row.first()["j"] == expected


def test_domain_id_separates_domains(spark):
    row = spark.range(1).select(
        C.domain_id("idaa1_", "a:v1", F.lit('{"x":1}')).alias("a"), C.domain_id("idaa1_", "b:v1", F.lit('{"x":1}')).alias("b")
    ).first()
    assert row["a"] == "idaa1_" + hashlib.sha256(b'a:v1\x00{"x":1}').hexdigest()
    assert row["a"] != row["b"]


@pytest.mark.parametrize(
    "text, code",
    [
        ('{"a":1,"b":[true,null,"x"]}', None),
        ('{"a":1,"a":2}', "json.duplicate_key"),
        ('{"a":1.5}', "json.non_integer_number"),
        ('{"a":-0}', "json.non_integer_number"),
        ('{"a":9007199254740992}', "json.non_integer_number"),
        ('{"a":NaN}', "json.literal"),
        ('{"a":1} x', "json.trailing_data"),
        ('{"a":1', "json.syntax"),
        ('{"a":"\n"}', "json.control_character"),
        ('{"b":1,"a":2}', "json.noncanonical"),
        ('{"a": 1}', "json.noncanonical"),
        ('{"a":"é"}', "json.non_nfc_string"),
        ('{"a":"\\ud800"}', "json.unpaired_surrogate"),
        ("﻿{}", "json.bom"),
        ("[" * 40 + "]" * 40, "json.depth"),
        ("[" + "0," * 100_000 + "0]", "json.byte_length"),
        ("[" + "0," * 60_000 + "0]", None),
        (None, "json.input"),
    ],
)
def test_json_defects(text, code):
    assert defect_code(text) == code


def test_json_value_count():
    assert defect_code("[" + "0," * 100_000 + "0]", maximum_bytes=1 << 20) == "json.value_count"


def test_reference_metadata_faults(spark):
    good = ("a" * 64, 5, "text/plain", 1)
    bad = {
        "artifact.sha256": ("A" * 64, 5, "text/plain", 1),
        "artifact.byte_length": ("a" * 64, 500, "text/plain", 1),
        "artifact.media_type": ("a" * 64, 5, "Text", 1),
        "artifact.format_version": ("a" * 64, 5, "text/plain", 2),
    }
    schema = "id string, r struct<sha256:string,byte_length:long,media_type:string,format_version:int>"
    rows = spark.createDataFrame([("good", good), *bad.items()], schema)
    found = {(r["id"], r["code"]) for r in violations(rows, ["id"], reference_rules(F.col("r"), 100)).collect()}
    assert found == {(code, code) for code in bad}


OUTCOME = "struct<task_success:boolean,first_unsatisfied_step_id:string,recovery_actions:int,virtual_elapsed_ms:long,final_state_oracle:string,accessibility_oracle:string,raw_trace:string>"
LABELS = "struct<sample_valid:boolean,invalid_reason:string,task_regression:boolean,severity_ordinal:int,first_failed_step_id:string,localization:string>"
PASS = (True, None, 0, 10, "f", "a", "t")
FAIL = (False, "s1", 0, 12, "f2", "a2", "t2")
REGRESSION = (True, None, True, 4, "s1", "loc")


@pytest.mark.parametrize(
    "baseline, candidate, stored, expected",
    [
        (PASS, FAIL, REGRESSION, []),
        (PASS, PASS, (True, None, False, 0, None, None), []),
        (FAIL, PASS, (False, "baseline_failed", None, None, None, None), []),
        (PASS, FAIL, (True, None, False, 4, "s1", "loc"), ["record.derived_regression"]),
        (PASS, FAIL, (True, None, True, 0, "s1", "loc"), ["record.regression_severity"]),
        (PASS, FAIL, (True, None, True, 4, "s2", "loc"), ["record.derived_failed_step"]),
        (PASS, FAIL, (True, None, True, 4, "s1", None), ["record.regression_localization"]),
        (PASS, FAIL, (True, "late", True, 4, "s1", "loc"), ["record.valid_has_reason"]),
        (PASS, PASS, (True, None, False, 2, None, None), ["record.non_regression_labels"]),
        (FAIL, PASS, (False, None, None, None, None, None), ["record.baseline_failure_reason", "record.invalid_without_reason"]),
        (FAIL, PASS, (False, "baseline_failed", True, None, None, None), ["record.invalid_has_labels"]),
        (PASS, PASS, (False, "baseline_failed", None, None, None, None), ["record.spurious_baseline_failure_reason"]),
        (PASS, (True, "s1", 0, 10, "f", "a", "t"), (True, None, False, 0, None, None),
         ["record.outcome_artifact_contradiction", "record.success_has_failed_step"]),
        (PASS, (True, None, 0, 99, "f", "a", "t"), (True, None, False, 0, None, None), ["record.outcome_artifact_contradiction"]),
    ],
)
def test_label_rules(spark, baseline, candidate, stored, expected):
    rows = spark.createDataFrame([(1, baseline, candidate, stored)], f"id int, b {OUTCOME}, c {OUTCOME}, l {LABELS}")
    assert codes(violations(rows, ["id"], labels.label_rules(F.col("b"), F.col("c"), F.col("l")))) == expected


def test_trace_faults(spark):
    def run(*statuses):
        rows = spark.createDataFrame([(1, i, s) for i, s in enumerate(statuses)], "t int, o int, s string")
        return codes(sequence.trace_issues(rows, "t", ["o"], "s"))

    assert run("satisfied", "unsatisfied", "not_reached") == []
    assert run("satisfied", "satisfied") == []
    assert run("not_reached", "satisfied") == ["trace.early_not_reached"]
    assert run("unsatisfied", "satisfied") == ["trace.post_failure_status"]
    assert run("unsatisfied", "unsatisfied") == ["trace.multiple_failures", "trace.post_failure_status"]


def test_schedule_faults(spark):
    def run(bounds, n):
        schedule = spark.createDataFrame([(1, i, b) for i, b in enumerate(bounds)], "p int, o long, a long")
        actions = spark.createDataFrame([(1, n)], "p int, n_actions long")
        return codes(sequence.schedule_issues(schedule, actions, "p", "o", "a"))

    assert run([-1, 2, 3], 4) == []
    assert run([0, 2, 3], 4) == ["schedule.initial"]
    assert run([-1, 2], 4) == ["schedule.final"]
    assert run([-1, 2, 2, 3], 4) == ["schedule.order"]
    assert run([-1, 4], 4) == ["schedule.final", "schedule.out_of_range"]


@pytest.mark.parametrize(
    "letters, closed",
    [("fxtc", True), ("fkktc", True), ("fxtktc", True), ("fktkktc", True), ("fxktc", False), ("fktxtc", False),
     ("ftc", False), ("fttc", False), ("fktc" + "c", False), ("kftc", False), ("fktkc", False), ("fktktktc", False)],
)
def test_recipe_grammar(spark, letters, closed):
    rows = spark.createDataFrame([(1, i, c) for i, c in enumerate(letters)], "w int, o long, c string")
    assert sequence.recipe_conformance(rows, ["w"], "o", "c").first()["closed"] is closed


def test_policy_vector_construction_is_clean_and_faults_are_found(spark):
    predicates = ["p", "q", "r"]
    rows = spark.createDataFrame([("d1", "q", "fail", ["r"], False), ("d2", "p", "pass", [], True)],
                                 "d string, designated string, state string, correlated array<string>, control boolean")
    vectors = rows.select(
        "d", "control", F.explode(policy.declared_vector(predicates, F.col("designated"), F.col("state"), F.col("correlated"))).alias("v")
    ).select("d", "control", "v.*")
    assert vectors.where("d = 'd1'").orderBy("ordinal").select("role").toPandas().role.tolist() == ["preserved", "designated", "correlated"]
    assert codes(policy.vector_issues(vectors, ["d"], "role", "expected_state", F.col("control"))) == []
    broken = vectors.withColumn("expected_state", F.when(F.col("role") == "preserved", "fail").otherwise(F.col("expected_state")))
    found = policy.vector_issues(broken, ["d"], "role", "expected_state", F.col("control"))
    assert codes(found) == ["policy.control", "policy.preserved", "policy.preserved"]


def test_metadata_conflicts_and_unique_bytes(spark):
    rows = spark.createDataFrame(
        [(1, "x", 10, "a"), (2, "x", 10, "a"), (3, "x", 11, "a"), (4, "y", 5, "a")], "n long, sha256 string, byte_length long, media_type string"
    ).withColumn("format_version", F.lit(1))
    assert [r["n"] for r in refs.metadata_conflicts(rows, [], "n").collect()] == [3]
    assert refs.unique_bytes(rows, [], "n").first()["unique_bytes"] == 15


def test_group_protocols():
    assert "application_group_id" not in splits.disjoint_groups("random_item")
    assert set(splits.disjoint_groups("joint_application_and_family_holdout")) >= {"application_group_id", "mutation_family_group_id"}


def test_folds_rotate_every_block_once_through_test(spark):
    schedule = splits.role_schedule(spark)
    tests = schedule.where("role = 'test'").select("block").distinct().count()
    assert (schedule.count(), tests) == (16, 4)


def test_misplaced_ordinals(spark):
    rows = spark.createDataFrame([(1, o) for o in (0, 1, 1, 3)] + [(2, o) for o in (0, 1, 2)] + [(3, 1)], "k int, o long")
    found = {(r["k"], r["o"]): r["n_misplaced"] for r in sequence.misplaced_ordinals(rows, ["k"], "o", 2).collect()}
    assert found == {(1, 1): 1, (3, 1): 1}


def test_factorial_plan_order_and_audit(spark):
    a = factorial.dimension(spark.createDataFrame([("x",), ("y",), ("x",)], "a string"), "a")
    b = factorial.dimension(spark.range(3).withColumnRenamed("id", "b"), "b")
    plan = factorial.factorial_plan(spark, {"a": a, "b": b})
    assert [tuple(r) for r in plan.orderBy("cell").collect()] == [(i, "xy"[i // 3], i % 3) for i in range(6)]
    actual = plan.where("cell <> 2").select("a", "b").unionByName(plan.where("cell = 4").select("a", "b"))
    extra = actual.unionByName(spark.createDataFrame([("z", 9)], "a string, b long"))
    assert codes(factorial.matrix_audit(plan, extra, ["a", "b"])) == ["cell.missing", "cell.repeated", "cell.unplanned"]


def test_publication_is_idempotent(spark, tmp_path):
    store = str(tmp_path / "store")
    first = spark.createDataFrame([(1, "p", 0), (2, "q", 1), (2, "q", 2), (2, "r", 3)], "id long, pub string, at long")
    def actions(frame):
        return [r["action"] for r in publish.publish(spark, frame, store, "id", "pub", "at").orderBy("at").collect()]

    assert actions(first) == ["publish", "publish", "noop", "conflict"]
    assert actions(first) == ["noop", "noop", "noop", "conflict"]
    second = spark.createDataFrame([(1, "z", 0), (3, "s", 1)], "id long, pub string, at long")
    assert actions(second) == ["conflict", "publish"]
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(store).collect()) == [(1, "p"), (2, "q"), (3, "s")]


def test_tree_digest_and_topology(spark, tmp_path):
    root = tmp_path / "releases"
    for name, entries in {"r1": ("visible", "sealed"), "r2": ("visible",), "r9": ("visible", "sealed")}.items():
        (root / name).mkdir(parents=True)
        for entry in entries:
            (root / name / entry).write_text(name + entry)
    digests = {r["path"]: r for r in files.tree_digests(spark, str(root), 8).collect()}
    assert digests["r1/sealed"]["sha256"] == hashlib.sha256(b"r1sealed").hexdigest()
    assert digests["r1/visible"]["code"] == "tree.file_bytes" and digests["r1/visible"]["sha256"] is None
    metadata = files.file_metadata(spark, str(root))
    assert files.tree_budget_issues(metadata, 5, 1000, 3, 1).count() == 0
    over = files.tree_budget_issues(metadata, 4, 20, 2, 0)
    assert {r["code"]: r["value"] for r in over.collect()} == {
        "tree.files": 5, "tree.bytes": sum(map(len, ("r1visible", "r1sealed", "r2visible", "r9visible", "r9sealed"))), "tree.directories": 3, "tree.depth": 1
    }
    committed = spark.createDataFrame([("r1",), ("r2",)], "release_id string")
    found = files.release_topology(files.file_metadata(spark, str(root)), committed, ["visible", "sealed"])
    assert sorted((r["release_id"], r["entry"], r["code"]) for r in found.collect()) == [
        ("r2", "sealed", "membership.missing"),
        ("r9", "sealed", "membership.unexpected"),
        ("r9", "visible", "membership.unexpected"),
    ]


def test_visible_projection_refuses_leaks(spark):
    rows = spark.createDataFrame([(1, "secret", 5)], "id long, label string, size long")
    assert visible_features(rows, {"f": F.col("size") * 2}, ["id", "label"]).first()["f"] == 10
    with pytest.raises(Exception):
        visible_features(rows, {"f": F.length("label")}, ["id", "label"]).count()
    with pytest.raises(ValueError):
        visible_features(rows, {"id": F.col("size")}, ["id"])
    with pytest.raises(ValueError):
        visible_features(rows, {"f": F.col("label")}, ["id"])


def test_codec_runs_once_per_digest_and_normalizes(spark):
    rows = spark.createDataFrame([(1, "é  x"), (2, "é  x"), (3, "é x")], "id long, t string")
    found = {r["id"]: r for r in codecs.canonicalize(rows, "id", "t", codecs.nfc_whitespace_codec).collect()}
    assert found[1]["canonical_sha256"] == found[3]["canonical_sha256"] == hashlib.sha256("é x".encode()).hexdigest()
    assert (found[1]["stored_is_canonical"], found[3]["stored_is_canonical"]) == (False, True)
    assert all(r["idempotent"] for r in found.values())
    assert spark.createDataFrame([(None,)], "t string").select(nfc("t").alias("t")).first()["t"] is None


def test_codec_registry_dispatch(spark):
    rows = spark.createDataFrame([(1, "a", "x  y"), (2, "b", "ab"), (3, "c", "x"), (4, "a", "x y")], "id long, m string, t string")
    registry = {"a": codecs.whitespace_codec, "b": lambda text: F.concat(text, F.lit("!"))}
    found = sorted((r["id"], r["code"]) for r in codecs.codec_issues(rows, "id", "m", "t", registry).collect())
    assert found == [(1, "codec.noncanonical"), (2, "codec.idempotence"), (2, "codec.noncanonical"), (3, "codec.unregistered")]


def test_scalar_edges(spark):
    row = spark.range(1).select(
        S.round_ties_even(F.lit(-0.5)).alias("a"), S.round_ties_even(F.lit(2.5)).alias("b"),
        S.quantize_q64(F.lit(262144.0)).alias("c"), S.quantize_q64(F.lit(262144.1)).alias("d"),
        S.contrast_milli(S.parse_rgb(F.lit("rgb(0, 0, 0)")), S.parse_rgb(F.lit("rgb(255,255,255)"))).alias("e"),
        S.parse_rgb(F.lit("rgb(256, 0, 0)")).alias("f"), S.parse_opacity(F.lit("0.125")).alias("g"),
        S.parse_z_index(F.lit("2147483648")).alias("h"), S.unsafe_path(F.lit("a/../b")).alias("i"),
        S.unsafe_path(F.lit("a/..b/c.")).alias("j"), S.path_ancestors(F.lit("a/b/c")).alias("k"),
        S.parameters_out_of_order(F.lit("a=1; b=2"), "; ").alias("l"), S.parameters_out_of_order(F.lit("a=1; a=2"), "; ").alias("m"),
    ).first()
    assert list(row) == [0, 2, 16_777_216, None, 21_000, None, 125, None, True, False, ["a", "a/b"], False, True]


def test_percentiles_are_nearest_rank(spark):
    rows = spark.createDataFrame([("a", v) for v in (1, 1, 1, 1, 5, 6, 7, 8, 9, 3000)] + [("b", 4)], "k string, v long")
    found = audit.percentile_report(rows, ["k"], "v", {"p50": 500, "p95": 950}, F.expr("v div 4"))
    values = {r["k"]: (r["n_rows"], r["max_value"], r["sum_value"], r["p50"], r["p95"]) for r in found.collect()}
    assert values == {"a": (10, 3000, 3039, 5, 3000), "b": (1, 4, 4, 4, 4)}


def test_checkpoint_alignment_codes(spark):
    rows = spark.createDataFrame(
        [(1, "b", 0, "x"), (1, "c", 0, "x"), (2, "b", 0, "x"), (2, "c", 0, "y"), (3, "b", 0, "x"), (3, "b", 1, "z"), (3, "c", 0, "x")],
        "r int, role string, o long, i string",
    )
    found = bindings.checkpoint_alignment(rows, "r", "role", "o", "i", "b", "c")
    expected = [(2, 0, "checkpoint.identity"), (3, -1, "checkpoint.count"), (3, 1, "checkpoint.identity")]
    assert sorted(map(tuple, found.collect())) == expected


def test_checkpoint_alignment_sees_a_slot_of_one_side_with_equal_counts(spark):
    rows = spark.createDataFrame(
        [(1, "b", 0, "x"), (1, "b", 0, "x"), (1, "b", 1, "y"), (1, "c", 0, "x"), (1, "c", 1, "y"), (1, "c", 2, "z")],
        "r int, role string, o long, i string",
    )
    found = bindings.checkpoint_alignment(rows, "r", "role", "o", "i", "b", "c")
    assert list(map(tuple, found.collect())) == [(1, 2, "checkpoint.identity")]


def test_first_mismatch_sees_missing_rows_and_equal_sides(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    gone = bindings.first_mismatch(["k"], left, left.where("k = 1"), ["v"], "k").collect()
    assert list(map(tuple, gone)) == [(2, "", "present", None)]
    extra = bindings.first_mismatch(["k"], left.where("k = 2"), left, ["v"], "k").collect()
    assert list(map(tuple, extra)) == [(1, "", None, "present")]
    assert bindings.first_mismatch(["k"], left, left, ["v"], "k").isEmpty()


def test_conformance_sees_a_repeated_ordinal(spark):
    expected = spark.createDataFrame([(0, "a")], "o int, v string")
    actual = spark.createDataFrame([(0, "a"), (0, "A")], "o int, v string")
    found = bindings.ordinal_conformance(["o"], expected, actual, ["v"])
    assert list(map(tuple, found.collect())) == [(0, "conformance.duplicate")]


def test_percentiles_leave_nulls_out(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", None), ("a", None), ("b", None)], "k string, v long")
    found = audit.percentile_report(rows, ["k"], "v", {"p50": 500}, F.expr("v div 8"))
    assert sorted(map(tuple, found.collect())) == [("a", 2, 2, 2, 3, 1), ("b", 0, 1, None, None, None)]


def test_bootstrap_memory_follows_the_histogram():
    """Two thousand clusters with a score of their own: 2,000 cells, where a dense table would have four million."""
    import tracemalloc

    import numpy as np

    size = 2_000
    at = np.arange(size)
    tracemalloc.start()
    found = scoring.weighed_precision(at, at * 7 % size, at % 2, np.ones(size, "i8"), size, range(2), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000
    for resample, value in found:
        weight = scoring.draws(resample, size, 5)
        ranked = sorted(range(size), key=lambda c: -(c * 7 % size))
        hits = taken = gain = 0
        for c in ranked:
            hits, taken = hits + weight[c] * (c % 2), taken + weight[c]
            gain += weight[c] * (c % 2) * hits / max(taken, 1)
        assert value == pytest.approx(gain / hits)
