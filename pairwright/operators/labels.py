"""Label decisions, label consistency, oracles, preconditions and localization."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.functions.canonical import sha256_hex

# Severity of a derived regression and the reason of a failed baseline.
REGRESSION_SEVERITY = 4
BASELINE_FAILED = "baseline_failed"


def label_decision(baseline_ok: Column, candidate_ok: Column, failed_step: Column) -> dict[str, Column]:
    """Labels from the two outcomes: invalid baseline, passing candidate, or regression."""
    regressed = baseline_ok & ~candidate_ok
    return {
        "sample_valid": baseline_ok,
        "invalid_reason": F.when(~baseline_ok, BASELINE_FAILED),
        "task_regression": F.when(baseline_ok, ~candidate_ok),
        "severity_ordinal": F.when(regressed, REGRESSION_SEVERITY).when(baseline_ok, 0),
        "first_failed_step_id": F.when(regressed, failed_step),
        "requires_localization": regressed,
    }


def label_rules(baseline: Column, candidate: Column, labels: Column) -> dict[str, Column]:
    """Consistency of labels with both outcomes; structs as in the data model."""
    valid = labels["sample_valid"]
    invalid = ~valid
    reason = labels["invalid_reason"]
    base_ok, cand_ok = baseline["task_success"], candidate["task_success"]
    severity, step, place = (
        labels["severity_ordinal"],
        labels["first_failed_step_id"],
        labels["localization"],
    )
    regressed = valid & ~cand_ok
    passed = valid & cand_ok
    failed_base = reason.eqNullSafe(F.lit(BASELINE_FAILED))
    outcome_fields = ("task_success", "first_unsatisfied_step_id", "recovery_actions", "virtual_elapsed_ms")
    differ = F.lit(False)
    for field in outcome_fields:
        differ = differ | ~baseline[field].eqNullSafe(candidate[field])
    same_artifacts = (
        (baseline["final_state_oracle"] == candidate["final_state_oracle"])
        & (baseline["accessibility_oracle"] == candidate["accessibility_oracle"])
        & (baseline["raw_trace"] == candidate["raw_trace"])
    )

    def outcome(o: Column, ok: bool) -> Column:
        missing = o["first_unsatisfied_step_id"].isNull()
        return o["task_success"] & ~missing if ok else ~o["task_success"] & missing

    return {
        "record.success_has_failed_step": outcome(baseline, True) | outcome(candidate, True),
        "record.failure_missing_step": outcome(baseline, False) | outcome(candidate, False),
        "record.invalid_without_reason": invalid & reason.isNull(),
        "record.invalid_has_labels": invalid
        & (labels["task_regression"].isNotNull() | severity.isNotNull() | step.isNotNull() | place.isNotNull()),
        "record.baseline_failure_reason": invalid & ~base_ok & ~failed_base,
        "record.spurious_baseline_failure_reason": invalid & base_ok & failed_base,
        "record.valid_has_reason": valid & reason.isNotNull(),
        "record.valid_failed_baseline": valid & ~base_ok,
        "record.derived_regression": valid & ~labels["task_regression"].eqNullSafe(~cand_ok),
        "record.regression_severity": regressed & (severity.isNull() | (severity < 1)),
        "record.derived_failed_step": regressed
        & (step.isNull() | ~step.eqNullSafe(candidate["first_unsatisfied_step_id"])),
        "record.regression_localization": regressed & place.isNull(),
        "record.non_regression_labels": passed & (~severity.eqNullSafe(F.lit(0)) | step.isNotNull() | place.isNotNull()),
        "record.outcome_artifact_contradiction": differ & same_artifacts,
    }


def precondition_report(rows: DataFrame, keys: Sequence[str], checks: Mapping[str, tuple[Column, Column]]) -> DataFrame:
    """``(keys..., code, passed, observed_sha256, applicable)``: one row per check, sorted by code.

    ``checks`` maps a code to (passed, canonical text of what was observed); a row is applicable when
    all of its checks passed.
    """
    entries = F.array_sort(
        F.array(
            *[
                F.struct(
                    F.lit(code).alias("code"),
                    F.coalesce(passed, F.lit(False)).alias("passed"),
                    sha256_hex(observed).alias("observed_sha256"),
                )
                for code, (passed, observed) in checks.items()
            ]
        )
    )
    reported = rows.select(*keys, entries.alias("checks"))
    applicable = F.forall("checks", lambda check: check["passed"]).alias("applicable")
    return reported.select(*keys, applicable, F.explode("checks").alias("c")).select(*keys, "applicable", "c.*")


def terminal_oracles(
    nodes: DataFrame, keys: Sequence[str], checkpoint: str, is_target: Column, is_primary: Column, is_confirmation: Column
) -> DataFrame:
    """Oracle results from the last checkpoint of each key.

    Nodes are counted per checkpoint first (map-side), then the last checkpoint is picked among those
    few rows.
    """
    counted = nodes.groupBy(*keys, checkpoint).agg(
        F.max(F.coalesce(is_target, F.lit(False))).alias("target_present"),
        F.count_if(is_primary).alias("primary_action_count"),
        F.count_if(is_confirmation).alias("confirmation_count"),
    )
    last = counted.groupBy(*keys).agg(
        F.max(F.struct(checkpoint, "target_present", "primary_action_count", "confirmation_count")).alias("last")
    )
    rows = last.select(*keys, "last.*")
    state = F.when(F.col("target_present"), "review").otherwise("confirmed")
    return rows.select(
        *keys,
        checkpoint,
        state.alias("observed_state"),
        (~F.col("target_present")).alias("final_passed"),
        "primary_action_count",
        "confirmation_count",
        ((F.col("primary_action_count") == 0) & (F.col("confirmation_count") == 1)).alias("accessibility_passed"),
    )


def changed_region(effect_rect: Column, target_bounds: Column) -> Column:
    """The rectangle an intervention touches: its own effect rectangle, else the target's bounds."""
    return F.coalesce(effect_rect, target_bounds)


def localization_rules(localization: Column, surface: Column) -> dict[str, Column]:
    """A localization must repeat the changed surface it was derived from."""
    return {
        "localization.instance": ~localization["instance_id"].eqNullSafe(surface["instance_id"]),
        "localization.nodes": ~localization["affected_node_ids"].eqNullSafe(surface["affected_node_ids"]),
        "localization.regions": ~localization["regions"].eqNullSafe(surface["regions"]),
    }
