"""Ordered traces: sortedness, ordinals, schedules, step statuses and action recipes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.keyed import attach, blocked_window, merge_sides, null_safe_join, over_groups
from pairwright.operators.rules import violations


def not_strictly_sorted(
    rows: DataFrame, keys: Sequence[str], position: str, values: Mapping[str, str], block: Column
) -> DataFrame:
    """``(keys..., position, code)``: values that do not exceed the value one position earlier.

    ``values`` maps a violation code to the column that must rise strictly.
    """
    lagged = blocked_window(
        rows, keys, [position], block, previous={f"_previous_{column}": F.col(column) for column in values.values()}
    )
    rules = {code: F.col(f"_previous_{column}") >= F.col(column) for code, column in values.items()}
    return violations(lagged, [*keys, position], rules)


def misplaced_ordinals(rows: DataFrame, keys: Sequence[str], ordinal: str, block_width: int = 1 << 16) -> DataFrame:
    """Ordinals that are not contiguous from zero: ``(keys..., ordinal, n_misplaced)``.

    Copies of one ordinal are counted before the shuffle. The rows of an ordinal fill the positions
    ``first..first + n - 1``; the one standing at its own ordinal, if any, is in place.
    """
    counts = rows.groupBy(*keys, ordinal).agg(F.count(F.lit(1)).alias("_n"))
    block = F.floor(F.col(ordinal) / block_width)
    placed = blocked_window(counts, keys, [ordinal], block, running={"_end": F.col("_n")})
    start = F.col("_end") - F.col("_n")
    fits = (F.col(ordinal) >= start) & (F.col(ordinal) < F.col("_end"))
    return placed.select(
        *keys, ordinal, (F.col("_n") - F.when(fits, 1).otherwise(0)).cast("long").alias("n_misplaced")
    ).where("n_misplaced > 0")


def schedule_issues(
    schedule: DataFrame, actions: DataFrame, plan: str, ordinal: str, after: str, block_width: int = 1 << 16
) -> DataFrame:
    """Checkpoint schedules against the number of actions of their plan.

    ``(plan, ordinal, code)``: first boundary -1, last boundary n - 1, strictly increasing, none
    beyond the plan. ``actions`` has one row per plan with ``n_actions``.
    """
    lagged = blocked_window(
        schedule,
        [plan],
        [ordinal],
        F.floor(F.col(ordinal) / block_width),
        previous={"_previous": F.col(after)},
    )
    bounds = schedule.groupBy(plan).agg(F.min(ordinal).alias("_first"), F.max(ordinal).alias("_last"))
    side = actions.select(plan, "n_actions").join(bounds, plan)
    rows = attach(lagged, side, [plan], spread=[ordinal], hot_from=schedule)
    boundary = F.col(after)
    return violations(
        rows,
        [plan, ordinal],
        {
            "schedule.out_of_range": boundary >= F.col("n_actions"),
            "schedule.order": boundary <= F.col("_previous"),
            "schedule.initial": (F.col(ordinal) == F.col("_first")) & (boundary != -1),
            "schedule.final": (F.col(ordinal) == F.col("_last")) & (boundary != F.col("n_actions") - 1),
        },
    )


# Checkpoints of a pilot workflow, in order, with how many actions before the end of the plan they stand (None: before the first).
PILOT_CHECKPOINTS = (("initial_state", None), ("pre_primary_action", 2), ("post_primary_action", 1))


def pilot_schedule_issues(schedule: DataFrame, actions: DataFrame, plan: str, ordinal: str, key: str, after: str) -> DataFrame:
    """``(plan, n_checkpoints, code)`` of the plans whose schedule is not exactly (-1, n - 2, n - 1) under the fixed keys.

    ``actions`` has one row per plan with ``n_actions``; a plan without any checkpoint is a violation. Both tables meet in one aggregation of
    conditional values, so a schedule is never ordered or collected.
    """
    at = {k: F.when((F.col(ordinal) == k) & (F.col(key) == name), F.col(after)) for k, (name, _) in enumerate(PILOT_CHECKPOINTS)}
    nothing = F.lit(None).cast("long")
    told = schedule.select(plan, nothing.alias("_n"), F.lit(1).alias("_row"), *[value.cast("long").alias(f"_{k}") for k, value in at.items()])
    sized = actions.select(plan, F.col("n_actions").cast("long").alias("_n"), F.lit(0).alias("_row"), *[nothing.alias(f"_{k}") for k in at])
    facts = told.unionByName(sized).groupBy(plan).agg(
        F.max("_n").alias("_n"), F.sum("_row").alias("n_checkpoints"), *[F.max(f"_{k}").alias(f"_{k}") for k in at]
    )
    exact = F.col("n_checkpoints") == len(PILOT_CHECKPOINTS)
    for k, (_, left) in enumerate(PILOT_CHECKPOINTS):
        exact = exact & F.col(f"_{k}").eqNullSafe(F.lit(-1) if left is None else F.col("_n") - left)
    return facts.where(F.col("_n").isNotNull() & ~exact).select(plan, "n_checkpoints", F.lit("schedule.pilot").alias("code"))


def step_statuses(rows: DataFrame, trace: str, order: Sequence[str], failed: Column) -> DataFrame:
    """``status``: satisfied before the first failure, unsatisfied at it, not_reached after.

    The failing position is one aggregate per trace; no ordered window is needed.
    """
    at = F.struct(*order)
    traced = over_groups(rows, [trace], spread=list(order), _fail=F.min(F.when(failed, at)))
    status = (
        F.when(F.col("_fail").isNull() | (at < F.col("_fail")), "satisfied")
        .when(at == F.col("_fail"), "unsatisfied")
        .otherwise("not_reached")
    )
    return traced.withColumn("status", status).drop("_fail")


def trace_issues(rows: DataFrame, trace: str, order: Sequence[str], status: str) -> DataFrame:
    """Replay of stored statuses: ``(trace, order..., code)``."""
    at = F.struct(*order)
    value = F.col(status)
    traced = over_groups(
        rows, [trace], spread=list(order), _fail=F.min(F.when(value == "unsatisfied", at))
    )
    after = F.coalesce(at > F.col("_fail"), F.lit(False))
    before = F.col("_fail").isNull() | (at < F.col("_fail"))
    return violations(
        traced,
        [trace, *order],
        {
            "trace.multiple_failures": after & (value == "unsatisfied"),
            "trace.post_failure_status": after & (value != "not_reached"),
            "trace.early_not_reached": before & (value == "not_reached"),
        },
    )


def trace_replay(
    plan: DataFrame, steps: DataFrame, outcomes: DataFrame, trace: str, ordinal: str, action: str, status: str, success: str, failed: str
) -> DataFrame:
    """Stored traces against their action plan and recorded outcome: ``(trace, ordinal, code)``.

    ``plan`` and ``steps`` have one row per position, ``outcomes`` one per trace with ``success`` and the ``failed`` action or null. ``trace.actions``: a
    position that one side lacks, another action, or a status that does not follow from the outcome (satisfied before the failed action of the plan,
    unsatisfied at it, not_reached after; an unknown failed action stands before all). ``trace.derived_success`` and ``trace.derived_failed_step``
    (ordinal null): the outcome does not follow from the stored steps. Rows of a trace without outcome, and outcomes without steps, break
    ``trace.outcome``.
    """
    at = F.col(ordinal)
    nothing = F.lit(None).cast("string")
    wanted = plan.select(trace, ordinal, F.col(action).cast("string").alias("_action"), nothing.alias("_status"))
    stored = steps.select(trace, ordinal, F.col(action).cast("string").alias("_action"), F.col(status).alias("_status"))
    told = outcomes.select(trace, F.col(success).alias("_success"), F.col(failed).cast("string").alias("_failed"), F.lit(True).alias("_told"))
    fails = attach(wanted, told.where("_failed is not null"), [trace], spread=[ordinal]).where("_action = _failed").groupBy(trace).agg(F.min(at).alias("_at"))
    derived = stored.groupBy(trace).agg(F.min(F.when(F.col("_status") == "unsatisfied", F.struct(at.alias("o"), F.col("_action").alias("a")))).alias("_first"))
    facts = null_safe_join(null_safe_join(told, fails, [trace], "left"), derived.withColumn("_kept", F.lit(True)), [trace], "left")
    first = F.col("_first.a")
    kept = F.coalesce("_kept", F.lit(False))
    whole = violations(
        facts.withColumn(ordinal, F.lit(None).cast(dict(plan.dtypes)[ordinal])),
        [trace, ordinal],
        {
            "trace.derived_success": kept & (F.col("_success") != F.col("_first").isNull()),
            "trace.derived_failed_step": kept & ~F.col("_failed").eqNullSafe(first),
            "trace.outcome": ~kept,
        },
    )
    both = merge_sides([trace, ordinal], ["_action", "_status"], wanted, stored)
    known = attach(both, facts.select(trace, "_success", "_at", "_told"), [trace], how="left", spread=[ordinal])
    fail = F.coalesce(F.col("_at"), F.lit(-1))
    expected = F.when(F.col("_success") | (at < fail), "satisfied").when(at == fail, "unsatisfied").otherwise("not_reached")
    wrong = F.col("l").isNull() | F.col("r").isNull() | ~F.col("l._action").eqNullSafe(F.col("r._action")) | ~F.col("r._status").eqNullSafe(expected)
    rules = {"trace.actions": F.col("_told") & wrong, "trace.outcome": F.col("_told").isNull()}
    return violations(known, [trace, ordinal], rules).unionByName(whole)


def trace_outcomes(rows: DataFrame, trace: str, order: Sequence[str], status: str, step: str) -> DataFrame:
    """Derived outcome per trace: success and the first unsatisfied step."""
    first = F.min(F.when(F.col(status) == "unsatisfied", F.struct(*order, F.col(step).alias("_step"))))
    return rows.groupBy(trace).agg(first.alias("_f")).select(
        trace, F.col("_f").isNull().alias("task_success"), F.col("_f._step").alias("first_unsatisfied_step")
    )


def dense_ranks(rows: DataFrame, keys: Sequence[str], value: str, block: Column, spread: Sequence[str]) -> DataFrame:
    """Zero-based dense rank of ``value`` inside each key: ranks distinct values, then attaches."""
    distinct = rows.select(*keys, value).distinct()
    ranks = blocked_window(distinct, keys, [value], block, position="dense_rank")
    return attach(rows, ranks, [*keys, value], spread=spread)


def sibling_ordinals(rows: DataFrame, parent: str, order: str, block: Column) -> DataFrame:
    """Running zero-based ordinal of each row under its parent."""
    return blocked_window(rows, [parent], [order], block, position="ordinal")


def recipe_conformance(rows: DataFrame, workflow: Sequence[str], ordinal: str, letter: str) -> DataFrame:
    """Action recipe grammar per workflow from conditional aggregates, no sequence is collected.

    Letters: ``f`` focus, ``x`` fill, ``k`` key, ``t`` Tab, ``c`` click. A closed recipe is one focus
    first, then one control segment or two segments parted by one Tab, then Tab and one click. The
    first segment is a single fill or keys only, the second keys only; ordinals are contiguous from 0.
    """
    at, code = F.col(ordinal), F.col(letter)

    def n(mark: str) -> Column:
        return F.count_if(code == mark)

    def first(mark: str) -> Column:
        return F.min(F.when(code == mark, at))

    def last(mark: str) -> Column:
        return F.max(F.when(code == mark, at))

    facts = rows.groupBy(*workflow).agg(
        F.count(F.lit(1)).alias("n_actions"),
        n("f").alias("_nf"),
        first("f").alias("_f"),
        n("c").alias("_nc"),
        last("c").alias("_c"),
        n("t").alias("_nt"),
        first("t").alias("_t0"),
        last("t").alias("_t1"),
        n("x").alias("_nx"),
        first("x").alias("_x"),
    )
    size = F.col("n_actions")
    focus = (F.col("_nf") == 1) & (F.col("_f") == 0)
    click = (F.col("_nc") == 1) & (F.col("_c") == size - 1)
    tab = F.col("_t1") == size - 2
    end = F.when(F.col("_nt") == 1, size - 2).otherwise(F.col("_t0"))  # end of the first segment
    one_segment = (F.col("_nt") == 1) & (size >= 4)
    two_segments = (F.col("_nt") == 2) & (F.col("_t0") >= 2) & (F.col("_t1") - F.col("_t0") >= 2)
    fills = (F.col("_nx") == 0) | ((F.col("_nx") == 1) & (F.col("_x") == 1) & (end == 2))
    falsy = F.lit(False)
    checks = {
        "focus_first": focus,
        "click_last": click,
        "tab_before_click": tab,
        "segments_closed": (one_segment | two_segments) & fills,
    }
    named = {name: F.coalesce(check, falsy) for name, check in checks.items()}
    closed = F.lit(True)
    for check in named.values():
        closed = closed & check
    return facts.select(
        *workflow, "n_actions", *[check.alias(name) for name, check in named.items()], closed.alias("closed")
    )


def late_activity(rows: DataFrame, session: str, at: Sequence[str], completed: Column, spread: Sequence[str]) -> DataFrame:
    """Rows of a session after its completion, the first row for which ``completed`` holds."""
    moment = F.struct(*at)
    timed = over_groups(rows, [session], spread=spread, _done=F.min(F.when(completed, moment)))
    return timed.where(moment > F.col("_done")).drop("_done")
