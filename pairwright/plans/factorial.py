"""Factorial plans and their exact-once audits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.operators.keyed import attach, blocked_window, tally_sides
from pairwright.operators.rules import violations


def dimension(rows: DataFrame, key: str, block: Column | None = None) -> DataFrame:
    """Distinct keys with a dense zero-based ordinal in key order.

    Give a ``block`` that does not decrease with the key when there can be many distinct keys.
    """
    unique = rows.select(key).distinct()
    return blocked_window(unique, [], [key], block, position="_at")


def factorial_plan(spark: SparkSession, dimensions: Mapping[str, DataFrame]) -> DataFrame:
    """``(cell, <key>...)``: every combination once, first dimension slowest.

    Cells are a distributed range; each cell index is read as mixed-radix digits and every digit is an
    equi-join to its dimension. The index is the plan's total order, and no row is paired by a cross
    join. Only the dimension sizes come to the driver.
    """
    sizes = {key: frame.count() for key, frame in dimensions.items()}
    cells = spark.range(prod(sizes.values())).withColumnRenamed("id", "cell")
    step = prod(sizes.values())
    for key, frame in dimensions.items():
        step //= max(sizes[key], 1)
        digit = F.expr(f"(cell div {max(step, 1)}) % {max(sizes[key], 1)}")
        cells = cells.withColumn("_at", digit).join(frame.select("_at", key), "_at").drop("_at")
    return cells.select("cell", *dimensions)


def matrix_audit(plan: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Planned cells against executed cells: ``(keys..., n_actual, code)``."""
    counts = tally_sides(keys, planned=plan, actual=actual)
    return violations(
        counts,
        [*keys, "n_actual"],
        {
            "cell.missing": F.col("n_actual") == 0,
            "cell.repeated": (F.col("n_planned") > 0) & (F.col("n_actual") > 1),
            "cell.unplanned": F.col("n_planned") == 0,
        },
    )


def order_audit(plan: DataFrame, actual: DataFrame, keys: Sequence[str], position: str, block_width: int = 1 << 16) -> DataFrame:
    """``(keys..., position, code)`` of the executed cells that stand behind a cell the plan has later.

    ``position`` orders the executed cells. A running maximum of plan indexes, carried from block to block, finds every such cell, not only
    those behind their direct neighbour. Cells that are not planned are passed over; ``matrix_audit`` names them.
    """
    known = attach(actual.select(*keys, position), plan.select(*keys, "cell"), keys, spread=[position])
    block = F.floor(F.col(position) / block_width)
    seen = blocked_window(known, [], [position, "cell"], block, highest={"_before": F.col("cell")})
    return violations(seen, [*keys, position], {"cell.order": F.col("_before") > F.col("cell")})


def coverage_once(planned: DataFrame, predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every planned row must be predicted exactly once: ``(keys..., n_predictions, code)``."""
    counts = tally_sides(keys, planned=planned, predictions=predictions)
    return violations(
        counts,
        [*keys, "n_predictions"],
        {
            "coverage.missing": F.col("n_predictions") == 0,
            "coverage.repeated": (F.col("n_planned") > 0) & (F.col("n_predictions") > 1),
            "coverage.unplanned": F.col("n_planned") == 0,
        },
    )


def dependency_breaks(rows: DataFrame, determinant: Sequence[str], dependent: str) -> DataFrame:
    """Determinants bound to more than one dependent value."""
    return (
        rows.groupBy(*determinant).agg(F.count_distinct(dependent).alias("n_values")).where("n_values > 1")
    )


def matched_pairs(rows: DataFrame, pair: Sequence[str], body: Column, members: int = 2) -> DataFrame:
    """Pairs must have exactly ``members`` rows that share one common body."""
    facts = rows.groupBy(*pair).agg(
        F.count(F.lit(1)).alias("n_members"), F.min(body).alias("_low"), F.max(body).alias("_high")
    )
    return violations(
        facts,
        [*pair, "n_members"],
        {
            "pair.cardinality": F.col("n_members") != members,
            "pair.common_body": ~F.col("_low").eqNullSafe(F.col("_high")),
        },
    )


def replicate_determinism(rows: DataFrame, keys: Sequence[str], digest: str, expected: int) -> DataFrame:
    """Replicates per key, whether all of them are byte-identical, and whether all ``expected`` ones are there."""
    return rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_replicates"),
        (F.min(digest) == F.max(digest)).alias("identical"),
        (F.count(F.lit(1)) == expected).alias("complete"),
    )
