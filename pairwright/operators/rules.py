"""Named rules as boolean columns; a violated rule becomes one row of a violations table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fired(rules: Mapping[str, Column]) -> Column:
    """Array of the codes whose violation condition is true (null counts as not violated)."""
    return F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))


def violations(rows: DataFrame, keys: Sequence[str], rules: Mapping[str, Column]) -> DataFrame:
    """``(keys..., code)``: one row per violated rule. An empty result means valid."""
    return rows.select(*keys, F.explode(fired(rules)).alias("code"))


def outside(value: Column, allowed: Sequence) -> Column:
    return value.isNull() | ~value.isin(*allowed)


def out_of_range(value: Column, low, high) -> Column:
    return value.isNull() | (value < F.lit(low)) | (value > F.lit(high))


def mismatched(value: Column, pattern: str) -> Column:
    return value.isNull() | ~value.rlike(pattern)


def partly_null(columns: Sequence[Column]) -> Column:
    """All-or-none column sets: violated when some but not all are null."""
    nulls = sum((c.isNull().cast("int") for c in columns[1:]), columns[0].isNull().cast("int"))
    return (nulls > 0) & (nulls < len(columns))


def required_iff(value: Column, state: Column) -> Column:
    """Conditional nullability: the value is present exactly when the state holds."""
    return value.isNotNull() != F.coalesce(state, F.lit(False))


def not_ascending(columns: Sequence[Column]) -> Column:
    """Ordered budgets: violated when a later bound is below an earlier one."""
    broken = F.lit(False)
    for low, high in zip(columns, columns[1:]):
        broken = broken | (low > high)
    return broken


# Identifier and artifact-reference formats.
IDENTIFIER_PATTERN = r"^id[a-z]{2}1_[0-9a-f]{64}$"
DIGEST_PATTERN = r"^[0-9a-f]{64}$"
MEDIA_TYPE_PATTERN = r"^[a-z0-9!#$&^_.+-]+/[a-z0-9!#$&^_.+-]+$"
FORMAT_VERSION = 1


def reference_rules(ref: Column, maximum_bytes: int) -> dict[str, Column]:
    """Metadata validity of one artifact reference struct."""
    return {
        "artifact.sha256": mismatched(ref["sha256"], DIGEST_PATTERN),
        "artifact.media_type": mismatched(ref["media_type"], MEDIA_TYPE_PATTERN),
        "artifact.byte_length": out_of_range(ref["byte_length"], 0, maximum_bytes),
        "artifact.format_version": ~ref["format_version"].eqNullSafe(F.lit(FORMAT_VERSION)),
    }
