"""The model-visible projection: an allowlist of numeric features and nothing else."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.types import NumericType


def visible_features(rows: DataFrame, features: Mapping[str, Column], forbidden: Sequence[str]) -> DataFrame:
    """Select the declared features; refuse forbidden names and non-numeric results.

    Also refuses a feature whose expression reads a forbidden column, by resolving the projection
    against the table without those columns.
    """
    named = [value.alias(name) for name, value in features.items()]
    leaked = sorted(set(features) & set(forbidden))
    if leaked:
        raise ValueError(f"forbidden feature names: {leaked}")
    projection = rows.drop(*forbidden).select(*named)
    textual = [field.name for field in projection.schema if not isinstance(field.dataType, NumericType)]
    if textual:
        raise ValueError(f"features must be numeric: {textual}")
    return projection
