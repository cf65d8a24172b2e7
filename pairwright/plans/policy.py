"""Predicate policy vectors: construction from a declaration, and the causal-vector audit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.rules import violations

DESIGNATED, CORRELATED, PRESERVED = "designated", "correlated", "preserved"


def declared_vector(predicates: Sequence[str], designated: Column, state: Column, correlated: Column) -> Column:
    """Ordered array of ``(ordinal, predicate, expected_state, role)`` for one definition row."""

    def row(predicate: Column, ordinal: Column) -> Column:
        is_designated = predicate == designated
        is_correlated = F.array_contains(correlated, predicate)
        return F.struct(
            ordinal.cast("long").alias("ordinal"),
            predicate.alias("predicate"),
            F.when(is_designated, state).when(is_correlated, "fail").otherwise("pass").alias("expected_state"),
            F.when(is_designated, DESIGNATED).when(is_correlated, CORRELATED).otherwise(PRESERVED).alias("role"),
        )

    return F.transform(F.array(*[F.lit(p) for p in predicates]), row)


def vector_issues(rows: DataFrame, definition: Sequence[str], role: str, state: str, control: Column) -> DataFrame:
    """One designated row, correlated rows fail, preserved rows pass, controls have only passes.

    ``control`` is constant inside a definition.
    """
    kind, value = F.col(role), F.col(state)
    facts = rows.groupBy(*definition).agg(
        F.count_if(kind == DESIGNATED).alias("_d"),
        F.count_if((kind == PRESERVED) & (value != "pass")).alias("_p"),
        F.count_if((kind == CORRELATED) & (value != "fail")).alias("_c"),
        F.count_if(control & ((kind == CORRELATED) | (value != "pass"))).alias("_k"),
    )
    return violations(
        facts,
        definition,
        {
            "policy.designated": F.col("_d") != 1,
            "policy.preserved": F.col("_p") > 0,
            "policy.correlated": F.col("_c") > 0,
            "policy.control": F.col("_k") > 0,
        },
    )
