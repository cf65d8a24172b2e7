"""Eligibility gates over folds, the pooled test role and each application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.splits import fold_roles

# Minimum groups, regressions and non-regressions per gate.
GATES = {
    "train": {"n_groups": 10},
    "validation": {"n_groups": 5, "n_positive": 50, "n_negative": 50},
    "test": {"n_groups": 5, "n_positive": 50, "n_negative": 50},
    "pooled_test": {"n_groups": 20, "n_positive": 200, "n_negative": 200},
    "application": {"n_positive": 8, "n_negative": 8},
}


def eligibility_gates(rows: DataFrame, application: str, block: str, positive: Column, valid: Column) -> DataFrame:
    """``(gate, scope, metric, value, minimum, passed)``, one row per gate metric.

    Rows are counted per application first; every gate is a sum over those few counts. Invalid rows
    are left out and appear only as each application's ``n_invalid``.
    """
    counts = (
        rows.groupBy(application, block)
        .agg(
            F.count_if(valid & positive).alias("n_positive"),
            F.count_if(valid & ~positive).alias("n_negative"),
        )
        .withColumn("n_groups", F.lit(1).cast("long"))
    )
    sums = [F.sum(metric).alias(metric) for metric in ("n_groups", "n_positive", "n_negative")]
    per_role = fold_roles(counts, block).groupBy(F.col("role").alias("gate"), F.col("fold_id").alias("scope")).agg(*sums)
    pooled = counts.groupBy(F.lit("pooled_test").alias("gate"), F.lit("all").alias("scope")).agg(*sums)
    each = counts.groupBy(F.lit("application").alias("gate"), F.col(application).alias("scope")).agg(*sums)
    found = per_role.unionByName(pooled).unionByName(each)
    wanted = F.array_compact(
        F.array(
            *[
                F.when(
                    F.col("gate") == gate,
                    F.struct(
                        F.lit(metric).alias("metric"),
                        F.col(metric).alias("value"),
                        F.lit(minimum).cast("long").alias("minimum"),
                    ),
                )
                for gate, minima in GATES.items()
                for metric, minimum in minima.items()
            ]
        )
    )
    return found.select("gate", "scope", F.explode(wanted).alias("w")).select(
        "gate", "scope", "w.*", (F.col("w.value") >= F.col("w.minimum")).alias("passed")
    )
