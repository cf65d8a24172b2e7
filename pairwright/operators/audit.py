"""Session event logs, owned-byte budgets, asset reuse and percentile reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwright.operators.keyed import attach, blocked_window


def session_counts(events: DataFrame, session: str, categories: Mapping[str, Column]) -> DataFrame:
    """Events per session and category in one aggregation."""
    return events.groupBy(session).agg(
        F.count(F.lit(1)).alias("n_events"),
        *[F.count_if(member).alias(f"n_{name}") for name, member in categories.items()],
    )


def session_taints(counts: DataFrame, cap: int, reasons: Mapping[str, Column]) -> DataFrame:
    """Recorded events under a cap, the overflow flag and the sorted taint reasons."""
    overflow = F.col("n_events") > cap
    fired = F.array(
        *[F.when(condition, F.lit(name)) for name, condition in {**reasons, "event_overflow": overflow}.items()]
    )
    return (
        counts.withColumn("n_recorded", F.least(F.col("n_events"), F.lit(cap).cast("long")))
        .withColumn("overflow", overflow)
        .withColumn("taints", F.array_join(F.array_sort(F.array_compact(fired)), ","))
    )


def count_expectations(events: DataFrame, session: str, category: str, expected: Mapping[str, int]) -> DataFrame:
    """Categories whose exact expected count per session is not met: ``(session, category, expected, actual)``."""
    counts = events.groupBy(session).agg(
        *[F.count_if(F.col(category) == name).alias(f"_{i}") for i, name in enumerate(expected)]
    )
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias(category),
                F.lit(times).cast("long").alias("expected"),
                F.col(f"_{i}").alias("actual"),
            )
            for i, (name, times) in enumerate(expected.items())
        ]
    )
    return counts.select(session, F.explode(entries).alias("e")).select(session, "e.*").where("actual <> expected")


def owned_bytes(resources: DataFrame, owner: str, size: Column, exempt: Column, maximum: int) -> DataFrame:
    """Bytes per owner without exempt resources, with the budget verdict."""
    return resources.groupBy(owner).agg(
        F.count(F.lit(1)).alias("n_resources"),
        F.coalesce(F.sum(F.when(~exempt, size)), F.lit(0)).cast("long").alias("owned_bytes"),
    ).withColumn("within_budget", F.col("owned_bytes") <= maximum)


def asset_reuse(assets: DataFrame, digest: str, owner: str, allowed: DataFrame) -> DataFrame:
    """Digests used by more than one owner, minus the exact-digest allowlist.

    Uses are counted per (digest, owner) first, so a digest copied everywhere arrives as one row per
    owner and not one per use.
    """
    per_owner = assets.groupBy(digest, owner).agg(F.count(F.lit(1)).alias("_n"))
    shared = per_owner.groupBy(digest).agg(
        F.count(F.lit(1)).alias("n_owners"), F.min(owner).alias("first_owner"), F.sum("_n").alias("n_uses")
    )
    return shared.where("n_owners > 1").join(allowed.select(digest).distinct(), digest, "left_anti")


def percentile_report(
    rows: DataFrame, keys: Sequence[str], value: str, permilles: Mapping[str, int], block: Column
) -> DataFrame:
    """Exact nearest-rank percentiles, counts, maximum and sum per key; ``permilles`` maps names to ranks.

    Null values have no rank: ``n_rows`` counts the others and ``n_null`` the nulls. Equal values are counted before the shuffle and the cumulative counts run in blocks, so no key's
    values meet in one task. ``block`` must not decrease with ``value``.
    """
    counted = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    ranked = counted.where(F.col(value).isNotNull())
    running = blocked_window(ranked, keys, [value], block, running={"_upto": F.col("_n")})
    totals = counted.groupBy(*keys).agg(
        F.sum(F.when(F.col(value).isNotNull(), F.col("_n")).otherwise(0)).alias("n_rows"),
        F.sum(F.when(F.col(value).isNull(), F.col("_n")).otherwise(0)).alias("n_null"),
        F.max(value).alias("max_value"),
        F.sum(F.col("_n") * F.col(value)).cast("long").alias("sum_value"),
    )
    # keys whose values are all null have no ranks and keep their row
    bare = totals.where("n_rows = 0").select(*keys, F.lit(None).cast(ranked.schema[value].dataType).alias(value), F.lit(0).cast("long").alias("_n"), F.lit(0).cast("long").alias("_upto"))
    joined = attach(running.select(*keys, value, "_n", "_upto").unionByName(bare), totals, keys, spread=[value], hot_from=rows)
    picked = []
    for name, permille in permilles.items():
        rank = F.ceil(F.col("n_rows") * permille / 1000)
        here = (F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank)
        picked.append(F.max(F.when(here, F.col(value))).alias(name))
    return joined.groupBy(*keys).agg(
        *[F.first(name).alias(name) for name in ("n_rows", "n_null", "max_value", "sum_value")], *picked
    )
