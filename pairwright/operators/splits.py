"""Partitions, group leakage, ownership, uniformity and outer folds."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.canonical import hash_bucket
from pairwright.operators.keyed import over_groups

# Partition names, and which grouping keys must not cross partitions per protocol.
PARTITIONS = ("train", "validation", "test")
ALWAYS_DISJOINT = (
    "source_state_group_id",
    "source_task_group_id",
    "near_duplicate_group_id",
    "asset_component_id",
)
PROTOCOL_EXTRA = {
    "random_item": (),
    "application_holdout": ("application_group_id",),
    "mutation_family_holdout": ("mutation_family_group_id",),
    "joint_application_and_family_holdout": ("application_group_id", "mutation_family_group_id"),
}


def disjoint_groups(protocol: str) -> tuple[str, ...]:
    return ALWAYS_DISJOINT + PROTOCOL_EXTRA.get(protocol, ())


def hashed_partition(key: Column, validation: int = 10, test: int = 10) -> Column:
    """Deterministic train/validation/test assignment in percent, from a hash of the key."""
    draw = hash_bucket(key, 100)
    return F.when(draw < test, "test").when(draw < test + validation, "validation").otherwise("train")


def unpivot_groups(items: DataFrame, item: str, groups: Mapping[str, Column]) -> DataFrame:
    """``(item, partition, group_key, group_value)``: all grouping keys in one pass."""
    entries = F.array(
        *[F.struct(F.lit(name).alias("group_key"), value.alias("group_value")) for name, value in groups.items()]
    )
    return items.select(item, "partition", F.explode(entries).alias("g")).select(item, "partition", "g.*")


def leaking_items(rows: DataFrame, keys: Sequence[str], item: str, order: Column | None = None) -> DataFrame:
    """Rows whose partition differs from the partition of the first item of their group.

    Owners are aggregated before the shuffle, groups inside one partition are dropped, and hot
    groups are salted when the owner is attached.
    """
    at = F.col(item) if order is None else order
    owned = over_groups(
        rows,
        keys,
        spread=[item],
        owner=F.min_by("partition", at),
    )
    return owned.where("partition <> owner")


def not_uniform(rows: DataFrame, keys: Sequence[str], value: str, item: str) -> DataFrame:
    """Rows whose value differs from the first value of their group."""
    owned = over_groups(rows, keys, spread=[item], first_value=F.min_by(value, item))
    return owned.where(~F.col(value).eqNullSafe(F.col("first_value")))


# Four blocks rotated through the roles of four outer folds.
ROLE_SCHEDULE = (
    ("outer_0", ("block_2", "block_3"), ("block_1",), ("block_0",)),
    ("outer_1", ("block_3", "block_0"), ("block_2",), ("block_1",)),
    ("outer_2", ("block_0", "block_1"), ("block_3",), ("block_2",)),
    ("outer_3", ("block_1", "block_2"), ("block_0",), ("block_3",)),
)


def role_schedule(spark: SparkSession) -> DataFrame:
    """``(fold_id, role, block)``: sixteen rows."""
    rows = [
        (fold, role, block)
        for fold, train, validation, test in ROLE_SCHEDULE
        for role, blocks in zip(PARTITIONS, (train, validation, test))
        for block in blocks
    ]
    return spark.createDataFrame(rows, "fold_id string, role string, block string")


def fold_roles(items: DataFrame, block: str = "block") -> DataFrame:
    """Each item once per fold, with its role there; the schedule is sixteen rows and broadcast."""
    schedule = role_schedule(items.sparkSession).withColumnRenamed("block", block)
    return items.join(F.broadcast(schedule), block)


def block_of(group: Column, blocks: int = 4) -> Column:
    return F.concat(F.lit("block_"), hash_bucket(group, blocks).cast("string"))


def fold_balance(items: DataFrame, block: str, relation: str) -> DataFrame:
    """Rollup of item counts over fold, role and relation.

    Items are counted per block and relation first, so only those few rows are repeated per fold.
    """
    counts = items.groupBy(block, relation).agg(F.count(F.lit(1)).alias("n"))
    return fold_roles(counts, block).rollup("fold_id", "role", relation).agg(F.sum("n").alias("n_items"))
